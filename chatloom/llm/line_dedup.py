"""Line dedup: winnowing finds runs of text that repeat, and later ones are deleted.

Two sequences of hashes are winnowed side by side: a text's lines, in runs of three
or more, and its words, in runs of 50 or more, for passages seldom begin and end where
lines do.  Of every ``run`` consecutive units the smallest hash of a ``gram``-unit
shingle is a fingerprint, so any run of that length that occurs twice has the same
fingerprint in both places.  Fingerprints are joined: positions of those that occur
once are dropped.  Around the others matches are extended both ways: every window of
``run`` units that contains the fingerprint is compared with its other occurrences.

Documents have an order: by doc_id, null last, then by a hash of the text.  A window
that an earlier document has is deleted.  One that only its own document has earlier
is deleted as well, but not the units of that window's first occurrence, where the two
overlap.  Single lines and pairs of lines stay, however often they repeat.

Hashes travel in blobs, one per chunk of documents and shard.  A shard is a range of
hash values; shards are as many as keep each below a fixed number of entries.  Within a
chunk a hash goes to its shard with its first document only, for all others are
later ones already: a window that a third of all documents hold costs its shard
an entry for each chunk, and no group of copies meets in one task.

Cases: null texts stay null and empty ones empty; documents with fewer units than a
run stay whole; rows with equal id and text count as one document and are edited alike;
ties go by the order above; very long texts are taken whole, in a block of their own;
an empty table gives no row; other columns pass through,
and ``n_units`` (words) and ``n_deleted`` are replaced if there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm import kernel
from chatloom.llm.blobs import pack, unpack
from chatloom.runtime import materialise, ship, shuffle_partitions, table

_NOT_NEWLINE = np.array([b not in (0x0A, 0x0D) for b in range(256)], dtype=bool)


@dataclass(frozen=True)
class Settings:
    unit: str
    run: int  #: a repeated run has so many units at least
    gram: int

    @property
    def window(self) -> int:
        """Shingles in a run."""
        return self.run - self.gram + 1

    def units(self, block: kernel.Block, **options) -> kernel.Words:
        return kernel.words(block, kernel.NOT_SPACE if self.unit == "word" else _NOT_NEWLINE, **options)


LINES, WORDS = Settings("line", 3, 2), Settings("word", 50, 25)
PRODUCTION = (LINES, WORDS)
#: Entries of a chunk of documents, and of a shard.
CHUNK, SHARD = 400_000, 600_000
#: Kinds of windows: an earlier document has it; its own document has it earlier; the first of such.
ELSEWHERE, OWN, FIRST = range(3)
_BLOB = "shard int, bucket int, blob binary"
_BUCKET = "bucket int, blob binary"
_MARKS = "__d long, __s long, __marks binary"
_KEY = np.dtype([("null", bool), ("id", np.int64), ("sig", np.uint32)])


def _sig() -> Column:
    """Tells rows of equal ids apart."""
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))


def _sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """``op`` over x[i : i + size], for each i for which that is inside."""
    have, out = 1, x
    while have * 2 <= size:
        out = op(out[:-have], out[have:])
        have *= 2
    if have < size:
        out = op(out[: len(out) - (size - have)], out[size - have :])
    return out


def fingerprints(w: kernel.Words, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed shingles: (hash, doc, first unit). Every run of ``s.run`` units contains one that its content determines."""
    count = np.diff(w.first)
    h, doc, at = kernel.windows(w, s.gram)
    fits = count[doc] >= s.run
    h, doc, at = h[fits], doc[fits], at[fits]
    if len(h) < s.window:
        return h[:0], doc[:0], at[:0]
    least = np.zeros(len(h), np.uint64)
    inside = doc[: len(h) - s.window + 1] == doc[s.window - 1 :]
    least[: len(inside)] = np.where(inside, _sliding(h, s.window, np.minimum), np.uint64(0))
    # selected: smallest of some window that contains it
    padded = np.concatenate([np.zeros(s.window - 1, np.uint64), least])
    picked = _sliding(padded, s.window, np.maximum) == h
    return h[picked], doc[picked], (at - w.first[:-1][doc])[picked]


def near_windows(w: kernel.Words, s: Settings, marked: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (hash, doc, first unit) that contain one of the shingles that ``marked`` lists for each text."""
    h, doc, at = kernel.windows(w, s.run)
    fits = np.diff(w.first)[doc] >= s.run
    h, doc, at = h[fits], doc[fits], at[fits]
    first = np.searchsorted(doc, np.arange(len(marked) + 1))
    near = np.zeros(len(h) + 1, np.int64)
    place = np.concatenate(marked) if marked else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(marked)), [len(m) for m in marked])
    n = (first[1:] - first[:-1])[of]
    # windows that begin at fingerprint - window + 1 to fingerprint contain it
    np.add.at(near, first[of] + np.clip(place - s.window + 1, 0, n), 1)
    np.add.at(near, first[of] + np.clip(place + 1, 0, n), -1)
    picked = np.cumsum(near[:-1]) > 0
    return h[picked], doc[picked], (at - w.first[:-1][doc])[picked]


def _per_shard(h: np.ndarray, cols: dict[str, np.ndarray], doc: np.ndarray, names: np.ndarray, shards: int) -> Iterator[tuple[int, int, bytes]]:
    """Entries, sorted by hash, by shard (a range of hashes), with the documents that they name."""
    width = (1 << 64) // shards + 1
    cuts = np.searchsorted(h, np.array([min(i * width, 2**64 - 1) for i in range(shards)], np.uint64))
    for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(h)], strict=True)):
        if b > a:
            named, place = np.unique(doc[a:b], return_inverse=True)
            n = names[named]
            yield i, -1, pack(h=h[a:b], doc=place.astype(np.uint16 if len(named) < 2**16 else np.uint32), **{k: v[a:b] for k, v in cols.items()}, ids=n["id"], null=n["null"], sig=n["sig"])


def _per_bucket(doc: np.ndarray, marks: np.ndarray, names: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Marks of documents in one blob for each bucket of documents."""
    bucket = (kernel.mix64(names["id"].view(np.uint64) ^ (names["sig"].astype(np.uint64) << kernel.U64(32))) % kernel.U64(buckets)).astype(np.int64)
    order = np.lexsort((doc, bucket[doc]))
    doc, marks = doc[order], marks[order]
    cuts = np.searchsorted(bucket[doc], np.arange(buckets + 1))
    for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if z > a:
            named, place = np.unique(doc[a:z], return_inverse=True)
            n = names[named]
            yield i, pack(doc=place.astype(np.uint32), marks=marks[a:z], ids=n["id"], null=n["null"], sig=n["sig"])


def _runs(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted hashes: first entry and number of each."""
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(h)))


def _emit(passes: tuple[Settings, ...], shards: int, around: bool):
    """Blobs of fingerprints, or (``around``) of the windows that contain one of the marked fingerprints.

    An entry's place is 2 * unit + pass.  What a chunk knows by itself goes on as marks at once.
    """

    def chunk(keys: np.ndarray, h: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        names, rank = np.unique(keys, return_inverse=True)
        doc = rank[doc]
        order = np.lexsort((at, doc, h))
        h, doc, at = h[order], doc[order], at[order]
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])  # rows that are equal
        h, doc, at = h[~same], doc[~same], at[~same]
        first, count = _runs(h)
        later = doc != np.repeat(doc[first], count)
        marks = (4 * at[later] + ELSEWHERE if around else at[later]).astype(np.uint32)
        rows = [(b % shards, b, blob) for b, blob in _per_bucket(doc[later], marks, names, shards)]
        cols = {"at": at.astype(np.uint32)} | ({} if around else {"again": np.repeat(count > 1, count)})
        rows += _per_shard(h[~later], {k: v[~later] for k, v in cols.items()}, doc[~later], names, shards)
        kinds = (pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", "bucket", "blob"])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
        """Keys of the rows of each block, and its (hash, doc, place) by pass."""
        for b in batches:
            keys = np.empty(b.num_rows, _KEY)
            keys["null"] = np.asarray(b["doc_id"].is_null())
            keys["id"], keys["sig"] = b["doc_id"].fill_null(0).to_numpy(zero_copy_only=False), b["sig"].to_numpy()
            for block in kernel.blocks(b["text"]):
                made = []
                if around:
                    marked = [np.frombuffer(m.as_py(), np.uint32).astype(np.int64) for m in b["__marks"].slice(block.first, len(block))]
                low = kernel.lowered(block.data)
                sums = low, kernel.running(low)
                for i, s in enumerate(passes):
                    w = s.units(block, sums=sums)
                    h, doc, at = near_windows(w, s, [m[m % 2 == i] // 2 for m in marked]) if around else fingerprints(w, s)
                    # passes have hashes of their own
                    made.append((kernel.mix64(h + kernel.U64(i)), doc, 2 * at + i))
                yield keys[block.first : block.first + len(block)], made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, got, base, size = [], [], 0, 0
        for k, made in entries(batches):
            got += [(h, doc + base, at) for h, doc, at in made]
            keys.append(k)
            base, size = base + len(k), size + sum(len(m[0]) for m in made)
            if size >= CHUNK:
                yield chunk(np.concatenate(keys), *(np.concatenate(x) for x in zip(*got, strict=True)))
                keys, got, base, size = [], [], 0, 0
        if size:
            yield chunk(np.concatenate(keys), *(np.concatenate(x) for x in zip(*got, strict=True)))

    return run


def _gather(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """All entries of some blobs, with their documents side by side."""
    parts, base = [], 0
    for blob in blobs:
        x = unpack(blob)
        x["doc"] = x["doc"].astype(np.int64) + base
        base += len(x["ids"])
        parts.append(x)
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    keys = np.empty(len(out["ids"]), _KEY)
    keys["null"], keys["id"], keys["sig"] = out["null"], out["ids"], out["sig"]
    names, place = np.unique(keys, return_inverse=True)
    return {k: v for k, v in out.items() if k not in ("ids", "null", "sig")} | {"doc": place[out["doc"]], "names": names}


def _by_document(t: pa.Table) -> pa.Table:
    """A bucket's blobs as one row for each document."""
    x = _gather([b.as_py() for b in t["blob"]])
    names, order = x["names"], np.argsort(x["doc"], kind="stable")
    doc, marks = x["doc"][order], x["marks"][order]
    first, _ = _runs(doc)
    name = names[doc[first]]
    ids = pa.array(name["id"], pa.int64(), mask=name["null"])
    return pa.table({"__d": ids, "__s": pa.array(name["sig"].astype(np.int64)), "__marks": pa.array([m.tobytes() for m in np.split(marks, first[1:])], pa.binary())})


def _repeated(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of a shard's fingerprints that occur more than once: (doc, mark)."""
    order = np.argsort(x["h"], kind="stable")
    first, count = _runs(x["h"][order])
    often = (count > 1) | np.logical_or.reduceat(x["again"][order].astype(bool), first)
    keep = order[np.repeat(often, count)]
    return x["doc"][keep], x["at"][keep]


def _later(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of a shard's windows that repeat: (doc, 4 * place + kind)."""
    order = np.lexsort((x["at"], x["doc"], x["h"]))
    h, doc, at = x["h"][order], x["doc"][order], x["at"][order].astype(np.int64)
    # several chunks can hold rows that are equal: such entries are one
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])])
    h, doc, at = h[~same], doc[~same], at[~same]
    first, count = _runs(h)
    begins = np.zeros(len(h), bool)
    begins[first] = True
    kind = np.where(doc != np.repeat(doc[first], count), ELSEWHERE, np.where(begins, FIRST, OWN))
    own = np.add.reduceat((kind == OWN).astype(np.int64), first) > 0
    keep = (kind != FIRST) | np.repeat(own, count)
    return doc[keep], (4 * at + kind)[keep].astype(np.uint32)


def deleted_units(start: np.ndarray, kind: np.ndarray, units: int, run: int) -> np.ndarray:
    """Which of a text's units windows of ``run`` units delete."""

    def covered(which: int) -> np.ndarray:
        cover = np.zeros(units + 1, np.int64)
        np.add.at(cover, start[kind == which], 1)
        np.add.at(cover, np.minimum(units, start[kind == which] + run), -1)
        return np.cumsum(cover[:-1]) > 0

    return covered(ELSEWHERE) | (covered(OWN) & ~covered(FIRST))


def _dead_bytes(w: kernel.Words, i: int, dead: np.ndarray, end: int) -> list[tuple[int, int]]:
    """Byte ranges of the deleted units of text i; a run goes with the space after it."""
    a, z = w.first[i], w.first[i + 1]
    first = np.flatnonzero(dead & ~np.concatenate([[False], dead[:-1]]))
    last = np.flatnonzero(dead & ~np.concatenate([dead[1:], [False]]))
    return [(int(w.start[a + f]), int(w.start[a + e + 1]) if a + e + 1 < z else end) for f, e in zip(first, last, strict=True)]


def _cut(passes: tuple[Settings, ...], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            units, gone = np.zeros(n, np.int64), np.zeros(n, np.int64)
            marks, texts = b["__marks"], b["text"]
            new: dict[int, str] = {}
            for block in kernel.blocks(texts):
                words = kernel.words(block, hashed=False)
                units[block.first : block.first + len(block)] = np.diff(words.first)
                rows = [i for i in range(len(block)) if marks[block.first + i].is_valid]
                made = [words if s.unit == "word" else s.units(block, hashed=False) for s in passes] if rows else []
                for i in rows:
                    row, end, spans = block.first + i, int(block.offsets[i + 1]), []
                    m = np.frombuffer(marks[row].as_py(), np.uint32).astype(np.int64)
                    for k, (s, w) in enumerate(zip(passes, made, strict=True)):
                        own = m[m // 4 % 2 == k]
                        if len(own):
                            spans += _dead_bytes(w, i, deleted_units(own // 8, own % 4, int(w.first[i + 1] - w.first[i]), s.run), end)
                    kept, at = [], int(block.offsets[i])
                    start = words.start[words.first[i] : words.first[i + 1]]
                    for f, e in sorted(spans):
                        if e > at:
                            gone[row] += np.searchsorted(start, e) - np.searchsorted(start, max(f, at))
                            kept.append(block.data[at : max(f, at)].tobytes())
                            at = e
                    if kept:
                        new[row] = b"".join([*kept, block.data[at:end].tobytes()]).decode("utf-8", "replace")
            if new:
                values = texts.to_pylist()
                for row, v in new.items():
                    values[row] = v
                texts = pa.array(values, b.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([*[texts if c == "text" else b[c] for c in names], pa.array(units), pa.array(gone)], [*names, "n_units", "n_deleted"])

    return run


def _as_passes(s: Settings | tuple[Settings, ...]) -> tuple[Settings, ...]:
    return (s,) if isinstance(s, Settings) else s


def dedup(docs: DataFrame, s: Settings | tuple[Settings, ...] = PRODUCTION) -> DataFrame:
    """``docs`` (doc_id, text and others) with later repeated runs cut out of the texts, and n_units and n_deleted (words)."""
    spark, passes = docs.sparkSession, _as_passes(s)
    ship(spark)
    docs = docs.drop("n_units", "n_deleted")
    names = docs.columns
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _sig().alias("sig"))

    def shards_for(entries: int) -> int:
        return max(shuffle_partitions(spark), -(-entries // SHARD))

    def marked(source: DataFrame, shards: int, around: bool, tag: str) -> DataFrame:
        reduce = _later if around else _repeated

        def by_bucket(t: pa.Table) -> pa.Table:
            bucket, blobs = t["bucket"].to_pylist(), [b.as_py() for b in t["blob"]]
            rows = [(k, b) for k, b in zip(bucket, blobs, strict=True) if k >= 0]
            if len(rows) < len(blobs):
                x = _gather([b for k, b in zip(bucket, blobs, strict=True) if k < 0])
                rows += _per_bucket(*reduce(x), x["names"], shards)
            kernel.tidy()
            return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([r[1] for r in rows], pa.binary())})

        blobs = source.mapInArrow(_emit(passes, shards, around), _BLOB)
        marks = blobs.repartition(shards, "shard").groupBy("shard").applyInArrow(by_bucket, _BUCKET)
        return materialise(marks.repartition(shards, "bucket").groupBy("bucket").applyInArrow(_by_document, _MARKS), tag)

    def joined(left: DataFrame, marks: DataFrame, how: str) -> DataFrame:
        on = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (_sig() == F.col("__s"))
        return left.join(marks.hint("merge"), on, how).drop("__d", "__s")

    # a fingerprint is one of half a window of shingles, and stands for as many windows
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = marked(keyed, shards_for(size // 80), False, "line-fingerprints")
    marks = found.agg(F.sum(F.octet_length("__marks"))).first()[0] or 0
    near = joined(keyed, found, "inner")
    later = marked(near, shards_for(marks // 4 * max(x.window + 1 for x in passes) // 2), True, "line-windows")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_units", T.LongType()), T.StructField("n_deleted", T.LongType())])
    return joined(docs, later, "left").mapInArrow(_cut(passes, names), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_deleted", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


def brute_force(docs: list[tuple[int | None, int, str | None]], s: Settings | tuple[Settings, ...] = PRODUCTION) -> dict[tuple, str | None]:
    """The text left of each (doc_id, sig), by plain comparison of all windows; for tests."""
    import re

    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    rows = {(d is None, d or 0, s): t for d, s, t in docs}
    cuts: dict[tuple, list[tuple[int, int]]] = {k: [] for k in rows}
    for p in _as_passes(s):
        units = {k: list(re.finditer(r"[^\x20\x09-\x0D]+" if p.unit == "word" else r"[^\n\r]+", low(rows[k]))) for k in sorted(rows)}
        seen: dict[tuple, tuple] = {}
        sets = {k: (set(), set(), set()) for k in rows}
        for k, w in units.items():
            for i in range(len(w) - p.run + 1):
                win = tuple(m[0] for m in w[i : i + p.run])
                if win not in seen:
                    seen[win] = (k, i)
                elif seen[win][0] != k:
                    sets[k][ELSEWHERE].update(range(i, i + p.run))
                else:
                    sets[k][OWN].update(range(i, i + p.run))
                    sets[k][FIRST].update(range(seen[win][1], seen[win][1] + p.run))
        for k, w in units.items():
            for i in sets[k][ELSEWHERE] | (sets[k][OWN] - sets[k][FIRST]):
                cuts[k].append((w[i].start(), w[i + 1].start() if i + 1 < len(w) else len(rows[k])))
    out = {}
    for k, t in rows.items():
        dead = {j for a, z in cuts[k] for j in range(a, z)}
        out[None if k[0] else k[1], k[2]] = t if t is None else "".join(c for j, c in enumerate(t) if j not in dead)
    return out
