"""Benchmark decontamination with an FM-index per training shard.

Words of a batch of documents become symbols of the benchmark's vocabulary; a word
that the benchmark lacks can't be in an occurrence, so it ends a run, and runs shorter
than the shortest phrase are left out.  A shard is a bounded number of words of such
runs; a run that is longer by itself is cut into pieces that overlap by a phrase.  Each
run ends with a terminator of its own, smaller than all words and ordered by
position.  Over this text the shard has a suffix array (prefix doubling, in which
only unresolved groups are sorted again), its Burrows-Wheeler transform in a
wavelet matrix, and sampled suffix positions.  All phrases of a block are searched
backwards at once by wavelet ranks; rows of the matching ranges are located by
walking to a sampled position; occurrences merge into spans of hit words.

Phrases are the windows of ``window`` consecutive words of an item; an item of
fewer words, but not none, is one window.

Phrases reach the executors in blocks of ``BLOCK_CHARS`` characters of benchmark
text at most (or one item, if that is longer); more blocks mean more passes.

Cases: null texts and texts without words have no words and no hits; items without
words have no phrase; items without an id mark words but aren't named; repeated
items count once and repeated rows each; very long texts are searched whole; an empty benchmark hits nothing and
an empty document table gives no row; other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm import kernel
from chatloom.runtime import materialise, ship, table

WINDOW = 10
BLOCK_CHARS = 4 << 20
#: Every so manieth position of a run is sampled, from its first on.
SAMPLE = 8
#: Words of a shard.
SHARD = 1 << 20


@dataclass
class Phrases:
    """Sorted word hashes (symbol s is ``vocab[s - 1]``), the distinct phrases as symbol rows, and the items of each."""

    vocab: np.ndarray
    rows: np.ndarray
    length: np.ndarray
    item_first: np.ndarray
    item: np.ndarray
    names: list[str | None]

    @property
    def shortest(self) -> int:
        return int(self.length.min())


def compile_phrases(items: pa.Table, window: int = WINDOW) -> Phrases | None:
    """Phrases of a table (item_id, text); None if there are none."""
    hashes, lengths, owners = [], [], []
    for block in kernel.blocks(items["text"]):
        w = kernel.words(block, kernel.ALNUM)
        count = np.diff(w.first)
        n = np.where(count >= window, count - window + 1, (count > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(count)), n)
        at = w.first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(window, count[owner])
        row = np.zeros((len(at), window), np.uint64)
        for j in range(window):  # right-aligned, as the search goes backwards
            k = size - 1 - j
            ok = k >= 0
            row[ok, window - 1 - j] = w.hash[at[ok] + k[ok]]
        hashes.append(row)
        lengths.append(size)
        owners.append(owner + block.first)
    if not hashes or not sum(map(len, hashes)):
        return None
    row, size, owner = np.concatenate(hashes), np.concatenate(lengths), np.concatenate(owners)
    filled = np.arange(window)[None] >= window - size[:, None]
    vocab = np.unique(row[filled])
    symbols = np.where(filled, np.searchsorted(vocab, row) + 1, 0).astype(np.int32)
    distinct, inverse = np.unique(symbols, axis=0, return_inverse=True)
    names = [None if v is None else str(v) for v in items["item_id"].to_pylist()]
    pairs = np.unique(np.stack([inverse.ravel(), owner], axis=1), axis=0)
    first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
    return Phrases(vocab, distinct, (distinct > 0).sum(axis=1), first, pairs[:, 1], names)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes; zeros are terminators, each smaller than all symbols and ordered by position."""
    n = len(text)
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text.astype(np.int64) + int(zero.sum()))
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    head = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    # a suffix's rank is the place of the first one in its group
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        tail = np.concatenate([head[1:], [True]])
        loose = np.flatnonzero(~(head & tail))
        if not len(loose):
            return order
        at = order[loose]
        # a loose suffix shares ``step`` words, none a terminator, with another: at + step is inside the text
        key = rank[at] * (n + 1) + rank[at + step]
        by = np.argsort(key, kind="stable")
        order[loose] = at[by]
        key = key[by]
        head[loose] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[loose]] = np.maximum.accumulate(np.where(head, np.arange(n), 0))[loose]
        step *= 2


class Bits:
    """A bit vector with counts of ones before every 64th bit."""

    def __init__(self, bit: np.ndarray):
        padded = np.zeros(len(bit) // 64 * 64 + 64, bool)
        padded[: len(bit)] = bit
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.concatenate([[0], ones[:-1]])
        self.total = int(ones[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols in a sequence, by one bit vector a level."""

    def __init__(self, seq: np.ndarray, most: int):
        self.bits = max(1, int(most).bit_length())
        self.planes, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            self.planes.append(Bits(bit))
            self.zeros.append(len(seq) - self.planes[-1].total)
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often each symbol stands before each end."""
        at, ends = np.zeros(len(symbol), np.int64), [e.astype(np.int64) for e in ends]
        for i, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)

            def step(x: np.ndarray) -> np.ndarray:
                ones = plane.rank(x)  # noqa: B023
                return np.where(one, zeros + ones, x - ones)  # noqa: B023

            at, ends = step(at), [step(e) for e in ends]
        return [e - at for e in ends]

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        out = np.zeros(len(at), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            one, ones = plane[at], plane.rank(at)
            out = 2 * out + one
            at = np.where(one, zeros + ones, at - ones)
        return out


class FMIndex:
    """Holds the transformed text as bit vectors and the sampled positions only."""

    def __init__(self, text: np.ndarray, sampled: np.ndarray, most: int):
        """``text``: symbols and zeros; ``sampled``: which positions are; the first of each run must be."""
        order = suffix_array(text)
        self.size = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        self.wavelet = WaveletMatrix(text[order - 1], most)
        self.is_sampled = Bits(sampled[order])
        self.position = order[sampled[order]]

    def find(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each right-aligned row of symbols."""
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), self.size, np.int64)
        width = rows.shape[1]
        live = np.arange(len(rows))
        for j in range(width):
            live = live[(length[live] > j) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = rows[live, width - 1 - j]
            a, b = self.wavelet.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.first[c] + a, self.first[c] + b
        return lo, np.maximum(lo, hi)

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one."""
        row, steps, out = row.copy(), np.zeros(len(row), np.int64), np.empty(len(row), np.int64)
        left = np.arange(len(row))
        while len(left):
            hit = self.is_sampled[row[left]]
            done = left[hit]
            out[done] = self.position[self.is_sampled.rank(row[done])] + steps[done]
            left = left[~hit]
            c = self.wavelet[row[left]]
            row[left] = self.first[c] + self.wavelet.rank(c, row[left])[0]
            steps[left] += 1
        return out


@dataclass
class Hits:
    """Of a shard's documents: word count, hit words, merged spans (document, first and last byte), names of items."""

    words: np.ndarray
    hit: np.ndarray
    span_doc: np.ndarray
    span_start: np.ndarray
    span_end: np.ndarray
    items: dict[int, set[str | None]]


def _pieces(first: np.ndarray, size: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``SHARD`` words at most; pieces of a longer one overlap, so that no phrase is cut."""
    step = SHARD - overlap
    n = np.maximum(1, -(-(size - overlap) // step))
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + inside * step, np.minimum(SHARD, np.repeat(size, n) - inside * step)


def _shards(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of runs with about ``SHARD`` words."""
    at, total = 0, np.concatenate([[0], np.cumsum(size)])
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(total, total[at] + SHARD, side="right")) - 1)
        yield at, end
        at = end


def _occurrences(symbol: np.ndarray, run_first: np.ndarray, size: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(word, phrase) of every occurrence in some runs of words, by an index of their own."""
    place = np.cumsum(size + 1) - (size + 1)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    origin = np.repeat(run_first, size) + inside
    at = np.repeat(place, size) + inside
    text = np.zeros(int(size.sum()) + len(size), np.int32)
    text[at] = symbol[origin]
    word_at = np.full(len(text), -1, np.int64)
    word_at[at] = origin
    sampled = np.zeros(len(text), bool)
    sampled[at[inside % SAMPLE == 0]] = True
    index = FMIndex(text, sampled, len(phrases.vocab))
    lo, hi = index.find(phrases.rows, phrases.length)
    times = hi - lo
    found = np.flatnonzero(times)
    phrase = np.repeat(found, times[found])
    row = np.repeat(lo[found], times[found]) + np.arange(len(phrase)) - np.repeat(np.cumsum(times[found]) - times[found], times[found])
    return word_at[index.locate(row)], phrase


def search_shard(texts: pa.ChunkedArray | pa.Array, phrases: Phrases | None) -> Hits:
    starts, ends, symbols, counts = [], [], [], []
    for block in kernel.blocks(texts):
        w = kernel.words(block, kernel.ALNUM)
        counts.append(np.diff(w.first))
        if phrases is None:
            continue
        at = np.searchsorted(phrases.vocab, w.hash)
        known = phrases.vocab[np.minimum(at, len(phrases.vocab) - 1)] == w.hash
        symbols.append(np.where(known, at + 1, 0).astype(np.int32))
        base = block.offsets[w.doc]
        starts.append((w.start - base).astype(np.int64))
        ends.append((w.end - base).astype(np.int64))
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    none = np.zeros(0, np.int64)
    hits = Hits(count, np.zeros(len(count), np.int64), none, none, none, {})
    if phrases is None or not count.sum():
        return hits
    symbol, start, end = np.concatenate(symbols), np.concatenate(starts), np.concatenate(ends)
    doc = np.repeat(np.arange(len(count)), count)
    # runs of the benchmark's words inside a document, long enough for a phrase
    known = symbol > 0
    same = np.concatenate([[False], doc[1:] == doc[:-1]])
    begins = known & ~(np.concatenate([[False], known[:-1]]) & same)
    run_first = np.flatnonzero(begins)
    stops = known & ~(np.concatenate([known[1:], [False]]) & np.concatenate([same[1:], [False]]))
    run_end = np.flatnonzero(stops) + 1
    long = run_end - run_first >= phrases.shortest
    run_first, size = _pieces(run_first[long], (run_end - run_first)[long], phrases.rows.shape[1] - 1)
    found = [_occurrences(symbol, run_first[a:z], size[a:z], phrases) for a, z in _shards(size)]
    word, phrase = (np.concatenate([f[i] for f in found] or [none]) for i in range(2))
    if not len(word):
        return hits
    cover = np.zeros(len(symbol) + 1, np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + phrases.length[phrase], -1)
    hit = np.cumsum(cover[:-1]) > 0
    hits.hit = np.bincount(doc[hit], minlength=len(count))
    joined = hit[1:] & hit[:-1] & same[1:]
    first = np.flatnonzero(hit & ~np.concatenate([[False], joined]))
    last = np.flatnonzero(hit & ~np.concatenate([joined, [False]]))
    hits.span_doc, hits.span_start, hits.span_end = doc[first], start[first], end[last]
    both = np.unique(doc[word] * np.int64(len(phrases.rows)) + phrase)
    for d, p in zip(both // len(phrases.rows), both % len(phrases.rows), strict=True):
        hits.items.setdefault(int(d), set()).update(phrases.names[i] for i in phrases.item[phrases.item_first[p] : phrases.item_first[p + 1]])
    return hits


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", _SPAN), T.StructField("items", T.ArrayType(T.StringType()))]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order without overlaps; neighbours between which no word stands stay as they are."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _hit_words(text: str, spans: list[tuple[int, int]]) -> int:
    raw = pa.array([text])
    w = kernel.words(next(kernel.blocks(raw)), kernel.ALNUM)
    at = np.searchsorted([s for s, _ in spans], w.start, side="right") - 1
    return int(((at >= 0) & (w.start < np.array([e for _, e in spans])[np.maximum(at, 0)])).sum())


def _pass(shared, names: list[str], again: bool, cut: dict[str, str] | None = None):
    """One block of phrases against all documents; ``again``: add to what earlier blocks have found.

    With ``cut`` the spans are cut out of the texts, and only the columns ``names`` leave, under what it names them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for b in batches:
            texts = b["text"]
            hits = search_shard(texts, phrases)
            n = len(texts)
            spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            for d, s, e in zip(hits.span_doc.tolist(), hits.span_start.tolist(), hits.span_end.tolist(), strict=True):
                spans[d].append((s, e))
            items = [sorted(x for x in hits.items.get(i, ()) if x is not None) for i in range(n)]
            hit = hits.hit.tolist()
            if again:
                for i, (old, named) in enumerate(zip(b["spans"].to_pylist(), b["items"].to_pylist(), strict=True)):
                    if old:
                        spans[i] = _merged(spans[i] + [(x["start"], x["end"]) for x in old])
                        hit[i] = _hit_words(texts[i].as_py(), spans[i])
                    items[i] = sorted({*items[i], *named})
            if cut is not None:
                texts = _without(texts, spans)
                yield pa.RecordBatch.from_arrays([texts if c == "text" else b[c] for c in names], [cut.get(c, c) for c in names])
                continue
            cols = [b[c] for c in names]
            cols += [pa.array(hits.words.astype(np.int64)), pa.array(hit, pa.int64())]
            cols.append(pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            cols.append(pa.array(items, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(cols, [*names, *(f.name for f in FOUND)])

    return run


def _without(texts: pa.Array, spans: list[list[tuple[int, int]]]) -> pa.Array:
    """Texts without their byte spans."""
    if not any(spans):
        return texts
    values = texts.to_pylist()
    for i, found in enumerate(spans):
        if found:
            raw, at, kept = values[i].encode(), 0, []
            for s, e in found:
                kept.append(raw[at:s])
                at = e
            values[i] = b"".join([*kept, raw[at:]]).decode()
    return pa.array(values, texts.type)


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Iterator[Phrases]:
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()  # equal rows have one hash: a block would hold them all
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for i in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        if (made := compile_phrases(part.toArrow(), window)) is not None:
            yield made


def _searched(docs: DataFrame, benchmark: DataFrame, cut: dict[str, str] | None, window: int, block_chars: int) -> DataFrame:
    """``docs`` with what the blocks of phrases find, one after another; with ``cut`` the last one's pass cuts it out."""
    spark, names = docs.sparkSession, docs.columns
    ship(spark)
    schema = T.StructType([*docs.schema.fields, *FOUND])
    last = schema if cut is None else T.StructType([T.StructField(cut.get(f.name, f.name), f.dataType, f.nullable) for f in docs.schema.fields])
    blocks, again = phrase_blocks(benchmark, window, block_chars), False
    phrases, following = next(blocks, None), next(blocks, None)
    while following is not None:
        docs = materialise(docs.mapInArrow(_pass(spark.sparkContext.broadcast(phrases), names, again), schema), "decon-pass")
        phrases, following, again = following, next(blocks, None), True
    return docs.mapInArrow(_pass(spark.sparkContext.broadcast(phrases), names, again, cut), last)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit, spans (bytes of the text, merged) and items; columns of these names are replaced."""
    return _searched(docs.drop(*(f.name for f in FOUND)), benchmark, None, window, block_chars)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with every hit span cut out of its text; other columns and untouched rows stay as they are."""
    clashing = {f.name: f"__own_{f.name}" for f in FOUND if f.name in docs.columns}
    return _searched(docs.withColumnsRenamed(clashing), benchmark, {v: k for k, v in clashing.items()}, window, block_chars)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The query's rows by plain search, for tests."""
    import re

    def split(t: str | None) -> list[str]:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    phrases: dict[tuple, set] = {}
    for name, t in items:
        w = split(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[i : i + window]), set()).add(name)
    out = []
    for doc_id, t in docs:
        w, hit, names = split(t), set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                if (p := tuple(w[i : i + size])) in phrases:
                    hit.update(range(i, i + size))
                    names |= phrases[p]
        listed = sorted(str(x) for x in names if x is not None)
        out.append((doc_id, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return out
