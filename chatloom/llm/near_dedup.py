"""Near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates, exact links.

A document's set holds 64-bit hashes of its shingles.  Documents with equal sets
(by a 128-bit digest) are one class.  One permutation deals a class's hashes to
128 bins, whose minima are its signature; empty bins are filled by optimal
densification (each looks through the bins in an order of its own until one has a
value).  Bands of the signature are bucket keys: classes of similarity 0.8 share a
bucket with a probability above 1 - 1e-7.  A bucket of n classes gives n - 1
candidate edges, a star around its smallest class; connected by these edges,
classes form clusters in which every two classes of a common bucket are together.

Links are then decided inside clusters on full sets.  A cluster is cut into blocks
of bounded size, and each pair of blocks is a task, in which one class after
another is compared with all others through an inverted index, from the most
central on, until all classes left are connected already.  So no pair of a
cluster goes unexamined that could change the outcome, and each task gives a
spanning forest, never all pairs.  Components of the forests' edges are the result.

Cases: null and empty texts and texts without words have an empty set, link with
nothing and are kept; texts of fewer words than a shingle are one shingle; rows
with equal texts are one class, whatever their ids; rows without an id take part,
but an id that is null never names a component (one of only such rows has none:
the query keeps these, ``keep_one`` one of them); rows with equal ids and different texts are judged each;
very long texts are sets of all their shingles;
an empty table gives no row; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import kernel
from chatloom.llm.blobs import pack, unpack
from chatloom.llm.graph import components
from chatloom.llm.skew import salted_join
from chatloom.runtime import materialise, ship, table

BINS, BANDS = 128, 32
#: Classes, and shingles, of a block of a cluster.
BLOCK_CLASSES, BLOCK_SHINGLES = 2_000, 4_000_000
PERCENT = 80
#: Tasks over which rows of one bucket, cluster or class are dealt in a join.
SALTS = 8

_SEARCH = np.argsort(kernel.mix64(np.arange(BINS * BINS, dtype=np.uint64) + kernel.U64(12345)).reshape(BINS, BINS), axis=1)
_SHIFT = kernel.U64(64 - (BINS - 1).bit_length())


def shingle_sets(block: kernel.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts of a block, sorted; text i has ``first[i]`` to ``first[i + 1]``."""
    h, doc, _ = kernel.windows(kernel.words(block), size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(block) + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One-permutation minima with optimal densification; rows of empty sets are 0."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    at = doc * BINS + (h >> _SHIFT).astype(np.int64)
    least = np.ones(len(h), bool)  # hashes are sorted, so a bin's first is its minimum
    least[1:] = at[1:] != at[:-1]
    out, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    out[at[least]], full[at[least]] = h[least], True
    out, full = out.reshape(n, BINS), full.reshape(n, BINS)
    rows, bins = np.nonzero(~full & full.any(axis=1)[:, None])
    for turn in range(BINS):
        if not len(rows):
            break
        source = _SEARCH[bins, turn]
        hit = full[rows, source]
        out[rows[hit], bins[hit]] = out[rows[hit], source[hit]]
        rows, bins = rows[~hit], bins[~hit]
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    rows = BINS // BANDS
    key = np.broadcast_to(kernel.mix64(np.arange(BANDS, dtype=np.uint64) + kernel.U64(999)), (len(sig), BANDS))
    for j in range(rows):
        key = kernel.mix64(key ^ sig[:, j::rows])
    return key.view(np.int64)


def _digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in kernel.blocks(b["text"]):
                h, first = shingle_sets(block, size)
                count = np.diff(first)
                keys = bands(signatures(h, first))
                digests = [_digest(h[a:z]) if z > a else None for a, z in zip(first[:-1], first[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * BANDS), pa.array(np.ascontiguousarray(keys).ravel()))
                nodes = pa.array([None if d is None else _node(d) for d in digests], pa.int64())
                yield pa.RecordBatch.from_arrays([*[b[c].slice(block.first, len(block)) for c in ("doc_id", "sig")], pa.array(count.astype(np.int64)), pa.array(digests, pa.binary()), nodes, lists], ["doc_id", "sig", "n_shingles", "digest", "node", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b["node"].to_numpy()
            for block in kernel.blocks(b["text"]):
                h, first = shingle_sets(block, size)
                keep, made = [], []
                for i in range(len(block)):
                    part = h[first[i] : first[i + 1]]
                    # a row that only shares its id with the class's row is not meant
                    if len(part) and _node(_digest(part)) == nodes[block.first + i]:
                        keep.append(block.first + i)
                        made.append(pack(h=part))
                if keep:
                    rows = pa.array(keep, pa.int64())
                    yield pa.RecordBatch.from_arrays([*[b[c].take(rows) for c in ("cluster", "blocks", "node")], pa.array(made, pa.binary())], ["cluster", "blocks", "node", "shingles"])

    return run


def forest(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Edges that connect what links connect; with two sides only pairs across them must be examined."""
    n = len(nodes)
    size = np.array([len(s) for s in sets], np.int64)
    token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    doc = np.repeat(np.arange(n), size)
    shared = df[token] > 1  # others are in no intersection
    token, doc = token[shared], doc[shared]
    mine = np.searchsorted(doc, np.arange(n + 1))
    order = np.argsort(token, kind="stable")
    posted, first = doc[order], np.searchsorted(token[order], np.arange(len(df) + 1))
    weight = np.bincount(doc, weights=df[token], minlength=n)
    root = np.arange(n)
    done = np.zeros(n, bool)
    two = len(np.unique(side)) > 1
    while True:
        left = np.flatnonzero(~done)
        roots, place, count = np.unique(root[left], return_inverse=True, return_counts=True)
        if len(roots) <= 1 or (two and len(np.unique(side[left])) < 2):
            break
        rest = left[place != count.argmax()]
        i = rest[weight[rest].argmax()] if done.any() else left[weight[left].argmax()]
        t = token[mine[i] : mine[i + 1]]
        long = first[t + 1] - first[t]
        at = np.repeat(first[t] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        both = np.bincount(posted[at], minlength=n)
        near = 100 * both >= percent * (size[i] + size - both)
        near[i] = True
        merged = np.isin(root, np.unique(root[near]))
        root[merged] = root[near].min()
        done[i] = True
    return [(int(nodes[r]), int(x)) for r, x in zip(root, nodes, strict=True) if nodes[r] != x]


def _solve(t: pa.Table) -> pa.Table:
    nodes, place = np.unique(t["node"].to_numpy(), return_index=True)  # rows of one class are equal
    sets = [unpack(t["shingles"][int(i)].as_py())["h"] for i in place]
    edges = forest(nodes, t["own"].to_numpy()[place], sets)
    kernel.tidy()
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _row_key(sig: str = "sig") -> dict[str, Column]:
    """Columns without nulls that tell rows apart by id (null last) and text."""
    return {"__k0": F.col("doc_id").isNull(), "__k1": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__k2": F.col(sig)}


def link(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, sig (a hash of the text), n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    return _linked(docs, size).drop("component")


def _linked(docs: DataFrame, size: int) -> DataFrame:
    """As ``link``, with a number for each component, whether it has an id or not; null for empty sets."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("sig"))
    signed = materialise(docs.mapInArrow(_signed(size), "doc_id long, sig long, n_shingles long, digest binary, node long, bands array<long>"), "near-signed")
    # a class is found again by the id and text of its least row
    row = F.struct(*[c.alias(n) for n, c in _row_key().items()])
    classes = signed.where(F.col("n_shingles") > 0).groupBy("digest", "node", "n_shingles", "bands").agg(F.min(row).alias("row"), F.min("doc_id").alias("rep"))
    classes = materialise(classes, "near-classes")

    entries = classes.select("node", F.explode("bands").alias("key"))
    hubs = entries.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1).select("key", "hub")
    stars = salted_join(entries, hubs, ["key"], "inner", SALTS).where(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    clusters = components(stars)

    members = classes.join(clusters.hint("merge"), "node").select("node", "row", "n_shingles", F.col("label").alias("cluster"))
    members = materialise(members, "near-members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_CLASSES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    members = salted_join(members, sizes.select("cluster", blocks.alias("blocks")), ["cluster"], "inner", SALTS)
    # equal rows are one before they meet; never a broadcast, however few the members: their number grows with the input
    texts = docs.select(*[c.alias(n) for n, c in _row_key().items()], "text").groupBy(*_row_key()).agg(F.first("text").alias("text"))
    rows = texts.join(members.select("cluster", "blocks", "node", "row.*").hint("merge"), list(_row_key())).select("cluster", "blocks", "node", "text")
    sets = rows.mapInArrow(_sets(size), "cluster long, blocks int, node long, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sets = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sets = sets.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).select("cluster", "low", "high", "node", "own", "shingles")
    links = sets.groupBy("cluster", "low", "high").applyInArrow(_solve, "a long, b long")
    linked = components(links)

    named = classes.select("digest", "node", "rep").join(linked.hint("merge"), "node", "left")
    least = named.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("rep").alias("least"))
    named = salted_join(named, least, ["label"], "left", SALTS).select("digest", F.coalesce("least", "rep").alias("component_id"), F.coalesce("label", "node").alias("component"))
    named = materialise(named, "near-components")
    out = salted_join(signed.select("doc_id", "sig", "n_shingles", "digest"), named, ["digest"], "left", SALTS)
    return out.select("doc_id", "sig", "n_shingles", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def with_kept(linked: DataFrame) -> DataFrame:
    return linked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, of its smallest id (or of none, if no row has one) and then smallest text hash.

    Rows with an empty set are in no component; of those with equal id and text one stays.
    """
    names = list(_row_key())
    linked = _linked(docs, size).select("component", *[c.alias(n) for n, c in _row_key().items()])
    kept = linked.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct(*names)).alias("least")).select("least.*")
    kept = kept.unionByName(linked.where(F.col("component").isNull()).select(*names).distinct())
    # rows of equal id and text are one before they meet; columns of one's own may have the key's names
    own = {n: f"__own{n}" for n in names if n in docs.columns}
    rows = docs.withColumnsRenamed(own).withColumn("__k2", F.xxhash64("text")).withColumns({n: c for n, c in _row_key("__k2").items() if n != "__k2"}).dropDuplicates(names)
    return rows.join(kept.hint("merge"), names).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_kept(link(table(spark, sf_dir, "documents"))).drop("sig")


def brute_force(docs: list[tuple[int, str | None]], size: int = 4, percent: int = PERCENT) -> list[tuple]:
    """The query's rows by comparison of all pairs; for tests."""
    import re

    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(docs)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]
