"""Exact top-k inner product search with a pivot-distance index.

Vectors become integers, floor(256 * x).  One more coordinate, sqrt(M^2 - |x|^2)
with M the largest norm, turns the largest inner product into the smallest
Euclidean distance, which obeys the triangle inequality.  The index keys each
vector by its nearest pivot and its distance to that pivot; range partitioning on
this key gives parts of sorted annuli.  Each query first goes to the one part whose
bound is best, which gives its k-th best score there.  Then it goes to every part
whose lower bound |d(q, p) - d(x, p)| can still beat that score; inside a part annuli
are expanded from the best bound on, until no query of the batch can gain.  Bounds are
loosened by a relative 1e-9 against rounding, and scores are exact integers.

The index is read twice, however many queries there are: a task holds one part of
``PART`` vectors and lets the queries that were sent to it pass by in batches.  Parts
are repeated for every ``QUERIES`` queries, so that no task has more of them.

Only pivots come from a bounded sample (``sample`` vectors of smallest hash); every
vector is indexed, and recall is 1 by construction.  What is broadcast is the pivots and
the ranges of the parts, a few numbers for each ``PART`` vectors.

Cases: vectors that are null, hold null or non-finite components, and rows without
an id take no part; shorter vectors count as padded with zeros; rows with equal ids
are candidates each, but never of a query of their id; query rows with equal ids and
different vectors are a query each, equal query rows are one; ties go to the
smaller id; an empty table gives no row; scores beyond 64 bits are held at their ends;
extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.runtime import materialise, ship, table

SCALE = 256.0
PIVOTS = 64
SAMPLE = 4096
#: Vectors of a part, and queries that one copy of it serves.
PART, QUERIES = 32_768, 100_000
#: Queries of a batch; vectors of an annulus that are bounded and multiplied together.
BLOCK, ANNULUS = 512, 256
_BIG = 2**53


def integers(vec: Column) -> Column:
    """floor(256 * x) of an array of numbers, null if it is null or holds a null or non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vec.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vec, lambda x: F.floor(x.cast("double") * SCALE).cast("double")))


def matrix(values: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, col] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows as int64, held at the ends of 64 bits."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < _BIG:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in a], dtype=object) @ np.array([[int(v) for v in r] for r in b], dtype=object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def lifted(vecs: np.ndarray, top2: float) -> np.ndarray:
    norm2 = np.einsum("ij,ij->i", vecs, vecs)
    return np.hstack([vecs, np.sqrt(np.maximum(0.0, top2 - norm2))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, d2))


@dataclass
class Space:
    """What bounds are made of: pivots in the lifted space, the largest squared norm, and parts' (part, pivot, least, largest distance)."""

    dims: int
    top2: float
    pivots: np.ndarray
    part: np.ndarray = None
    pivot: np.ndarray = None
    low: np.ndarray = None
    high: np.ndarray = None

    def bounds(self, vecs: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Scores that each query can't exceed in each annulus."""
        norm2 = np.einsum("ij,ij->i", vecs, vecs)[:, None]
        d = distances(np.hstack([vecs, np.zeros((len(vecs), 1))]), self.pivots)[:, pivot]
        gap = np.maximum(0.0, np.maximum(low - d, d - high))
        # score = (top2 + |q|^2 - distance^2) / 2; rounding is given room
        return (self.top2 + norm2 - gap**2) / 2 + 1e-9 * (self.top2 + norm2 + 1.0)


class Part:
    """Vectors sorted by pivot and distance, as annuli of ``ANNULUS`` vectors at most."""

    def __init__(self, pivot: np.ndarray, dist: np.ndarray, ids: np.ndarray, vecs: np.ndarray):
        cells = np.concatenate([[0], np.flatnonzero(np.diff(pivot)) + 1, [len(pivot)]])
        cuts = [(a, min(int(z), a + ANNULUS)) for s, z in zip(cells[:-1], cells[1:], strict=True) for a in range(int(s), int(z), ANNULUS)] if len(pivot) else []
        self.begin, self.end = (np.array([c[i] for c in cuts], np.int64) for i in range(2))
        self.pivot, self.low, self.high = pivot[self.begin], dist[self.begin], dist[self.end - 1]
        self.ids, self.vecs = ids, vecs

    def search(self, space: Space, ids: np.ndarray, vecs: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(id, score) of each query's k best vectors of at least its floor."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        floor = floor.copy()
        bound = space.bounds(vecs, self.pivot, self.low, self.high)
        for i in np.argsort(-bound.max(axis=0, initial=-np.inf), kind="stable"):
            near = np.flatnonzero(bound[:, i] >= floor)
            if not len(near):
                if bound[:, i].max() < floor.min():
                    break
                continue
            a, b = self.begin[i], self.end[i]
            got = products(vecs[near], self.vecs[a:b])
            reach = got.max(axis=1) >= floor[near]
            for q, row in zip(near[reach], got[reach], strict=True):
                keep = np.flatnonzero((row >= floor[q]) & (self.ids[a:b] != ids[q]))
                if not len(keep):
                    continue
                v, s = np.concatenate([found[q][0], self.ids[a:b][keep]]), np.concatenate([found[q][1], row[keep]])
                best = np.lexsort((v, -s))[:k]
                found[q] = v[best], s[best]
                if len(best) == k:
                    floor[q] = max(floor[q], s[best][-1])
        return found


_SENT = "cell long, kind int, id long, sig long, floor long, vec array<double>, pivot int, dist double"
_FOUND = "query_id long, sig long, vec_id long, score long"


def _route(shared, everywhere: bool, salts: int):
    """Queries to the part of the best bound, or to all that can reach their floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space: Space = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK):
                b = whole.slice(lo, BLOCK)
                bound = space.bounds(matrix(b["vec"], space.dims), space.pivot, space.low, space.high)
                if everywhere:
                    row, at = np.nonzero(bound >= b["floor"].to_numpy()[:, None])
                    pairs = np.unique(np.stack([row, space.part[at]], axis=1), axis=0)
                else:
                    pairs = np.stack([np.arange(len(bound)), space.part[bound.argmax(axis=1)]], axis=1)
                salt = (b["sig"].to_numpy().view(np.uint64) % np.uint64(salts)).astype(np.int64)
                sent = b.take(pa.array(pairs[:, 0]))
                n = len(pairs)
                cols = [pa.array(pairs[:, 1] * salts + salt[pairs[:, 0]]), pa.array(np.ones(n, np.int32)), *(sent[c] for c in ("id", "sig", "floor", "vec")), pa.nulls(n, pa.int32()), pa.nulls(n, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, ["cell", "kind", "id", "sig", "floor", "vec", "pivot", "dist"])

    return run


def _searcher(shared, k: int):
    """Rows by cell, a part's vectors before its queries: the part is held, queries pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space: Space = shared.value
        now, held, part = None, [], None
        for b in batches:
            cell, kind = b["cell"].to_numpy(), b["kind"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1, [len(cell)]])
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z == a:
                    continue
                if cell[a] != now:
                    now, held, part = cell[a], [], None
                if kind[a] == 0:
                    x = b.slice(a, z - a)
                    held.append((x["pivot"].to_numpy(), x["dist"].to_numpy(), x["id"].to_numpy(), matrix(x["vec"], space.dims)))
                    continue
                if part is None:
                    part = Part(*(np.concatenate(v) for v in zip(*held, strict=True)))
                    held = []
                for lo in range(a, z, BLOCK):
                    q = b.slice(lo, min(BLOCK, z - lo))
                    ids, sig = q["id"].to_numpy(), q["sig"].to_numpy()
                    found = part.search(space, ids, matrix(q["vec"], space.dims), q["floor"].to_numpy(), k)
                    n = [len(v) for v, _ in found]
                    cols = [np.repeat(ids, n), np.repeat(sig, n), *(np.concatenate([f[i] for f in found]) for i in range(2))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "sig", "vec_id", "score"])

    return run


def _pivots(vectors: DataFrame, dims: int, top2: float, count: int, sample: int) -> np.ndarray:
    """Spread vectors of a bounded sample: each next one is the farthest from those taken."""
    rows = vectors.select("vec", F.xxhash64("vec_id", "vec").alias("h")).orderBy("h").limit(sample).collect()
    x = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        x[i, : len(r.vec)] = r.vec
    x = lifted(x, top2)
    taken, far = [0], np.full(len(x), np.inf)
    while len(taken) < min(count, len(x)):
        far = np.minimum(far, distances(x, x[taken[-1:]])[:, 0])
        if far.max() <= 0:
            break
        taken.append(int(far.argmax()))
    return x[taken]


def index(vectors: DataFrame, space: Space, parts: int) -> DataFrame:
    """part, id, vec, pivot, dist of every vector; a part is a range of (pivot, distance)."""
    shared = vectors.sparkSession.sparkContext.broadcast(space)  # PIVOTS rows at most

    def key(batches):
        for b in batches:
            d = distances(lifted(matrix(b["vec"], shared.value.dims), shared.value.top2), shared.value.pivots)
            nearest = d.argmin(axis=1) if len(d) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["vec"], pa.array(nearest.astype(np.int32)), pa.array(d[np.arange(len(d)), nearest])], ["id", "vec", "pivot", "dist"])

    keyed = vectors.select("vec_id", "vec").mapInArrow(key, "id long, vec array<double>, pivot int, dist double")
    return materialise(keyed.repartitionByRange(parts, "pivot", "dist", "id").withColumn("part", F.spark_partition_id().cast("long")), "topk-index")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, sample: int = SAMPLE, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: for the rows of ``vectors`` (vec_id, embedding) under ``is_query`` the k best others."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("vec"))
    rows = materialise(rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()), "topk-vectors")
    norm2 = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    dims, top2, n, asked = rows.agg(F.max(F.size("vec")), F.max(norm2), F.count("*"), F.count_if(is_query)).first()
    if not n or not asked:
        return _ranked(spark.createDataFrame([], _FOUND), k)
    dims, top2 = max(1, dims), float(top2)
    space = Space(dims, top2, _pivots(rows, dims, top2, pivots, sample))
    indexed = index(rows, space, -(-n // part))
    ranges = indexed.groupBy("part", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high")).orderBy("part", "pivot").toArrow()
    space.part, space.pivot, space.low, space.high = (ranges[c].to_numpy() for c in ("part", "pivot", "low", "high"))
    shared = spark.sparkContext.broadcast(space)

    salts = -(-asked // QUERIES)
    salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    held = indexed.withColumn("salt", salt).select((F.col("part") * salts + F.col("salt")).alias("cell"), F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("sig"), F.lit(0).cast("long").alias("floor"), "vec", "pivot", "dist")
    queries = rows.where(is_query).select(F.col("vec_id").alias("id"), F.xxhash64("vec").alias("sig"), "vec").groupBy("id", "sig").agg(F.min("vec").alias("vec"))

    def searched(asking: DataFrame, everywhere: bool) -> DataFrame:
        sent = asking.select("id", "sig", "floor", "vec").mapInArrow(_route(shared, everywhere, salts), _SENT)
        both = held.unionByName(sent).repartition("cell").sortWithinPartitions("cell", "kind", "pivot", "dist", "id", "sig")
        return both.mapInArrow(_searcher(shared, k), _FOUND)

    lowest = F.lit(-(2**63)).cast("long")
    first = searched(queries.withColumn("floor", lowest), False)
    kth = first.groupBy(F.col("query_id").alias("id"), "sig").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).drop("n")
    floored = queries.join(kth.hint("merge"), ["id", "sig"], "left").withColumn("floor", F.coalesce("floor", lowest))
    return _ranked(searched(materialise(floored, "topk-queries"), True), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "sig").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT DISTINCT vec_id, vec FROM v WHERE vec_id % 50 = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.vec AS vec, v.vec_id AS vec_id, CAST(list_dot_product(q.vec, v.vec) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, vec ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
