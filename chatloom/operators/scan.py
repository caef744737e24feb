"""Scans over ordered rows, however many rows a group has: range partitions are summed up, the sums are scanned, then each partition by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.runtime import materialise, ship, shuffle_partitions


def ranged(rows: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` in partitions ``__p`` that follow one another in ``order``; written, so that a lost executor can't deal them anew."""
    n = partitions or shuffle_partitions(rows.sparkSession)
    return materialise(rows.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "ranged")


def running_before(rows: DataFrame, run: str, order: list[str], name: str, value: Column, aggregate: Callable[[Column], Column], combine: Callable[[Column, Column], Column], partitions: int | None = None) -> DataFrame:
    """``rows`` with ``name``: ``aggregate`` of ``value`` over the rows of the same ``run`` that come before in ``order``.

    ``aggregate`` must be associative, null where there is nothing, and able to aggregate its own results (min, max, sum, and the like);
    ``combine`` joins two of its results, neither of which is null. A partition holds a range of (run, order); what earlier partitions
    say of its first run is scanned from one row a partition. So a run may have all rows: no task gets more than a partition.
    """
    rows = ranged(rows.withColumn("__v", value), [run, *order], partitions)
    place = F.struct(run, *order)
    ends = rows.groupBy("__p").agg(F.min_by(F.struct(run), place).alias("first"), F.max_by(F.struct(run), place).alias("last"))
    sums = rows.groupBy("__p", F.struct(run).alias("of")).agg(aggregate(F.col("__v")).alias("sum"))
    # one row of each partition: what it says of its last run, and a row that asks for what is said before of its first
    last = ends.join(sums, (ends["__p"] == sums["__p"]) & (ends["last"].eqNullSafe(sums["of"]))).select(ends["__p"], "of", "sum", F.lit(False).alias("asks"))
    asks = ends.select("__p", F.col("first").alias("of"), F.lit(None).alias("sum"), F.lit(True).alias("asks"))
    earlier = Window.partitionBy("of").orderBy("__p", F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = asks.unionByName(last).withColumn("carried", aggregate(F.col("sum")).over(earlier)).where("asks").select("__p", F.col("of").alias("__of"), "carried")
    here = Window.partitionBy("__p", run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("__own", aggregate(F.col("__v")).over(here)).join(F.broadcast(carried), "__p")  # a row for each partition
    before = F.when(F.struct(run).eqNullSafe(F.col("__of")), F.col("carried"))
    whole = F.when(before.isNotNull() & F.col("__own").isNotNull(), combine(before, F.col("__own"))).otherwise(F.coalesce(before, F.col("__own")))
    return local.withColumn(name, whole).drop("__p", "__v", "__own", "__of", "carried")


class Fold:
    """What a range of row sizes does to a buffer that is closed when the next row would make it ``chunk`` or more.

    A buffer on entry holds 0 to ``chunk`` (``chunk`` stands for more, too). ``leaves`` and ``closed`` say, for each,
    what the buffer holds on exit and how many were closed; folds of ranges that follow one another are composed.
    Entries that close their buffer at one row behave alike from there on, so few different exits are left.
    """

    def __init__(self, leaves: np.ndarray, closed: np.ndarray):
        self.leaves, self.closed = leaves, closed

    @staticmethod
    def nothing(chunk: int) -> Fold:
        return Fold(np.arange(chunk + 1), np.zeros(chunk + 1, np.int64))

    @staticmethod
    def of(sizes: np.ndarray, chunk: int) -> Fold:
        n, sums = len(sizes), np.cumsum(sizes)
        if not n:
            return Fold.nothing(chunk)
        before, rows, held = sums - sizes, np.arange(n), np.arange(chunk + 1)
        # steps from a row that opens a buffer to the row that closes it, doubled until they end
        closer = np.maximum(np.searchsorted(sums, chunk + before), rows + 1)
        at, count = np.where(closer < n, closer, rows), (closer < n).astype(np.int64)
        while (at[at] != at).any():
            at, count = at[at], count + count[at]
        first = np.searchsorted(sums, chunk - held)
        open_ = first == n
        i = np.minimum(first, n - 1)
        leaves = np.where(open_, held + sums[-1], sums[-1] - before[at[i]])
        return Fold(np.minimum(leaves, chunk), np.where(open_, 0, 1 + count[i]))

    def then(self, later: Fold) -> Fold:
        return Fold(later.leaves[self.leaves], self.closed + later.closed[self.leaves])

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of stretches of entries, what they leave (where none is closed: what is added), and how many are closed."""
        value = np.where(self.closed == 0, self.leaves - np.arange(len(self.leaves)), self.leaves)
        new = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (self.closed[1:] != self.closed[:-1])]))
        return new, value[new], self.closed[new]

    @staticmethod
    def from_steps(starts: np.ndarray, values: np.ndarray, closed: np.ndarray, chunk: int) -> Fold:
        size = np.diff(np.append(starts, chunk + 1))
        value, done = np.repeat(values, size), np.repeat(closed, size)
        return Fold(np.where(done == 0, value + np.arange(chunk + 1), value), done)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        p = b["__p"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]])
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if z > a:
                yield int(p[a]), b.slice(a, z - a)


_NODE = "node long, starts array<int>, values array<long>, closed array<long>"


def _node(node: int, fold: Fold) -> pa.RecordBatch:
    starts, values, closed = fold.steps()
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([starts], pa.list_(pa.int32())), pa.array([values], pa.list_(pa.int64())), pa.array([closed], pa.list_(pa.int64()))], ["node", "starts", "values", "closed"])


def _fold_of(row, chunk: int) -> Fold:
    return Fold.from_steps(*(np.asarray(row[c]) for c in ("starts", "values", "closed")), chunk)


def _in_order(t: pa.Table) -> list[dict]:
    return sorted(t.to_pylist(), key=lambda r: r["node"])


def fold_ranges(rows: DataFrame, key: str, size: str, chunk: int, partitions: int | None = None, fan: int = 64) -> tuple[DataFrame, int]:
    """key, chunk_id of all rows in one greedy packing by (key, size), and how many buffers were closed.

    Each range of rows becomes a :class:`Fold`; folds are composed in a tree of ``fan`` children a node, which tells
    each range what its buffer holds on entry and how many were closed before; then ranges are packed side by side.
    The driver sees ``fan`` folds at most.
    """
    ship(rows.sparkSession)
    rows = ranged(rows.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("n")), ["k", "n"], partitions)
    dealt = rows.repartition("__p").sortWithinPartitions("__p", "k", "n")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for p, b in _stretches(batches):
            if p != now:
                if fold:
                    yield _node(now, fold)
                now, fold = p, Fold.nothing(chunk)
            fold = fold.then(Fold.of(b["n"].to_numpy(), chunk))
        if fold:
            yield _node(now, fold)

    def composed(node: tuple, t: pa.Table) -> pa.Table:
        fold = Fold.nothing(chunk)
        for r in _in_order(t):
            fold = fold.then(_fold_of(r, chunk))
        return pa.Table.from_batches([_node(node[0].as_py(), fold)])

    def told(node: tuple, t: pa.Table) -> pa.Table:
        """What the node's children meet: ``held`` and ``done`` of the node are in each of its rows."""
        out, held, done = [], None, None
        for r in _in_order(t):
            held, done = (r["held"], r["done"]) if held is None else (held, done)
            out.append((r["node"], held, done))
            fold = _fold_of(r, chunk)
            held, done = int(fold.leaves[held]), done + int(fold.closed[held])
        cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        return pa.Table.from_arrays(cols, ["node", "held", "done"])

    levels = [materialise(dealt.mapInArrow(summed, _NODE), "folds")]
    while levels[-1].count() > fan:
        up = levels[-1].withColumn("up", F.floor(F.col("node") / fan).cast("long"))
        levels.append(materialise(up.groupBy("up").applyInArrow(composed, _NODE), "folds"))
    held = done = 0
    met = []
    for r in sorted(levels[-1].collect(), key=lambda r: r.node):
        met.append((r.node, held, done))
        fold = _fold_of(r, chunk)
        held, done = int(fold.leaves[held]), done + int(fold.closed[held])
    entries = rows.sparkSession.createDataFrame(met, "node long, held long, done long")
    for level in levels[-2::-1]:
        mine = level.withColumn("up", F.floor(F.col("node") / fan).cast("long")).join(entries.withColumnRenamed("node", "up"), "up")
        entries = materialise(mine.groupBy("up").applyInArrow(told, "node long, held long, done long"), "folds")
    entries = entries.withColumnRenamed("node", "__p")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = used = at = None
        for p, b in _stretches(batches):
            if p != now:
                now, used, at = p, b["held"][0].as_py(), b["done"][0].as_py()
            sizes = b["n"].to_numpy()
            sums = np.cumsum(sizes)
            new, i = [], int(np.searchsorted(sums, chunk - used)) if used < chunk else 0
            while i < len(sums):
                new.append(i)
                i = max(i + 1, int(np.searchsorted(sums, chunk + sums[i] - sizes[i])))
            ids = at + np.searchsorted(np.array(new, np.int64), np.arange(len(sums)), side="right")
            used = int(min(chunk, sums[-1] - sums[new[-1]] + sizes[new[-1]] if new else used + sums[-1]))
            at += len(new)
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(ids)], [key, "chunk_id"])

    kind = rows.schema["k"].dataType.simpleString()
    with_entry = dealt.join(F.broadcast(entries), "__p").sortWithinPartitions("__p", "k", "n")  # entries: a row for each partition
    return with_entry.mapInArrow(packed, f"`{key}` {kind}, chunk_id long"), done
