"""Packing and running aggregates are the same at any number of partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.operators import scan, training


def _plain(sizes, chunk):
    out, used, at = [], 0, 0
    for n in sizes:
        if used + n >= chunk:
            at, used = at + 1, 0
        out.append(at)
        used += n
    return out, at


@pytest.mark.parametrize("seed", range(6))
def test_folds_compose(seed):
    rnd, chunk = random.Random(seed), 20
    sizes = [rnd.choice([0, 1, 3, 5, 8, 19, 20, 45]) for _ in range(rnd.randint(1, 60))]
    cuts = sorted(rnd.choices(range(len(sizes) + 1), k=4))
    whole = scan.Fold.nothing(chunk)
    for a, z in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        part = scan.Fold.of(np.array(sizes[a:z], np.int64), chunk)
        again = scan.Fold.from_steps(*part.steps(), chunk)
        assert (again.leaves == part.leaves).all() and (again.closed == part.closed).all()
        whole = whole.then(again)
    for held in range(chunk + 1):
        used, closed = held, 0
        for n in sizes:
            if used + n >= chunk:
                closed, used = closed + 1, 0
            used += n
        assert (whole.leaves[held], whole.closed[held]) == (min(chunk, used), closed)


def test_summaries_stay_short():
    fold = scan.Fold.of(np.array([random.Random(1).randint(1, 900) for _ in range(5000)], np.int64), 4096)
    assert len(fold.steps()[0]) < 40


@pytest.mark.parametrize("partitions,fan", [(1, 64), (4, 64), (13, 2), (13, 3)])
def test_packing_is_that_of_one_stream(spark, partitions, fan):
    rnd = random.Random(partitions)
    sizes = [rnd.choice([0, 1, 2, 7, 30, 99, 100, 250]) for _ in range(400)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "k long, n long").repartition(5)
    out, closed = scan.fold_ranges(rows, "k", "n", 100, partitions, fan)
    want, at = _plain(sizes, 100)
    assert [r.chunk_id for r in out.orderBy("k").collect()] == want and closed == at
    kept = training.greedy_pack(rows, "k", "n", 100, partitions=partitions)
    assert {r.k: r.chunk_id for r in kept.collect()} == {i: c for i, c in enumerate(want) if c < at}


def test_packing_cases(spark):
    schema = "k string, n int"
    assert training.greedy_pack(spark.createDataFrame([], schema), "k", "n", 10).collect() == []
    rows = spark.createDataFrame([("a", 4), ("b", None), ("b", 9), ("b", 9), ("c", -3), (None, 2)], schema)  # in order: null, a, b, b, b, c
    got = sorted((r.k or "", r.chunk_id) for r in training.greedy_pack(rows, "k", "n", 10, drop_last=False, partitions=3).collect())
    assert got == [("", 0), ("a", 0), ("b", 0), ("b", 1), ("b", 2), ("c", 2)]


@pytest.mark.parametrize("partitions", [1, 3, 11])
def test_running_aggregates_cross_partitions(spark, partitions):
    rnd = random.Random(7)
    rows = [("one" if i % 10 else rnd.choice(["two", "three", None]), i, rnd.choice([None, rnd.uniform(0, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "run string, step int, v double")
    low = scan.running_before(df, "run", ["step"], "low", F.col("v"), F.min, F.least, partitions)
    total = scan.running_before(df, "run", ["step"], "total", F.col("v"), F.sum, lambda a, b: a + b, partitions)
    assert low.columns == ["run", "step", "v", "low"]
    low, total = ({r.step: r[3] for r in d.collect()} for d in (low, total))
    for run, step, _ in rows:
        before = [v for r, s, v in rows if r == run and s < step and v is not None]
        assert low[step] == min(before, default=None)
        assert total[step] == (pytest.approx(sum(before)) if before else None)


def test_best_so_far_with_one_run(spark):
    rows = spark.range(500).select(F.lit("r").alias("run"), "id", (F.xxhash64("id") % 1000).alias("loss"))
    got = training.best_so_far(rows, "run", "id", "loss", partitions=7).orderBy("id").collect()
    best = None
    for r in got:
        assert r.best_before == best and r.improved == (best is None or r.loss < best)
        best = r.loss if best is None else min(best, r.loss)
