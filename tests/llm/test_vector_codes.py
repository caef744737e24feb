"""Codes against a plain Lloyd with whole integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, near string, kind string, low string"


def _plain(rows, parts, k, rounds):
    kept = [(i, lab, tuple(math.floor(256 * x) for x in v)) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-max((len(v) for _, _, v in kept), default=1) // parts)
    cut = [[(v + (0,) * (parts * width))[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[c[p] for c in cut[:k]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(nearest(p, c[p])[1], []).append(c[p])
            books[p] = [tuple(sum(col) // len(of[i]) for col in zip(*of[i], strict=True)) if i in of else e for i, e in enumerate(books[p])]
    out = [(i, tuple(nearest(p, c[p])[1] for p in range(parts)), min(2**63 - 1, sum(nearest(p, c[p])[0] for p in range(parts)))) for (i, _, _), c in zip(kept, cut, strict=True)]
    return sorted(out, key=str), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def _coded(spark, rows, partitions=3, **kw):
    got = vc.encode(spark.createDataFrame(rows, SCHEMA).repartition(partitions), **kw)
    return sorted(((r.vec_id, tuple(r.codes), min(r.error, 2**63 - 1)) for r in got.rows.collect()), key=str), got.digest()


@pytest.mark.parametrize("spread", [1.0, 0.02, 1e9])
def test_equals_plain_lloyd(spark, spread):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(rnd.choice([-2, 0, 2]) * spread, spread) for _ in range(12)], i % 3, "x", "y", "z") for i in range(160)]
    assert _coded(spark, rows, parts=4, entries=32, rounds=3) == _plain(rows, 4, 32, 3)


def test_cases(spark):
    rnd = random.Random(6)
    rows = [(i, [float(rnd.randint(-1, 1)) for _ in range(rnd.choice([5, 7]))], None, None, None, None) for i in range(60)]  # ties, lengths
    rows += rows[:20] + [(3, [9.0] * 7, 1, "", "", "")] * 4  # repeated rows, equal ids
    rows += [(None, [1.0] * 7, 1, "", "", ""), (7, None, 1, "", "", ""), (8, [1.0, None], 1, "", "", ""), (9, [float("nan")], 1, "", "", ""), (10, [float("inf")], 2, "", "", ""), (11, [], 2, "", "", "")]
    for partitions in (1, 5):
        assert _coded(spark, rows, partitions, parts=4, entries=16, rounds=2) == _plain(rows, 4, 16, 2)
    few = rows[:3]
    assert _coded(spark, few, parts=4, entries=16, rounds=2) == _plain(few, 4, 16, 2)
    long = [(i, [rnd.uniform(-1, 1) for _ in range(20_000)], 0, "", "", "") for i in range(6)]
    assert _coded(spark, long, parts=4, entries=4, rounds=1) == _plain(long, 4, 4, 1)
    empty = vc.encode(spark.createDataFrame([], SCHEMA))
    assert empty.rows.count() == 0 and empty.entries is None


def test_errors_and_sums_beyond_64_bits(spark):
    rows = [(i, [float(1 << 60) * (1 if i % 2 else -1), float(i)], 0, "", "", "") for i in range(9)]
    got, digest = _coded(spark, rows, parts=1, entries=2, rounds=1)
    held = [(i, [max(-(2.0**53), min(2.0**53, v[0])), v[1]], *r) for i, v, *r in rows]  # 2^61 after the factor
    want, plain = _plain(held, 1, 2, 1)
    assert digest == plain and got == [(i, c, min(e, 2**63 - 1)) for i, c, e in want]


def test_bounds_spare_distances_and_lose_nothing():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(3000, 4)) * 40 + rng.choice([-300, 0, 300], size=(3000, 1)))
    books = vc.Codebooks.of(x[None, :64].astype(np.int64))
    near = low = None
    taken = []
    for _ in range(6):
        at, d, low, took = books.assign(0, x, near, low)
        full = ((x[:, None] - books.entries[0][None]) ** 2).sum(axis=2)
        assert (at == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
        for g in range(books.groups):  # bounds hold
            others = np.where((books.group[0] == g)[None] & (np.arange(64)[None] != at[:, None]), full, np.inf).min(axis=1)
            assert (low[:, g].astype(float) * books.unit[0] <= np.sqrt(others)).all()
        taken.append(took)
        near = at
        sums = {int(e): (int((at == e).sum()), [int(v) for v in x[at == e].sum(axis=0)]) for e in np.unique(at)}
        books = books.moved(sums)
    assert taken[0] == 3000 * 64 and max(taken[2:]) < 3000 * 30


def test_query_label_errors(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0], None if i % 4 == 0 else i % 4, "", "", "") for i in range(90)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vc.query(spark, str(tmp_path)).toPandas()
    label = {i: r[2] for i, r in enumerate(rows)}
    for _, r in got.iterrows():
        assert r.label_error == got.error[[label[i] == label[r.vec_id] for i in got.vec_id]].sum() and len(r.code) == 32
    assert spark.read.parquet(f"{tmp_path}/embeddings.parquet").where(F.col("vec_id") < 0).count() == 0
