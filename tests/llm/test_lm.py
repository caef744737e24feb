import itertools
import math

import numpy as np
import pytest

from chatloom.llm import kernel, lm


def _seatings(c):
    """All partitions of c customers, as table sizes."""
    if c == 0:
        yield []
        return
    for smaller in _seatings(c - 1):
        yield [*smaller, 1]
        for i in range(len(smaller)):
            yield [*smaller[:i], smaller[i] + 1, *smaller[i + 1 :]]


def test_stirling_numbers_sum_over_seatings():
    d = 0.4
    log_s = lm.stirling(d, 6)
    for c in range(1, 7):
        for t in range(1, c + 1):
            want = sum(math.prod(math.prod(k - d for k in range(1, n)) for n in s) for s in _seatings(c) if len(s) == t)
            assert math.exp(log_s[c, t]) == pytest.approx(want)


def test_gibbs_draws_from_the_conditional():
    d, theta, p, c, rest = 0.5, 1.0, 0.3, 5, 4.0
    n = 40_000
    got = lm.resample(np.full(n, c), np.full(n, rest), np.full(n, p), theta, d, lm.stirling(d, 10), np.random.default_rng(0).random(n))
    log_s = lm.stirling(d, 10)
    w = np.array([math.exp(log_s[c, t]) * math.prod((theta + d * (rest + j)) * p for j in range(t)) for t in range(1, c + 1)])
    assert np.allclose(np.bincount(got, minlength=c + 1)[1:] / n, w / w.sum(), atol=0.01)


def test_many_customers_stay_in_bounds():
    c = np.array([1, 2, 50, 193, 1000, 10**6])
    t = lm.resample(c, np.full(6, 3.0), np.full(6, 0.2), 1.0, 0.6, lm.stirling(0.6), np.random.default_rng(1).random(6))
    assert (t >= 1).all() and (t <= c).all()


@pytest.mark.parametrize(("d", "c", "p", "rest"), [(0.8, 192, 0.2, 100.0), (0.8, 193, 0.2, 100.0), (0.8, 193, 0.02, 2000.0), (0.5, 193, 0.9, 100.0), (0.8, 1600, 0.2, 100.0), (0.5, 1600, 0.02, 2000.0), (0.1, 1600, 1e-6, 0.0)])
def test_many_customers_follow_the_conditional(d, c, p, rest):
    n, t = 1_500, np.arange(1, c + 1)
    got = lm.resample(np.full(n, c), np.full(n, rest), np.full(n, p), 1.0, d, lm.stirling(d), np.random.default_rng(3).random(n))
    log_w = lm.stirling(d, c)[c, 1:] + np.cumsum(np.log((1.0 + d * (rest + t - 1)) * p))
    w = np.exp(log_w - log_w.max())
    mean = (w * t).sum() / w.sum()
    spread = math.sqrt((w * (t - mean) ** 2).sum() / w.sum())
    assert abs(got.mean() - mean) <= 5 * spread / math.sqrt(n) + 1e-4 and got.std() == pytest.approx(spread, rel=0.1, abs=0.05)


DOCS = [(i, " ".join(["a b A c", "b c d", "é a", "", "a a a"][i % 5] for _ in range(i % 4))) for i in range(60)]


def _brute(rows):
    import re
    import zlib
    from collections import Counter

    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    low = lambda t: "".join(x.lower() if "A" <= x <= "Z" else x for x in t or "")
    split = {r: [*re.findall(r"[^\x20\x09-\x0D]+", low(r[1])), None] for r in rows}
    c = Counter(itertools.chain.from_iterable(split[r] for r in rows if not held(r[0])))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(split[d, t]), sum(c[w] > 0 for w in split[d, t]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split[d, t]), 6)) for d, t in rows]


def test_counts_and_base_equal_brute_force(spark):
    rows = [*DOCS, (77, None), (78, "x new words"), (78, "x new words"), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm.score(df, lm.held_out(df["doc_id"])).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=key) == sorted(_brute(rows), key=key)
    assert all(r.score < 0 for r in got)
    again = lm.score(df.repartition(1), lm.held_out(df["doc_id"])).collect()
    assert sorted((r.doc_id or 0, round(r.score, 9)) for r in got) == sorted((r.doc_id or 0, round(r.score, 9)) for r in again)


def test_first_word_and_end_are_at_most_certain(spark):
    from pyspark.sql import functions as F

    train = [(i, "a b a c b a b") for i in range(3)]
    probes = [(1000 + i, w) for i, w in enumerate(["a", "b", "c", "zzz"])]
    df = spark.createDataFrame([*train, *probes, (2000, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in lm.score(df, F.col("doc_id") >= 1000).collect()}
    assert out[2000].n_tokens == 1
    # P(empty), and P(word) * P(end | word) of each first word
    assert 10 ** out[2000].score + sum(10 ** out[1000 + i].score for i in range(4)) <= 1.0 + 1e-9


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, lm.held_out(df["doc_id"])).count() == 0


def test_tokens_of_a_block():
    import pyarrow as pa

    u, w, doc = lm.tokens(next(kernel.blocks(pa.array(["x y", "", "x"]))))
    assert doc.tolist() == [0, 0, 0, 1, 2, 2]
    assert u.tolist() == [lm.START, w[0], w[1], lm.START, lm.START, w[0]] and w[2] == w[3] == w[5] == lm.END
    assert len({int(x) & 63 for x in u}) == 3 and int(lm.START) & 63 == 63


def _texts(seed, n):
    import random

    rng = random.Random(seed)
    words = [rng.choice("pqrs") + rng.choice(["xa", "xe", "on"]) for _ in range(40)] + ["the"] * 12
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 20])))) for i in range(n)]


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([*_texts(1, 250), (900, " ".join(t for _, t in _texts(2, 2500)))], "doc_id long, text string").withColumn("score", lm.F.lit("own"))
    s = lm.Settings(shard=4_000)  # several shards, and hot contexts
    assert lm._totals(df, s).bins.any()
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got.append({r.doc_id: r.score for r in lm.score(df.repartition(parts), lm.held_out(df["doc_id"]), s).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0].keys() == got[1].keys() and all(got[1][k] == pytest.approx(v, abs=1e-9) for k, v in got[0].items())


class _Restaurant:
    def __init__(self, d, theta, parent, rng):
        self.d, self.theta, self.parent, self.rng, self.tables = d, theta, parent, rng, {}

    def p(self, w):
        if self.parent is None:
            raise NotImplementedError
        c, t = sum(self.tables.get(w, [])), len(self.tables.get(w, []))
        all_c, all_t = sum(map(sum, self.tables.values())), sum(map(len, self.tables.values()))
        return (c - self.d * t + (self.theta + self.d * all_t) * self.parent.p(w)) / (self.theta + all_c)

    def add(self, w):
        mine, all_t = self.tables.setdefault(w, []), sum(map(len, self.tables.values()))
        weights = [n - self.d for n in mine] + [(self.theta + self.d * all_t) * self.parent.p(w)]
        k = self.rng.choices(range(len(weights)), weights)[0]
        if k < len(mine):
            mine[k] += 1
        else:
            mine.append(1)
            self.parent.add(w)

    def remove(self, w):
        mine = self.tables[w]
        k = self.rng.choices(range(len(mine)), mine)[0]
        mine[k] -= 1
        if not mine[k]:
            mine.pop(k)
            self.parent.remove(w)


class _Uniform:
    def __init__(self, n):
        self.n = n

    def p(self, w):
        return 1 / self.n

    def add(self, w):
        pass

    def remove(self, w):
        pass


def test_predictive_equals_a_customer_by_customer_sampler(spark):
    import random

    train = ["pxa qxa pxa on", "qxa on on pxa qxa", "pxa on qxa qxa", "pxa pxa qxa on on", "on qxa pxa", "qxa", "pxa on"]
    probes = ["pxa", "qxa on", "on on pxa", "", "new qxa", "pxa new"]
    rows = [(i, t) for i, t in enumerate(train * 2)] + [(1000 + i, t) for i, t in enumerate(probes)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    s = lm.Settings(burn=5, samples=60)
    got = {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") >= 1000, s).collect() if r.doc_id >= 1000}

    def pairs(text):
        w = [None, *text.split(), "</>"]
        return list(zip(w, w[1:], strict=False))

    tokens = [p for t in train * 2 for p in pairs(t)]
    counts = [tokens.count(p) for p in set(tokens)]
    n1, n2 = counts.count(1), counts.count(2)
    d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    rng = random.Random(1)
    root = _Restaurant(s.d_root, s.theta, _Uniform(len({w for _, w in tokens}) + 1), rng)
    classes, leaves = {}, {}

    def leaf(u):
        k = None if u is None else u[-2:]
        parent = classes.setdefault(k, _Restaurant(s.d_class, s.theta, root, rng))
        return leaves.setdefault(u, _Restaurant(d, s.theta, parent, rng))

    for u, w in tokens:
        leaf(u).add(w)
    asked = {p for t in probes for p in pairs(t)}
    sums, rounds = dict.fromkeys(asked, 0.0), 400
    for turn in range(rounds + 50):
        for u, w in tokens:
            leaf(u).remove(w)
            leaf(u).add(w)
        if turn >= 50:
            for u, w in asked:
                sums[u, w] += leaf(u).p(w) / rounds
    for i, t in enumerate(probes):
        assert got[1000 + i] == pytest.approx(sum(math.log10(sums[p]) for p in pairs(t)), abs=0.06 * len(pairs(t)))


def test_predictive_sums_to_one():
    rng = np.random.default_rng(1)
    vocab = 30
    base = np.full(vocab + 1, 1 / (vocab + 1))
    levels = []
    for _ in range(3):
        c = rng.integers(0, 9, vocab + 1)
        c[-1] = 0  # the unknown token
        t = np.minimum(c, rng.integers(1, 4, vocab + 1))
        base = lm._predictive(c, t, 0.6, 1.0, c.sum(), t.sum(), base)
        levels.append(base.sum())
    assert np.allclose(levels, 1.0)
