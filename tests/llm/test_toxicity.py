import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from chatloom.llm import toxicity as X


def test_block_max_search_equals_full_search():
    rng = np.random.default_rng(1)
    n, terms = 400, 60
    sets = [np.sort(rng.choice(terms, rng.integers(0, 7), replace=False)) for _ in range(n)]
    doc, term = np.repeat(np.arange(n), [len(x) for x in sets]), np.concatenate(sets)
    tf = rng.integers(1, 4, len(doc))
    for frequent in (3, 8, 1000):  # some, most and all terms in blocks
        m = X.build(np.arange(terms, dtype=np.uint64), rng.random(terms) + 0.1, np.arange(n), rng.integers(0, 2, n), doc, term, tf, X.Settings(k=9, block=16, frequent=frequent))
        dense = np.zeros((n, terms))
        dense[doc, term] = m.weights(doc, term, tf, n)
        places, cosines = m.search(doc, term, dense[doc, term], n)
        for i in range(n):
            exact = dense @ dense[i]
            want = [p for p in np.lexsort((np.arange(n), -exact))[:9] if exact[p] > 0]
            assert [int(m.ids[p]) for p in places[i] if p >= 0] == want
            assert cosines[i][: len(want)].tolist() == (exact[want] / X.SCALE**2).tolist()


def test_neighbours_equal_plain_tf_idf(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 8)))
    docs = [(i, " ".join([word() for _ in range(rng.choice([0, 3, 30]))] + ["Badly"] * (i % 9 == 0))) for i in range(300)]
    docs += [(900, docs[5][1]), (901, " ".join(word() for _ in range(30_000)))]
    labels = [(i, int(i % 9 == 0)) for i in range(0, 300, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = X.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.evidence for r in X.score(d, model, 5).collect()}

    def counts(text):
        w = [x.encode() for x in re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
        return Counter(w) + Counter((n, x[:n]) for x in w for n in X.PREFIXES if len(x) > n)

    every, toxic = {i: counts(t) for i, t in docs}, dict(labels)
    df = Counter(t for c in every.values() for t in c)
    bad = sum(toxic.values())

    def weight(t):
        n, b = sum(t in every[i] for i in toxic), sum(t in every[i] for i in toxic if toxic[i])
        p, rest = n / len(toxic), len(toxic) - bad
        z = (b / bad - (n - b) / rest) / math.sqrt(p * (1 - p) * (1 / bad + 1 / rest)) if 0 < p < 1 else 0
        return (math.log((1 + len(docs)) / (1 + df[t])) + 1) * (0.1 + max(0, z - 4.5))

    weights = {t: weight(t) for t in {t for i in toxic for t in every[i]}}

    def unit(c):
        v = {t: (1 + math.log(f)) * weights[t] for t, f in c.items() if t in weights}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    units = {i: unit(c) for i, c in every.items()}
    for i, _ in docs:
        cosines = sorted((sum(x * units[j].get(t, 0) for t, x in units[i].items()) for j in toxic), reverse=True)
        want = [c for c in cosines[:5] if c > 1e-9]
        assert np.allclose([e.cosine for e in got[i]], want, atol=1e-6)
        for e in got[i]:
            assert abs(sum(x * units[e.doc_id].get(t, 0) for t, x in units[i].items()) - e.cosine) < 1e-6 and e.toxic == toxic[e.doc_id]
    assert got[900] == got[5]


def test_learns_held_out_and_handles_odd_rows(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    docs, labels = [], []
    for i in range(1500):
        t = [word() for _ in range(rng.choice([5, 40, 200]))]
        toxic = i % 7 == 0
        for _ in range(3 * toxic):
            t.insert(rng.randrange(len(t)), "zzbad" + rng.choice(["o", "ent", "ly", "s"]))
        docs.append((i, " ".join(t), "own"))
        labels.append((i, int(toxic)))
    docs += [(9000, None, None), (9001, "", None), (None, "zzbado zzbads zzbadly", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = X.fit(d.select("doc_id", "text"), spark.createDataFrame([*labels, (9000, None)], "doc_id long, toxic int"), ~X.held_out(F.col("doc_id")))
    got = {r.doc_id: r.score for r in X.score(d, model).collect()}
    rows = spark.createDataFrame(docs, "doc_id long, text string, score string").select("doc_id", X.held_out(F.col("doc_id")).alias("h")).collect()
    held = [r.doc_id for r in rows if r.h and r.doc_id is not None and r.doc_id < 1500]
    right = [(got[i] >= 0.3) == (i % 7 == 0) for i in held]
    assert len(held) > 300 and np.mean(right) > 0.98
    assert got[9000] == got[9001] < 0.1 and got[None] > 0.5
    assert all(0 <= s <= 1 for s in got.values())


def test_no_labels_and_no_rows(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    model = X.fit(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in X.score(d, model).collect()] == [0.0, 0.0]
    assert X.score(d.limit(0), model).count() == 0
