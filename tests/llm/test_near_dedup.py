import random

import numpy as np

from chatloom.llm import graph, kernel
from chatloom.llm import near_dedup as N


def _docs(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.75:
            t = (docs[0] if rng.random() < 0.5 else rng.choice(docs))[1].split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                if t:
                    t[rng.randrange(len(t))] = word()
        else:
            t = [word() for _ in range(rng.choice([0, 1, 3, 4, 9, 60, 120]))]
        docs.append((i * 3 + 1, " ".join(t)))
    docs[0] = (docs[0][0], " ".join(word() for _ in range(90)))
    return docs + [(5000, "  \n"), (5001, "A b C"), (5002, "a B c"), (5002, "a B c")]


def test_equals_brute_force(spark):
    for seed in range(2):
        docs = _docs(seed)
        df = spark.createDataFrame([*docs, (6000, None)], "doc_id long, text string").repartition(3)
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.with_kept(N.link(df)).collect())
        assert got == sorted([*N.brute_force(docs), (6000, 0, 6000, True)])


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_CLASSES", 7)
    docs = _docs(5)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in N.link(df).collect())
    assert got == sorted((d, c) for d, _, c, _ in N.brute_force(docs))


def test_signature_agrees_as_similarity():
    rng = np.random.default_rng(3)
    for n in (5, 40, 400):
        agree = []
        for _ in range(200):
            pool = kernel.mix64(rng.integers(0, 2**62, n).astype(np.uint64))
            a, b = np.sort(pool[: int(n * 0.9)]), np.sort(pool[int(n * 0.1) :])
            sig = N.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            agree.append((sig[0] == sig[1]).mean())
        want = (int(n * 0.9) - int(n * 0.1)) / n
        assert abs(np.mean(agree) - want) < 0.04


def test_null_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (7, "p q r s t"), (None, "p q r s t")], "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in N.with_kept(N.link(df)).collect())))
    assert got == sorted(map(str, [(None, None, True), (None, None, True), (7, 7, True), (None, 7, False)]))
    assert N.with_kept(N.link(df.limit(0))).count() == 0


def test_near_copies_without_ids(spark):
    def text(name, *changed):
        return " ".join(f"{name}{i}{'x' if i in changed else ''}" for i in range(60))

    # the row without an id is like both others, which are not like each other
    bridge = [(1, text("a")), (None, text("a", 10)), (2, text("a", 10, 40))]
    nulls = [(None, text("b")), (None, text("b", 20)), (None, text("b", 20))]
    twice = [(9, text("c")), (9, text("c", 30))]
    other = [(9, text("d")), (None, "   "), (None, text("e"))]
    rows = [*bridge, *nulls, *twice, *other]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.sig): r.component_id for r in N.link(df).collect()}
    assert sorted(v for (d, _), v in got.items() if d in (1, 2)) == [1, 1] and sorted(v for (d, _), v in got.items() if d is None and v) == [1]
    stay = [(r.doc_id, r.text) for r in N.keep_one(df).collect()]
    assert len(stay) == 6 and {(1, text("a")), *other} <= set(stay)
    assert sum(t.startswith("b0") for _, t in stay) == 1 and sum(t.startswith("c0") for _, t in stay) == 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(-5, 300)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near: dict = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[x] == min(seen)
