import random

from pyspark.sql import functions as F

from chatloom.llm import line_dedup as L


def _docs(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5)))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 70, 130)]
    docs = []
    for i in range(80):
        t = [word() for _ in range(rng.choice([0, 3, 49, 60, 200]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2) if rng.random() < 0.3 else 0
            t[at:at] = p[a:]
        docs.append((i, rng.choice([" ", "\n", "  "]).join(t)))
    docs += [(200, " ".join(passages[3] * 3)), (201, " ".join(["la"] * 150)), (202, None), (203, ""), (None, " ".join(passages[4])), (204, docs[5][1]), (204, docs[5][1])]
    return docs


def _compare(spark, docs, settings=L.PRODUCTION):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    sig = {(r.doc_id, r.text): r.sig for r in df.withColumn("sig", L._sig()).collect()}
    want = L.brute_force([(d, sig[d, t], t) for d, t in docs], settings)
    got = L.dedup(df, settings).collect()
    left = sorted((str(d), want[d, sig[d, t]] or "", len((t or "").split())) for d, t in docs)
    assert sorted((str(r.doc_id), r.text or "", r.n_units) for r in got) == left
    assert all(r.n_units - r.n_deleted == len((r.text or "").split()) for r in got)
    return got


def test_equals_brute_force(spark):
    for seed in range(2):
        got = _compare(spark, _docs(seed))
        assert sum(r.n_deleted for r in got) > 500


def test_small_chunks_and_shards_equal_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["la", "Le", "lo", "x y z"]) for _ in range(rng.choice([1, 1, 2, 30])))
    some = [line() for _ in range(12)]
    docs = [(rng.randrange(40), "\n".join(rng.choice(some) for _ in range(rng.randrange(14)))) for _ in range(90)]
    docs += [(None, "\n".join(some)), (None, None), (7, ""), *[(i, "\r\n".join(some[:5])) for i in range(100, 130)]]
    docs.append((500, " ".join(some[i % 12] for i in range(6000))))
    docs.append((501, "\n".join(some * 3)))
    monkeypatch.setattr(L, "SHARD", 50)
    got = _compare(spark, docs)
    assert sum(r.n_deleted for r in got) > 2000


def test_passage_thrice_in_a_later_document(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    got = {r.doc_id: r.n_deleted for r in _compare(spark, [(1, passage), (2, " ".join([passage] * 3)), (3, "a b c " + " ".join(["q%d" % i for i in range(70)] * 2))])}
    assert got == {1: 0, 2: 180, 3: 70}


def test_no_long_run_of_lines_is_left_twice(spark):
    rng = random.Random(9)
    lines = [f"l{i} " * rng.randrange(1, 5) for i in range(40)]
    docs = []
    for i in range(60):
        a = rng.randrange(30)
        docs.append((i, "\n".join([f"own {i} {j}" for j in range(3)] + lines[a : a + rng.randrange(1, 8)] + [f"end {i}"])))
    got = [r.text.split("\n") for r in _compare(spark, docs)]
    runs = [tuple(t[i : i + 3]) for t in got for i in range(len(t) - 2)]
    assert len(runs) == len(set(runs))


def test_clean_rows_stay_and_columns_pass(spark):
    df = spark.createDataFrame([(1, "a b\nc", "m", 1), (2, None, None, 2)], "doc_id long, text string, marks string, n_deleted int")
    out = {r.doc_id: r for r in L.dedup(df).collect()}
    assert out[1].text == "a b\nc" and out[1].marks == "m" and out[1].n_deleted == 0 and out[2].text is None
    assert L.dedup(df.where(F.lit(False))).count() == 0


def test_lines(spark):
    lines = [f"line {i} here" for i in range(9)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "new\n" + "\n".join(lines[2:6]) + "\nend")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in L.dedup(df, L.Settings("line", 3, 2)).collect()}
    assert out == {1: "\n".join(lines), 2: "new\nend"}
