import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chatloom.operators import corpus
from chatloom.plans.catalogue import QUERIES

xxhash64 = F.xxhash64


def _shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("query", ["ngram_counts", "ngram_dedup"])
def test_no_string_of_a_frequent_ngram_is_shuffled_by_its_hash(spark, tmp_path, monkeypatch, query):
    """At sizes where frequent hashes are too many for a broadcast: strings would take over 200 bytes an n-gram."""
    monkeypatch.setattr(corpus, "BROADCAST_HASHES", 0, raising=False)
    rng = random.Random(7)
    words = [f"{rng.getrandbits(160):040x}" for _ in range(1800)]
    texts = [" ".join(words[k : k + 60]) for _ in range(20) for k in range(0, 1800, 60)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before, broadcasts = _shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[query](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
    assert _shuffled(spark) - before < 60 * 54 * len(texts)


def _expected(rows, n, threshold):
    grams = [(i, [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)]) for i, t in rows for w in [(t or "").lower().split()]]
    count = Counter(g for _, gs in grams for g in gs)
    hot = {g: c for g, c in count.items() if c > threshold}
    return hot, {i for i, gs in grams if i is not None and hot.keys() & set(gs)}


@pytest.mark.parametrize("values", [None, 1, 40])
def test_ngrams_of_equal_ids_and_equal_hashes(spark, monkeypatch, values):
    """Ids that are null or occur twice, texts twice, and hashes of few values: strings decide."""
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), " ".join(rng.choice("abcD") for _ in range(rng.randrange(12)))) for _ in range(60)]
    rows += [(100, None), (101, ""), (102, "a"), rows[0], rows[0], (7, "x y z w"), (8, "x y z w"), (9, "x y z v"), (9, "u")]
    df = spark.createDataFrame(rows, "id long, t string")
    if values:
        monkeypatch.setattr(corpus.F, "xxhash64", lambda *c: F.pmod(xxhash64(*c), F.lit(values)))
    hot, gone = _expected(rows, 3, 2)
    assert {r.ng: r.n for r in corpus.hot_ngrams(df, "id", "t", 3, 2).collect()} == hot
    got = corpus.mark_repetitive(df, "id", "t", 3, 2).collect()
    assert len(got) == len(rows) and all(r.kept == (r.id not in gone) for r in got)


@pytest.mark.parametrize("query", ["ngram_counts", "ngram_dedup"])
def test_a_rare_ngram_shuffles_a_few_bytes(spark, tmp_path, query):
    """a row for each n-gram took 14 bytes here and 17 over larger tables; texts take under 2 an n-gram here."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1000)) for _ in range(100)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = _shuffled(spark)
    assert not [r for r in QUERIES[query](spark, str(tmp_path)).collect() if query == "ngram_counts" or not r.kept]
    assert _shuffled(spark) - before < 12 * 994 * len(texts)


@pytest.mark.parametrize("values", [None, 1, 40])
def test_ngrams_of_many_shards(spark, monkeypatch, values):
    """Small batches and shards: n-grams that are frequent in one batch, over all of them only, and twice in a text."""
    monkeypatch.setattr(corpus, "SHARD_CHARS", 100)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdE") for _ in range(rng.randrange(40)))) for i in range(120)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:30])] + [(300 + i, "q r s t u") for i in range(20)]
    if values:
        monkeypatch.setattr(corpus.F, "xxhash64", lambda *c: F.pmod(xxhash64(*c), F.lit(values)))
    df = spark.createDataFrame(rows, "id long, t string")
    try:
        for n, threshold in ((3, 5), (4, 2), (2, 0)):
            hot, gone = _expected(rows, n, threshold)
            assert {r.ng: r.n for r in corpus.hot_ngrams(df, "id", "t", n, threshold).collect()} == hot
            assert all(r.kept == (r.id not in gone) for r in corpus.mark_repetitive(df, "id", "t", n, threshold).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_shard_gets_all_places_of_one_ngram():
    """An n-gram that is everywhere goes to its shard a few times a batch; its places are dealt by text."""
    packed = pytest.importorskip("chatloom.operators.packed")
    hs = [[7] * 500 + [t] for t in range(100, 300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(hs, pa.list_(pa.int64()))], ["t", "hs"])
    (out,) = packed._dealer(10, 5)([batch])
    out = out.to_pylist()
    assert sum(len(r["keys"] or b"") for r in out) == 6 * (200 + 1)
    assert {r["shard"] for r in out if r["kind"] == packed._PLACES} == set(range(10))
    t, place = packed._where([r for r in out if r["kind"] == packed._PLACES])
    assert sorted(zip(t.tolist(), place.tolist(), strict=True)) == [(t, p) for t in range(200) for p in range(500)]
