"""Very long texts, and extra columns under the names that operators use inside."""

from pyspark.sql import functions as F

from chatloom.llm import chat_format, decontaminate, language, line_dedup, mixing, near_dedup, secrets, spelling, toxicity, vector_codes

LONG = " ".join(f"w{i * 7919 % 1_000_003}" for i in range(150_000))
CLASHING = ["cluster", "node", "bands", "digest", "key", "label", "rank", "n", "size", "place", "__k0", "spans", "items"]


def _docs(spark):
    near = LONG.replace("w7919 ", "w0 ", 1)
    rows = [(1, LONG, "a"), (2, near, "a"), (3, "short text of a few words", "b"), (4, None, None), (5, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


def test_near_duplicates(spark):
    docs = _docs(spark)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dedup.link(docs, 5).collect()}
    assert got[1] == (1, 149_996) and got[2][0] == 1 and got[3][0] == 3 and got[4] == (4, 0)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    assert all(r.cluster == "own cluster" and r["__k0"] == "own __k0" for r in kept.collect())


def test_lines_and_words(spark):
    docs = _docs(spark)
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert got[1].text == LONG and len(got[2].text.split()) < 60 and got[4].text is None and got[3].node == "own node"


def test_mix(spark):
    got = mixing.mixed(_docs(spark)).collect()
    assert all(r.taken == r.copies * len((r.text or "").split()) and r.key == "own key" and r["__k0"] == "own __k0" for r in got) and any(r.doc_id in (1, 2) for r in got)


def test_decontamination(spark):
    items = spark.createDataFrame([("x", " ".join(LONG.split()[70_000:70_040]))], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.clean(_docs(spark), items).collect()}
    assert len(got[1].text.split()) == 150_000 - 40 and got[3].text == "short text of a few words" and got[1]["items"] == "own items" and got[1].spans == "own spans"


def test_secrets_and_words(spark):
    secret = " password: abcdefghijkl123 "
    docs = _docs(spark).withColumn("text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(secret), "text")).otherwise(F.col("text")))
    got = {r.doc_id: [(x.s, x.e) for x in r.assign] for r in secrets.scan(docs).collect()}
    assert got[1] == [(len(LONG) + 1, len(LONG) + len(secret) - 1)] and not any(got[i] for i in (2, 3, 4, 5))
    words = spelling.variants(docs.select(F.explode(F.split("text", " ")).alias("word"), "node").groupBy("word").agg(F.count("*").alias("n")).where("n > 1 and length(word) > 4"))
    assert words.count() > 50_000


def test_conversations(spark):
    rows = spark.createDataFrame([(1, 1, "user", LONG), (1, 2, "assistant", LONG + "</s>")], "conv_id long, turn int, role string, text string")
    rows = rows.select("*", *[F.lit("own").alias(c) for c in ("example", "loss", "turns", "place")])
    made = chat_format.examples(rows)
    back = chat_format.read_back(made).first()
    assert made.count() == 1 and back.n_turns == 2 and back.loss_chars == len(LONG) + 4


def test_models(spark):
    docs = _docs(spark).withColumn("lang", F.when(F.col("doc_id") < 3, "en").otherwise("de"))
    got = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert got[1].lang_pred == "en" and got[4].lang_pred == "und" and got[1].rank == "own rank"
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert {r.doc_id for r in scored.collect()} == {1, 2, 3, 4, 5} and scored.first().cluster == "own cluster"
    vectors = spark.createDataFrame([(i, [float(i)] * 4, i % 2) for i in range(9)], "vec_id long, embedding array<double>, label int").select("*", *[F.lit("own").alias(c) for c in CLASHING if c != "label"])
    assert vector_codes.encode(vectors, parts=2, entries=4).rows.count() == 9
