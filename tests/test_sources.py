import json

import pytest
from pyspark.sql import functions as F

from chatloom.operators import corpus, judging, prompts, training
from chatloom.operators.model_calls import FALLBACK, Rejected, Reply, call, respond, safety_checks
from chatloom.plans.catalogue import ORACLES, QUERIES
from chatloom.sources import files


def _line(i, **more):
    return json.dumps({"conversation_id": f"c{i}", "language": "English", "conversation": [{"role": "user", "content": f"hi {i}"}], **more})


def test_tolerant_and_strict_lines(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    (tmp_path / "a.jsonl").write_text("\n".join([_line(1), '{"conversation_id": "cut', "", _line(2), "[1"]) + "\n")
    assert sorted(r.conversation_id for r in files.tolerant_jsonl(spark, path).collect() if r.conversation_id) == ["c1", "c2"]
    assert sorted(r[0] for r in files.finished_keys(spark, path, "conversation_id", files.CONVERSATION).collect()) == ["c1", "c2"]
    with pytest.raises(Exception, match="alformed"):
        files.strict_jsonl(spark, path).collect()
    (tmp_path / "b.jsonl").write_text("\n".join(_line(i) for i in (3, 1, 2)))
    got = files.first_lines(spark, str(tmp_path / "b.jsonl"), 2).collect()
    assert [r.conversation_id for r in got] == ["c3", "c1"] and got[1].conversation[0].content == "hi 1"
    assert files.strict_jsonl(spark, str(tmp_path / "b.jsonl"), rows=2).count() == 2


def test_last_line_of_a_key_wins_and_a_missing_file_is_an_error(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"session_id": "a", "n": 1}\n\n{"session_id": "b", "n": 2}\n  \n{"session_id": "a", "n": 3}\n')
    got = files.last_line_per_key(spark, str(tmp_path / "d.jsonl"), "session_id", "session_id string, n int").collect()
    assert sorted((r.session_id, r.n) for r in got) == [("a", 3), ("b", 2)]
    with pytest.raises(FileNotFoundError):
        files.last_line_per_key(spark, str(tmp_path / "none.jsonl"), "session_id", "session_id string")


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes, so that files have several."""
    keys = {"spark.sql.files.maxPartitionBytes": "400b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_last_line_wins_across_splits_and_files(spark, tmp_path, small_splits):
    lines = [{"session_id": f"s{i % 7}", "n": i, "pad": "x" * (i % 40)} for i in range(300)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.jsonl").write_text("".join(json.dumps(x) + "\n\n" for x in lines))
    (tmp_path / "d" / "a.jsonl").write_text("".join(json.dumps({**x, "n": -1, "session_id": k}) + "\n" for x, k in zip(lines[:2], ("s3", "only here"), strict=True)))
    path = str(tmp_path / "d")
    assert files.placed_lines(spark, path).rdd.getNumPartitions() > 10
    got = {r.session_id: r.n for r in files.last_line_per_key(spark, path, "session_id", "session_id string, n int").collect()}
    assert got == {**{x["session_id"]: x["n"] for x in lines}, "only here": -1}
    (tmp_path / "d" / "c.jsonl").write_text('{"session_id": "s0", "n": 1000}\n')
    got = {r.session_id: r.n for r in files.last_line_per_key(spark, path, "session_id", "session_id string, n int").collect()}
    assert got["s0"] == 1000 and got["s1"] == max(x["n"] for x in lines if x["session_id"] == "s1")


def _bytes_read(spark, action):
    """What ``action`` gives, and the bytes that its tasks read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorList(True).apply(0).totalInputBytes()
    out = action()
    return out, store.executorList(True).apply(0).totalInputBytes() - before


def test_first_lines_stop_early(spark, tmp_path, small_splits):
    schema, d = "n int, pad string", tmp_path / "d"
    d.mkdir()
    for f in range(12):
        (d / f"{f:02}.jsonl").write_text("".join(json.dumps({"n": f * 100 + i, "pad": "x" * 50}) + "\n" for i in range(100 if f == 2 else 5)))
    (d / "12.jsonl").write_text("no json\n" * 2000)
    every = [*range(5), *range(100, 105), *range(200, 300), *(f * 100 + i for f in range(3, 12) for i in range(5))]
    for n in (0, 1, 5, 7, 60, 111, len(every)):
        assert [r.n for r in files.first_lines(spark, str(d), n, schema).collect()] == every[:n]
    with pytest.raises(Exception, match="alformed"):
        files.first_lines(spark, str(d), len(every) + 1, schema).collect()
    few, read = _bytes_read(spark, lambda: files.first_lines(spark, str(d), 7, schema).collect())
    every_, all_read = _bytes_read(spark, lambda: files.first_lines(spark, str(d), len(every), schema).collect())
    assert len(few) == 7 and len(every_) == len(every) and 0 < read < all_read / 3 and files.first_lines(spark, str(d / "02.jsonl"), 500, schema).count() == 100
    with pytest.raises(FileNotFoundError):
        files.first_lines(spark, str(d / "none"), 1, schema)


def test_summaries_and_toxicity_rows(spark, tmp_path):
    spark.createDataFrame([("1", "a: b", "c", 9)], "id string, dialogue string, summary string, more int").write.parquet(str(tmp_path / "s/val"))
    assert [tuple(r) for r in files.load(spark, "dialogue_summaries", {"path": str(tmp_path / "s")}, "validation").collect()] == [("1", "a: b", "c")]
    rows = [("x", "hi", True, "[['hate', 0.5]]", 1), ("y", None, False, "[]", 2)]
    spark.createDataFrame(rows, "conv_id string, user_input string, toxicity boolean, openai_moderation string, more int").write.parquet(str(tmp_path / "t/test"))
    got = files.load(spark, "toxicity_chat", {"path": str(tmp_path / "t")}, "test")
    assert got.columns == ["conv_id", "user_input", "toxicity", "openai_moderation"] and sorted(map(tuple, got.collect())) == [("x", "hi", 1, "[['hate', 0.5]]"), ("y", None, 0, "[]")]
    coded = got.select("conv_id", prompts.category_code(prompts.scores_of(F.col("openai_moderation"))).alias("c")).collect()
    assert {r.conv_id: r.c for r in coded} == {"x": "010", "y": None}


def test_arrays_and_csv_round_trip(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    assert sorted((r.a, r.b) for r in files.json_array(spark, str(tmp_path / "x.json"), "a int, b string").collect()) == [(1, "x"), (2, None)]
    rows = [("one, \"two\"", "a\nb"), ("é", "c")]
    files.write_pairs(spark.createDataFrame(rows, "input string, target string"), str(tmp_path / "p"))
    assert sorted(map(tuple, files.csv(spark, str(tmp_path / "p"), "input string, target string").collect())) == sorted(rows)
    files.write_pairs(spark.createDataFrame([("other", "x")], "input string, target string"), str(tmp_path / "q"))
    both = corpus.union_all(*[files.csv(spark, str(tmp_path / x), "input string, target string") for x in ("p", "q")])
    assert sorted(map(tuple, both.collect())) == sorted([*rows, ("other", "x")])


def test_split_sink_append_and_reports(spark, tmp_path):
    df = spark.sql("SELECT id, CASE WHEN id < 3 THEN 'train' ELSE 'test' END AS split, CAST(NULL AS STRING) AS nothing, TIMESTAMP'2024-05-06 07:08:09' AS at FROM range(5)")
    files.write_splits(df, str(tmp_path / "s"))
    lines = [json.loads(x) for p in (tmp_path / "s" / "split=test").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(x["id"] for x in lines) == [3, 4] and lines[0]["nothing"] is None and lines[0]["at"].startswith("2024-05-06T07:08:09")
    for _ in range(2):
        files.append_jsonl(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 10
    files.write_report(df, df.agg(F.count("*").alias("n")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/details")).count() == 5 and spark.read.json(str(tmp_path / "r/summary")).first().n == 5


def test_metrics_round_trip_and_guard(spark, tmp_path):
    rows = [("train_step_loss", i, 1.0 / (i + 1)) for i in range(4)] + [("val_epoch_loss", 0, 0.5)]
    files.write_metrics(spark.createDataFrame(rows, "metric string, step int, value double"), str(tmp_path / "m"))
    got = files.read_metrics(spark, str(tmp_path / "m/*.json")).collect()
    assert sorted((r.metric, r.step, r.value) for r in got) == sorted(rows)
    (tmp_path / "bad.json").write_text('{"train_step_loss": [1, ')
    with pytest.raises(ValueError):
        files.read_metrics(spark, str(tmp_path / "bad.json"))


def test_cache_reads_what_was_written_and_finished_work_is_skipped(spark, tmp_path):
    made, path = [], str(tmp_path / "cache")

    def compute():
        made.append(1)
        return spark.range(3)

    assert files.cached(spark, path, compute).count() == files.cached(spark, path, compute).count() == 3 and len(made) == 1
    (tmp_path / "cache" / "_SUCCESS").unlink()  # as if the first run had been cut short
    assert files.cached(spark, path, compute).count() == 3 and len(made) == 2
    write = lambda p: spark.range(2).write.mode("overwrite").json(p)
    assert files.unless_finished(spark, str(tmp_path / "o"), write) and not files.unless_finished(spark, str(tmp_path / "o"), write)


def test_registry_splits_and_plugins(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "val"))
    assert files.load(spark, "parquet", {"path": str(tmp_path)}, "validation").count() == 3
    with pytest.raises(KeyError):
        files.load(spark, "nothing", {}, "train")
    (tmp_path / "plug.py").write_text("def get_dataset(spark, config, split):\n    return spark.range(config['n'])\n")
    assert files.load(spark, "plugin", {"file": str(tmp_path / "plug.py"), "n": 4}, "train").count() == 4
    with pytest.raises(AttributeError):
        files.from_file(str(tmp_path / "plug.py"), "other")
    (tmp_path / "train.jsonl").write_text('{"input_ids": [1, 2], "labels": [-100, 2]}\n{"input_ids": [1, 2, 3], "labels": [1, 2, 3]}\n')
    assert files.load(spark, "training_rows", {"path": str(tmp_path), "max_length": 2}, "train").count() == 1
    spark.createDataFrame([("1", "a", "b", 0)], "id string, dialogue string, summary string, more int").write.parquet(str(tmp_path / "test"))
    assert files.load(spark, "dialogue_summaries", {"path": str(tmp_path)}, "test").columns == ["id", "dialogue", "summary"]


def test_client_errors_are_reported_or_raised(spark):
    def client():
        def ask(texts):
            return [Rejected("400") if t == "bad" else ValueError("x") if t == "err" else "" if t == "empty" else Reply(t, 1, 2) for t in texts]

        return ask

    df = spark.createDataFrame([("bad",), ("err",), ("empty",), ("ok",)], "p string").coalesce(1)
    got = {r.p: r for r in respond(df, "p", client).collect()}
    assert got["bad"].error == "Rejected: 400" and got["err"].error == "ValueError: x" and got["empty"].error is None
    assert {k: r.response for k, r in got.items()} == {"bad": FALLBACK, "err": FALLBACK, "empty": FALLBACK, "ok": "ok"} and got["ok"].total_tokens == 3
    with pytest.raises(Exception, match="ValueError: x"):
        call(df.where("p in ('err', 'ok')"), "p", "a", client, strict=True).collect()
    with pytest.raises(KeyError):
        safety_checks(df, "p", ["nobody"])


def test_verdicts_of_an_answer():
    read = judging.read_verdicts
    assert read('x ```json\n[{"item": 1, "satisfied": "TRUE"}]\n```', 1) == [{"item": 1, "satisfied": True, "reasoning": ""}]
    assert read('[{"satisfied": false, "reasoning": "\\d"}]', 2) == [{"item": None, "satisfied": False, "reasoning": "\\d"}]
    assert read("[]", 1) is None and read("[]", 0) == [] and read('[{"satisfied": 1}]', 1) is None and read("none", 1) is None and read("{}", 1) is None


def test_messages_alternate(spark):
    rows = [(1, [("user", "a"), ("assistant", "b")]), (2, [("assistant", "b")]), (3, [])]
    df = spark.createDataFrame(rows, "k int, h array<struct<role:string,text:string>>")
    got = {r.k: r.m for r in df.select("k", prompts.messages(F.col("h"), F.lit("q")).alias("m")).collect()}
    assert [m.text for m in got[1]] == ["a", "b", "q"] and got[2] is None and len(got[3]) == 1
    with pytest.raises(Exception, match="alternate"):
        df.select(prompts.messages(F.col("h"), F.lit("q"), strict=True)).collect()


def test_vocabulary_adds_up_to_the_whole_text(spark):
    import pathlib

    paths = sorted(pathlib.Path("/opt/tokenizers").glob("byte_bpe*.json"))
    if not paths:
        pytest.skip("no vocabulary file here")
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(str(paths[0]))
    reader.add_special_tokens([training.END_CONVERSATION])
    rows = spark.createDataFrame([(1, [("Hello there\n", False), ("how are you?\n", True), ("<|endconversation|>", True)])], "conv_id long, segments array<struct<text:string,trainable:boolean>>")
    got = training.training_ids(rows, training.vocabulary(str(paths[0]))).first()
    assert got.input_ids == reader.encode("Hello there\nhow are you?\n<|endconversation|>", add_special_tokens=False).ids
    assert len(got.labels) == len(got.input_ids) and got.labels[0] == training.IGNORED and got.labels[-1] == got.input_ids[-1]


def test_policies(spark):
    df = spark.createDataFrame([(i, 3) for i in range(10)], "k long, n long")
    assert {r.k: r.batch_no for r in training.batched(df, "k", "n", "packing", batch=2, chunk=7).collect()} == {i: i // 2 // 2 for i in range(8)}
    with pytest.raises(ValueError):
        training.batched(df, "k", "n", "other")
    kept = training.batched(df, "k", "n", "packing", batch=3, chunk=7, drop_last=False)
    assert {r.k: r.batch_no for r in kept.collect()} == {i: i // 2 // 3 for i in range(8)}


def test_doubled_cache_rows_and_empty_overlap(spark):
    tasks, cache = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a", 1), (1, "b", 2), (9, "c", 1)], "k int, v string, line int")
    got = sorted((r.k, r.v, r.missing) for r in corpus.with_cached(tasks, cache, "k", {"v": ""}, "line").collect())
    assert got == [(1, "b", False), (2, "", True)]
    with pytest.raises(ValueError):
        corpus.common_ids(tasks, cache.where("k = 9"), "k")
    with pytest.raises(ValueError):
        corpus.first_rows(tasks, 1)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
