import json
import math
import random

import pytest
from pyspark.sql import functions as F

from chatloom.functions.text import fix_spacing, strip, words
from chatloom.operators import corpus, evaluation, judging, prompts, training
from chatloom.operators.model_calls import call
from chatloom.plans.catalogue import QUERIES


def test_words_and_strip_know_all_whitespace(spark):
    t = "\x1c a b\x85\tc  "
    r = spark.createDataFrame([(t,)], "t string").select(words(F.col("t")).alias("w"), strip(F.col("t")).alias("s")).first()
    assert r.w == t.split() and r.s == t.strip()


def test_spacing_order(spark):
    t = "in 2 0 0 6 , 5 5 and 5 0 did n't"
    assert spark.range(1).select(fix_spacing(F.lit(t))).first()[0] == "in 2006, 55 and 50 didn't"


def test_repetitive_counts_occurrences(spark):
    rows = [(1, "a b c a b c a b c"), (2, "x y z w"), (3, "a B c"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "id long, t string")
    kept = {r.id: r.kept for r in corpus.mark_repetitive(df, "id", "t", 3, 3).collect()}
    assert kept == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_split_is_disjoint_and_has_floors(spark):
    users = spark.createDataFrame([(i, i % 3) for i in range(90)] + [(1000, 9)], "u long, c long")
    got = corpus.split_users(users, "u", "c").collect()
    for c in range(3):
        n = {s: sum(r.c == c and r.split == s for r in got) for s in ("train", "val", "test")}
        assert n == {"train": 26, "val": 1, "test": 3}
    assert [r.split for r in got if r.c == 9] == ["test"]
    with pytest.raises(ValueError):
        corpus.split_users(users, "u", "c", 0.5, 0.1, 0.1)


def test_verdicts(spark):
    good = '```json\n[{"satisfied": true}, {"satisfied": "FALSE"}]\n```'
    rows = [(good, [True, False]), ('x [{"satisfied": true, "r": "a \\d"}] y', [True]), ('[{"satisfied": 1}]', None), ('[{"satisfied": null}]', None), ("[1]", None), ("[]", None), ('{"satisfied": true}', None), ("junk", None), ('[{"r": 1}]', None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r[0] for r in df.select(evaluation.verdicts(F.col("t"), F.lit(1))).collect()] == [w for _, w in rows]
    assert spark.range(1).select(evaluation.verdicts(F.lit("[]"), F.lit(0))).first()[0] == []


def test_flip_headers(spark):
    turns = [(1, 0, "user", " hi "), (1, 1, "assistant", "yo"), (2, 0, "user", "a"), (3, 0, "assistant", "a"), (4, 0, "user", " ")]
    convs = prompts.nested(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r.segments for r in training.flip_segments(convs, F.lit("want")).collect()}
    assert [(s.text, s.trainable) for s in got[1]] == [
        ("<|im_start|>system\nwant<|im_end|>\n<|im_start|>user\n", False),
        ("hi<|im_end|>\n", True),
        ("<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n", False),
        ("<|endconversation|><|im_end|>\n", True),
    ]
    assert got[2][-1].text.startswith("<|im_start|>user\n") and set(got) == {1, 2}
    reasons = {r.conv_id: r.x for r in convs.select("conv_id", prompts.reject_reason(F.col("turns")).alias("x")).collect()}
    assert reasons == {1: 0, 2: 0, 3: -2, 4: -1}


def test_packing_closes_at_the_limit(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([3, 4, 3, 10, 2, 8, 1])], "k long, n long")
    got = {r.k: r.chunk_id for r in training.greedy_pack(df, "k", "n", 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_global_rank(spark):
    df = spark.createDataFrame([(i, i * 7 % 50) for i in range(200)], "k long, n long").repartition(7)
    got = [r.k for r in training.rank_all(df, ["n", "k"]).orderBy("rank").collect()]
    assert got == [k for _, k in sorted((i * 7 % 50, i) for i in range(200))]


def test_learning_rate(spark):
    got = [r.lr for r in spark.range(12).orderBy("id").select(training.learning_rate(F.col("id"), 10, 2, 1.0, 0.1).alias("lr")).collect()]
    want = [0.5, 1.0] + [0.1 + 0.9 * 0.5 * (1 + math.cos(math.pi * (s - 2) / 8)) for s in range(2, 10)] + [0.1, 0.1]
    assert got == pytest.approx(want)


def test_calls_retry_and_report(spark):
    def client():
        seen = {}

        def ask(texts):
            for t in texts:
                seen[t] = seen.get(t, 0) + 1
            if seen.get("flaky") == 1:
                raise RuntimeError("once")
            return [None if t == "never" else t.upper() for t in texts]

        return ask

    df = spark.createDataFrame([("flaky",), ("never",)], "p string").coalesce(1)
    assert sorted((r.a, r.status) for r in call(df, "p", "a", client).collect() if r.a) == [("FLAKY", "ok")]


def test_padding_refuses_longer_rows(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "x array<long>")
    assert df.select(training.padded(F.col("x"), 5, 0)).first()[0] == [1, 2, 3, 0, 0]
    with pytest.raises(Exception, match="longer than 2"):
        df.select(training.padded(F.col("x"), 2, 0)).collect()


def test_every_document_has_a_padded_row(spark, tmp_path):
    texts = {1: "a" * 300, 2: "b\n" * 200, 3: "c" * 4096, 4: "d" * 4097, 5: "", 6: None, 7: "😀é", 8: "w " * 4096, 9: "w " * 4097}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["pad_bucket"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(i, len(t) if t is not None and len(t) <= 4096 else None, None if t is None else len(t) > 4096) for i, t in texts.items()]
    masked = {r.doc_id: r.mask_sum for r in QUERIES["length_filter_and_mask"](spark, str(tmp_path)).where("doc_id in (7, 8, 9)").collect()}
    assert masked == {7: 1, 8: 4096}


def test_every_event_and_order_counts(spark, tmp_path):
    spark.createDataFrame([(i, float(i % 7)) for i in range(6000)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    rows = QUERIES["perplexity_by_step"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in rows) == [(i, round(math.exp(i % 7 / 100), 6), i % 50 == 0) for i in range(6000)]
    spark.createDataFrame([(i, 0.1, 0.0) for i in range(1, 27)], "l_orderkey long, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, "x") for i in range(1, 27)], "o_orderkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    whole = QUERIES["satisfaction_summary"](spark, str(tmp_path)).first()
    assert (whole.n_tasks, whole.n_failed, whole.n_valid) == (26, 2, 24)
    assert [r.n for r in QUERIES["satisfaction_by_tag"](spark, str(tmp_path)).collect()] == [24]


def _answers(n):
    """Random JSON, mended and broken in ways that answers are."""
    rnd = random.Random(9)

    def value(depth):
        kind = rnd.randrange(9 if depth else 6)
        if kind < 2:
            return rnd.choice(["true", "false", "null", "NaN", "-Infinity", "Infinity", "-NaN"])
        if kind == 2:
            return rnd.choice(["1", "-2.5e3", "01", "+1", "1.", "0"])
        if kind < 6:
            return json.dumps(rnd.choice(["true", "FALSE", "x", "[", "]}", 'a "b" \\d', "NaN, ", "é"]), ensure_ascii=rnd.random() < 0.5)
        if kind == 6:
            return "[" + ", ".join(value(depth - 1) for _ in range(rnd.randrange(3))) + "]"
        return item(depth - 1)

    def item(depth):
        keys = rnd.sample(["satisfied", "item", "reasoning", "note"], rnd.randint(1, 4))
        return "{" + ",".join(f'"{k}": ' + (rnd.choice(["true", "false", '"True"', '"no"']) if k == "satisfied" and rnd.random() < 0.9 else value(depth)) for k in keys) + "}"

    out = []
    for _ in range(n):
        text = "[" + ", ".join(item(2) if rnd.random() < 0.95 else value(1) for _ in range(rnd.randrange(4))) + "]"
        for _ in range(rnd.choice([0, 0, 0, 1])):
            at = rnd.randrange(len(text) + 1)
            text = text[:at] + rnd.choice(["", "]", "[", "}", "{", ",", '"', "\\", "\\d", " ", "\n", "junk", "NaN"]) + text[at + rnd.randrange(2) :]
        text = rnd.choice([text, f"```json\n{text}\n```", f"so {text} it is", f"```{text}``` and {text}", text + text, f"{text} [1", f"{text}]", f"{text}}}]", f"{text}, {text}", f"{text}, \"a\": 1"])
        out.append(text)
    return [*out, "", "[]", "[1]", "null", "[1] junk", "[[]]", "[{}]", '[{"satisfied": true}] [2]', '[{"satisfied": true}], "a": [1]']


def test_both_readers_of_verdicts_agree(spark):
    answers = _answers(3000)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(answers)], "i int, t string")
    got = {r.i: r.v for r in rows.select("i", evaluation.verdicts(F.col("t"), F.lit(1)).alias("v")).collect()}
    read = [judging.read_verdicts(t, 1) for t in answers]
    wrong = [(t, got[i], r) for i, (t, r) in enumerate(zip(answers, read, strict=True)) if got[i] != (None if r is None else [v["satisfied"] for v in r])]
    assert wrong == [] and 80 < sum(r is not None for r in read) < 2700
