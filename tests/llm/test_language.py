"""Forward-backward against all labellings, and accuracy on held-out and code-switched texts."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chatloom.llm import kernel
from chatloom.llm import language as ll

SYLLABLES = {"aa": ["ka", "lo", "mi", "ré"], "bb": ["sch", "ung", "ü", "ost"], "cc": ["ción", "ez", "ña", "ja"]}
SCHEMA = "doc_id long, text string, lang string, score string, runs int"


def _word(rnd, lang):
    return "".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4)))


def _docs(n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(SYLLABLES))
        rows.append((i, " ".join(_word(rnd, lang) for _ in range(rnd.randint(2, 60))).capitalize() + ".", lang, "x", 1))
    return rows


def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    score, start, move = rng.normal(size=(9, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    first, length, pairs = np.array([0, 4, 5]), np.array([4, 1, 4]), np.zeros((3, 3))
    p, log = ll.forward_backward(score, first, length, start, move, pairs)
    want, want_pairs, want_log = np.zeros((9, 3)), np.zeros((3, 3)), 0.0
    for f, n in zip(first, length, strict=True):
        each = [(np.exp(start[y[0]] + sum(score[f + t, y[t]] for t in range(n)) + sum(move[y[t - 1], y[t]] for t in range(1, n))), y) for y in itertools.product(range(3), repeat=int(n))]
        z = sum(v for v, _ in each)
        want_log += np.log(z)
        for v, y in each:
            for t in range(n):
                want[f + t, y[t]] += v / z
                if t:
                    want_pairs[y[t - 1], y[t]] += v / z
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(log, want_log)


def test_words_are_runs_of_letters():
    text = "ÀÉ don't ×x÷ «mot» 3º a—b  µ Straße"
    low, w = ll._words(next(kernel.blocks(pa.array([text, None, "", "Ã\u0097"]))))
    got = [low[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == ["àé", "don", "t", "x", "mot", "º", "a", "b", "µ", "straße", "ã"]


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    low, w = ll._words(next(kernel.blocks(pa.array(["casa über x casa"]))))
    word, rows = ll.features(low, w.start, w.end, w.hash, [np.sort(w.hash[:1]), np.zeros(0, np.uint64)], 1000)
    of = [sorted(rows[word == i]) for i in range(4)]
    assert of[0] == of[3] and 1000 in of[0] and 1000 not in of[1] and len(of[2]) == 2 + 1 + 1  # two pairs, a triple, the word


def test_held_out_accuracy_and_switches(spark):
    docs = spark.createDataFrame(_docs(400), SCHEMA)
    model = ll.fit(docs, ~ll.held_out(F.col("doc_id")))
    got = ll.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    held = got.where(ll.held_out(F.col("doc_id"))).toPandas()
    assert len(held) > 60 and (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()
    rnd = random.Random(4)
    mixed = " ".join(_word(rnd, "aa") for _ in range(12)) + " " + " ".join(_word(rnd, "bb") for _ in range(20))
    row = ll.identify(spark.createDataFrame([(1, mixed)], "id int, text string"), model, runs=True).first()
    assert row.lang_pred == "bb" and sum(r.words for r in row.runs) == 32
    assert [r.lang for r in row.runs if r.words >= 8] == ["aa", "bb"] and 0.5 < row.score < 0.8


def test_same_at_any_number_of_partitions(spark):
    rows = _docs(120)
    one, many = (ll.fit(spark.createDataFrame(rows, SCHEMA).repartition(n)) for n in (1, 7))
    assert np.array_equal(one.weight, many.weight) and all(np.array_equal(a, b) for a, b in zip(one.lexicons, many.lexicons, strict=True))
    a = ll.identify(spark.createDataFrame(rows, SCHEMA).repartition(1), one).select("doc_id", "lang_pred", "score").collect()
    b = ll.identify(spark.createDataFrame(rows, SCHEMA).repartition(7), many).select("doc_id", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_cases(spark):
    rows = _docs(60) + [(900, None, "aa", "", 0), (901, "", "bb", "", 0), (902, "12 -- 3!", "cc", "", 0), (None, "ka lo mi", "aa", "", 0), (903, "ka lo mi", None, "", 0), (904, "ka lo mi", None, "", 0), (905, "ℝ", None, "", 0)]
    rows += [(906, "sch ung ost " * 20_000, None, "", 0), (907, "x" * 300_000, None, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = ll.fit(docs)
    got = {r.doc_id: r for r in ll.identify(docs, model, runs=True).collect()}
    assert len(got) == len(rows)
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].runs) == ("und", 0.0, [])
    assert got[903].lang_pred == got[None].lang_pred == "aa" and (got[903].score, got[903].runs) == (got[904].score, got[904].runs)
    assert got[905].lang_pred == model.langs[int(model.share.argmax())] and got[905].score == model.share.max()
    assert got[906].lang_pred == "bb" and sum(r.words for r in got[906].runs) == 60_000 and got[907].lang_pred in model.langs
    assert model.langs == ["aa", "bb", "cc"]
    empty = spark.createDataFrame([], SCHEMA)
    assert ll.fit(empty) is None and ll.identify(empty, None).count() == 0 and ll.identify(empty, model).count() == 0
    none = ll.identify(docs, ll.fit(docs, F.col("doc_id") < 0), runs=True).where("lang_pred <> 'und' or score <> 0")
    assert none.count() == 0
    only = ll.fit(docs.where("lang = 'aa'"))
    assert only.langs == ["aa"] and ll.identify(docs.where("doc_id = 3"), only).first().score == 1.0


def test_query(spark, tmp_path):
    spark.createDataFrame(_docs(200), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = ll.query(spark, str(tmp_path)).toPandas()
    want = {i: lang for i, _, lang, *_ in _docs(200)}
    assert list(got.columns) == ["doc_id", "held_out", "lang_pred", "score"] and len(got) == 200
    assert (got[got.held_out].lang_pred == got[got.held_out].doc_id.map(want)).mean() > 0.9
