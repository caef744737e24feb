"""Collators from a registry, a file or the default, and settings by name."""

import warnings

import pytest
from pyspark.sql import functions as F

from chatloom import settings
from chatloom.operators import collate, evaluation, prompts, safety
from chatloom.settings import DataSettings, TrainSettings, updated

ROWS = [(i, list(range(i + 1)), list(range(i + 1))) for i in range(9)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k int, input_ids array<bigint>, labels array<bigint>")


def test_default_fills_to_the_longest_of_a_batch(rows):
    got = sorted(collate.batches(rows, "k", TrainSettings(batch=4), DataSettings(pad=7)).collect())
    assert [r.k for r in got] == list(range(8)) and {(r.batch_no, len(r.input_ids), len(r.labels), len(r.attention_mask)) for r in got} == {(0, 4, 4, 4), (1, 8, 8, 8)}
    assert got[0].input_ids == [0, 7, 7, 7] and got[0].labels == [0, -100, -100, -100] and got[0].attention_mask == [1, 0, 0, 0]
    kept = collate.batches(rows, "k", TrainSettings(batch=4), DataSettings(drop_last=False, max_length=6)).collect()
    assert sorted(r.k for r in kept) == list(range(6))
    assert collate.batches(rows, "k", TrainSettings(batch=4), DataSettings(), split="val").count() == 9  # one row a batch
    packed = collate.batches(rows, "k", TrainSettings(batching="packing", batch=2, chunk=7), DataSettings()).collect()
    assert {r.k: r.batch_no for r in packed} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2, 7: 2}
    with pytest.raises(ValueError):
        collate.batches(rows, "k", TrainSettings(batching="other"), DataSettings())


def test_plugins(rows, tmp_path):
    (tmp_path / "own.py").write_text("from pyspark.sql import functions as F\n\ndef get_data_collator(rows, data):\n    return rows.select('k', F.lit(data.pad).alias('x'))\n\ndef other(rows, data):\n    return rows.limit(1)\n")
    run = lambda file: collate.batches(rows, "k", TrainSettings(batch=3), DataSettings(file=file, pad=5))
    assert {r.x for r in run(f"{tmp_path}/own.py").collect()} == {5} and run(f"{tmp_path}/own.py:other").count() == 1
    with pytest.warns(UserWarning, match="default collator"):
        assert set(run(f"{tmp_path}/own.py:nothing").columns) == {"k", "input_ids", "labels", "batch_no", "attention_mask"}
    with pytest.raises(FileNotFoundError):
        run(f"{tmp_path}/none.py")
    with pytest.raises(ValueError):
        run(f"{tmp_path}/own.txt")
    collate.register_collator("mine", lambda rows, data: rows.select("k"))
    assert collate.collator_for(DataSettings(dataset="mine", file="none.py"))(rows, DataSettings()).columns == ["k"]


def test_settings_by_name():
    both = (TrainSettings(), DataSettings())
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        train, data = updated(both, **settings.from_words(["--batch=8", "--TrainSettings.lr=1e-3", "--DataSettings.drop_last=False", "--file=a.py:f"]))
    assert (train.batch, train.lr, data.drop_last, data.file) == (8, 1e-3, False, "a.py:f") and both[0].batch == 16
    assert updated(train, lr=1, seed=7) == TrainSettings(batch=8, lr=1.0, seed=7)
    with pytest.warns(UserWarning, match="no settings have nothing"):
        assert updated(both, nothing=1) == both
    with pytest.warns(UserWarning, match="DataSettings has no batch"):
        assert updated(both, **{"DataSettings.batch": 3}) == both
    with pytest.warns(UserWarning, match="no settings have Other.batch"):
        assert updated(both, **{"Other.batch": 3}) == both
    for bad in ({"batch": "many"}, {"batch": 1.5}, {"drop_last": "perhaps"}, {"batching": 3}, {"drop_last": 1}):
        with pytest.raises(ValueError):
            updated(both, **bad)
    for bad in ("batch=1", "--batch", "--=1"):
        with pytest.raises(ValueError):
            settings.from_words([bad])


def test_no_common_key_is_an_error(spark):
    a, b = (spark.createDataFrame([(k, "t", 1)], "k int, tag string, n_satisfied int") for k in (1, 2))
    with pytest.raises(ValueError, match="no k is on both sides"):
        evaluation.outcomes(a, b, "k")
    assert sorted(r.outcome for r in evaluation.outcomes(a, b, "k", strict=False).collect()) == ["only1", "only2"]


def test_evaluation_tasks_keep_checklist_and_tag(spark):
    items = spark.createDataFrame([("a", [("user", "q"), ("assistant", "r"), ("user", "s"), ("assistant", "t")], ["one", "two"])], "session_id string, conversation_input array<struct<role:string,text:string>>, checklist array<string>")
    r = prompts.evaluation_tasks(items).first()
    assert (r.history, len(r.history_list), r.user_query, r.checklist, r.primary_tag) == ("Human: q\n\nAI: r", 2, "s", ["one", "two"], None)
    assert prompts.evaluation_tasks(items.withColumn("primary_tag", F.lit("x"))).first().primary_tag == "x"
    with pytest.raises(Exception, match="no user turn: a"):
        prompts.evaluation_tasks(items.withColumn("conversation_input", F.slice("conversation_input", 2, 1))).collect()


def test_explanation_before_and_shuffled_categories(spark):
    rows = spark.createDataFrame([(i, "p", "N/A", "unsafe" if i % 2 else "safe", [1, 3] if i % 2 else [], "why") for i in range(30)], "k int, prompt string, response string, label string, violated array<int>, explanation string")
    categories = [("A", "a"), ("B", "b"), ("C", "c")]
    got = [safety.training_rows(rows, "k", categories, "{guidelines}|{conversation}|", position="before", shuffle=s, augment=False).orderBy("k").collect() for s in (False, True, True)]
    assert got[0][1].text == "O1: A. \nO2: B. \nO3: C. |human: p| Explanation: why\nunsafe\nO1,O3" and got[1] == got[2]
    assert len({r.text.split("|")[0] for r in got[1]}) > 3
    for r in got[1]:
        shown = [line.split(": ")[1][0] for line in r.text.split("|")[0].split("\n")]
        assert sorted(shown) == ["A", "B", "C"] and (r.label == "safe" or r.text.split("\n")[-1] == ",".join(sorted(f"O{shown.index(c) + 1}" for c in "AC")))
