"""A run that dies loses one slice, and no key is answered twice."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from chatloom.operators.model_calls import call
from chatloom.sources import slices
from chatloom.streaming.resume import answer_stream

SCHEMA = "k string, answer string"


def _answers(log, dies_at=None):
    """Notes each prompt that it is asked in a file, and dies at one."""

    def client():
        def ask(texts):
            with open(log, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            if dies_at in texts:
                raise RuntimeError("gone")
            return [f"re {t}" for t in texts]

        return ask

    return lambda rows: call(rows, "text", "answer", client, attempts=1, strict=dies_at is not None).select("k", "answer")


def _rows(spark, ids):
    return spark.createDataFrame([(f"k{i:03}", f"t{i}") for i in ids], "k string, text string")


def test_crash_and_resume(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "out")
    rows = _rows(spark, [*range(100), 5, 5])
    with pytest.raises(Exception, match="gone"):
        slices.answer_slices(rows, "k", path, _answers(str(log), "t57"), slices=5)
    before = slices.read(spark, path, SCHEMA).collect()
    kept = {r.k for r in before}
    assert kept == {f"k{i:03}" for i in range(len(kept))} and 20 <= len(kept) <= 57
    asked = len(log.read_text().splitlines())
    names = slices.answer_slices(rows, "k", path, _answers(str(log)), slices=99)  # the first run's bounds stay
    again = log.read_text().splitlines()[asked:]
    assert len(names) == 5 - len([n for n in slices.committed(spark, path) if n != "bounds" and n not in names])
    assert sorted(again) == sorted(f"t{i}" for i in range(len(kept), 100))
    got = slices.read(spark, path, SCHEMA).collect()
    assert sorted(r.k for r in got) == [f"k{i:03}" for i in range(100)] and all(r.answer == f"re t{int(r.k[1:])}" for r in got)
    assert slices.answer_slices(rows, "k", path, _answers(str(log))) == []


def test_new_keys_are_answered_beside_the_old(spark, tmp_path):
    log, path = tmp_path / "log", str(tmp_path / "out")
    slices.answer_slices(_rows(spark, range(0, 40, 2)), "k", path, _answers(str(log)), slices=3, form="parquet")
    (tmp_path / "out" / "slice=rest").mkdir()  # what a dead run leaves is not read
    shutil.copy(next((tmp_path / "out" / "slice=00000-000").glob("*.parquet")), tmp_path / "out" / "slice=rest" / "x.parquet")
    asked = len(log.read_text().splitlines())
    names = slices.answer_slices(_rows(spark, [*range(0, 40, 2), 1, 1, 3]), "k", path, _answers(str(log)), form="parquet")
    assert names == ["00000-001"] and sorted(log.read_text().splitlines()[asked:]) == ["t1", "t3"]
    assert sorted(r.k for r in slices.read(spark, path, SCHEMA, "parquet").collect()) == sorted(f"k{i:03}" for i in [*range(0, 40, 2), 1, 3])


def test_numbers_nulls_and_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(9, "a"), (10, "b"), (100, "c"), (None, "d")], "k int, text string")
    answer = lambda df: df.select("k", F.upper("text").alias("answer"))
    assert len(slices.answer_slices(rows, "k", str(tmp_path / "a"), answer, slices=3)) == 3  # 9 < 10 < 100, as numbers
    assert sorted(map(tuple, slices.read(spark, str(tmp_path / "a"), "k int, answer string").collect())) == [(9, "A"), (10, "B"), (100, "C")]
    assert slices.answer_slices(rows.where("false"), "k", str(tmp_path / "b"), answer) == []
    assert slices.read(spark, str(tmp_path / "b"), SCHEMA).count() == 0 == slices.read(spark, str(tmp_path / "c"), SCHEMA).count()


def test_stream_answers_each_key_once(spark, tmp_path):
    source, out, log = tmp_path / "in", str(tmp_path / "out"), tmp_path / "log"
    source.mkdir()

    def add(name, ids):
        (source / name).write_text("".join(json.dumps({"k": f"k{i:03}", "text": f"t{i}"}) + "\n" for i in ids))

    def run(answer):
        stream = spark.readStream.schema("k string, text string").json(str(source))
        answer_stream(stream, "k", out, str(tmp_path / "check"), answer).awaitTermination()

    add("a.json", [1, 2, 2, 3])
    run(_answers(str(log)))
    add("b.json", [3, 4])
    with pytest.raises(Exception, match="gone"):
        run(_answers(str(log), "t4"))
    assert sorted(r.k for r in slices.read(spark, out, SCHEMA, "parquet").collect()) == ["k001", "k002", "k003"]
    run(_answers(str(log)))
    add("c.json", [4, 5, 1])
    run(_answers(str(log)))
    assert sorted(r.k for r in slices.read(spark, out, SCHEMA, "parquet").collect()) == [f"k{i:03}" for i in range(1, 6)]
    assert sorted(log.read_text().split()) == ["t1", "t2", "t3", "t4", "t4", "t5"]
    # a batch that was committed, but not noted in the checkpoint, is not answered again
    last = max(int(p.name) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "check" / "commits").glob(f"*{last}*"):
        p.unlink()
    run(_answers(str(log)))
    assert len(log.read_text().split()) == 6 and slices.read(spark, out, SCHEMA, "parquet").count() == 5
