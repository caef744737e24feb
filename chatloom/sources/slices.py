"""Output in slices of keys, each committed once: its data first, then its line of the manifest.

The manifest is a folder ``_slices`` beside the data, with one small file a commit, made under another name and renamed. Readers see
committed slices only, so what a run that died has left behind is not read, and is overwritten when the slice is done again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators.corpus import not_done

MANIFEST, BOUNDS = "_slices", "bounds"
#: Keys from which the slices' bounds are taken.
SAMPLE = 4096


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def commit(spark: SparkSession, path: str, name: str, line: dict) -> None:
    """Add a line to the manifest; whoever reads it sees all of it or nothing."""
    fs, final = _store(spark, f"{path.rstrip('/')}/{MANIFEST}/{name}.json")
    _, made = _store(spark, f"{path.rstrip('/')}/{MANIFEST}/.{name}.{uuid.uuid4().hex}")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(line).encode()))
    out.close()
    if not fs.rename(made, final):
        raise OSError(f"{final} can't be committed")


def committed(spark: SparkSession, path: str) -> dict[str, dict]:
    """The manifest's lines by name."""
    fs, folder = _store(spark, f"{path.rstrip('/')}/{MANIFEST}")
    if not fs.exists(folder):
        return {}
    lines = spark.read.text(f"{path.rstrip('/')}/{MANIFEST}/*.json", wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value") if fs.globStatus(_store(spark, f"{path.rstrip('/')}/{MANIFEST}/*.json")[1]) else None
    return {} if lines is None else {r.name.removesuffix(".json"): json.loads(r.value) for r in lines.collect()}


def is_committed(spark: SparkSession, path: str, name: str) -> bool:
    fs, at = _store(spark, f"{path.rstrip('/')}/{MANIFEST}/{name}.json")
    return fs.exists(at)


def read(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """Rows of all committed slices."""
    parts = sorted(f"{path.rstrip('/')}/{line['data']}" for line in committed(spark, path).values() if "data" in line)
    return spark.read.schema(schema).format(form).load(parts) if parts else spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, form: str) -> None:
    out = df.write.mode("overwrite")
    (out.option("ignoreNullFields", False) if form == "json" else out).format(form).save(path)


def _bounds(rows: DataFrame, key: str, slices: int) -> list[str]:
    """Keys, as text, at which slices begin: quantiles of the keys of smallest hash."""
    sample = rows.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE)
    sample = [r[0] for r in sample.orderBy(key).select(F.col(key).cast("string")).collect()]
    return list(dict.fromkeys(sample[i * len(sample) // slices] for i in range(1, slices) if sample))


def answer_slices(rows: DataFrame, key: str, path: str, answer: Callable[[DataFrame], DataFrame], slices: int = 16, form: str = "json") -> list[str]:
    """Answer the rows of each range of keys, write and commit them, and give the names of what was committed now.

    The ranges are fixed by the first run. A slice that was committed from the same keys (as many, of the same sum of hashes) is
    skipped unread; where keys have changed, those of the slice's output are read, and the others answered and committed beside them.
    So a run that dies loses the slice it was at, and no key is in the output twice. Rows without a key have no answer; of the rows of
    one key one is taken. The keys are read once for the sums, and the rows once for each slice that is not done.
    """
    spark, done = rows.sparkSession, committed(rows.sparkSession, path)
    kind = rows.schema[key].dataType
    if BOUNDS not in done:
        commit(spark, path, BOUNDS, {"bounds": _bounds(rows, key, slices)})
        done = committed(spark, path)
    bounds = [F.lit(b).cast(kind) for b in done[BOUNDS]["bounds"]]
    rows = rows.where(F.col(key).isNotNull())
    nth: Column = F.lit(0)
    for b in bounds:
        nth = nth + (F.col(key) >= b).cast("int")
    sums = rows.groupBy(nth.alias("nth")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("sum"))
    now = {r.nth: [r.n, str(r.sum)] for r in sums.collect()}
    names = []
    for i in sorted(now):
        parts = sorted(n for n in done if n.startswith(f"{i:05}-"))
        if parts and done[parts[-1]]["keys"] == now[i]:
            continue
        mine = rows
        if i:
            mine = mine.where(F.col(key) >= bounds[i - 1])
        if i < len(bounds):
            mine = mine.where(F.col(key) < bounds[i])
        todo = mine.dropDuplicates([key])
        if parts:
            held = spark.read.schema(f"`{key}` {kind.simpleString()}").format(form).load([f"{path.rstrip('/')}/{done[p]['data']}" for p in parts])
            todo = not_done(todo, held, key)
        name = f"{i:05}-{len(parts):03}"
        _write(answer(todo), f"{path.rstrip('/')}/slice={name}", form)
        commit(spark, path, name, {"data": f"slice={name}", "keys": now[i]})
        names.append(name)
    return names
