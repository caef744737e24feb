"""Sources and sinks of conversation data, and a registry of named sources."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chatloom.runtime import materialise, ship

TURN = "struct<role:string,content:string>"
CONVERSATION = f"conversation_id string, conversation_hash string, language string, hashed_ip string, country string, timestamp timestamp, conversation array<{TURN}>"
TRAINING_ROW = "input_ids array<bigint>, labels array<bigint>"
SPLITS = {"train": "train", "validation": "val", "test": "test"}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The rows that ``path`` (Parquet) holds; where it was not written to its end they are computed, written there and read again."""
    if not finished(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def unless_finished(spark: SparkSession, path: str, write: Callable[[str], None]) -> bool:
    """Call ``write(path)`` unless its output is there; whether it was called."""
    if finished(spark, path):
        return False
    write(path)
    return True


def tolerant_jsonl(spark: SparkSession, path: str, schema: str | StructType = CONVERSATION) -> DataFrame:
    """Rows of the lines that parse; others are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def strict_jsonl(spark: SparkSession, path: str, schema: str | StructType = CONVERSATION, rows: int | None = None) -> DataFrame:
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df if rows is None else df.limit(rows)


def json_array(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def placed_lines(spark: SparkSession, path: str | list[str], column: str = "text") -> DataFrame:
    """Lines of text files with their ``place``: file, where its split begins, and an ordinal that rises inside the split.

    Places of one file rise with its lines, however many splits and tasks it has.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ordinal"))
    return spark.read.text(path).select(place.alias("place"), F.col("value").alias(column))


def last_line_per_key(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Keyed detail lines: blank lines are skipped and the last line of a key wins; the lines of a later file, by path, come later."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = placed_lines(spark, path).where(F.trim("text") != "").select("place", F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r"))
    return rows.groupBy(F.col(f"r.{key}").alias("__k")).agg(F.max_by("r", "place").alias("r")).select("r.*")


def finished_keys(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Keys that an earlier run's output holds; lines cut short are skipped."""
    return tolerant_jsonl(spark, path, schema).select(key).where(F.col(key).isNotNull()).distinct()


def write_splits(df: DataFrame, path: str) -> None:
    """One folder of JSON lines per split, nulls written and timestamps in ISO form."""
    df.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", False).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_stats(df: DataFrame, path: str) -> None:
    """A one-row aggregate as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_report(details: DataFrame, summary: DataFrame, path: str) -> None:
    """A judge's report: details as JSON lines, and one row of rates."""
    details.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/details")
    write_stats(summary, f"{path}/summary")


METRICS = ("train_step_loss", "train_epoch_loss", "train_step_perplexity", "train_epoch_perplexity", "val_step_loss", "val_epoch_loss", "val_step_perplexity", "val_epoch_perplexity")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Rows (metric, step, value) of a training run as one JSON object of lists."""
    lists = metrics.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("v"))
    by_name = lists.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("v.value")))).alias("m"))
    none = F.array().cast("array<double>")
    write_stats(by_name.select(*[F.coalesce(F.try_element_at("m", F.lit(n)), none).alias(n) for n in METRICS]), path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """metric, step, value of such a file; an error if it is no JSON object."""
    schema = ", ".join(f"{n} array<double>" for n in METRICS)
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    if rows.where(F.col("m").isNull() | F.col("m._bad").isNotNull()).limit(1).count():
        raise ValueError(f"{path} holds no metrics in JSON")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m.{n}").alias("v")) for n in METRICS])).alias("r"))
    return long.select("r.metric", F.posexplode("r.v").alias("step", "value"))


def files_in_order(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder or of one file, by path; names that begin with a dot or an underscore are none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    found = fs.listStatus(at)
    return sorted((f.getPath().toString(), f.getLen()) for f in found if f.isFile() and f.getPath().getName()[0] not in "._")


def _heads(rows: int):
    """The first ``rows`` lines of each split. A task that has them of its only split reads no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: dict[tuple, int] = {}
        for b in batches:
            file, block = (b["place"].field(i) for i in range(2))
            for split in dict.fromkeys(zip(file.to_pylist(), block.to_pylist(), strict=True)):
                mine = b.filter(pc.and_(pc.equal(file, split[0]), pc.equal(block, split[1])))
                left = rows - had.get(split, 0)
                had[split] = had.get(split, 0) + mine.num_rows
                if left > 0:
                    yield mine.slice(0, left)
            if len(had) == 1 and min(had.values()) >= rows and b["whole"][0].as_py():
                return

    return run


def first_lines(spark: SparkSession, path: str, rows: int, schema: str | StructType = CONVERSATION) -> DataFrame:
    """The first ``rows`` strict JSON lines of a file, or of a folder's files by path, in that order; blank lines are none.

    Files are taken in growing batches until there are enough lines, so later files are not opened; a split gives at most its first
    ``rows`` lines, and a large file's tasks stop there. A line that is taken and is no JSON of the schema is an error.
    """
    ship(spark)
    files, at, step, left, taken = files_in_order(spark, path), 0, 1, rows, []
    large = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    kind = "place struct<file:string,block:bigint,ordinal:bigint>, text string"
    while at < len(files) and left > 0:
        # a file of several splits is a batch of its own: each of its tasks has one split
        several = files[at][1] > large
        group = files[at : at + (1 if several else step)]
        group = group[: next((i for i, f in enumerate(group) if i and f[1] > large), len(group))]
        lines = placed_lines(spark, [f for f, _ in group]).where(F.trim("text") != "")
        heads = lines.withColumn("whole", F.lit(several)).mapInArrow(_heads(left), f"{kind}, whole boolean").drop("whole")
        got = materialise(heads.orderBy("place").limit(left), "first-lines")
        left -= got.count()
        taken.append(got)
        at, step = at + len(group), step * 2
    if not taken:
        return spark.createDataFrame([], schema)
    all_ = taken[0]
    for more in taken[1:]:
        all_ = all_.unionByName(more)
    return all_.orderBy("place").select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def from_file(path: str, function: str = "get_dataset") -> Callable[..., DataFrame]:
    """A function out of a Python file; an error if the file or the function is not there."""
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    spec = importlib.util.spec_from_file_location("source_plugin", path)
    if spec is None:
        raise ValueError(f"{path} is no Python file")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, function):
        raise AttributeError(f"{path} has no function {function}")
    return getattr(module, function)


def write_pairs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, source: Callable[..., DataFrame]) -> None:
    """A source: a function of (spark, config, split)."""
    _SOURCES[name] = source


def load(spark: SparkSession, name: str, config: dict, split: str) -> DataFrame:
    if name not in _SOURCES:
        raise KeyError(f"{name} is not a known source")
    return _SOURCES[name](spark, config, SPLITS.get(split, split))


register("training_rows", lambda spark, config, split: spark.read.schema(TRAINING_ROW).json(f"{config['path']}/{split}.jsonl").where(F.size("input_ids") <= config.get("max_length", 4096)))
register("parquet", lambda spark, config, split: spark.read.parquet(f"{config['path']}/{split}"))
register("dialogue_summaries", lambda spark, config, split: spark.read.parquet(f"{config['path']}/{split}").select("id", "dialogue", "summary"))
register("toxicity_chat", lambda spark, config, split: spark.read.parquet(f"{config['path']}/{split}").select("conv_id", "user_input", F.col("toxicity").cast("int").alias("toxicity"), "openai_moderation"))
register("plugin", lambda spark, config, split: from_file(config["file"], config.get("function", "get_dataset"))(spark, config, split))
