"""From documents to a training mix: five stages, each on all that the one before has kept.

Toxic documents go; later repeats of runs of 50 words are cut out; of each group of
near-duplicates one document stays; passages of the benchmark are cut out; the rest
is mixed to the sources' target weights.  A stage's rows are written and read again
before the next.  Stages that cut text set ``n_chars`` anew.

Cases, for every stage: null and empty texts are clean, are cut nowhere, are nobody's
duplicates (of rows equal in id and text one stays) and give 0 words to the mix; very
long texts are taken whole; rows without an id go through, and no label is theirs; ties
go by id, then by a hash of the text, so reruns agree; repeated rows are scored and cut
alike, and one of them is left after the third stage; an empty table gives an empty one
with the same columns; other columns pass through, whatever their names, but for
``copies`` and ``taken``, which the last stage sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from chatloom.runtime import materialise, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.production_model(spark, docs, sf_dir)
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.dedup(docs)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage adds ``copies`` and ``taken`` (words)."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", repeated_runs),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("mixing", mix),
]

#: Nearest neighbours, winnowing, links and draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
