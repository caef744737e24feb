"""What the modules of queries share: their registry, and parts of the SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators import prompts
from chatloom.runtime import table

QUERIES: dict = {}
ORACLES: dict = {}
WS_SQL = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def conversations(spark: SparkSession, d: str) -> DataFrame:
    return prompts.nested(table(spark, d, "conversations"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"

LAST = """l AS (SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)"""

PLACED = "p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"
WRONG = "role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END"


def details(spark, d, column, limit, skip=None):
    """Judged orders; without every ``skip``-th key if that is given."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    sat = l.groupBy("l_orderkey").agg(F.count_if(F.col(column) > limit).alias("s"), F.count("*").alias("n_items"))
    rows = sat.join(o, sat["l_orderkey"] == o["o_orderkey"])
    rows = rows.where(F.col("o_orderkey") % skip != 0) if skip else rows
    failed = F.col("o_orderkey") % 13 == 0
    return rows.select("o_orderkey", F.col("o_orderpriority").alias("tag"), F.when(~failed, F.col("s")).alias("n_satisfied"), "n_items")

ALL_DETAILS = """(SELECT o_orderkey, any_value(o_orderpriority) AS tag, CASE WHEN o_orderkey % 13 <> 0 THEN count(*) FILTER (l_discount > 0.05) END AS n_satisfied, count(*) AS n_items
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""

BATCH = "b AS (SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 16 AS batch_no, count(*) OVER () AS n FROM documents), k AS (SELECT doc_id, batch_no, n // 16 AS batches FROM b WHERE batch_no < n // 16)"

CATEGORIES = [("Violent Crimes", "Speech that helps with violence."), ("Hate", "Speech that demeans."), ("Self-Harm", "Speech that helps with self-harm."), ("Privacy", "Private facts about persons.")]
