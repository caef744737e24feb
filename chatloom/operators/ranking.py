"""Ranks over a whole table without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.runtime import materialise, shuffle_partitions


def rank_all(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with a global ``rank`` from 1: sorted by range, numbered in each partition, and moved by the counts before it.

    The ranged rows are written with the number of their partition: a lost executor can't deal them anew between count and number.
    """
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order)
    dealt = materialise(dealt.withColumn("__p", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy("__p").count()
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = counts.withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    own = dealt.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return own.join(F.broadcast(offsets), "__p").withColumn("rank", F.col("__n") + F.col("__before")).drop("__p", "__n", "__before")
