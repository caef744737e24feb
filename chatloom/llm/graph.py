"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.skew import salted_join
from chatloom.runtime import materialise


def components(edges: DataFrame) -> DataFrame:
    """node, label of every end of ``edges`` (a, b): label is the smallest node of its component.

    Each round every node takes its smallest neighbour, if that is smaller, as parent; parents'
    parents follow; then ends of edges become their parents and loops and doubles go. Rounds are
    few, as stars collapse at once, and each writes its result. No round gathers a component: a
    node's neighbours are reduced by a minimum, and joins on a node of many edges are salted.
    """
    spark = edges.sparkSession

    def simple(e: DataFrame) -> DataFrame:
        e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return materialise(e.where(F.col("a") < F.col("b")).distinct(), "graph-edges")

    left, found = simple(edges), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
        parent = materialise(parent, "graph-parents")
        for _ in range(2):
            step = parent.select(F.col("node").alias("label"), F.col("label").alias("next"))
            parent = salted_join(parent, step, ["label"], salts=8).select("node", F.coalesce("next", "label").alias("label"))
        parent = materialise(parent, "graph-jumped")
        moved = salted_join(left, parent.withColumnsRenamed({"node": "a", "label": "pa"}), ["a"], salts=8)
        moved = salted_join(moved, parent.withColumnsRenamed({"node": "b", "label": "pb"}), ["b"], salts=8)
        left = simple(moved.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")))
        found.append(parent)
    if not found:
        return spark.createDataFrame([], "node long, label long")
    out = found[0]
    for later in found[1:]:
        out = salted_join(out, later.select(F.col("node").alias("label"), F.col("label").alias("next")), ["label"], salts=8)
        out = out.select("node", F.coalesce("next", "label").alias("label"))
    return materialise(out, "graph-components")
