"""Joins that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """``big`` with ``small`` on ``keys`` (equal, or both null); each key's rows of ``big`` are dealt over ``salts`` tasks.

    ``small`` has at most one row for each key and is repeated ``salts`` times. Columns of ``small``
    other than the keys are added. It is a sort-merge join at every size. Empty inputs give the join's usual empty or unmatched rows.
    """
    names = {k: f"__key_{i}" for i, k in enumerate(keys)}
    right = small.withColumnsRenamed(names).withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = big.withColumn("__salt_l", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    on = F.col("__salt_l") == F.col("__salt_r")
    for k, other in names.items():
        on = on & left[k].eqNullSafe(F.col(other))
    return left.join(right.hint("merge"), on, how).drop("__salt_l", "__salt_r", *names.values())
