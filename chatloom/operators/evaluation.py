"""Checklist verdicts, satisfaction and win rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.operators.judging import FENCED, STRAY, WIDEST


#: Fixed value: numbers that JSON does not know and the judge's reader takes.
NO_NUMBER = r"(?<=[:\[,\s])(NaN|-?Infinity)(?=\s*[,\]}])"


def strict_array(text: Column) -> Column:
    """The elements of a text that is one JSON array and nothing else, null if it is not; NaN and infinities count as numbers.

    The parser stops at the end of the first value, so a text is parsed inside an array and inside an object: what follows the value
    must fit into both, which only a comma does, and then the array has a second element.
    """

    def whole(t: Column) -> Column:
        boxed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))).try_cast("array<variant>")
        named = F.try_parse_json(F.concat(F.lit('{"a":'), t, F.lit("}")))
        return F.when((F.size(boxed) == 1) & named.isNotNull(), F.get(boxed, F.lit(0)).try_cast("array<variant>"))

    return F.coalesce(whole(text), whole(F.regexp_replace(text, NO_NUMBER, "null")))


def verdicts(text: Column, n_items: Column) -> Column:
    """Booleans of a judge's answer, or null if it can't be used; the same as :func:`chatloom.operators.judging.read_verdicts` says.

    The first fenced array counts, else the widest bracketed part, else the whole text; if it is no
    JSON, stray backslashes are doubled. Every element must be an object whose ``satisfied`` is a
    boolean or says true or false; an empty array is right only for an empty checklist. An object with
    a key twice can't be used here.
    """
    fenced = F.regexp_extract(text, f"(?s){FENCED}", 1)
    wide = F.regexp_extract(text, f"(?s){WIDEST}", 0)
    raw = F.when(fenced != "", fenced).when(wide != "", wide).otherwise(text)
    found = F.coalesce(strict_array(raw), strict_array(F.regexp_replace(raw, STRAY, r"\\\\")))

    def satisfied(e: Column) -> Column:
        v = F.try_variant_get(e, "$.satisfied", "variant")
        says = F.lower(F.try_variant_get(e, "$.satisfied", "string"))
        word = F.when((F.schema_of_variant(v) == "STRING") & says.isin("true", "false"), says == "true")
        return F.when(F.schema_of_variant(e).startswith("OBJECT"), F.when(F.schema_of_variant(v) == "BOOLEAN", F.try_variant_get(e, "$.satisfied", "boolean")).otherwise(word))

    got = F.transform(found, satisfied)
    good = F.forall(got, lambda b: b.isNotNull()) & ((F.size(got) > 0) | (n_items == 0))
    return F.when(good, got)


def summary(details: DataFrame) -> DataFrame:
    """Rates over ``details`` (tag, n_satisfied, n_items; null where the judge failed), in one row."""
    rate = F.when(F.col("n_satisfied").isNotNull(), F.coalesce(F.try_divide("n_satisfied", "n_items"), F.lit(0.0)))
    return details.withColumn("rate", rate).agg(
        F.count("*").alias("n_tasks"),
        F.count_if(F.col("rate").isNull()).alias("n_failed"),
        F.count("rate").alias("n_valid"),
        F.round(F.coalesce(F.avg("rate"), F.lit(0.0)) * 100, 2).alias("macro_rate"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("rate").isNotNull(), F.col("n_satisfied"))), F.sum(F.when(F.col("rate").isNotNull(), F.col("n_items")))), F.lit(0.0)) * 100, 2).alias("micro_rate"),
    )


def tag_of(*tags: Column) -> Column:
    """The first tag that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tags], F.lit("unknown"))


def by_tag(details: DataFrame) -> DataFrame:
    rate = F.coalesce(F.try_divide("n_satisfied", "n_items"), F.lit(0.0))
    rows = details.where(F.col("n_satisfied").isNotNull())
    return rows.groupBy(tag_of(F.col("tag")).alias("tag")).agg(F.round(F.avg(rate) * 100, 2).alias("rate"), F.count("*").alias("n"))


def usage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sums that skip nulls, 0 without any."""
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns])


def outcomes(first: DataFrame, second: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """key, tag, n1, n2, outcome for keys of both sides (key, tag, n_satisfied); ``only1`` and ``only2`` mark the others.

    No common key is an error, unless ``strict`` is off: it is looked for among the keys alone, up to the first.
    """
    if strict and first.select(key).join(second.select(key), key, "left_semi").isEmpty():
        raise ValueError(f"no {key} is on both sides")
    a = first.select(key, F.col("tag").alias("t1"), F.col("n_satisfied").alias("n1"), F.lit(True).alias("in1"))
    b = second.select(key, F.col("tag").alias("t2"), F.col("n_satisfied").alias("n2"), F.lit(True).alias("in2"))
    both = a.join(b, key, "full_outer")
    outcome = (
        F.when(F.col("in2").isNull(), "only1").when(F.col("in1").isNull(), "only2")
        .when(F.col("n1").isNull() | F.col("n2").isNull(), "failed")
        .when(F.col("n1") > F.col("n2"), "win").when(F.col("n1") < F.col("n2"), "loss").otherwise("tie")
    )
    return both.select(key, tag_of(F.col("t1"), F.col("t2")).alias("tag"), "n1", "n2", outcome.alias("outcome"))


def _counts() -> list[Column]:
    return [F.count_if(F.col("outcome") == o).alias(n) for o, n in (("win", "wins"), ("tie", "ties"), ("loss", "losses"))]


def pairwise_summary(rows: DataFrame) -> DataFrame:
    others = [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("failed", "only1", "only2")]
    s = rows.agg(*_counts(), *others)
    n = F.col("wins") + F.col("ties") + F.col("losses")
    rate = lambda x: F.round(F.coalesce(F.try_divide(x, n), F.lit(0.0)) * 100, 2)
    return s.withColumns({"n": n, "win_rate": rate(F.col("wins")), "tie_rate": rate(F.col("ties")), "loss_rate": rate(F.col("losses")), "adjusted_rate": rate(F.col("wins") + 0.5 * F.col("ties"))})


def pairwise_by_tag(rows: DataFrame) -> DataFrame:
    s = rows.where(F.col("outcome").isin("win", "tie", "loss")).groupBy("tag").agg(*_counts(), F.count("*").alias("n"))
    return s.withColumn("win_rate", F.round(F.col("wins") / F.col("n") * 100, 2))


def by_rate(tags: DataFrame) -> DataFrame:
    """Categories (tag, rate, ...) by falling rate, then by name."""
    return tags.orderBy(F.col("rate").desc(), "tag")


def satisfied(verdicts: Column) -> Column:
    """How many items of a record are satisfied, null if the judge failed."""
    return F.size(F.filter(verdicts, lambda v: v["satisfied"])).cast("long")
