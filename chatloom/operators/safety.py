"""Fine-tuning rows of a safety classifier, and rows that leave categories out of the prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Fixed value: the response of an example that is a prompt only.
NO_RESPONSE = "N/A"


def _order(shown: Column, key: Column, shuffle: bool) -> Column:
    """Shown categories by number, or in an order that a hash of the row decides."""
    if not shuffle:
        return F.array_sort(shown)
    by = F.transform(shown, lambda c: F.struct(_hash(key, c, "order").alias("h"), c.alias("c")))
    return F.transform(F.array_sort(by), lambda x: x["c"])


def _hash(key: Column, category: Column, what: str) -> Column:
    return F.md5(F.concat_ws(":", key.cast("string"), category.cast("string"), F.lit(what), F.lit(str(SEED))).cast("binary"))


def category_text(shown: Column, categories: list[tuple[str, str]], prefix: str, described: bool) -> Column:
    """The shown categories, numbered anew, a line each; descriptions follow on lines of their own."""
    names, texts = (F.array(*[F.lit(c[i]) for c in categories]) for i in range(2))

    def line(c: Column, i: Column) -> Column:
        name = F.concat(F.lit(prefix), (i + 1).cast("string"), F.lit(": "), F.element_at(names, c), F.lit(". "))
        return F.concat(name, F.lit("\n"), F.element_at(texts, c)) if described else name

    return F.array_join(F.transform(shown, line), "\n")


def target(label: Column, violated: Column, shown: Column, explanation: Column | None, prefix: str, position: str | None) -> Column:
    """The decision, the violated categories under their new numbers, sorted as strings, and the explanation before or after it."""
    codes = F.transform(F.array_distinct(violated), lambda c: F.concat(F.lit(prefix), F.array_position(shown, c).cast("string")))
    said = F.when(label == "unsafe", F.concat(label, F.lit("\n"), F.array_join(F.array_sort(codes), ","))).otherwise(label)
    if position is None:
        return said
    why = F.concat(F.lit("Explanation: "), explanation)
    return F.concat(why, F.lit("\n"), said) if position == "before" else F.concat(said, F.lit("\n"), why)


def _keep_some(candidates: Column, key: Column, what: str, at_least_one: Column) -> Column:
    """About half of some categories, by hash; the one of least hash if all went and one must stay."""
    kept = F.filter(candidates, lambda c: _hash(key, c, what) < F.lit("8"))
    first = F.transform(F.slice(F.array_sort(F.transform(candidates, lambda c: F.struct(_hash(key, c, what).alias("h"), c.alias("c")))), 1, 1), lambda x: x["c"])
    return F.when((F.size(kept) == 0) & at_least_one, first).otherwise(kept)


def training_rows(
    rows: DataFrame, key: str, categories: list[tuple[str, str]], template: str, prefix: str = "O", described: bool = False, position: str | None = None,
    augment: bool = True, shuffle: bool = False, safe_because: str = "",
) -> DataFrame:
    """key, variant, text, label of rows (key, prompt, response, label, violated (numbers from 1), explanation).

    ``template`` has the places ``{guidelines}`` and ``{conversation}``. The variant "all" shows all categories. With ``augment`` two more
    follow: "fewer" leaves out a part of the categories that are not violated, and of an unsafe row "none" leaves out all violated ones
    and a part of the others, and is safe, because of ``safe_because``. What is left out is a matter of hashes: reruns agree.
    At least one category is shown, in "none" one that is not violated, if there is one.
    """
    every = F.array(*[F.lit(i) for i in range(1, len(categories) + 1)])
    k, violated = F.col(key), F.coalesce(F.col("violated"), F.array().cast("array<int>"))
    clean = F.array_except(every, violated)
    fewer = F.concat(F.array_intersect(every, violated), _keep_some(clean, k, "fewer", F.size(violated) == 0))
    none = _keep_some(clean, k, "none", F.lit(True))

    def variant(name: str, shown: Column, label: Column, bad: Column, why: Column) -> Column:
        return F.struct(F.lit(name).alias("variant"), _order(shown, k, shuffle).alias("shown"), label.alias("label"), bad.alias("violated"), why.alias("explanation"))

    made = [variant("all", every, F.col("label"), violated, F.col("explanation"))]
    if augment:
        made.append(variant("fewer", fewer, F.col("label"), violated, F.col("explanation")))
        made.append(F.when(F.col("label") == "unsafe", variant("none", none, F.lit("safe"), F.array().cast("array<int>"), F.lit(safe_because))))
    out = rows.withColumn("v", F.explode(F.filter(F.array(*made), lambda v: v.isNotNull())))
    said = F.concat(F.lit("human: "), F.col("prompt"))
    said = F.when(F.col("response") == NO_RESPONSE, said).otherwise(F.concat(said, F.lit("\n\nchatbot: "), F.col("response")))
    before, rest = template.split("{guidelines}")
    between, after = rest.split("{conversation}")
    prompt = F.concat(F.lit(before), category_text(F.col("v.shown"), categories, prefix, described), F.lit(between), said, F.lit(after))
    answer = target(F.col("v.label"), F.col("v.violated"), F.col("v.shown"), F.col("v.explanation"), prefix, position)
    return out.select(key, F.col("v.variant").alias("variant"), F.concat(prompt, F.lit(" "), answer).alias("text"), F.col("v.label").alias("label"))
