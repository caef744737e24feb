"""Corpus preparation: filters, frequent-phrase dedup, routed and stratified user-disjoint splits, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import words
from chatloom.operators.packed import frequent_places
from chatloom.operators.ranking import rank_all
from chatloom.runtime import materialise


def by_language(df: DataFrame, language: str = "English", column: str = "language", ignore_case: bool = False) -> DataFrame:
    """Rows of one language; null never matches."""
    c = F.col(column)
    return df.where(F.lower(c) == language.lower() if ignore_case else c == language)


def first_user_turns(turns: DataFrame) -> DataFrame:
    """conv_id, text: the first user turn of each conversation that has one."""
    return turns.where(F.col("role") == "user").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))


#: Characters of texts a shard of n-grams: some four million n-grams, twelve million at most.
SHARD_CHARS = 24_000_000


def _text_hash(text: str) -> Column:
    """40 bits; texts that share one share their places, which strings then tell apart."""
    return F.shiftrightunsigned(F.xxhash64(text), 24)


def _frequent_places(df: DataFrame, text: str, n: int, threshold: int) -> DataFrame:
    """t, places: where in the texts of hash ``t`` n-grams start whose hash occurs more than ``threshold`` times.

    What is shuffled for an n-gram is six bytes of its hash and its share of packed places, once, and no string.
    """
    chars = df.agg(F.sum(F.length(text).cast("long")).alias("n")).first().n or 0
    cut = df.select(_text_hash(text).alias("t"), words(F.lower(text)).alias("ws"))
    hashes = F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.xxhash64(F.slice("ws", i, n)))
    rows = cut.where(F.size("ws") >= n).select("t", hashes.alias("hs"))
    return materialise(frequent_places(rows, chars // SHARD_CHARS + 1, threshold), "hot-places")


def _held(df: DataFrame, key: str, text: str, n: int, threshold: int) -> DataFrame:
    """id, text, places of the rows of ``df`` that have n-grams which may occur more than ``threshold`` times.

    Texts and places meet by sorting at every size: a broadcast would pass all places through the driver.
    """
    places = _frequent_places(df, text, n, threshold)
    own = df.select(F.col(key).alias("id"), F.col(text).alias("text"), _text_hash(text).alias("t"), F.size(words(F.lower(text))).alias("size"))
    return own.join(places.hint("merge"), "t").select("id", "text", F.filter("places", lambda p: p <= F.col("size") - n).alias("places"))


def _grams_at(held: DataFrame, n: int) -> DataFrame:
    """id, ng: the n-grams at the places of each text."""
    held = held.select("id", "places", words(F.lower("text")).alias("ws"))
    return held.select("id", F.explode(F.transform("places", lambda p: F.array_join(F.slice("ws", p + 1, n), " "))).alias("ng"))


def hot_ngrams(df: DataFrame, key: str, text: str, n: int = 7, threshold: int = 100) -> DataFrame:
    """ng, n of the n-grams of lower-cased words that occur more than ``threshold`` times in all texts, repeats counted."""
    grams = _grams_at(_held(df, key, text, n, threshold), n)
    return grams.groupBy("ng").agg(F.count("*").alias("n")).where(F.col("n") > threshold)


def mark_repetitive(df: DataFrame, key: str, text: str, n: int = 7, threshold: int = 100) -> DataFrame:
    """``df`` with ``kept``: false if any n-gram of the text occurs more than ``threshold`` times in all texts, repeats counted.

    What hashes find is counted by strings: those that are too rare (their hash is another's) tell nothing, and usually there are none.
    """
    held = _held(df, key, text, n, threshold)
    rare = materialise(_grams_at(held, n).groupBy("ng").agg(F.count("*").alias("n")).where(F.col("n") <= threshold).select("ng"), "rare-grams")
    gone = held.where(F.size("places") > 0) if rare.isEmpty() else _grams_at(held, n).join(rare, "ng", "left_anti")
    gone = gone.select(F.col("id").alias("__id")).distinct()
    return df.join(gone, df[key] == gone["__id"], "left").withColumn("kept", F.col("__id").isNull()).drop("__id")


def user_key(ip: Column, country: Column) -> Column:
    return F.concat(F.coalesce(ip, F.lit("unknown")), F.lit("_"), F.coalesce(country, F.lit("unknown")))


def split_users(users: DataFrame, user: str, stratum: str, train: float = 0.89, val: float = 0.05, test: float = 0.06, seed: int = 42) -> DataFrame:
    """One row per distinct (user, stratum) with its split: in each stratum users in hash order, cut at floor(train n) and floor(val n) more.

    Places come from a sort by range over all strata: no stratum is one task.
    """
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError("the ratios must sum to 1")
    each = users.select(user, stratum).distinct()
    by = F.md5(F.concat(F.col(user).cast("string"), F.lit(f":{seed}")).cast("binary"))
    ranked = materialise(rank_all(each.withColumn("__h", by), [stratum, "__h", user]), "split-ranks")
    sizes = ranked.groupBy(stratum).agg(F.count("*").alias("__n"), F.min("rank").alias("__first")).withColumnRenamed(stratum, "__s")
    ranked = ranked.join(sizes, ranked[stratum].eqNullSafe(F.col("__s")))
    a, b = F.floor(F.col("__n") * F.lit(float(train))), F.floor(F.col("__n") * F.lit(float(val)))
    place = F.col("rank") - F.col("__first")
    return ranked.select(user, stratum, F.when(place < a, "train").when(place < a + b, "val").otherwise("test").alias("split"))


def split_rows(df: DataFrame, user: str, stratum: str, forced: DataFrame | None = None, key: str | None = None, **ratios) -> DataFrame:
    """``df`` with ``split`` and ``forced``: rows whose key is in ``forced`` go to test; the others follow their user."""
    if forced is not None:
        ids = forced.select(F.col(key).alias("__id")).where(F.col("__id").isNotNull()).distinct()
        df = df.join(ids, df[key] == F.col("__id"), "left").withColumn("forced", F.col("__id").isNotNull()).drop("__id")
    else:
        df = df.withColumn("forced", F.lit(False))
    users = split_users(df.where(~F.col("forced")), user, stratum, **ratios).withColumnsRenamed({user: "__u", stratum: "__s"})
    out = df.join(users, df[user].eqNullSafe(F.col("__u")) & df[stratum].eqNullSafe(F.col("__s")), "left").drop("__u", "__s")
    return out.withColumn("split", F.when(F.col("forced"), "test").otherwise(F.col("split")))


def split_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_if("forced").alias("n_forced"))


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key a former run has not finished; rows without a key stay."""
    return df.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def last_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("r"))
    return last.select(key, "r.*")


def with_cached(tasks: DataFrame, cache: DataFrame, key: str, defaults: dict, order: str | None = None) -> DataFrame:
    """All tasks with their cached values, defaults where there are none, and ``missing``.

    Of several cached rows of a key the last by ``order`` counts (any one of them without an order); rows of other keys are left out.
    """
    columns = [c for c in cache.columns if c not in (key, order)]
    cache = last_per_key(cache, key, order, columns) if order else cache.dropDuplicates([key])
    out = tasks.join(cache.withColumn("__hit", F.lit(True)), key, "left").withColumn("missing", F.col("__hit").isNull()).drop("__hit")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def missing_count(joined: DataFrame) -> DataFrame:
    """How many tasks had nothing cached."""
    return joined.agg(F.count_if("missing").alias("n_missing"))


def distinct_ids(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def id_overlap(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """key, side ("both", "only1", "only2") of the distinct ids of two tables; raises nothing, see :func:`common_ids`."""
    a, b = distinct_ids(first, key).withColumn("__a", F.lit(True)), distinct_ids(second, key).withColumn("__b", F.lit(True))
    side = F.when(F.col("__b").isNull(), "only1").when(F.col("__a").isNull(), "only2").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def common_ids(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Ids of both tables in ascending order; an error if there are none."""
    both = distinct_ids(first, key).join(distinct_ids(second, key), key, "left_semi")
    if both.isEmpty():
        raise ValueError(f"no {key} is in both tables")
    return both.orderBy(key)


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns by name; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def zipped(left: Column, right: Column) -> Column:
    """Pairs (left, right) of two arrays by place, as many as the shorter one has."""
    both = F.transform(left, lambda x, i: F.struct(x.alias("left"), F.get(right, i).alias("right")))
    return F.slice(both, F.lit(1), F.least(F.size(left), F.size(right)))


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows in a given order."""
    if not order:
        raise ValueError("the first rows of what order?")
    return df.orderBy(*order).limit(n)


def assigned(df: DataFrame, key: str, ports: int) -> DataFrame:
    """``key``, ``port``: rows in order of key in turn to the port with the fewest, the lowest on ties."""
    return rank_all(df.select(key), [key]).select(key, F.pmod(F.col("rank") - 1, F.lit(ports)).cast("int").alias("port"))
