"""Spelling variants: words one code point apart, found by wildcard groups and without pairs.

Words are ranked by falling count, then by code points; the rank stands for the word from
there on.  Each word of L code points sends L keys (position, what stands before, what
stands after), which are also the places and results of its deletions, and one key of its own:

- words with one key differ by a replacement there.  Such a group keeps its size and the
  two words of least rank, for each member's count of others and its best other;
- a key that equals a word is a deletion that leads to it: the word gets the number of
  longer ones and the best of them, each of these gets the word.  A run of equal code
  points deletes to one result, which only its first position sends.

Words meet in groups only: a group has as many words as one place has code points, and
as many longer ones as that times the places, so no group grows with the corpus.  What the
groups say is added up by word: the number of near words and the least rank, which is the
near word of largest count.  A word's form is that word if it is at least ``factor`` times as frequent;
counts at least double along forms, so chains are short, and roots come by doubling the steps.

Keys are four polynomial hashes modulo primes below 2^31 (124 bits in all), made for all
positions of a word at once, so a very long word costs as many rows as it has code points, of fixed size.

Cases: null texts have no words; a null doc_id counts as the empty string in the hash of
:func:`query`; ties of count go to the word that sorts first; repeated rows count each;
an empty table, or one without frequent words, gives no row; very long words and texts are
taken whole; extra columns, whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.skew import salted_join
from chatloom.operators.ranking import rank_all
from chatloom.runtime import discard, materialise, ship, table

LETTERS = r"[A-Za-zÀ-ÿ]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Primes and bases of the hashes, and rows of a batch of keys.
_PRIMES, _BASES = (2147483647, 2147483629, 2147483587, 2147483579), (1000003, 917519273, 1327217885, 40503697)
_ROWS = 1 << 18


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo a prime below 2^31."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def keys(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (two 62-bit columns) of the words ``points[first[i]:first[i + 1]]`` and, position by position, of the words without that code point."""
    size = np.diff(first)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(points)) - first[:-1][word]
    whole, without = np.zeros((len(size), 4), np.uint64), np.zeros((len(points), 4), np.uint64)
    for j, (p, base) in enumerate(zip(_PRIMES, _BASES, strict=True)):
        prime, back = np.uint64(p), np.uint64(pow(base, -1, p))
        value = (points.astype(np.uint64) * np.uint64(2654435761) + np.uint64(j + 1)) % prime
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(base, p, int(size.max(initial=1)))[place] % prime, dtype=np.uint64)])
        begin, end = sums[first[:-1]], sums[first[1:]]
        whole[:, j] = (end - begin) % prime
        after = (end[word] - sums[1:]) % prime * back % prime
        without[:, j] = (sums[:-1] - begin[word] + after) % prime
    return tuple((h[:, ::2] << np.uint64(31) | h[:, 1::2]).astype(np.int64) for h in (whole, without))


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hash_a, hash_b, place (-1: the word itself), rank, sent (this deletion's result is new) of each word."""
    names = ["hash_a", "hash_b", "place", "rank", "sent"]
    for b in batches:
        size = pc.utf8_length(b["word"]).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < b.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(size[at:]), _ROWS, side="right")))
            part, length = b.slice(at, n), size[at : at + n]
            at += n
            points = np.frombuffer("".join(part["word"].to_pylist()).encode("utf-32-le"), np.uint32)
            first, rank = np.concatenate([[0], np.cumsum(length)]), part["rank"].to_numpy()
            whole, without = keys(points, first)
            place = np.arange(len(points)) - np.repeat(first[:-1], length)
            sent = np.ones(len(points), bool)
            sent[1:] = points[1:] != points[:-1]
            sent |= place == 0
            own = (whole[:, 0], whole[:, 1], np.full(n, -1), rank, np.zeros(n, bool))
            for cols in (own, (without[:, 0], without[:, 1], place, np.repeat(rank, length), sent)):
                for lo in range(0, len(cols[0]), _ROWS):
                    a, h, p, r, s = (c[lo : lo + _ROWS] for c in cols)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(h), pa.array(p.astype(np.int32)), pa.array(r), pa.array(s)], names)


def neighbours(words: DataFrame) -> DataFrame:
    """rank, n_near, best (the least rank near it) of the words (rank, word) that have near words."""
    rows = words.select("rank", "word").mapInArrow(_key_rows, "hash_a long, hash_b long, place int, rank long, sent boolean")
    key, group = Window.partitionBy("hash_a", "hash_b"), Window.partitionBy("hash_a", "hash_b", "place")
    is_word = F.col("place") < 0
    rows = rows.select(
        "rank", "place", "sent", is_word.alias("is_word"),
        F.count("*").over(group).alias("size"),
        F.min("rank").over(group).alias("top"),
        F.lead("rank").over(group.orderBy("rank")).alias("next"),
        F.max(F.when(is_word, F.col("rank"))).over(key).alias("shorter"),
        F.count_if("sent").over(key).alias("n_longer"),
        F.min(F.when(F.col("sent"), F.col("rank"))).over(key).alias("longer"),
    )
    replaced = ~F.col("is_word") & (F.col("size") > 1)
    deleted = F.col("sent") & F.col("shorter").isNotNull()
    inserted = F.col("is_word") & (F.col("n_longer") > 0)
    n = F.when(replaced, F.col("size") - 1).otherwise(0) + F.when(deleted, 1).otherwise(0) + F.when(inserted, F.col("n_longer")).otherwise(0)
    other = F.when(F.col("rank") == F.col("top"), F.col("next")).otherwise(F.col("top"))
    best = F.least(F.when(replaced, other), F.when(deleted, F.col("shorter")), F.when(inserted, F.col("longer")))
    return rows.where(replaced | deleted | inserted).groupBy("rank").agg(F.sum(n).alias("n_near"), F.min(best).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """rank, root of the rows (rank, up): where the steps up end. Each round doubles the steps; a lower rank is a more frequent word, so no step leads back."""
    at = materialise(forms, "spelling-steps")
    while True:
        step = at.select(F.col("rank").alias("up"), F.col("up").alias("further"))
        after = materialise(salted_join(at, step, ["up"], salts=4).select("rank", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "spelling-steps")
        discard(at)
        at = after.select("rank", "up")
        at._chatloom_path = after._chatloom_path
        if not after.where("moved").head(1):
            return at.withColumnRenamed("up", "root")


def variants(counts: DataFrame, factor: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n, root of the distinct words of ``counts`` (word, n)."""
    ship(counts.sparkSession)
    ranked = rank_all(counts.select("word", F.col("n").cast("long").alias("n"), (-F.col("n")).alias("order")), ["order", "word"])
    words = materialise(ranked.select("rank", "word", "n"), "spelling-words")
    near = words.join(neighbours(words), "rank", "left")
    best = words.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = near.join(best, "best", "left")
    is_form = F.col("form_n") >= factor * F.col("n")
    near = near.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n")])
    near = materialise(near, "spelling-near")
    roots = _roots(near.where(F.col("best").isNotNull()).select("rank", F.col("best").alias("up")))
    named = roots.join(words.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root")
    return near.join(named, "rank", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root_word", "word").alias("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("doc", F.translate("run", _CAPITALS, _CAPITALS.lower()).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    counts = runs.select(F.when(h % 97 == 0, cut).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return variants(counts.where((F.length("word") >= 5) & (F.col("n") >= 3))).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE r AS MATERIALIZED (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL
), t AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END, i)) AS crc
), h AS MATERIALIZED (
  SELECT run, n, xor(4294967295, list_reduce(flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)),
    lambda a, b: xor(crc[xor(a, b) % 256 + 1], a // 256), CAST(4294967295 AS BIGINT))) AS h FROM r, t
), v AS MATERIALIZED (
  SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), d AS MATERIALIZED (
  SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)
), e AS (
  SELECT a.word AS word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, rest FROM d JOIN v ON v.word = rest
  UNION SELECT rest, d.word FROM d JOIN v ON v.word = rest
), b AS (
  SELECT e.word, count(*) AS n_near, arg_min(other, (-o.n, other)) AS best, arg_min(o.n, (-o.n, other)) AS best_n FROM e JOIN v o ON o.word = other GROUP BY e.word
), f AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * v.n THEN best END AS form, CASE WHEN best_n >= 2 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)
), s AS (
  SELECT word, word AS root, form AS up FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.up
)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, root FROM s WHERE up IS NULL) USING (word)
"""
