"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all have the same expected number of copies, its target
over its size.  The whole part is given to each; the fractions are rounded
together: two documents meet, one's fraction is raised and the other's lowered
by the same number of words until one is 0 or 1 (which way is drawn so that both
keep their expectation), and the other goes on to the next meeting.  Blocks of
documents are folded first, what each leaves over is folded in blocks again, and
so on: a reduction tree whose last value, less than one document per source, is
drawn by itself.  So a source's taken words differ from its target by less than
one document's size.  Draws are hashes of ids: reruns agree, whatever the
partitions.

Cases: null texts and texts without words have size 0 and give 0 words; null
sources are one source, the last; rows with equal doc_id, source and size are
counted first and stand for each other, however many; very long texts are a size
like others; an empty table gives no row; extra columns are kept out of the plan and join back in ``mixed``.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.llm.skew import salted_join
from chatloom.runtime import materialise, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK = 128
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"

_ENTRY = "struct<h:bigint,doc_id:bigint,size:bigint,rows:bigint,whole:bigint,sure:bigint,r:double>"
_DONE = "struct<doc_id:bigint,size:bigint,rows:bigint,whole:bigint,more:bigint>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, entries, source_size, target of ``sizes`` (source, entries, source_size): one row per source.

    The sources' order and the level at which caps leave off need their totals side by side: this
    one step sorts the table of sources (not of rows) in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", rest / left)
    # the first source in order of cap over weight that stays below its cap fixes the level of all that do
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return s.select("source", "entries", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _draw(level: int, *cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED + level), *cols), 11) * F.lit(2.0**-53)


def _fold(level: int):
    def meet(acc: Column, j: Column) -> Column:
        i = acc["carry"]
        up_i, down_i = (1 - i["r"]) * i["size"], i["r"] * i["size"]
        up_j, down_j = (1 - j["r"]) * j["size"], j["r"] * j["size"]
        a, b = F.least(up_i, down_j), F.least(down_i, up_j)
        raise_i = _draw(level, i["h"], j["h"]) * (a + b) < b
        i_done = F.when(raise_i, up_i <= down_j).otherwise(down_i <= up_j)

        def done(x: Column, more: Column) -> Column:
            return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["rows"].alias("rows"), x["whole"].alias("whole"), (x["sure"] + more.cast("long")).alias("more"))

        def left(x: Column, r: Column) -> Column:
            return x.withField("r", F.least(F.lit(1.0), F.greatest(F.lit(0.0), r)))

        # in every case the one that is left takes over the other's words
        carry = F.when(i_done, left(j, F.when(raise_i, (down_j - up_i) / j["size"]).otherwise((down_j + down_i) / j["size"]))).otherwise(
            left(i, F.when(raise_i, (down_i + down_j) / i["size"]).otherwise((down_i - up_j) / i["size"]))
        )
        out = F.when(i_done, done(i, raise_i)).otherwise(done(j, ~raise_i))
        first = i.isNull()
        return F.struct(F.when(first, j).otherwise(carry).alias("carry"), F.when(first, acc["done"]).otherwise(F.array_append(acc["done"], out)).alias("done"))

    return meet


def _level(entries: DataFrame, level: int) -> DataFrame:
    """One level of the tree: entries (source, block, e) folded within (source, block)."""
    start = F.struct(F.lit(None).cast(_ENTRY).alias("carry"), F.array().cast(f"array<{_DONE}>").alias("done"))
    blocks = entries.groupBy("source", "block").agg(F.array_sort(F.collect_list("e")).alias("es"))
    return blocks.select("source", "block", F.aggregate("es", start, _fold(level)).alias("f")).select("source", "block", "f.carry", "f.done")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, rows, whole, more: of ``rows`` equal rows each gets ``whole`` copies, and ``more`` of them one besides."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    entries = materialise(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-entries")
    sizes = entries.groupBy("source").agg(F.count("*").alias("entries"), F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    wanted = materialise(targets(sizes, weights, most), "mix-targets")
    each = salted_join(entries, wanted, ["source"])
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    each = each.withColumn("whole", F.floor(copies).cast("long")).withColumn("sum_r", (copies - F.floor(copies)) * F.col("rows"))
    each = each.withColumn("sure", F.floor("sum_r").cast("long")).withColumn("r", F.col("sum_r") - F.floor("sum_r"))
    settled = (F.col("r") <= 0) | (F.col("size") == 0)
    cols = ["doc_id", "source", "size", "rows", "whole"]
    parts = [each.where(settled).select(*cols, F.col("sure").alias("more"))]

    h = F.xxhash64(F.lit(SEED), "doc_id", "source", "size")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("entries") / block))
    state = each.where(~settled).select("source", F.pmod(h, blocks).alias("block"), F.struct(h.alias("h"), "doc_id", "size", "rows", "whole", "sure", "r").alias("e"))
    most_blocks = wanted.agg(F.max(F.ceil(F.col("entries") / block))).first()[0] or 1
    level = 0
    while True:
        folded = materialise(_level(state, level), f"mix-level{level}")
        parts.append(folded.select("source", F.explode("done").alias("d")).select("d.doc_id", "source", "d.size", "d.rows", "d.whole", "d.more"))
        left = folded.where(F.col("carry").isNotNull())
        if most_blocks <= 1:
            break
        state = left.select("source", F.floor(F.col("block") / block).alias("block"), F.col("carry").alias("e"))
        most_blocks = -(-most_blocks // block)
        level += 1
    last = _draw(level + 1, F.col("carry.h")) < F.col("carry.r")
    parts.append(left.select("carry.doc_id", "source", "carry.size", "carry.rows", "carry.whole", (F.col("carry.sure") + last.cast("long")).alias("more")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return salted_join(out, wanted.drop("entries"), ["source"])


def per_row(planned: DataFrame) -> DataFrame:
    """The plan with a row for each row of the documents: ``copy_row`` numbers equal rows from 1."""
    out = planned.withColumn("copy_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.withColumn("copies", F.col("whole") + (F.col("copy_row") <= F.col("more")).cast("long")).drop("rows", "whole", "more")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns and ``copies`` and ``taken`` (words)."""
    names = [f"__k{i}" for i in range(5)]

    def keys(size: Column) -> dict[str, Column]:
        id_, source = F.col("doc_id").cast("long"), F.col("source")
        return dict(zip(names, [F.coalesce(id_, F.lit(0)), id_.isNull(), F.coalesce(source, F.lit("")), source.isNull(), size], strict=True))

    planned = plan(docs, **options).where((F.col("whole") > 0) | (F.col("more") > 0))
    planned = planned.withColumns(keys(F.col("size"))).select(*names, F.col("whole").alias("__w"), F.col("more").alias("__m"))
    # columns of one's own may have the names that are used here
    own = {n: f"__own{n}" for n in (*names, "__w", "__m", "__n") if n in docs.columns}
    rows = docs.withColumnsRenamed(own).withColumns(keys(word_count(F.col("text")))).join(planned.hint("merge"), names)
    # equal rows are numbered where the join has put them
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64("text"))))
    copies = F.col("__w") + (F.col("__n") <= F.col("__m")).cast("long")
    out = rows.withColumns({"copies": copies, "taken": copies * F.col("__k4")})
    return out.where(F.col("copies") > 0).drop(*names, "__w", "__m", "__n").withColumnsRenamed({v: k for k, v in own.items()})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = per_row(plan(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
