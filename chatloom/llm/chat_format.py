"""Prefix-target expansion of conversations into training examples.

Every assistant turn becomes an example of its own: all preceding turns are the
context and only that reply is trainable.  Turns after the last assistant turn,
or a conversation without one, give a last example with nothing trainable, so
that the examples of a conversation hold all its turns.

Cases: null role, text or turn count as empty strings and as a turn before all
others; turns are ordered by turn, then role, then text, so ties and repeated
rows keep all rows in a stable order; very long texts are taken whole; null conversation ids form one
conversation; an empty table gives no example; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.runtime import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings of this template and of common others: a first character, then the rest.
CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])"


def escape(text: Column) -> Column:
    r"""No control string is left: a backslash goes in after its first character; one that has k backslashes there gets k + 1."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end of ``turns`` (conv_id, turn, role, text).

    ``text`` is the formatted context with the example's reply; code points
    ``loss_start`` to ``loss_end`` (exclusive) are trainable, none if both are equal.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    convs = convs.withColumn(
        "parts",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(OPEN), escape(_escape_role(t["role"])), F.lit("\n")).alias("head"),
                escape(t["text"]).alias("body"),
                (t["role"] == "assistant").alias("reply"),
            ),
        ),
    ).drop("turns")
    last = F.size("parts") - 1
    targets = F.filter(
        F.transform("parts", lambda p, i: F.struct(i.alias("at"), p["reply"].alias("reply"))),
        lambda x: x["reply"] | (x["at"] == last),
    )
    out = convs.select("conv_id", "parts", F.posexplode(targets).alias("example", "target"))
    shown = F.slice("parts", F.lit(1), F.col("target.at") + 1)
    text = F.array_join(F.transform(shown, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))), "")
    out = out.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        text.alias("text"),
        F.length(F.element_at("parts", F.col("target.at") + 1)["body"]).alias("body_chars"),
        F.col("target.reply").alias("reply"),
    )
    end = F.length("text") - F.lit(len(CLOSE) + 1)
    return out.select(
        "conv_id",
        "example",
        "text",
        F.when(F.col("reply"), end - F.col("body_chars")).otherwise(end).cast("long").alias("loss_start"),
        end.cast("long").alias("loss_end"),
    )


def turns_of(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds."""
    pieces = F.split(text, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        cut = F.instr(body, "\n")
        return F.struct(
            _unescape_role(unescape(F.substring(body, F.lit(1), cut - 1))).alias("role"),
            unescape(F.substring(body, cut + 1, F.length(body))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_back(made: DataFrame) -> DataFrame:
    """One row per conversation, from its examples' texts and loss spans alone."""
    loss = unescape(F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    made = made.withColumn("loss", loss)
    per = made.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    turns = turns_of(F.col("whole"))
    joined = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_control_case(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose two turns consist of control strings."""
    spark = turns.sparkSession
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(examples(with_control_case(table(spark, sf_dir, "conversations"))))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    length('<|im_start|>' || replace(replace(role, '%', '%25'), chr(10), '%0A') || chr(10) || text || '<|im_end|>' || chr(10))
      + len(regexp_extract_all(replace(role, '%', '%25'), '[<\[]\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])'))
      + len(regexp_extract_all(text, '[<\[]\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\])')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns
), prefixed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR pos = n) AS BIGINT) AS formatted_chars
FROM prefixed GROUP BY conv_id
"""
