"""Training rows: loss masks, packing, batching, padding, and the metrics of a run."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.functions.text import strip
from chatloom.operators import bpe
from chatloom.operators.prompts import alternates, reject_reason
from chatloom.operators.ranking import rank_all
from chatloom.operators.scan import fold_ranges, running_before

IGNORED = -100
END_CONVERSATION = "<|endconversation|>"
#: By template family the begin of a text, text before and after a message, the name of an assistant,
#: the prompt for a user turn, and what stands before and after the system text.
FAMILIES = {
    "header": ("<|begin_of_text|>", "<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", "assistant", "<|start_header_id|>user<|end_header_id|>\n\n", "", ""),
    "dated": ("<|begin_of_text|>", "<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", "assistant", None, "Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n", ""),
    "im": ("", "<|im_start|>{role}\n", "<|im_end|>\n", "assistant", "<|im_start|>user\n", "", ""),
    "turn": ("<bos>", "<start_of_turn>{role}\n", "<end_of_turn>\n", "model", "<start_of_turn>user\n", "", "\n\n"),
}
#: Fixed value: the system text that a conversation without one gets.
DEFAULT_SYSTEM = {"im": "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."}


def _family(family: str) -> tuple:
    if family not in FAMILIES:
        raise ValueError(f"no template family {family!r}")
    return FAMILIES[family]


def _head(role: Column, before: str, assistant: str) -> Column:
    left, right = before.split("{role}")
    return F.concat(F.lit(left), F.when(role == "assistant", assistant).otherwise(role), F.lit(right))


def chat_text(turns: Column, family: str, system: Column | None = None, ask: bool = False) -> Column:
    """A conversation of user and assistant turns in the template of a family; ``ask``: with the head of an assistant's turn.

    The family "turn" folds the system text into the first user turn, "dated" puts dates before it, "im" has a default for it.
    "turn" has no text for roles that do not alternate.
    """
    bos, before, after, assistant, _, dates, gap = _family(family)
    # two families trim the texts of turns, and the dated one its system text
    text = strip if family != "im" else (lambda c: c)
    if system is None and family in DEFAULT_SYSTEM:
        system = F.lit(DEFAULT_SYSTEM[family])
    if family == "dated":
        system = strip(system) if system is not None else F.lit("")
    body = F.transform(turns, lambda t: F.concat(_head(t["role"], before, assistant), text(t["text"]), F.lit(after)))
    if family == "turn" and system is not None:
        first = F.lit(before.replace("{role}", "user"))
        folded = F.concat(first, system, F.lit(gap), F.substring(F.get(body, F.lit(0)), len(before.replace("{role}", "user")) + 1, 2**31 - 1))
        body = F.when(F.size(turns) > 0, F.concat(F.array(folded), F.slice(body, 2, F.greatest(F.size(turns) - 1, F.lit(0))))).otherwise(body)
    elif system is not None:
        kept = text(system) if family == "header" else system
        body = F.concat(F.array(F.concat(_head(F.lit("system"), before, assistant), F.lit(dates), kept, F.lit(after))), body)
    head = _head(F.lit("assistant"), before, assistant) if ask else F.lit("")
    whole = F.concat(F.lit(bos), F.array_join(body, ""), head)
    return F.when(alternates(turns), whole) if family == "turn" else whole


def flip_segments(convs: DataFrame, intent: Column, family: str = "im") -> DataFrame:
    """conv_id, segments (text, trainable): the intent as system turn, every user turn trainable, and an end turn.

    The header of a user turn follows a turn that is no user's, and is not trained there.
    """
    bos, before, after, assistant, ask, _, gap = _family(family)
    if ask is None:
        raise ValueError(f"the template family {family!r} puts dates before a system text: it can't carry an intent")
    ok = convs.where((reject_reason(F.col("turns")) == 0) & (strip(intent) != ""))
    message = lambda role, text: F.struct(role.alias("role"), strip(text).alias("text"))
    turns = F.concat(
        F.array(message(F.lit("system"), intent)),
        F.transform("turns", lambda t: message(t["role"], t["text"])),
        F.array(message(F.lit("user"), F.lit(END_CONVERSATION))),
    )

    def segment(t: Column, i: Column) -> Column:
        user = t["role"] == "user"
        own = _head(t["role"], before, assistant)
        asked = (i > 0) & (F.get(turns, i - 1)["role"] != "user") & user
        body = F.concat(F.when(asked, F.lit("")).otherwise(own), t["text"], F.lit(after), F.when(user, F.lit("")).otherwise(F.lit(ask)))
        # a family without system turns opens the first user turn with the intent
        opening = F.concat(F.lit(bos), F.lit(ask), t["text"], F.lit(gap)) if gap else F.concat(F.lit(bos), body)
        return F.struct(F.when(i == 0, opening).otherwise(body).alias("text"), user.alias("trainable"))

    return ok.select("conv_id", F.transform(turns, segment).alias("segments"))


Tokenizer = Callable[[Column], Column]


def code_points(texts: Column) -> Column:
    """The plain tokenizer: ids of an array of texts, which follow one another, are their code points."""
    return F.transform(texts, lambda t: F.transform(F.regexp_extract_all(t, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long")))


def vocabulary(path: str, special: tuple[str, ...] = (END_CONVERSATION,)) -> Tokenizer:
    """A tokenizer from a byte-level vocabulary file, with special tokens added; see :mod:`chatloom.operators.bpe`."""
    return bpe.encoder(bpe.load(SparkSession.active(), path).with_special(special))


def training_ids(segments: DataFrame, tokenizer: Tokenizer = code_points, eos: int | None = None) -> DataFrame:
    """conv_id, input_ids, labels of rows (conv_id, segments): ids of what is not trainable have no label, nor has the end."""
    ids = tokenizer(F.col("segments.text"))
    rows = segments.withColumn("__ids", ids)
    nothing = lambda x: F.array_repeat(F.lit(IGNORED).cast("long"), F.size(x))
    labels = F.flatten(F.transform("__ids", lambda x, i: F.when(F.get("segments", i)["trainable"], x).otherwise(nothing(x))))
    end = lambda v: F.array().cast("array<bigint>") if eos is None else F.array(F.lit(v).cast("long"))
    return rows.select("conv_id", F.concat(F.flatten("__ids"), end(eos)).alias("input_ids"), F.concat(labels, end(IGNORED)).alias("labels"))


def label_counts(segments: Column) -> tuple[Column, Column]:
    """Characters of a row and those that are trainable."""
    total = F.aggregate(segments, F.lit(0).cast("long"), lambda a, s: a + F.length(s["text"]))
    kept = F.aggregate(segments, F.lit(0).cast("long"), lambda a, s: a + F.when(s["trainable"], F.length(s["text"])).otherwise(0))
    return total, kept


def masked(prompt_ids: Column, target_ids: Column) -> Column:
    """Labels of a prompt and its target: the prompt is ignored."""
    return F.concat(F.array_repeat(F.lit(IGNORED).cast("long"), F.size(prompt_ids)), target_ids)


def trainable_tokens(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def padded(ids: Column, size: int, value: int) -> Column:
    """``ids`` filled up to ``size``; longer ones are an error."""
    fill = F.concat(ids, F.array_repeat(F.lit(value).cast("long"), size - F.size(ids)))
    return F.when(F.size(ids) <= size, fill).otherwise(F.raise_error(F.lit(f"a row is longer than {size}")))


def unmasked(ids: Column) -> Column:
    """Labels of a sequence that is trained whole."""
    return ids


def padded_row(ids: Column, labels: Column, size: int = 4096, pad: int = 0) -> Column:
    """(input_ids, attention_mask, labels) filled up to ``size``: pad id, 0, and no label; longer rows are an error."""
    ones = F.transform(ids, lambda _: F.lit(1).cast("long"))
    return F.struct(padded(ids, size, pad).alias("input_ids"), padded(ones, size, 0).alias("attention_mask"), padded(labels, size, IGNORED).alias("labels"))


def greedy_pack(rows: DataFrame, key: str, size: str, chunk: int = 4096, drop_last: bool = True, partitions: int | None = None) -> DataFrame:
    """key, chunk_id of rows that are packed, in order of key: a buffer is closed when the next row would make it ``chunk`` or more.

    This is the packing of one stream, at any number of ``partitions``. The last, open buffer is dropped, unless ``drop_last`` is off.
    Rows of equal key follow by size; a null size is 0; a row of ``chunk`` or more has a buffer of its own.
    """
    out, closed = fold_ranges(rows, key, size, chunk, partitions)
    return out.where(F.col("chunk_id") < closed) if drop_last else out


def shuffled_batches(batches: DataFrame, seed: int = 42) -> DataFrame:
    """batch_no, place: batches in an order that a seed decides."""
    each = batches.select("batch_no").distinct()
    by = F.md5(F.concat(F.col("batch_no").cast("string"), F.lit(f":{seed}")).cast("binary"))
    return rank_all(each.withColumn("__h", by), ["__h", "batch_no"]).select("batch_no", (F.col("rank") - 1).alias("place"))


def batched(rows: DataFrame, key: str, size: str, policy: str = "padding", batch: int = 16, chunk: int = 4096, drop_last: bool = True) -> DataFrame:
    """key, batch_no by a policy: "padding" groups rows of like length, "packing" fills chunks of a fixed size, ``batch`` of them a batch.

    ``drop_last`` drops a last batch that is not full; the packing's open buffer always goes.
    """
    if policy == "padding":
        return length_batches(rows, key, size, batch, drop_last)
    if policy == "packing":
        out, closed = fold_ranges(rows, key, size, chunk)
        most = closed // batch * batch if drop_last else closed
        return out.where(F.col("chunk_id") < most).select(key, F.floor(F.col("chunk_id") / batch).cast("long").alias("batch_no"))
    raise ValueError(f"no batching policy {policy!r}")


def length_batches(rows: DataFrame, key: str, size: str, batch: int, drop_last: bool = True) -> DataFrame:
    """key, batch_no: rows by length, then key, in groups of ``batch``. Ranks come from range partitions' offsets, not from one task."""
    ranked = rank_all(rows.select(key, size), [size, key])
    n = ranked.count() if drop_last else None
    out = ranked.withColumn("batch_no", F.floor((F.col("rank") - 1) / batch).cast("long"))
    out = out if n is None else out.where(F.col("batch_no") < n // batch)
    return out.select(key, "batch_no")


def stripe(batches: DataFrame, ranks: int, rank: int, n_batches: int) -> DataFrame:
    """The batches of one of ``ranks`` workers; a remainder that does not fill all workers is left out."""
    return batches.where((F.col("batch_no") % ranks == rank) & (F.col("batch_no") < n_batches // ranks * ranks))


def learning_rate(step: Column, total: int | Column, warmup: int, peak: float = 2e-5, low: float = 2e-6) -> Column:
    """Linear warm-up, cosine decay until ``total`` steps, then the floor."""
    total = F.lit(total) if isinstance(total, int) else total
    cosine = F.lit(low) + F.lit(peak - low) * 0.5 * (1 + F.cos(F.lit(math.pi) * (step - warmup) / F.greatest(F.lit(1), total - warmup)))
    return F.when(step < warmup, F.lit(peak) * (step + 1) / max(1, warmup)).when(step < total, cosine).otherwise(F.lit(low))


def weighted_loss(rows: DataFrame, loss: str, tokens: str) -> DataFrame:
    """loss and perplexity over all tokens."""
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)
    return rows.agg(mean.alias("loss"), F.exp(mean).alias("perplexity"), F.sum(tokens).alias("tokens"))


def best_so_far(rows: DataFrame, run: str, step: str, loss: str, partitions: int | None = None) -> DataFrame:
    """Each step of a run with the best loss before it and whether it improves on that. A run may have all rows."""
    out = running_before(rows, run, [step], "best_before", F.col(loss), F.min, F.least, partitions)
    return out.withColumn("improved", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))


def every_k_steps(rows: DataFrame, step: str, loss: str, k: int, most: int | None = None) -> DataFrame:
    """step, perplexity, and whether it is one of each ``k``; with ``most`` a run stops before the step of that number."""
    rows = rows if most is None else rows.where(F.col(step) < most)
    return rows.select(step, F.exp(loss).alias("perplexity"), (F.col(step) % k == 0).alias("kth"))


def epoch_means(epochs: DataFrame, run: str, columns: list[str]) -> DataFrame:
    """Means of a run's epochs, 0 where there is nothing, and the best of each column."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in columns]
    return epochs.groupBy(run).agg(*means, *[F.min(c).alias(f"best_{c}") for c in columns])


def tensor_deltas(rows: DataFrame, name: str, first: Column, second: Column, top: int = 10) -> DataFrame:
    """The ``top`` names of the largest difference, with it and the mean size of the second."""
    found = rows.groupBy(name).agg(F.round(F.max(F.abs(first - second)), 4).alias("max_delta"), F.round(F.avg(F.abs(second)), 6).alias("mean_abs"))
    return found.orderBy(F.col("max_delta").desc(), name).limit(top)


def corpus_statistics(rows: DataFrame, tokens: str) -> DataFrame:
    """Rows, tokens, different tokens, longest and mean length of a column of token arrays."""
    n = F.size(tokens).cast("long")
    sizes = rows.agg(F.count("*").alias("n_rows"), F.sum(n).alias("n_tokens"), F.max(n).alias("longest"), F.avg(n).alias("mean_length"))
    kinds = rows.select(F.explode(tokens).alias("t")).agg(F.count_distinct("t").alias("n_kinds"))
    return sizes.crossJoin(kinds)  # a row each
