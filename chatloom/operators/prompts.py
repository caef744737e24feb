"""Conversation formats, prompt builders and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.functions.text import strip
from chatloom.operators.ranking import rank_all

#: Prompt texts.
NO_HISTORY = "(No prior conversation history.)"
INTENT_HEAD = (
    "You are given the conversation history between a user and assistant model and your task is to create a summary of the user's intent from the conversation.",
    "",
    "Your summary should be structured to define what the high level intent of the user is, but should not go into specific details.",
    "",
    'Format the summary to start with "You are a user chatting with an assistant language model to"',
    "",
)
INTENT_ASK = "Now generate a summary of the user intent for the following conversation:"
INTENT_TAIL = "Reply with only the intent summary and nothing else."
WITH_INPUT = "Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.\n\n### Instruction:\n"
WITHOUT_INPUT = "Below is an instruction that describes a task. Write a response that appropriately completes the request.\n\n### Instruction:\n"
#: Moderation category to policy code.
CATEGORY_CODES = {
    "sexual": "012",
    "violence": "01",
    "sexual/minors": "04",
    "self-harm/intent": "011",
    "hate": "010",
    "harassment": "010",
    "self-harm": "011",
    "self-harm/instructions": "011",
    "violence/graphic": "01",
    "harassment/threatening": "010",
    "hate/threatening": "010",
}


def nested(turns: DataFrame) -> DataFrame:
    """conv_id, turns: an array of (turn, role, text) in order."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def long(convs: DataFrame) -> DataFrame:
    return convs.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")


def formatted(turns: Column, cut: int = 2048) -> Column:
    """``<role>: text`` lines; assistant texts beyond ``cut`` characters are shortened."""

    def line(t: Column) -> Column:
        long_ = (t["role"] == "assistant") & (F.length(t["text"]) > cut)
        return F.concat(F.lit("<"), t["role"], F.lit(">: "), F.when(long_, F.concat(F.substring(t["text"], 1, cut), F.lit(" ..."))).otherwise(t["text"]))

    return F.array_join(F.transform(turns, line), "\n")


def intent_prompt(turns: Column, examples: list[tuple[str, str]] = (), cut: int = 2048) -> Column:
    """Instructions, worked examples (formatted conversation, intent), and the conversation."""
    parts = list(INTENT_HEAD)
    for i, (conversation, intent) in enumerate(examples, 1):
        parts += [f"Example {i}:", "", "Conversation History:", conversation, "", "Intent Summary:", intent, ""]
    return F.concat(F.lit("\n".join([*parts, INTENT_ASK, "", ""])), formatted(turns, cut), F.lit(f"\n\n{INTENT_TAIL}"))


def last_user(turns: Column) -> Column:
    """Place of the last user turn, null without one."""
    places = F.transform(turns, lambda t, i: F.when(t["role"] == "user", i))
    return F.array_max(F.filter(places, lambda i: i.isNotNull()))


def history_and_query(convs: DataFrame) -> DataFrame:
    """conv_id, history (turns before the last user turn), user_query."""
    at = last_user(F.col("turns"))
    rows = convs.withColumn("__at", at).where(F.col("__at").isNotNull())
    return rows.select("conv_id", F.slice("turns", F.lit(1), F.col("__at")).alias("history"), F.get("turns", F.col("__at"))["text"].alias("user_query"))


def evaluation_tasks(items: DataFrame, key: str = "session_id") -> DataFrame:
    """key, history, history_list, user_query, checklist and primary_tag (null if there is none) of items with a ``conversation_input``.

    The last user turn is the query, what comes before it the history. An item without a user turn is an error.
    """
    turns = F.col("conversation_input")
    at = F.coalesce(last_user(turns), F.raise_error(F.concat(F.lit("no user turn: "), F.col(key).cast("string"))))
    before = F.slice(turns, F.lit(1), F.col("__at"))
    tag = F.col("primary_tag") if "primary_tag" in items.columns else F.lit(None).cast("string")
    rows = items.withColumn("__at", at)
    return rows.select(key, history_text(before).alias("history"), before.alias("history_list"), F.get(turns, F.col("__at"))["text"].alias("user_query"), "checklist", tag.alias("primary_tag"))


def history_text(history: Column) -> Column:
    lines = F.transform(history, lambda t: F.concat(F.when(t["role"] == "user", "Human: ").otherwise("AI: "), t["text"]))
    return F.when(F.size(history) == 0, F.lit(NO_HISTORY)).otherwise(F.array_join(lines, "\n\n"))


def messages(history: Column, query: Column, strict: bool = False) -> Column:
    """The history's turns and the query as user, as (role, text); null, or with ``strict`` an error, if roles do not alternate."""
    built = F.concat(F.transform(history, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.array(F.struct(F.lit("user").alias("role"), query.alias("text"))))
    good = F.coalesce(alternates(history), F.lit(False))
    return F.when(good, built).otherwise(F.raise_error(F.lit("roles must alternate, from a user's turn on"))) if strict else F.when(good, built)


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def alternates(turns: Column) -> Column:
    """Whether roles are user, assistant, user, ..."""
    return F.forall(F.transform(turns, lambda t, i: t["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda b: b)


def reject_reason(turns: Column) -> Column:
    """0 if a conversation can be flipped; -2 if the first bad turn breaks alternation, -1 if its text is empty or there are no turns."""
    wrong = F.transform(
        turns,
        lambda t, i: F.when(t["role"] != F.when(i % 2 == 0, "user").otherwise("assistant"), -2)
        .when(strip(F.coalesce(t["text"], F.lit(""))) == "", -1)
        .otherwise(0),
    )
    return F.when(F.size(turns) == 0, -1).otherwise(F.coalesce(F.get(F.filter(wrong, lambda r: r != 0), F.lit(0)), F.lit(0)))


def instruction_prompt(instruction: Column, input_: Column) -> Column:
    bare = F.concat(F.lit(WITHOUT_INPUT), instruction, F.lit("\n\n### Response:"))
    full = F.concat(F.lit(WITH_INPUT), instruction, F.lit("\n\n### Input:\n"), input_, F.lit("\n\n### Response:"))
    return F.when(F.coalesce(input_, F.lit("")) == "", bare).otherwise(full)


def summary_prompt(dialog: Column) -> Column:
    return F.concat(F.lit("Summarize this dialog:\n"), dialog, F.lit("\n---\nSummary:\n"))


def correction_prompt(sentence: Column) -> Column:
    return F.concat(F.lit("Correct this to standard English: "), sentence, F.lit("\n---\nCorrected: "))


def scores_of(text: Column) -> Column:
    """Scores as array of (name, score) of their string form, a JSON array of [name, number] pairs; null if it is none."""
    pairs = F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<array<string>>")
    return F.transform(pairs, lambda p: F.struct(F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).try_cast("double").alias("score")))


def category_code(scores: Column) -> Column:
    """The code of the highest of ``scores`` (array of (name, score)), the first of equals; null without any."""
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s["score"]).alias("by"), i.alias("i"), s["name"].alias("name"))))
    codes = F.create_map(*[F.lit(x) for kv in CATEGORY_CODES.items() for x in kv])
    return F.try_element_at(codes, F.get(ranked, F.lit(0))["name"])


def recoded(flag: Column, names: tuple[str, str] = ("safe", "unsafe")) -> Column:
    return F.when(flag == 0, names[0]).otherwise(names[1])


def corrections(rows: DataFrame, text: str, targets: str) -> DataFrame:
    """A row for each target of a text, as input and target; blank ones go."""
    each = rows.withColumn("target", F.explode(targets)).withColumnRenamed(text, "input").drop(targets)
    return each.where((strip(F.col("input")) != "") & (strip(F.col("target")) != ""))


def replies(convs: DataFrame) -> DataFrame:
    """conv_id, turn, input, target: each user turn with the assistant turn that follows it; empty texts go."""
    pairs = F.filter(F.transform("turns", lambda t, i: F.struct(t.alias("a"), F.get("turns", i + 1).alias("b"))), lambda p: (p["a"]["role"] == "user") & (p["b"]["role"] == "assistant") & (p["b"]["turn"] == p["a"]["turn"] + 1))
    rows = convs.select("conv_id", F.explode(pairs).alias("p")).where((F.col("p.a.text") != "") & (F.col("p.b.text") != ""))
    return rows.select("conv_id", F.col("p.a.turn").alias("turn"), F.col("p.a.text").alias("input"), F.col("p.b.text").alias("target"))


def head_and_tail(rows: DataFrame, key: str, share: int = 20) -> DataFrame:
    """``key``, ``part``: the first of ``share`` parts, in order of key, is for evaluation."""
    ranked = rank_all(rows.select(key), [key])
    n = ranked.agg(F.count("*").alias("__all"))
    return ranked.crossJoin(F.broadcast(n)).select(key, F.when(F.col("rank") <= F.floor(F.col("__all") / share), "eval").otherwise("train").alias("part"))  # one row


def violated_codes(codes: Column, shown: Column, prefix: str = "S") -> Column:
    """Codes of violated categories as places among those shown: distinct, sorted as strings, comma-joined."""
    places = F.transform(F.array_distinct(codes), lambda c: F.array_position(shown, F.regexp_replace(c, "^[A-Za-z]+", "").cast("int")))
    kept = F.transform(F.filter(places, lambda p: p > 0), lambda p: F.concat(F.lit(prefix), p.cast("string")))
    return F.array_join(F.array_sort(kept), ",")


#: The parts of a safety classifier's prompt.
SAFETY_TASK = "Task: Check if there is unsafe content in '{agent}' messages in conversations according our safety policy with the below categories.\n\n"
SAFETY_LIST = "<BEGIN UNSAFE CONTENT CATEGORIES>\n{listed}\n<END UNSAFE CONTENT CATEGORIES>\n\n<BEGIN CONVERSATION>\n\n"
SAFETY_ASK = "\n\n<END CONVERSATION>\n\nProvide your safety assessment for ONLY THE LAST {agent} message in the above conversation:\n - First line must read 'safe' or 'unsafe'.\n - If unsafe, a second line must include a comma-separated list of violated categories."


def by_parity(texts: Column, names: tuple[str, str] = ("User", "Agent")) -> Column:
    """A conversation (role, text) of a list of texts: roles by place."""
    return F.transform(texts, lambda t, i: F.struct(F.when(i % 2 == 0, names[0]).otherwise(names[1]).alias("role"), t.alias("text")))


def safety_prompt(turns: Column, categories: list[tuple[str, str]], agent: str = "User", prefix: str = "S", with_policy: bool = False) -> Column:
    """A classifier prompt: numbered categories and the conversation, turns named by parity."""
    listed = "\n".join(f"{prefix}{i}: {name}" + (f"\n{policy}" if with_policy else "") for i, (name, policy) in enumerate(categories, 1))
    head = SAFETY_TASK.replace("{agent}", agent) + SAFETY_LIST.replace("{listed}", listed)
    lines = F.transform(by_parity(F.transform(turns, lambda t: t["text"])), lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return F.concat(F.lit(head), F.array_join(lines, "\n\n"), F.lit(SAFETY_ASK.replace("{agent}", agent)))


def is_safe(answer: Column) -> Column:
    return F.get(F.split(answer, "\n"), F.lit(0)) == "safe"


#: Names of a moderation service's severity levels.
SEVERITIES = {0: "Safe", 2: "Low", 4: "Medium", 6: "High"}


def is_mild(severities: Column, most: int = 0) -> Column:
    """Whether no severity is above ``most``."""
    return F.forall(severities, lambda s: s <= most)


def _centred(x: Column) -> Column:
    room = F.lit(10) - F.length(x)
    left = F.greatest(F.floor(room / 2), F.lit(0)).cast("int")
    return F.concat(F.repeat(F.lit(" "), left), x, F.repeat(F.lit(" "), F.greatest(room - left, F.lit(0))))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("|"), F.array_join(F.transform(cells, _centred), "|"), F.lit("|\n"))


def severity_report(names: list[str], severities: Column) -> Column:
    """A table of two lines, names and levels centred in ten places; empty if all is mild."""
    levels = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    shown = _line(F.transform(severities, lambda s: F.try_element_at(levels, s)))
    return F.when(is_mild(severities), "").otherwise(F.concat(_line(F.array(*map(F.lit, names))), shown))


def class_check(names: list[str], scores: list[Column], fine: str = "none") -> tuple[Column, Column]:
    """A classifier as (is it safe, a report): safe if the class of the largest score, the first of several, is ``fine``.

    The report names the class and lists all scores, rounded to five places, in a table of two lines; it is empty for what is safe.
    """
    values = F.array(*scores)
    found = F.element_at(F.array(*map(F.lit, names)), F.array_position(values, F.array_max(values)).cast("int"))
    shown = F.transform(values, lambda v: F.round(v, 5).cast("string"))
    safe = found == fine
    return safe, F.when(safe, "").otherwise(F.concat(F.lit("Predicted class: "), found, F.lit("\n"), _line(F.array(*map(F.lit, names))), _line(shown)))


def target_prompt(text: Column, user_prompt: Column) -> Column:
    """What is judged of an agent's output: its text without space around it and without the user's prompt."""
    bare = strip(text)
    return F.when(F.coalesce(user_prompt, F.lit("")) == "", bare).otherwise(F.replace(bare, user_prompt, F.lit("")))
