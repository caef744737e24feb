"""Queries of judging, caching, clients, templates, batching and safety data, and their SQL twins."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import functions as F

from chatloom.functions.text import words
from chatloom import settings
from chatloom.operators import bpe, collate, corpus, evaluation, judging, model_calls, prompts, safety, templates, training
from chatloom.plans.shared import ALL_DETAILS, BATCH, CATEGORIES, LAST, PLACED, WRONG, WS_SQL, conversations, details, query, quoted
from chatloom.runtime import shared_dir, table
from chatloom.sources import files, slices


def _digest(column):
    return F.concat(F.lit("h"), F.md5(column.cast("binary")))


_ITEMS = ("Is it right?", "Does it say 100% of what was asked?", "Is it short?")


def _judge_sql(columns: str = "'h' || md5({body}) AS digest") -> str:
    items = "\n".join(f"{i}. {x}" for i, x in enumerate(_ITEMS, 1))
    parts = [quoted(x) for x in judging.JUDGE]
    body = " || ".join([parts[0], "history", parts[1], "user_query", parts[2], "answer", parts[3], quoted(items), parts[4], f"'{len(_ITEMS)}'", parts[5]])
    return f"""WITH {LAST}, h AS (SELECT l.conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN 'Human: ' ELSE 'AI: ' END || text, chr(10) || chr(10) ORDER BY turn), '(No prior conversation history.)') AS history
FROM l LEFT JOIN conversations c ON c.conv_id = l.conv_id AND c.turn < l.t GROUP BY l.conv_id), q AS (SELECT conv_id, text AS user_query, text || '!' AS answer FROM l JOIN conversations USING (conv_id) WHERE turn = t)
SELECT conv_id, {columns.format(body=body)} FROM h JOIN q USING (conv_id)"""


def _judged(spark, d):
    rows = prompts.history_and_query(conversations(spark, d))
    prompt = judging.judge_prompt(prompts.history_text(F.col("history")), F.col("user_query"), F.concat("user_query", F.lit("!")), F.array(*map(F.lit, _ITEMS)))
    return rows.select("conv_id", prompt.alias("prompt"))


@query(_judge_sql())
def judge_prompt(spark, d):
    return _judged(spark, d).select("conv_id", _digest(F.col("prompt")).alias("digest"))


def _number(prompt: str) -> int:
    """What a stub's answer hangs on: the first 28 bits of the prompt's md5."""
    return int(hashlib.md5(prompt.encode()).hexdigest()[:7], 16)


_NUMBER_SQL = "CAST('0x' || md5({body})[1:7] AS BIGINT)"


def _stub_judge():
    """Answers by the prompt's number: some at once, some on a second try, some never."""

    def ask(texts, heat, port):
        n = _number(texts[0])
        if n % 7 == 3 and not heat:
            raise RuntimeError("busy")
        if n % 5 == 4 or (n % 5 == 3 and not heat):
            return [model_calls.Reply("no verdict", 10, n % 4)]
        said = [{"item": i + 1, "satisfied": (n >> i) % 2 == 1 if i else str((n >> i) % 2 == 1), "reasoning": f"r{n}"} for i in range(len(_ITEMS))]
        return [model_calls.Reply(f"So:\n```json\n{json.dumps(said)}\n```", 20, n % 6)]

    return ask


@query(
    f"""WITH n AS ({_judge_sql(_NUMBER_SQL + " AS c")}), s AS (SELECT conv_id, c, c % 5 = 4 AS failed, c % 2 + c // 2 % 2 + c // 4 % 2 AS good FROM n)
SELECT conv_id, failed, CASE WHEN NOT failed THEN {len(_ITEMS)} END AS n_total, CASE WHEN NOT failed THEN CAST(good AS BIGINT) END AS n_satisfied, CASE WHEN NOT failed THEN round(CAST(good AS DOUBLE) / {len(_ITEMS)}, 9) END AS rate,
CASE WHEN failed THEN 3 WHEN c % 5 = 3 OR c % 7 = 3 THEN 2 ELSE 1 END AS attempts, CASE WHEN failed THEN 10 + c % 4 ELSE 20 + c % 6 END AS total_tokens,
CASE WHEN NOT failed THEN list_reduce(list_transform(range(1, {len(_ITEMS)} + 1), lambda i: CAST(i AS VARCHAR) || ':r' || c), lambda x, y: x || ',' || y) END AS said FROM s"""
)
def judge_rows(spark, d):
    rows = _judged(spark, d).withColumn("n_items", F.lit(len(_ITEMS)))
    out = judging.judge(rows, "prompt", "n_items", _stub_judge, attempts=3, window=4, ports=[8001, 8002])
    said = F.array_join(F.transform("verdicts", lambda v: F.concat(v["item"], F.lit(":"), v["reasoning"])), ",")
    return out.select("conv_id", "failed", "n_total", evaluation.satisfied(F.col("verdicts")).alias("n_satisfied"), F.round("satisfaction_rate", 9).alias("rate"), "attempts", "total_tokens", said.alias("said"))


@query("SELECT doc_id, length(text) AS n, 1 AS computed FROM documents")
def cached_generations(spark, d):
    """Computed and written by the first of two calls, read by the second."""
    path, made = f"{shared_dir(spark)}/chatloom/{uuid.uuid4().hex}-generations", []

    def compute():
        made.append(1)
        return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))

    files.cached(spark, path, compute)
    return files.cached(spark, path, compute).withColumn("computed", F.lit(len(made)))


@query("SELECT conv_id, 'You are a user chatting with an assistant language model to ' || arg_min(text, turn) AS intent, 4 AS n_commits, 0 AS n_commits_again FROM conversations WHERE role = 'user' GROUP BY conv_id")
def sliced_intents(spark, d):
    """Intents in four slices of keys; a second run finds nothing to do."""
    path = f"{shared_dir(spark)}/chatloom/{uuid.uuid4().hex}-intents"
    first = corpus.first_user_turns(table(spark, d, "conversations"))
    n, again = (len(slices.answer_slices(first, "conv_id", path, model_calls.stub_intents, slices=4)) for _ in range(2))
    rows = slices.read(spark, path, "conv_id long, intent string, status string")
    return rows.select("conv_id", "intent", F.lit(n).alias("n_commits"), F.lit(again).alias("n_commits_again"))


@query("SELECT count(*) AS n_missing FROM documents ANTI JOIN labels USING (doc_id)")
def missing_cache_count(spark, d):
    joined = corpus.with_cached(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id", "quality"), "doc_id", {})
    return corpus.missing_count(joined)


_NAMES = "['gpt-5', 'GPT-4o', 'Claude-3', 'gemini-pro', 'my/claude', 'llama']"


@query(f"SELECT doc_id, lower({_NAMES}[CAST(length(text) % 6 + 1 AS INTEGER)]) AS model, CASE WHEN length(text) % 6 < 2 THEN 'gpt' WHEN length(text) % 6 = 2 THEN 'claude' WHEN length(text) % 6 = 3 THEN 'gemini' ELSE 'local' END AS client, length(text) % 6 < 4 AS hosted FROM documents")
def model_routing(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in json.loads(_NAMES.replace("'", '"'))]), (F.length("text") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.lower(name).alias("model"), model_calls.route(name).alias("client"), model_calls.is_hosted(name).alias("hosted"))


def _stub_responses():
    def ask(texts, attempt):
        n = _number(texts[0])
        if n % 13 == 5:
            raise model_calls.Rejected("400")
        if n % 11 == 0 or (n % 4 == 1 and attempt < 2):
            return [TimeoutError("slow")]
        return [model_calls.Reply("" if n % 4 == 2 and not attempt else f"answer {n}", n % 50, 7)]

    return ask


@query(
    f"""WITH {LAST}, h AS (SELECT l.conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN 'Human: ' ELSE 'AI: ' END || text, chr(10) || chr(10) ORDER BY turn), '(No prior conversation history.)') AS history
FROM l LEFT JOIN conversations c ON c.conv_id = l.conv_id AND c.turn < l.t GROUP BY l.conv_id), n AS (SELECT conv_id, {_NUMBER_SQL.format(body="history || chr(10) || chr(10) || text")} AS c FROM h JOIN l USING (conv_id) JOIN conversations USING (conv_id) WHERE turn = t),
d AS (SELECT conv_id, c, c % 13 = 5 AS refused, c % 11 = 0 AS slow FROM n)
SELECT conv_id, CASE WHEN refused OR slow THEN 'Failed to generate response.' ELSE 'answer ' || c END AS response, CASE WHEN refused OR slow THEN 'failed' ELSE 'ok' END AS status,
CASE WHEN refused THEN 'Rejected: 400' WHEN slow THEN 'TimeoutError: slow' END AS error, CASE WHEN NOT (refused OR slow) THEN c % 50 + 7 END AS total_tokens FROM d"""
)
def responses(spark, d):
    rows = prompts.history_and_query(conversations(spark, d))
    rows = rows.select("conv_id", F.concat(prompts.history_text(F.col("history")), F.lit("\n\n"), "user_query").alias("prompt"))
    return model_calls.respond(rows, "prompt", _stub_responses, window=4).select("conv_id", "response", "status", "error", "total_tokens")


@query(
    f"""WITH {LAST}, {PLACED}, h AS (SELECT l.conv_id, coalesce(bool_or({WRONG}), false) AS bad, string_agg(role || ':' || text, chr(10) ORDER BY p.turn) AS said, count(p.turn) AS n FROM l LEFT JOIN p ON p.conv_id = l.conv_id AND p.turn < l.t GROUP BY l.conv_id),
q AS (SELECT conv_id, text FROM l JOIN conversations USING (conv_id) WHERE turn = t)
SELECT conv_id, CASE WHEN NOT bad THEN n + 1 END AS n, CASE WHEN NOT bad THEN 'h' || md5(coalesce(said || chr(10), '') || 'user:' || text) END AS digest FROM h JOIN q USING (conv_id)"""
)
def message_list(spark, d):
    rows = prompts.history_and_query(conversations(spark, d)).withColumn("m", prompts.messages(F.col("history"), F.col("user_query")))
    text = F.array_join(F.transform("m", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return rows.select("conv_id", F.when(F.col("m").isNotNull(), F.size("m")).cast("long").alias("n"), F.when(F.col("m").isNotNull(), _digest(text)).alias("digest"))


_ROLE = {"im": "'<|im_start|>' || role || chr(10)", "header": "'<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10)", "turn": "'<start_of_turn>' || CASE role WHEN 'assistant' THEN 'model' ELSE role END || chr(10)"}
_END = {"im": "'<|im_end|>' || chr(10)", "header": "'<|eot_id|>'", "turn": "'<end_of_turn>' || chr(10)"}
_BOS = {"im": "''", "header": "'<|begin_of_text|>'", "turn": "'<bos>'"}
_FIRST = {
    "im": "'<|im_start|>system' || chr(10) || intent || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)",
    "header": "'<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || intent || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10)",
    "turn": "'<bos><start_of_turn>user' || chr(10) || intent || chr(10) || chr(10)",
}
_ASK = {k: v.replace("CASE role WHEN 'assistant' THEN 'model' ELSE role END", "'user'").replace("role", "'user'") for k, v in _ROLE.items()}


def _ids_sql(family: str) -> str:
    head, end, ask = _ROLE[family], _END[family], _ASK[family]
    return f"""SELECT '{family}' AS family, conv_id, 0 AS k, {_FIRST[family]} AS part, false AS train FROM firsts
UNION ALL SELECT '{family}', conv_id, i + 1, CASE WHEN role = 'user' AND (i = 0 OR before <> 'user') THEN x || {end} ELSE {head} || x || {end} || CASE WHEN role <> 'user' THEN {ask} ELSE '' END END, role = 'user' FROM g
UNION ALL SELECT '{family}', conv_id, 1000000, CASE WHEN last = 'user' THEN {ask} ELSE '' END || '<|endconversation|>' || {end}, true FROM firsts"""


def _flip_sql() -> str:
    return f"""WITH {PLACED}, s AS (SELECT conv_id, i, role, regexp_replace(coalesce(text, ''), '^{WS_SQL}|{WS_SQL}$', '', 'g') AS x, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM p),
good AS (SELECT conv_id FROM s GROUP BY conv_id HAVING NOT bool_or(role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END OR x = '')), g AS (SELECT * FROM s SEMI JOIN good USING (conv_id)),
firsts AS (SELECT conv_id, 'intent of ' || conv_id AS intent, arg_max(role, i) AS last FROM g GROUP BY conv_id),
parts AS ({" UNION ALL ".join(_ids_sql(f) for f in ("im", "header", "turn"))}),
t AS (SELECT *, list_transform(string_split(part, ''), lambda c: unicode(c)) AS ids FROM parts)
SELECT family, conv_id, CAST(sum(len(ids)) + 1 AS BIGINT) AS n, CAST(sum(CASE WHEN train THEN len(ids) ELSE 0 END) AS BIGINT) AS n_labels, 'h' || md5(string_agg(array_to_string(ids, ','), ',' ORDER BY k) || ',2') AS ids_digest,
'h' || md5(string_agg(array_to_string(list_transform(ids, lambda x: CASE WHEN train THEN x ELSE -100 END), ','), ',' ORDER BY k) || ',-100') AS labels_digest FROM t GROUP BY family, conv_id"""


@query(_flip_sql())
def flip_token_ids(spark, d):
    convs = conversations(spark, d)
    intent, out = F.concat(F.lit("intent of "), F.col("conv_id").cast("string")), []
    for family in ("im", "header", "turn"):
        rows = training.training_ids(training.flip_segments(convs, intent, family), eos=2)
        joined = lambda c: _digest(F.array_join(F.col(c).cast("array<string>"), ","))
        out.append(rows.select(F.lit(family).alias("family"), "conv_id", F.size("input_ids").cast("long").alias("n"), training.trainable_tokens(F.col("labels")).cast("long").alias("n_labels"), joined("input_ids").alias("ids_digest"), joined("labels").alias("labels_digest")))
    return corpus.union_all(*out)


#: A small vocabulary: the bytes, and these merges by rank.
_MERGES = [m.split("+") for m in ("t+h", "th+e", "i+n", "e+r", "a+n", "o+n", "in+g", "e+n", "t+i", "ti+on", "an+d", "c+h", "s+t", "u+n", "un+g", "r+e", "m+en", "men+t", "l+e", " +the")]
_STOP = "<|stop|>"


def _bpe_sql() -> str:
    hexed = lambda x: x.encode().hex().upper()
    units = "regexp_replace(hex(encode(p)), '(..)', ' \\1;', 'g')"
    for a, b in _MERGES:
        units = f"replace({units}, ' {hexed(a)}; {hexed(b)};', ' {hexed(a)}{hexed(b)};')"
    known = [*(f"{i:02X}" for i in range(256)), *(hexed(a + b) for a, b in _MERGES)]
    space = r"\x09-\x0D\x20"
    return f"""WITH t AS (SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '[{space}]?[^{space}]+|[{space}]+'), lambda p: {units}), '') AS units FROM conversations),
i AS (SELECT conv_id, turn, list_append(list_transform(list_filter(string_split(units, ' '), lambda u: u <> ''), lambda u: list_position({known}, u[:-2]) - 1), {len(known)}) AS ids FROM t)
SELECT conv_id, CAST(sum(len(ids)) AS BIGINT) AS n, 'h' || md5(string_agg(array_to_string(ids, ','), ',' ORDER BY turn)) AS digest, 'h' || md5(string_agg(CAST(len(ids) AS VARCHAR), ',' ORDER BY turn)) AS cuts FROM i GROUP BY conv_id"""


@query(_bpe_sql())
def bpe_ids(spark, d):
    """Each conversation is encoded once and cut at its turns, which end with a special token."""
    vocabulary = bpe.Vocabulary.of([(a.encode(), b.encode()) for a, b in _MERGES], (_STOP,), pieces=r"[\x09-\x0D\x20]?[^\x09-\x0D\x20]+|[\x09-\x0D\x20]+")
    said = F.transform("turns", lambda t: F.concat(F.coalesce(t["text"], F.lit("")), F.lit(_STOP)))
    rows = conversations(spark, d).select("conv_id", bpe.encoder(vocabulary)(said).alias("ids"))
    joined = lambda c: _digest(F.array_join(c.cast("array<string>"), ","))
    return rows.select("conv_id", F.size(F.flatten("ids")).cast("long").alias("n"), joined(F.flatten("ids")).alias("digest"), joined(F.transform("ids", F.size)).alias("cuts"))


def _chat_sql() -> str:
    def one(family, system):
        text = "x" if family != "im" else "text"
        head = {"dated": _ROLE["header"]}.get(family) or _ROLE[family]
        end = _END["header"] if family == "dated" else _END[family]
        bos = _BOS["header"] if family == "dated" else _BOS[family]
        first = f"{system} || chr(10) || chr(10)" if family == "turn" else "''"
        opening = {"im": f"'<|im_start|>system' || chr(10) || {system} || '<|im_end|>' || chr(10)", "header": f"'<|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || {system} || '<|eot_id|>'", "dated": f"'<|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || 'Cutting Knowledge Date: December 2023' || chr(10) || 'Today Date: 26 Jul 2024' || chr(10) || chr(10) || {system} || '<|eot_id|>'", "turn": "''"}[family]
        ask = {"turn": "'<start_of_turn>model' || chr(10)", "im": "'<|im_start|>assistant' || chr(10)"}.get(family, "'<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)")
        good = f"NOT bool_or({WRONG})" if family == "turn" else "true"
        return f"SELECT '{family}' AS family, conv_id, CASE WHEN {good} THEN 'h' || md5({bos} || {opening} || string_agg({head} || CASE WHEN i = 0 THEN {first} ELSE '' END || {text} || {end}, '' ORDER BY i) || {ask}) END AS digest FROM s GROUP BY conv_id"

    return f"WITH {PLACED}, s AS (SELECT conv_id, i, role, text, regexp_replace(text, '^{WS_SQL}|{WS_SQL}$', '', 'g') AS x FROM p) " + " UNION ALL ".join(one(f, "'Be brief.'") for f in training.FAMILIES)


def _of_each(rows, name, families, texts):
    """``name``, conv_id, digest: a row for each of ``families`` with its family's text; conversations are read once and each text is made once."""
    made = rows.select("conv_id", *[_digest(text).alias(f"d_{f}") for f, text in texts.items()])
    each = F.array(*[F.struct(F.lit(x).alias(name), F.col(f"d_{f}").alias("digest")) for x, f in families.items()])
    return made.select("conv_id", F.explode(each).alias("e")).select(f"e.{name}", "conv_id", "e.digest")


@query(_chat_sql())
def chat_templates(spark, d):
    rows = conversations(spark, d)
    return _of_each(rows, "family", {f: f for f in training.FAMILIES}, {f: training.chat_text(F.col("turns"), f, F.lit("Be brief."), ask=True) for f in training.FAMILIES})


@query(f"WITH m AS (SELECT * FROM (VALUES {', '.join(f"('{m}', '{f}')" for m, f in templates.MODELS.items())}) t(model, family)), c AS ({_chat_sql()}) SELECT model, conv_id, digest FROM m JOIN c USING (family)")
def model_templates(spark, d):
    """Each model's template, compiled; the system text is the first message."""
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit("Be brief.").alias("text")))
    rows = conversations(spark, d).select("conv_id", F.concat(system, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("turns"))
    one = {f: m for m, f in templates.MODELS.items()}  # models of a family have one template
    return _of_each(rows, "model", templates.MODELS, {f: templates.model_text(m, F.col("turns"), ask=True) for f, m in one.items()})


@query("SELECT doc_id, length(text) > 4096 AS too_long, CASE WHEN length(text) <= 4096 THEN 4096 END AS size, CASE WHEN length(text) <= 4096 THEN length(text) END AS mask_sum, CASE WHEN length(text) <= 4096 THEN 4096 - length(text) END AS n_pad, CASE WHEN length(text) <= 4096 THEN length(text) - least(length(text), 5) END AS n_labels FROM documents")
def padded_rows(spark, d):
    """Rows that do not fit are flagged."""
    ids = F.get(training.code_points(F.array("text")), F.lit(0))
    labels = F.transform("ids", lambda x, i: F.when(i < 5, F.lit(training.IGNORED).cast("long")).otherwise(x))
    fits = F.size("ids") <= 4096
    rows = table(spark, d, "documents").select("doc_id", (F.length("text") > 4096).alias("too_long"), ids.alias("ids"))
    rows = rows.withColumn("r", F.when(fits, training.padded_row(F.col("ids"), labels, 4096, -1)))
    total = F.aggregate("r.attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    pads, size = F.size(F.filter("r.input_ids", lambda x: x == -1)), F.size("r.input_ids")
    counts = {"size": size, "mask_sum": total, "n_pad": pads, "n_labels": training.trainable_tokens(F.col("r.labels"))}
    return rows.select("doc_id", "too_long", *[F.when(F.col("r").isNotNull(), c).cast("long").alias(n) for n, c in counts.items()])


@query("SELECT doc_id, length(text) + 6 AS n, least(length(text), 3) AS n_labels FROM documents WHERE text IS NOT NULL")
def prompt_masking(spark, d):
    ids = training.code_points(F.array(F.lit("fix: "), F.lit(" "), F.substring("text", 4, 2**31 - 1), F.substring("text", 1, 3)))
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", ids.alias("i"))
    prompt = F.concat(*[F.get("i", F.lit(j)) for j in range(3)])
    rows = rows.select("doc_id", F.concat(prompt, F.get("i", F.lit(3))).alias("input_ids"), training.masked(prompt, F.get("i", F.lit(3))).alias("labels"))
    return rows.select("doc_id", F.size("input_ids").cast("long").alias("n"), training.trainable_tokens(F.col("labels")).cast("long").alias("n_labels"))


@query(f"WITH {BATCH}, e AS (SELECT DISTINCT batch_no FROM k) SELECT batch_no, row_number() OVER (ORDER BY md5(CAST(batch_no AS VARCHAR) || ':42'), batch_no) - 1 AS place FROM e")
def shuffled_batches(spark, d):
    return training.shuffled_batches(training.length_batches(table(spark, d, "documents"), "doc_id", "n_chars", 16))


@query(
    f"""WITH RECURSIVE {BATCH}, r AS (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
f AS (SELECT i, doc_id, CAST(n AS BIGINT) AS used, CASE WHEN n >= 4096 THEN 1 ELSE 0 END AS chunk FROM r WHERE i = 1
  UNION ALL SELECT r.i, r.doc_id, CAST(CASE WHEN f.used + r.n >= 4096 THEN r.n ELSE f.used + r.n END AS BIGINT), f.chunk + CASE WHEN f.used + r.n >= 4096 THEN 1 ELSE 0 END FROM f JOIN r ON r.i = f.i + 1)
SELECT 'padding' AS policy, doc_id, batch_no FROM k UNION ALL SELECT 'packing', doc_id, chunk // 16 FROM f WHERE chunk < (SELECT max(chunk) // 16 * 16 FROM f)"""
)
def batching_by_policy(spark, d):
    docs = table(spark, d, "documents")
    return corpus.union_all(*[training.batched(docs, "doc_id", "n_chars", p, 16).withColumn("policy", F.lit(p)) for p in ("padding", "packing")])


def _in_tens(rows, data):
    """A collator: rows in arrays whose length is a whole multiple of ten."""
    width = rows.groupBy("batch_no").agg((F.ceil(F.max(F.size("input_ids")) / 10) * 10).cast("int").alias("w"))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v).cast("long"), F.col("w") - F.size(c)))
    return rows.join(width, "batch_no").withColumns({"input_ids": fill(F.col("input_ids"), data.pad), "labels": fill(F.col("labels"), training.IGNORED)}).drop("w")


collate.register_collator("tens", _in_tens)


@query(
    """WITH c AS (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n FROM conversations GROUP BY conv_id), f AS (SELECT *, row_number() OVER (ORDER BY n, conv_id) - 1 AS r FROM c WHERE n <= 4096),
b AS (SELECT *, r // 4 AS batch_no FROM f), w AS (SELECT *, count(*) OVER (PARTITION BY batch_no) AS k, max(n) OVER (PARTITION BY batch_no) AS width FROM b), last AS (SELECT max(batch_no) + 1 AS whole FROM w WHERE k = 4),
o AS (SELECT conv_id, batch_no, n, width FROM w WHERE k = 4 AND batch_no % 2 = 1 AND batch_no < (SELECT whole // 2 * 2 FROM last))
SELECT 'default' AS dataset, conv_id, batch_no, width, n AS mask_sum, width - n AS n_pad, n AS n_labels FROM o UNION ALL SELECT 'tens', conv_id, batch_no, CAST(ceil(width / 10) * 10 AS BIGINT), NULL, CAST(ceil(width / 10) * 10 AS BIGINT) - n, n FROM o"""
)
def collated_batches(spark, d):
    """Worker 1 of 2, batches of four conversations, by the default collator and by one that is registered."""
    train, data = settings.updated((settings.TrainSettings(ranks=2), settings.DataSettings()), **settings.from_words(["--batch=4", "--TrainSettings.rank=1", "--DataSettings.pad=-1"]))
    said = F.concat_ws("", F.array_sort(F.collect_list(F.struct("turn", "text")))["text"])
    ids = F.get(training.code_points(F.array(said)), F.lit(0))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(ids.alias("input_ids")).withColumn("labels", training.unmasked(F.col("input_ids")))
    out = []
    for name in ("default", "tens"):
        got = collate.batches(rows, "conv_id", train, settings.updated(data, dataset=name))
        mask = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x) if name == "default" else F.lit(None).cast("long")
        pads = F.size(F.filter("input_ids", lambda x: x == -1))
        out.append(got.select(F.lit(name).alias("dataset"), "conv_id", "batch_no", F.size("input_ids").cast("long").alias("width"), mask.alias("mask_sum"), pads.cast("long").alias("n_pad"), training.trainable_tokens(F.col("labels")).cast("long").alias("n_labels")))
    return corpus.union_all(*out)


@query(
    f"""WITH {LAST}, h AS (SELECT l.conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN 'Human: ' ELSE 'AI: ' END || text, chr(10) || chr(10) ORDER BY turn), '(No prior conversation history.)') AS history, count(turn) AS n_history
FROM l LEFT JOIN conversations c ON c.conv_id = l.conv_id AND c.turn < l.t GROUP BY l.conv_id)
SELECT conv_id, 'h' || md5(history) AS history, n_history, text AS user_query, 'Is it right?,' || CAST(conv_id AS VARCHAR) AS checklist, CASE WHEN length(text) % 3 > 0 THEN 'tag ' || length(text) % 3 END AS primary_tag FROM h JOIN l USING (conv_id) JOIN conversations USING (conv_id) WHERE turn = t"""
)
def evaluation_tasks(spark, d):
    rows = conversations(spark, d).where(F.exists("turns", lambda t: t["role"] == "user"))
    last = F.length(F.get("turns", prompts.last_user(F.col("turns")))["text"]) % 3
    tag = F.when(last > 0, F.concat(F.lit("tag "), last.cast("string")))
    items = rows.select("conv_id", F.col("turns").alias("conversation_input"), F.array(F.lit("Is it right?"), F.col("conv_id").cast("string")).alias("checklist"), tag.alias("primary_tag"))
    out = prompts.evaluation_tasks(items, "conv_id")
    return out.select("conv_id", _digest(F.col("history")).alias("history"), F.size("history_list").cast("long").alias("n_history"), "user_query", F.array_join("checklist", ",").alias("checklist"), "primary_tag")


@query("SELECT event_type, round(coalesce(avg(value), 0), 6) AS avg_value, min(value) AS best_value, round(coalesce(avg(CASE WHEN event_id < 0 THEN value END), 0), 6) AS avg_nothing FROM events GROUP BY event_type")
def epoch_means(spark, d):
    rows = table(spark, d, "events").withColumn("nothing", F.when(F.col("event_id") < 0, F.col("value")))
    out = training.epoch_means(rows, "event_type", ["value", "nothing"])
    return out.select("event_type", F.round("avg_value", 6).alias("avg_value"), "best_value", F.round("avg_nothing", 6).alias("avg_nothing"))


@query(f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS_SQL}'), lambda x: x <> '') AS ws FROM documents) SELECT count(*) AS n_rows, CAST(sum(len(ws)) AS BIGINT) AS n_tokens, max(len(ws)) AS longest, round(avg(len(ws)), 6) AS mean_length, (SELECT count(DISTINCT x) FROM (SELECT unnest(ws) AS x FROM w)) AS n_kinds FROM w")
def corpus_statistics(spark, d):
    rows = table(spark, d, "documents").select(words(F.col("text")).alias("ws"))
    return training.corpus_statistics(rows, "ws").withColumn("mean_length", F.round("mean_length", 6))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place FROM (SELECT DISTINCT doc_id FROM documents SEMI JOIN labels USING (doc_id))")
def common_ids(spark, d):
    return corpus.rank_all(corpus.common_ids(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id"), ["doc_id"]).select("doc_id", F.col("rank").cast("long").alias("place"))


@query("SELECT side, count(*) AS n FROM (SELECT CASE WHEN b.p IS NULL THEN 'only1' WHEN a.p IS NULL THEN 'only2' ELSE 'both' END AS side FROM (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity > 45) a FULL JOIN (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_tax > 0.07) b ON a.p = b.p) GROUP BY side")
def id_overlap(spark, d):
    l = table(spark, d, "lineitem")
    return corpus.id_overlap(l.where(F.col("l_quantity") > 45), l.where(F.col("l_tax") > 0.07), "l_partkey").groupBy("side").agg(F.count("*").alias("n"))


@query("SELECT split, count(*) AS n, count(quality) AS n_quality FROM (SELECT doc_id, 'a' AS split, NULL AS quality FROM documents UNION ALL SELECT doc_id, 'b', quality FROM labels) GROUP BY split")
def union_all(spark, d):
    a, b = table(spark, d, "documents").select("doc_id", F.lit("a").alias("split")), table(spark, d, "labels").select(F.lit("b").alias("split"), "doc_id", "quality")
    return corpus.union_all(a, b).groupBy("split").agg(F.count("*").alias("n"), F.count("quality").alias("n_quality"))


@query("WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS i FROM conversations) SELECT u.conv_id, u.i AS place, md5(u.text || '|' || a.text) AS digest FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.i = a.i WHERE u.role = 'user' AND a.role = 'assistant'")
def zipped_turns(spark, d):
    said = lambda role: F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"])
    rows = conversations(spark, d).select("conv_id", F.posexplode(corpus.zipped(said("user"), said("assistant"))).alias("place", "p"))
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), F.md5(F.concat("p.left", F.lit("|"), "p.right").cast("binary")).alias("digest"))


@query("SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def first_rows(spark, d):
    return corpus.first_rows(table(spark, d, "documents").withColumn("less", -F.col("n_chars")), 25, "less", "doc_id").select("doc_id")


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 5 AS INTEGER) AS port FROM documents")
def least_loaded(spark, d):
    return corpus.assigned(table(spark, d, "documents"), "doc_id", 5)


@query(f"SELECT tag, rate, n, row_number() OVER (ORDER BY rate DESC, tag) AS place FROM (SELECT tag, round(avg(n_satisfied / n_items) * 100, 2) AS rate, count(*) AS n FROM {ALL_DETAILS} WHERE n_satisfied IS NOT NULL GROUP BY tag)")
def categories_by_rate(spark, d):
    rows = evaluation.by_rate(evaluation.by_tag(details(spark, d, "l_discount", 0.05))).withColumn("less", -F.col("rate"))
    return corpus.rank_all(rows, ["less", "tag"]).select("tag", "rate", "n", F.col("rank").cast("long").alias("place"))


@query("WITH n AS (SELECT doc_id, length(text) % 7 AS a, length(text) % 5 AS b FROM documents) SELECT doc_id, CASE WHEN a + b = 0 THEN NULL WHEN a >= b THEN '010' ELSE '012' END AS code FROM n")
def category_of_string(spark, d):
    a, b = (F.length("text") % n for n in (7, 5))
    text = F.when(a + b == 0, "[]").otherwise(F.concat(F.lit("[['hate', 0."), a.cast("string"), F.lit("], ['sexual', "), b.cast("string"), F.lit("e-1]]")))
    return table(spark, d, "documents").select("doc_id", prompts.category_code(prompts.scores_of(text)).alias("code"))


@query("SELECT doc_id, md5(input) AS input, target FROM (SELECT doc_id, text AS input, unnest(['fixed ' || doc_id, ' ', 'again ' || lang]) AS target FROM documents) WHERE trim(target) <> '' AND trim(input) <> ''")
def correction_pairs(spark, d):
    rows = table(spark, d, "documents").withColumn("targets", F.array(F.concat(F.lit("fixed "), F.col("doc_id").cast("string")), F.lit(" "), F.concat(F.lit("again "), "lang")))
    return prompts.corrections(rows.select("doc_id", "text", "targets"), "text", "targets").select("doc_id", F.md5(F.col("input").cast("binary")).alias("input"), "target")


def _prompts_sql() -> str:
    full = f"{quoted(prompts.WITH_INPUT)} || text || chr(10) || chr(10) || '### Input:' || chr(10) || lang || chr(10) || chr(10) || '### Response:'"
    bare = f"{quoted(prompts.WITHOUT_INPUT)} || text || chr(10) || chr(10) || '### Response:'"
    rest = ["'Summarize this dialog:' || chr(10) || text || chr(10) || '---' || chr(10) || 'Summary:' || chr(10)", "'Correct this to standard English: ' || text || chr(10) || '---' || chr(10) || 'Corrected: '"]
    return f"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN {full} ELSE {bare} END) AS instruction, md5({rest[0]}) AS summary, md5({rest[1]}) AS correction, replace(lang || '/' || source, '/', '_') AS name FROM documents"


@query(_prompts_sql())
def task_prompts(spark, d):
    from chatloom.functions.text import safe_name

    more = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    made = {"instruction": prompts.instruction_prompt(F.col("text"), more), "summary": prompts.summary_prompt(F.col("text")), "correction": prompts.correction_prompt(F.col("text"))}
    return table(spark, d, "documents").select("doc_id", *[F.md5(c.cast("binary")).alias(n) for n, c in made.items()], safe_name(F.concat_ws("/", "lang", "source")).alias("name"))


_TEMPLATE = "Judge this.\n{guidelines}\n--\n{conversation}\n--\nVerdict:"


def _guard_sql() -> str:
    n = len(CATEGORIES)
    every = f"[{', '.join(map(str, range(1, n + 1)))}]"
    names = "[" + ", ".join(quoted(f"{a}. \n{b}") for a, b in CATEGORIES) + "]"
    h = lambda what: f"md5(CAST(doc_id AS VARCHAR) || ':' || c || ':{what}:42')"
    some = lambda what: f"list_filter(clean, lambda c: {h(what)} < '8')"
    least = lambda what: f"list_transform(list_sort(list_transform(clean, lambda c: {{'h': {h(what)}, 'c': c}}))[1:1], lambda x: x.c)"
    before, rest = _TEMPLATE.split("{guidelines}")
    between, after = rest.split("{conversation}")
    return f"""WITH x AS (SELECT doc_id, text, toxic, CASE WHEN toxic = 1 THEN list_distinct([1 + doc_id % {n}, 1 + doc_id % 2]) ELSE [] END AS bad FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL),
y AS (SELECT *, list_filter({every}, lambda c: NOT list_contains(bad, c)) AS clean FROM x),
v AS (SELECT doc_id, text, 'all' AS variant, {every} AS shown, CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END AS label, bad, 'because' AS why FROM y
UNION ALL SELECT doc_id, text, 'fewer', list_sort(list_concat(list_filter({every}, lambda c: list_contains(bad, c)), CASE WHEN len({some("fewer")}) = 0 AND len(bad) = 0 THEN {least("fewer")} ELSE {some("fewer")} END)), CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END, bad, 'because' FROM y
UNION ALL SELECT doc_id, text, 'none', list_sort(CASE WHEN len({some("none")}) = 0 THEN {least("none")} ELSE {some("none")} END), 'safe', [], 'not asked' FROM y WHERE toxic = 1)
SELECT doc_id, variant, label, 'h' || md5({quoted(before)} || array_to_string(list_transform(shown, lambda c, i: 'O' || i || ': ' || ({names})[c]), chr(10)) || {quoted(between)} || 'human: ' || text || CASE WHEN doc_id % 2 = 0 THEN '' ELSE chr(10) || chr(10) || 'chatbot: ok' END || {quoted(after)} || ' ' || label
|| CASE WHEN label = 'unsafe' THEN chr(10) || array_to_string(list_sort(list_transform(bad, lambda c: 'O' || list_position(shown, c))), ',') ELSE '' END || chr(10) || 'Explanation: ' || why) AS digest FROM v"""


@query(_guard_sql())
def safety_training_rows(spark, d):
    n = len(CATEGORIES)
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").where(F.col("text").isNotNull())
    bad = F.when(F.col("toxic") == 1, F.array((1 + F.col("doc_id") % n).cast("int"), (1 + F.col("doc_id") % 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", F.col("text").alias("prompt"), F.when(F.col("doc_id") % 2 == 0, safety.NO_RESPONSE).otherwise("ok").alias("response"), prompts.recoded(F.col("toxic")).alias("label"), F.array_distinct(bad).alias("violated"), F.lit("because").alias("explanation"))
    out = safety.training_rows(rows, "doc_id", CATEGORIES, _TEMPLATE, described=True, position="after", safe_because="not asked")
    return out.select("doc_id", "variant", "label", _digest(F.col("text")).alias("digest"))


def _shuffled_sql() -> str:
    n = len(CATEGORIES)
    names = "[" + ", ".join(quoted(a) for a, _ in CATEGORIES) + "]"
    order = "list_transform(list_sort(list_transform(range(1, %d), lambda c: {'h': md5(CAST(doc_id AS VARCHAR) || ':' || c || ':order:42'), 'c': c})), lambda x: x.c)" % (n + 1)
    before, rest = _TEMPLATE.split("{guidelines}")
    between, after = rest.split("{conversation}")
    return f"""WITH x AS (SELECT doc_id, text, toxic, {order} AS shown, CASE WHEN toxic = 1 THEN list_distinct([1 + length(text) % {n}, 1 + length(text) % 2]) ELSE [] END AS bad FROM documents JOIN labels USING (doc_id))
SELECT doc_id, CASE WHEN toxic = 1 THEN 'unsafe' ELSE 'safe' END AS label, 'h' || md5({quoted(before)} || array_to_string(list_transform(shown, lambda c, i: 'O' || i || ': ' || ({names})[c] || '. '), chr(10)) || {quoted(between)} || 'human: ' || text || chr(10) || chr(10) || 'chatbot: ok' || {quoted(after)} || ' ' || CASE WHEN toxic = 1 THEN 'unsafe' || chr(10) || array_to_string(list_sort(list_transform(bad, lambda c: 'O' || list_position(shown, c))), ',') ELSE 'safe' END) AS digest FROM x"""


@query(_shuffled_sql())
def shuffled_categories(spark, d):
    """All categories, in an order that a hash of the row decides."""
    n, size = len(CATEGORIES), F.length("text")
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    bad = F.when(F.col("toxic") == 1, F.array((1 + size % n).cast("int"), (1 + size % 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", F.col("text").alias("prompt"), F.lit("ok").alias("response"), prompts.recoded(F.col("toxic")).alias("label"), F.array_distinct(bad).alias("violated"), F.lit("").alias("explanation"))
    out = safety.training_rows(rows, "doc_id", CATEGORIES, _TEMPLATE, augment=False, shuffle=True)
    return out.select("doc_id", "label", _digest(F.col("text")).alias("digest"))


def _levels(text):
    n = F.length(text)
    return F.transform(F.array(n % 3, n % 2, F.lit(0)), lambda x: (2 * x).cast("int"))


model_calls.register_checker("first line", lambda text: (prompts.is_safe(text), text))
model_calls.register_checker("severity", lambda text: (prompts.is_mild(_levels(text)), prompts.severity_report(["Hate", "Violence", "Sexual"], _levels(text))))


model_calls.register_checker("class", lambda text: prompts.class_check(["none", "toxicity", "profanity"], [F.length(text) % m for m in (3, 2, 5)]))


@query(
    """WITH s AS (SELECT conv_id, turn, x, length(x) % 3 AS a, length(x) % 2 AS b, length(x) % 5 AS c FROM (SELECT conv_id, turn, CASE WHEN length(text) % 4 < 2 THEN 'safe' ELSE 'unsafe' END || chr(10) || text AS x FROM conversations WHERE role = 'assistant'))
SELECT conv_id, turn, 'first line' AS checker, string_split(x, chr(10))[1] = 'safe' AS is_safe, md5(x) AS report FROM s
UNION ALL SELECT conv_id, turn, 'severity', a = 0 AND b = 0, md5(CASE WHEN a = 0 AND b = 0 THEN '' ELSE '|   Hate   | Violence |  Sexual  |' || chr(10) || '|' || ['   Safe   ', '   Low    ', '  Medium  '][a + 1] || '|' || ['   Safe   ', '   Low    '][b + 1] || '|   Safe   |' || chr(10) END) FROM s
UNION ALL SELECT conv_id, turn, 'class', a >= b AND a >= c, md5(CASE WHEN a >= b AND a >= c THEN '' ELSE 'Predicted class: ' || CASE WHEN b >= c THEN 'toxicity' ELSE 'profanity' END || chr(10) || '|   none   | toxicity |profanity |' || chr(10) || '|    ' || a || '     |    ' || b || '     |    ' || c || '     |' || chr(10) END) FROM s"""
)
def safety_checks(spark, d):
    """What a classifier says of each answer, its verdict before the text."""
    said = F.concat(F.when(F.length("text") % 4 < 2, "safe\n").otherwise("unsafe\n"), "text")
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", said.alias("text"))
    return model_calls.safety_checks(rows, "text", ["first line", "severity", "class"]).select("conv_id", "turn", "checker", "is_safe", F.md5(F.col("report").cast("binary")).alias("report"))


@query("SELECT conv_id, turn, replace(trim(text), 'the', '') AS target FROM conversations WHERE role = 'assistant'")
def target_prompt(spark, d):
    rows = table(spark, d, "conversations").where(F.col("role") == "assistant")
    return rows.select("conv_id", "turn", prompts.target_prompt(F.col("text"), F.lit("the")).alias("target"))
