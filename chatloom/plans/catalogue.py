"""The queries of the conversation operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions.text import fix_spacing, words
from chatloom.operators import corpus, evaluation, prompts, training
from chatloom.operators.model_calls import stub_intents
from chatloom.operators.ranking import rank_all
from chatloom.plans import model_queries  # noqa: F401  adds its queries to the registry
from chatloom.plans.shared import ALL_DETAILS, BATCH, CATEGORIES, LAST, ORACLES, PLACED, QUERIES, WRONG, WS_SQL, conversations, details, query, quoted  # noqa: F401
from chatloom.runtime import table


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def language_filter(spark, d):
    return corpus.by_language(table(spark, d, "documents"), "en", "lang").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE lower(lang) = 'en'")
def language_filter_ci(spark, d):
    return corpus.by_language(table(spark, d, "documents"), "EN", "lang", ignore_case=True).select("doc_id", "lang")


@query("SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def first_user_turn(spark, d):
    return corpus.first_user_turns(table(spark, d, "conversations"))


_GRAMS = f"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{WS_SQL}'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, array_to_string(ws[i:i + 6], ' ') AS ng FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 5)) AS i FROM w WHERE len(ws) >= 7))
"""


@query(f"WITH {_GRAMS} SELECT ng, count(*) AS n FROM g GROUP BY ng HAVING count(*) > 5")
def ngram_counts(spark, d):
    return corpus.hot_ngrams(table(spark, d, "documents"), "doc_id", "text", threshold=5)


@query(f"WITH {_GRAMS}, hot AS (SELECT ng FROM g GROUP BY ng HAVING count(*) > 2) SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM g SEMI JOIN hot USING (ng)) AS kept FROM documents")
def ngram_dedup(spark, d):
    return corpus.mark_repetitive(table(spark, d, "documents"), "doc_id", "text", threshold=2).select("doc_id", "kept")


_SPLIT = """
users AS (SELECT DISTINCT {user} AS u, {stratum} AS s FROM {rows}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(CAST(u AS VARCHAR) || ':42'), u) - 1 AS r, count(*) OVER (PARTITION BY s) AS n FROM users),
assigned AS (SELECT u, s, CASE WHEN r < floor(n * CAST(0.89 AS DOUBLE)) THEN 'train' WHEN r < floor(n * CAST(0.89 AS DOUBLE)) + floor(n * CAST(0.05 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM ranked)
"""


def _orders(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_custkey", "c_nationkey")


_ORDERS = "o AS (SELECT o_orderkey, c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),"


@query(f"WITH {_ORDERS} {_SPLIT.format(user='c_custkey', stratum='c_nationkey', rows='o')} SELECT o_orderkey, split FROM o JOIN assigned ON u = c_custkey AND s = c_nationkey")
def user_split(spark, d):
    return corpus.split_rows(_orders(spark, d), "c_custkey", "c_nationkey").select("o_orderkey", "split")


@query(f"WITH {_ORDERS} {_SPLIT.format(user='c_custkey', stratum='c_nationkey', rows='o')} SELECT split, count(*) AS n, 0 AS n_forced FROM o JOIN assigned ON u = c_custkey AND s = c_nationkey GROUP BY split")
def split_stats(spark, d):
    return corpus.split_stats(corpus.split_rows(_orders(spark, d), "c_custkey", "c_nationkey"))


@query(
    f"""WITH f AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), free AS (SELECT * FROM documents ANTI JOIN f USING (doc_id)),
{_SPLIT.format(user="source", stratum="lang", rows="free")}
SELECT documents.doc_id, f.doc_id IS NOT NULL AS forced, CASE WHEN f.doc_id IS NOT NULL THEN 'test' ELSE split END AS split
FROM documents LEFT JOIN f USING (doc_id) LEFT JOIN assigned ON u = source AND s = lang"""
)
def routed_split(spark, d):
    forced = table(spark, d, "labels").where(F.col("quality") == 0)
    return corpus.split_rows(table(spark, d, "documents"), "source", "lang", forced, "doc_id").select("doc_id", "forced", "split")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def resume_antijoin(spark, d):
    return corpus.not_done(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def details_last_wins(spark, d):
    return corpus.last_per_key(table(spark, d, "events"), "user_id", "event_id", ["event_id", "event_type"])


@query(
    """WITH c AS (SELECT doc_id, quality, 0 AS line FROM labels UNION ALL SELECT doc_id, quality + 10, 1 FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT -1 - doc_id, quality, 2 FROM labels),
l AS (SELECT doc_id, arg_max(quality, line) AS quality FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN l USING (doc_id)"""
)
def cache_left_join(spark, d):
    return _cache_join(spark, d)


def _cache_join(spark, d):
    """Tasks and a cache that has some keys twice and some that are no task's."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    again = labels.where(F.col("doc_id") % 3 == 0).select("doc_id", F.col("quality") + 10, F.lit(1).alias("line"))
    others = labels.select(-1 - F.col("doc_id"), "quality", F.lit(2).alias("line"))
    cache = labels.withColumn("line", F.lit(0)).union(again).union(others)
    return corpus.with_cached(table(spark, d, "documents").select("doc_id"), cache, "doc_id", {"quality": -1}, "line")


@query(
    """SELECT conv_id, string_agg('<' || role || '>: ' || CASE WHEN role = 'assistant' AND length(text) > 200 THEN text[1:200] || ' ...' ELSE text END, chr(10) ORDER BY turn) AS formatted
FROM conversations GROUP BY conv_id"""
)
def format_conversation(spark, d):
    return conversations(spark, d).select("conv_id", prompts.formatted(F.col("turns"), 200).alias("formatted"))


#: Worked examples, as the prompt's caller would give them.
_EXAMPLES = (("<user>: hi\n<assistant>: hello", "You are a user chatting with an assistant language model to say hello."), ("<user>: 2 + 2?", "You are a user chatting with an assistant language model to add numbers."))


def _intent_sql() -> str:
    head = "\n".join(prompts.INTENT_HEAD)
    for i, (conversation, intent) in enumerate(_EXAMPLES, 1):
        head += f"\nExample {i}:\n\nConversation History:\n{conversation}\n\nIntent Summary:\n{intent}\n"
    body = "string_agg('<' || role || '>: ' || CASE WHEN role = 'assistant' AND length(text) > 2048 THEN text[1:2048] || ' ...' ELSE text END, chr(10) ORDER BY turn)"
    before, after = f"{head}\n{prompts.INTENT_ASK}\n\n", f"\n\n{prompts.INTENT_TAIL}"
    return f"SELECT conv_id, 'h' || md5({quoted(before)} || {body} || {quoted(after)}) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id"


@query(_intent_sql())
def intent_prompt(spark, d):
    rows = conversations(spark, d).withColumn("prompt", prompts.intent_prompt(F.col("turns"), _EXAMPLES))
    return rows.select("conv_id", F.concat(F.lit("h"), F.md5(F.col("prompt").cast("binary"))).alias("digest"), F.size("turns").cast("long").alias("turns"))


@query(f"WITH {LAST} SELECT conv_id, (SELECT count(*) FROM conversations c WHERE c.conv_id = l.conv_id AND c.turn < l.t) AS n_history, text AS user_query FROM l JOIN conversations USING (conv_id) WHERE turn = t")
def last_user_split(spark, d):
    return prompts.history_and_query(conversations(spark, d)).select("conv_id", F.size("history").cast("long").alias("n_history"), "user_query")


@query(
    f"""WITH {LAST} SELECT l.conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN 'Human: ' ELSE 'AI: ' END || text, chr(10) || chr(10) ORDER BY turn), '(No prior conversation history.)') AS history
FROM l LEFT JOIN conversations c ON c.conv_id = l.conv_id AND c.turn < l.t GROUP BY l.conv_id"""
)
def format_history(spark, d):
    return prompts.history_and_query(conversations(spark, d)).select("conv_id", prompts.history_text(F.col("history")).alias("history"))


@query(f"WITH {PLACED} SELECT conv_id, NOT bool_or({WRONG}) AS ok FROM p GROUP BY conv_id")
def role_alternation(spark, d):
    return conversations(spark, d).select("conv_id", prompts.alternates(F.col("turns")).alias("ok"))


@query(
    f"""WITH {PLACED}, r AS (SELECT conv_id, coalesce(arg_min(CASE WHEN {WRONG} THEN -2 ELSE -1 END, i) FILTER ({WRONG} OR regexp_replace(coalesce(text, ''), '^{WS_SQL}|{WS_SQL}$', '', 'g') = ''), 0) AS reason FROM p GROUP BY conv_id)
SELECT reason, count(*) AS n FROM r GROUP BY reason"""
)
def reject_reasons(spark, d):
    return conversations(spark, d).groupBy(prompts.reject_reason(F.col("turns")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, string_agg(CAST(i AS VARCHAR) || '. ' || item, chr(10) ORDER BY i) AS checklist FROM (SELECT l_orderkey, 'part ' || CAST(l_partkey AS VARCHAR) AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'part ' || CAST(l_partkey AS VARCHAR)) AS i FROM lineitem) GROUP BY l_orderkey")
def numbered_checklist(spark, d):
    item = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("item")))).alias("x"))
    return lists.select("l_orderkey", prompts.numbered(F.col("x.item")).alias("checklist"))


def _spacing_sql() -> str:
    from chatloom.functions.text import SPACING

    out = "text"
    for a, b in SPACING:
        quote = lambda s: "'" + s.replace("'", "''") + "'"
        out = f"replace({out}, {quote(a)}, {quote(b)})"
    return out


@query(f"SELECT doc_id, md5({_spacing_sql()}) AS digest, length({_spacing_sql()}) AS chars FROM documents")
def spacing_fix(spark, d):
    fixed = fix_spacing(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(fixed.cast("binary")).alias("digest"), F.length(fixed).cast("long").alias("chars"))


@query("SELECT a.conv_id, a.turn, md5(a.text) AS input, md5(b.text) AS target FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' AND a.text <> '' AND b.text <> ''")
def pair_explode(spark, d):
    rows = prompts.replies(conversations(spark, d))
    return rows.select("conv_id", "turn", *[F.md5(F.col(c).cast("binary")).alias(c) for c in ("input", "target")])


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () / 20) THEN 'eval' ELSE 'train' END AS part FROM documents")
def head_tail_split(spark, d):
    return prompts.head_and_tail(table(spark, d, "documents"), "doc_id")


@query("SELECT doc_id, CASE WHEN toxic = 0 THEN 'safe' ELSE 'unsafe' END AS label FROM labels")
def label_recode(spark, d):
    return table(spark, d, "labels").select("doc_id", prompts.recoded(F.col("toxic")).alias("label"))


@query(
    """WITH s AS (SELECT doc_id, unnest(['hate', 'sexual', 'violence']) AS name, unnest([length(text) % 7, length(text) % 5, length(text) % 3]) AS score, unnest([0, 1, 2]) AS i FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k FROM s)
SELECT doc_id, CASE name WHEN 'hate' THEN '010' WHEN 'sexual' THEN '012' ELSE '01' END AS code FROM r WHERE k = 1"""
)
def category_argmax(spark, d):
    n = F.length("text")
    scores = F.array(*[F.struct(F.lit(k).alias("name"), (n % m).alias("score")) for k, m in (("hate", 7), ("sexual", 5), ("violence", 3))])
    return table(spark, d, "documents").select("doc_id", prompts.category_code(scores).alias("code"))


@query(f"WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{WS_SQL}'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, n, n AS mask_sum FROM w WHERE n <= 4096")
def length_filter_and_mask(spark, d):
    return _masked(spark, d, 4096)


def _masked(spark, d, most):
    ids = F.transform(words(F.col("text")), lambda w: F.length(w).cast("long"))
    rows = table(spark, d, "documents").select("doc_id", ids.alias("input_ids")).where(F.size("input_ids") <= most)
    rows = rows.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    return rows.select("doc_id", F.size("input_ids").cast("long").alias("n"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"))


@query("SELECT doc_id, CASE WHEN length(text) <= 4096 THEN length(text) END AS n, length(text) > 4096 AS too_long FROM documents")
def pad_bucket(spark, d):
    fits = F.length("text") <= 4096
    ids = F.transform(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), lambda c: F.length(c).cast("long"))
    rows = table(spark, d, "documents").select("doc_id", F.when(fits, training.padded(ids, 4096, -1)).alias("ids"), (~fits).alias("too_long"))
    n = F.size(F.filter("ids", lambda x: x >= 0)).cast("long")
    return rows.select("doc_id", F.when(F.col("ids").isNotNull(), n).alias("n"), "too_long")


#: What a judge may answer: by the length of a text, with its first words as the reasoning.
_ANSWERS = (
    '```json\n[{"item": 1, "satisfied": true, "reasoning": "@"}]\n```', 'so [{"satisfied": "TRUE", "reasoning": "a \\d b"}, {"satisfied": false}] it is', '[{"satisfied": 1}]', "no answer", "[]",
    '[{"satisfied": true}] junk [2]', '[{"satisfied": true, "score": NaN}, {"satisfied": false, "score": -Infinity}]', '[{"satisfied": true}]] more ]', '[{"satisfied": false, "reasoning": "[@]"}]',
    '[{"satisfied": true}, {"satisfied": true}], [1]', '```\n[{"satisfied": " true"}]\n```',
)


def _answers_sql() -> str:
    said = " ".join(f"WHEN {i} THEN replace({quoted(x)}, '@', said)" for i, x in enumerate(_ANSWERS))
    return rf"""WITH a AS (SELECT doc_id, CASE length(text) % {len(_ANSWERS)} {said} END AS t FROM (SELECT doc_id, text, regexp_replace(text[1:40], '[^A-Za-z ]', '', 'g') AS said FROM documents)),
r AS (SELECT doc_id, coalesce(nullif(regexp_extract(t, '(?s)```(?:json)?\s*(\[.*?\])\s*```', 1), ''), nullif(regexp_extract(t, '(?s)\[.*\]', 0), ''), t) AS raw FROM a),
j AS (SELECT doc_id, regexp_replace(CASE WHEN json_valid(replace(replace(raw, '-Infinity', '0'), 'NaN', '0')) THEN raw ELSE regexp_replace(raw, '\\([^"\\/bfnrtu])', '\\\\\1', 'g') END, '(NaN|-?Infinity)', '0', 'g') AS x FROM r),
e AS (SELECT doc_id, CASE WHEN json_valid(x) AND json_type(x) = 'ARRAY' THEN list_transform(json_extract(x, '$[*]'), lambda v: CASE
  WHEN json_type(v, '$.satisfied') = 'BOOLEAN' THEN json_extract_string(v, '$.satisfied') = 'true'
  WHEN json_type(v, '$.satisfied') = 'VARCHAR' AND lower(json_extract_string(v, '$.satisfied')) IN ('true', 'false') THEN lower(json_extract_string(v, '$.satisfied')) = 'true' END) END AS b FROM j)
SELECT doc_id, CASE WHEN len(b) > 0 AND len(list_filter(b, lambda v: v IS NULL)) = 0 THEN len(b) END AS n, CASE WHEN len(b) > 0 AND len(list_filter(b, lambda v: v IS NULL)) = 0 THEN len(list_filter(b, lambda v: v)) END AS n_satisfied FROM e"""


@query(_answers_sql())
def verdict_parse(spark, d):
    said = F.regexp_replace(F.substring("text", 1, 40), "[^A-Za-z ]", "")
    answer = F.replace(F.get(F.array(*map(F.lit, _ANSWERS)), F.length("text") % len(_ANSWERS)), F.lit("@"), said)
    rows = table(spark, d, "documents").select("doc_id", evaluation.verdicts(answer, F.lit(1)).alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("n"), F.size(F.filter("v", lambda x: x)).cast("long").alias("n_satisfied"))


def _details_sql(column, limit, skip):
    return f"""(SELECT o_orderkey, any_value(o_orderpriority) AS tag, CASE WHEN o_orderkey % 13 <> 0 THEN count(*) FILTER ({column} > {limit}) END AS n_satisfied, count(*) AS n_items
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % {skip} <> 0 GROUP BY o_orderkey)"""


_ONE, _TWO = _details_sql("l_discount", 0.05, 7), _details_sql("l_tax", 0.04, 11)


@query(
    f"""SELECT count(*) AS n_tasks, count(*) FILTER (n_satisfied IS NULL) AS n_failed, count(n_satisfied) AS n_valid, round(avg(n_satisfied / n_items) * 100, 2) AS macro_rate,
round(sum(n_satisfied) / sum(n_items) FILTER (n_satisfied IS NOT NULL) * 100, 2) AS micro_rate FROM {ALL_DETAILS}"""
)
def satisfaction_summary(spark, d):
    return evaluation.summary(details(spark, d, "l_discount", 0.05))


@query(f"SELECT tag, round(avg(n_satisfied / n_items) * 100, 2) AS rate, count(*) AS n FROM {ALL_DETAILS} WHERE n_satisfied IS NOT NULL GROUP BY tag")
def satisfaction_by_tag(spark, d):
    return evaluation.by_tag(details(spark, d, "l_discount", 0.05))


_USAGE = {"gen_prompt_tokens": "nullif(l_quantity, 1)", "gen_completion_tokens": "l_suppkey", "gen_total_tokens": "l_quantity + l_suppkey", "judge_prompt_tokens": "l_partkey", "judge_completion_tokens": "CASE WHEN l_partkey < 0 THEN 1 END", "judge_total_tokens": "l_partkey + l_linenumber"}


@query(f"SELECT {', '.join(f'CAST(coalesce(sum({x}), 0) AS BIGINT) AS {n}' for n, x in _USAGE.items())} FROM lineitem")
def token_usage(spark, d):
    rows = table(spark, d, "lineitem").select(*[F.expr(x).alias(n) for n, x in _USAGE.items()])
    return evaluation.usage(rows, list(_USAGE))


_OUT = f"""x AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(nullif(a.tag, ''), nullif(b.tag, ''), 'unknown') AS tag, a.n_satisfied AS n1, b.n_satisfied AS n2,
CASE WHEN b.o_orderkey IS NULL THEN 'only1' WHEN a.o_orderkey IS NULL THEN 'only2' WHEN a.n_satisfied IS NULL OR b.n_satisfied IS NULL THEN 'failed' WHEN a.n_satisfied > b.n_satisfied THEN 'win' WHEN a.n_satisfied < b.n_satisfied THEN 'loss' ELSE 'tie' END AS outcome
FROM {_ONE} a FULL JOIN {_TWO} b ON a.o_orderkey = b.o_orderkey)"""
_WTL = "count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'tie') AS ties, count(*) FILTER (outcome = 'loss') AS losses"


def _outcomes(spark, d):
    return evaluation.outcomes(details(spark, d, "l_discount", 0.05, 7), details(spark, d, "l_tax", 0.04, 11), "o_orderkey")


@query(f"WITH {_OUT} SELECT * FROM x")
def pairwise_outcomes(spark, d):
    return _outcomes(spark, d)


@query(
    f"""WITH {_OUT}, s AS (SELECT {_WTL}, count(*) FILTER (outcome = 'failed') AS n_failed, count(*) FILTER (outcome = 'only1') AS n_only1, count(*) FILTER (outcome = 'only2') AS n_only2 FROM x)
SELECT *, wins + ties + losses AS n, round(wins / (wins + ties + losses) * 100, 2) AS win_rate, round(ties / (wins + ties + losses) * 100, 2) AS tie_rate, round(losses / (wins + ties + losses) * 100, 2) AS loss_rate,
round((wins + CAST(0.5 AS DOUBLE) * ties) / (wins + ties + losses) * 100, 2) AS adjusted_rate FROM s"""
)
def pairwise_summary(spark, d):
    return evaluation.pairwise_summary(_outcomes(spark, d))


@query(f"WITH {_OUT} SELECT tag, {_WTL}, count(*) AS n, round(count(*) FILTER (outcome = 'win') / count(*) * 100, 2) AS win_rate FROM x WHERE outcome IN ('win', 'tie', 'loss') GROUP BY tag")
def pairwise_by_tag(spark, d):
    return evaluation.pairwise_by_tag(_outcomes(spark, d))


@query(
    """WITH RECURSIVE r AS (SELECT conv_id, sum(length(text)) AS n, row_number() OVER (ORDER BY conv_id) AS i FROM conversations GROUP BY conv_id),
f AS (SELECT i, conv_id, CAST(n AS BIGINT) AS used, CASE WHEN n >= 4096 THEN 1 ELSE 0 END AS chunk FROM r WHERE i = 1
  UNION ALL SELECT r.i, r.conv_id, CAST(CASE WHEN f.used + r.n >= 4096 THEN r.n ELSE f.used + r.n END AS BIGINT), f.chunk + CASE WHEN f.used + r.n >= 4096 THEN 1 ELSE 0 END FROM f JOIN r ON r.i = f.i + 1)
SELECT conv_id, CAST(chunk AS BIGINT) AS chunk_id FROM f WHERE chunk < (SELECT max(chunk) FROM f)"""
)
def greedy_pack(spark, d):
    sizes = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("size"))
    return training.greedy_pack(sizes, "conv_id", "size", 4096)


@query(f"WITH {BATCH} SELECT doc_id, batch_no FROM k")
def length_batches(spark, d):
    return training.length_batches(table(spark, d, "documents"), "doc_id", "n_chars", 16)


@query(f"WITH {BATCH} SELECT doc_id, batch_no FROM k WHERE batch_no % 4 = 1 AND batch_no < batches // 4 * 4")
def rank_stripe(spark, d):
    docs = table(spark, d, "documents")
    return training.stripe(training.length_batches(docs, "doc_id", "n_chars", 16), 4, 1, docs.count() // 16)


@query("WITH m AS (SELECT sum(value / 100 * (event_id % 97)) / sum(event_id % 97) AS loss, CAST(sum(event_id % 97) AS BIGINT) AS tokens FROM events) SELECT round(loss, 8) AS loss, round(exp(loss), 8) AS perplexity, tokens FROM m")
def weighted_loss(spark, d):
    rows = table(spark, d, "events").select((F.col("value") / 100).alias("loss"), (F.col("event_id") % 97).alias("tokens"))
    return training.weighted_loss(rows, "loss", "tokens").select(F.round("loss", 8).alias("loss"), F.round("perplexity", 8).alias("perplexity"), "tokens")


@query("WITH b AS (SELECT event_id, value, min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events) SELECT event_id, best_before, best_before IS NULL OR value < best_before AS improved FROM b")
def best_so_far(spark, d):
    return training.best_so_far(table(spark, d, "events"), "event_type", "event_id", "value").select("event_id", "best_before", "improved")


@query("WITH b AS (SELECT event_id, value, min(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events) SELECT event_id, best_before, best_before IS NULL OR value < best_before AS improved FROM b")
def best_of_one_run(spark, d):
    """All events are one run: its rows are dealt over ranges."""
    rows = table(spark, d, "events").withColumn("run", F.lit("all"))
    return training.best_so_far(rows, "run", "event_id", "value").select("event_id", "best_before", "improved")


@query("WITH n AS (SELECT count(*) AS n FROM events), s AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS step, 3 * n // 4 AS n FROM events, n) SELECT event_id, step, round(CASE WHEN step < 100 THEN 2e-5 * (step + 1) / 100 WHEN step < n THEN 2e-6 + (2e-5 - 2e-6) * 0.5 * (1 + cos(pi() * (step - 100) / greatest(1, n - 100))) ELSE 2e-6 END, 12) AS lr FROM s")
def lr_schedule(spark, d):
    """The events in order are the steps; the last quarter of them is at the floor."""
    steps = rank_all(table(spark, d, "events").select("event_id"), ["event_id"]).withColumn("step", F.col("rank") - 1)
    return steps.select("event_id", "step", F.round(training.learning_rate(F.col("step"), 3 * steps.count() // 4, 100), 12).alias("lr"))


@query("SELECT event_id, round(exp(value / 100), 6) AS perplexity, event_id % 50 = 0 AS kth FROM events WHERE event_id < (SELECT count(*) // 2 FROM events)")
def perplexity_every_k_steps(spark, d):
    """A run that stops at half its steps."""
    events = table(spark, d, "events").withColumn("loss", F.col("value") / 100)
    rows = training.every_k_steps(events, "event_id", "loss", 50, most=events.count() // 2)
    return rows.withColumn("perplexity", F.round("perplexity", 6))


@query("SELECT event_id, round(exp(value / 100), 6) AS perplexity, event_id % 50 = 0 AS kth FROM events")
def perplexity_by_step(spark, d):
    rows = training.every_k_steps(table(spark, d, "events").withColumn("loss", F.col("value") / 100), "event_id", "loss", 50)
    return rows.withColumn("perplexity", F.round("perplexity", 6))


@query("SELECT l_partkey, round(max(abs(l_extendedprice - l_quantity)), 4) AS max_delta, round(avg(abs(l_quantity)), 6) AS mean_abs FROM lineitem GROUP BY l_partkey ORDER BY max_delta DESC, l_partkey LIMIT 10")
def topk_delta(spark, d):
    return training.tensor_deltas(table(spark, d, "lineitem"), "l_partkey", F.col("l_extendedprice"), F.col("l_quantity"))


@query(
    f"""WITH {PLACED}, s AS (SELECT conv_id, i, role, regexp_replace(coalesce(text, ''), '^{WS_SQL}|{WS_SQL}$', '', 'g') AS x, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM p),
good AS (SELECT conv_id, any_value(i) FROM s GROUP BY conv_id HAVING NOT bool_or(role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END OR x = '')),
u AS (SELECT conv_id, sum(length(x) + 11) FILTER (role = 'user') AS user_chars, sum(length(x) + 61) FILTER (role = 'assistant') AS other_chars, arg_max(role, i) AS last FROM s SEMI JOIN good USING (conv_id) GROUP BY conv_id)
SELECT conv_id, CAST(user_chars + 19 + 11 + CASE WHEN last = 'user' THEN 17 ELSE 0 END AS BIGINT) AS trainable FROM u"""
)
def flip_labels(spark, d):
    convs = conversations(spark, d)
    intent = F.concat(F.lit("You are a user chatting with an assistant language model to "), F.get("turns", F.lit(0))["text"])
    segments = training.flip_segments(convs, intent)
    return segments.select("conv_id", training.label_counts(F.col("segments"))[1].alias("trainable"))


def _safety_sql() -> str:
    listed = "\n".join(f"S{i}: {n}\n{t}" for i, (n, t) in enumerate(CATEGORIES, 1))
    head = prompts.SAFETY_TASK.replace("{agent}", "Agent") + prompts.SAFETY_LIST.replace("{listed}", listed)
    body = "string_agg(CASE WHEN i % 2 = 0 THEN 'User: ' ELSE 'Agent: ' END || text, chr(10) || chr(10) ORDER BY i)"
    return f"WITH {PLACED} SELECT conv_id, 'h' || md5({quoted(head)} || {body} || {quoted(prompts.SAFETY_ASK.replace('{agent}', 'Agent'))}) AS digest FROM p GROUP BY conv_id"


@query(_safety_sql())
def safety_prompt(spark, d):
    made = prompts.safety_prompt(F.col("turns"), CATEGORIES, "Agent", with_policy=True)
    return conversations(spark, d).select("conv_id", F.concat(F.lit("h"), F.md5(made.cast("binary"))).alias("digest"))


@query("SELECT doc_id, array_to_string(list_sort(list_transform(list_distinct(list_filter([doc_id % 3, doc_id % 5, 9], lambda x: x IN (1, 2, 4))), lambda x: 'S' || CASE x WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END)), ',') AS codes FROM labels")
def safety_target(spark, d):
    codes = F.array(*[F.concat(F.lit("O"), x.cast("string")) for x in (F.col("doc_id") % 3, F.col("doc_id") % 5, F.lit(9))])
    return table(spark, d, "labels").select("doc_id", prompts.violated_codes(codes, F.array(*[F.lit(x) for x in (1, 2, 4)])).alias("codes"))


@query("SELECT conv_id, 'ok' AS status, 'You are a user chatting with an assistant language model to ' || arg_min(text, turn) AS intent FROM conversations WHERE role = 'user' GROUP BY conv_id")
def intent_stub(spark, d):
    return stub_intents(corpus.first_user_turns(table(spark, d, "conversations")))


@query(
    f"""WITH t AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id), w AS (SELECT conv_id, list_filter(regexp_split_to_array(lower(text), '{WS_SQL}'), lambda x: x <> '') AS ws FROM t),
g AS (SELECT conv_id, array_to_string(ws[i:i + 6], ' ') AS ng FROM (SELECT conv_id, ws, unnest(range(1, len(ws) - 5)) AS i FROM w WHERE len(ws) >= 7)), hot AS (SELECT ng FROM g GROUP BY ng HAVING count(*) > 100),
kept AS (SELECT conv_id, conv_id % 50 AS stratum FROM t WHERE conv_id NOT IN (SELECT conv_id FROM g SEMI JOIN hot USING (ng))), {_SPLIT.format(user="conv_id", stratum="stratum", rows="kept")}
SELECT split, count(*) AS n, 0 AS n_forced FROM kept JOIN assigned ON u = conv_id AND s = stratum GROUP BY split"""
)
def corpus_preprocess(spark, d):
    first = corpus.first_user_turns(table(spark, d, "conversations"))
    kept = corpus.mark_repetitive(first, "conv_id", "text").where("kept").withColumn("stratum", F.col("conv_id") % 50)
    return corpus.split_stats(corpus.split_rows(kept, "conv_id", "stratum"))

