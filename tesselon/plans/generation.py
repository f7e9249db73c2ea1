"""Registered queries of prompt assembly, template answers, the feedback loop, expansion and keyword metrics, each with SQL.

The turns of a conversation are its retrieved chunks: rank by turn, kind by role, every other one without a section.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import tokens
from ..operators import answers, intent
from ..operators import grounding as grounding_of
from ..session import shared_folder
from .catalogue import _TURNS, q, query, t
from .notes import _clean_sql

_QUESTIONS = "ask AS (SELECT conv_id AS query_id, arg_min(text, turn) FILTER (role = 'user') AS question, CASE WHEN conv_id % 3 = 0 THEN 'p' || conv_id END AS patient_id FROM conversations GROUP BY conv_id)"
_CHUNKS = "chunks AS (SELECT conv_id AS query_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS rank, text, role AS kind, CASE WHEN turn % 2 = 0 THEN 'S' || turn END AS section, greatest(1.0 - 0.25 * turn, 0.0) AS score FROM conversations)"
_NL = "chr(10)"


def _questions(spark, sf):
    c = t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("question"))
    return c.withColumn("patient_id", F.when(F.col("query_id") % 3 == 0, F.concat(F.lit("p"), "query_id")))


def _chunks(spark, sf):
    rank = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1).alias("rank")
    return t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), rank, "text", F.col("role").alias("kind"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("S"), "turn")).alias("section"), F.greatest(1 - 0.25 * F.col("turn"), F.lit(0.0)).alias("score"))


def _prompt_sql(budget: int) -> str:
    label = "'[' || coalesce(kind, 'document') || ' | ' || coalesce(section, 'general') || ' | score: ' || printf('%.2f', score) || ']'"
    return f"""{_QUESTIONS}, {_CHUNKS}, w AS (SELECT *, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM chunks WHERE text IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM w WHERE used <= {budget}),
m AS (SELECT query_id, string_agg('--- Context ' || place || ' ' || {label} || ' ---' || {_NL} || text, {_NL} || {_NL} ORDER BY rank) AS context, count(*) AS n, max(used) AS used FROM b GROUP BY query_id),
p AS (SELECT ask.query_id, coalesce(question, '') AS question, CASE WHEN patient_id IS NOT NULL THEN 'Patient ID: ' || patient_id || {_NL} || {_NL} ELSE '' END || 'PATIENT CONTEXT:' || {_NL} || coalesce(context, '{answers.NO_CONTEXT}') || {_NL} || {_NL} || 'QUESTION: ' || coalesce(question, '') || {_NL} || {_NL} || 'Please answer based solely on the context above.' AS user_message,
 CAST(coalesce(n, 0) AS INTEGER) AS n_context, CAST(coalesce(used, 0) + length(coalesce(question, '')) // 4 AS INTEGER) AS tokens FROM ask LEFT JOIN m USING (query_id))"""


@query(f"WITH {_prompt_sql(6000)} SELECT query_id, sha256(user_message) AS message, n_context, tokens FROM p")
def prompt_main(spark, sf):
    p = answers.prompts(_questions(spark, sf), _chunks(spark, sf))
    return p.select("query_id", F.sha2("user_message", 256).alias("message"), "n_context", "tokens")


_ANSWER = f"""a AS (SELECT *, strpos(user_message, '--- Context') AS c, strpos(user_message, 'QUESTION:') AS qn FROM p),
r AS (SELECT *, CASE WHEN c = 0 THEN '{answers.NOT_AVAILABLE}' ELSE 'Based on the clinical records: ' || substr(regexp_replace(substr(substr(user_message, c, CASE WHEN qn > 1 THEN greatest(qn - c, 0) ELSE length(user_message) END), 1, 300), '^\\s+|\\s+$', '', 'g'), 1, 200) || '...' || {_NL} || {_NL} || '[Mock response]' END AS answer FROM a)"""


@query(f"WITH {_prompt_sql(150)}, {_ANSWER} SELECT query_id, answer, CAST(length(user_message) // 4 AS INTEGER) AS input_tokens, CAST(length(answer) // 4 AS INTEGER) AS output_tokens FROM r")
def template_answers(spark, sf):
    p = answers.prompts(_questions(spark, sf), _chunks(spark, sf), 150)
    return p.select("query_id", answers.template_answer(F.col("user_message")).alias("a")).select("query_id", "a.*")


@query(f"WITH {_prompt_sql(150)}, tpl(query_type, line) AS (VALUES " + ", ".join(f"('{k}', {q(v)})" for k, v in rules.rows(rules.TEMPLATES)) + ") SELECT query_id, query_type, sha256(user_message || chr(10) || line) AS message FROM p JOIN tpl ON query_type = (['factual_lookup','explanation','comparison','multi_hop','summarization','temporal'])[1 + query_id % 6]")
def prompt_templates(spark, sf):
    kinds = [k for k, _ in rules.rows(rules.TEMPLATES)]
    p = answers.prompts(_questions(spark, sf), _chunks(spark, sf), 150).withColumn("query_type", F.array(*map(F.lit, kinds))[(F.col("query_id") % 6).cast("int")])
    lines = F.broadcast(spark.createDataFrame(rules.rows(rules.TEMPLATES), "query_type string, line string"))
    return p.join(lines, "query_type").select("query_id", "query_type", F.sha2(F.concat("user_message", F.lit("\n"), "line"), 256).alias("message"))


@query(f"WITH {_QUESTIONS} SELECT query_id, CASE WHEN len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')) < 10 THEN question || ' related information' ELSE replace(replace(question, ' exact ', ' '), ' only ', ' ') END AS broader FROM ask")
def broader_queries(spark, sf):
    return _questions(spark, sf).select("query_id", answers.broader(F.col("question")).alias("broader"))


_SHARE = "CAST(CAST(round(score * 100) AS INTEGER) AS VARCHAR) || '%'"


@query(f"""SELECT event_id, CASE WHEN score < 0.5 THEN props || chr(10) || chr(10) || '[Note: Low confidence (' || {_SHARE} || '). The retrieved records may not fully address this query. Please verify with the original clinical records.]'
 WHEN score < 0.7 THEN props || chr(10) || chr(10) || '[Note: Moderate confidence (' || {_SHARE} || '). Consider reviewing source records for complete information.]' ELSE props END AS answer FROM (SELECT *, (event_id % 101) / 100.0 AS score FROM events)""")
def confidence_warnings(spark, sf):
    e = t(spark, sf, "events").withColumn("score", F.col("event_id") % 101 / 100)
    return e.select("event_id", answers.with_warning(F.col("props"), F.col("score")).alias("answer"))


def _attempt(spark, sf):
    path = shared_folder(spark)
    _chunks(spark, sf).write.parquet(path)
    chunks = spark.read.parquet(path)

    def run(open_):
        top = chunks.join(open_.select("query_id", "k"), "query_id").where("rank < k")
        means = top.groupBy("query_id").agg(F.avg(F.when(F.col("rank") < 5, F.col("score"))).alias("mean"), F.count("*").alias("n"))
        made = answers.prompts(open_.select("query_id", "question", F.lit(None).cast("string").alias("patient_id")), top, 150).select("query_id", answers.template_answer(F.col("user_message"))["answer"].alias("answer"))
        return open_.join(made, "query_id").join(means, "query_id", "left").withColumn("score", answers.confidence(F.coalesce("mean", F.lit(0.0)), F.coalesce("n", F.lit(0)), F.col("answer")))

    return run


def _attempt_sql(n: int, source: str) -> str:
    """CTEs of one pass over source(query_id, question, k): a{n}(query_id, question, k, answer, score)."""
    return f"""top{n} AS (SELECT c.* FROM chunks c JOIN {source} o USING (query_id) WHERE rank < k),
mean{n} AS (SELECT query_id, avg(score) FILTER (rank < 5) AS mean, count(*) AS n FROM top{n} GROUP BY query_id),
w{n} AS (SELECT *, sum(greatest(1, length(text) // 4)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM top{n} WHERE text IS NOT NULL),
b{n} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM w{n} WHERE used <= 150),
m{n} AS (SELECT query_id, string_agg('--- Context ' || place || ' [' || coalesce(kind, 'document') || ' | ' || coalesce(section, 'general') || ' | score: ' || printf('%.2f', score) || '] ---' || {_NL} || text, {_NL} || {_NL} ORDER BY rank) AS context FROM b{n} GROUP BY query_id),
u{n} AS (SELECT o.query_id, o.question, o.k, 'PATIENT CONTEXT:' || {_NL} || coalesce(context, '{answers.NO_CONTEXT}') || {_NL} || {_NL} || 'QUESTION: ' || coalesce(question, '') || {_NL} || {_NL} || 'Please answer based solely on the context above.' AS user_message FROM {source} o LEFT JOIN m{n} USING (query_id)),
v{n} AS (SELECT *, strpos(user_message, '--- Context') AS c, strpos(user_message, 'QUESTION:') AS qn FROM u{n}),
x{n} AS (SELECT *, CASE WHEN c = 0 THEN '{answers.NOT_AVAILABLE}' ELSE 'Based on the clinical records: ' || substr(regexp_replace(substr(substr(user_message, c, CASE WHEN qn > 1 THEN greatest(qn - c, 0) ELSE length(user_message) END), 1, 300), '^\\s+|\\s+$', '', 'g'), 1, 200) || '...' || {_NL} || {_NL} || '[Mock response]' END AS answer FROM v{n}),
a{n} AS (SELECT x.*, CAST(round(CASE WHEN regexp_matches(lower(answer), '{rules.FALLBACK}') THEN 0.3 ELSE least(1.0, 0.4 * least(1.0, coalesce(mean, 0)::DOUBLE) + 0.3 * least(1.0, coalesce(mean{n}.n, 0) / 3) + 0.3 * least(1.0, len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda w: w <> '')) / 20)) END, 3) AS DOUBLE) AS score FROM x{n} x LEFT JOIN mean{n} USING (query_id)),
d{n} AS (SELECT *, CASE WHEN {n} >= 2 OR score >= 0.7 THEN 'stop' WHEN score >= 0.5 AND {n} = 0 THEN 'expand_query' WHEN score < 0.5 THEN 'increase_k' ELSE 'stop' END AS action FROM a{n}),
o{n + 1} AS (SELECT query_id, CASE WHEN action = 'expand_query' THEN CASE WHEN len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')) < 10 THEN question || ' related information' ELSE replace(replace(question, ' exact ', ' '), ' only ', ' ') END ELSE question END AS question, CASE WHEN action = 'expand_query' THEN k ELSE 20 END AS k FROM d{n} WHERE action <> 'stop')"""


@query(f"WITH {_QUESTIONS}, {_CHUNKS}, o0 AS (SELECT query_id, question, 1 AS k FROM ask), {_attempt_sql(0, 'o0')}, {_attempt_sql(1, 'o1')}, {_attempt_sql(2, 'o2')} " + " UNION ALL ".join(f"SELECT query_id, sha256(answer) AS answer, score, {n} AS attempts, action FROM d{n} WHERE action = 'stop'" for n in range(3)))
def feedback_loop(spark, sf):
    out = answers.feedback_loop(_questions(spark, sf).select("query_id", "question"), _attempt(spark, sf), 1)
    return out.withColumn("answer", F.sha2("answer", 256))


# ---------------------------------------------------------------- evaluation variant

_KEYWORDS = "keys AS (SELECT query_id, question, list_filter(list_distinct_in_order, lambda x: length(x) >= 4) AS keywords FROM (SELECT query_id, question, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS list_distinct_in_order FROM (SELECT query_id, question, regexp_extract_all(lower(coalesce(question, '')), '[\\p{L}\\p{N}_]+') AS ws FROM ask)))"


def _keywords(spark, sf):
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("question", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return _questions(spark, sf).withColumn("keywords", F.filter(words, lambda w: F.length(w) >= 4))


_EVALUATION = f"""{_QUESTIONS}, {_CHUNKS}, {_KEYWORDS}, planted AS (SELECT query_id * 100000 + rank AS doc_id, text FROM chunks WHERE text IS NOT NULL), {_clean_sql()},
e0 AS (SELECT chunks.* EXCLUDE (text), c10.text AS text FROM chunks JOIN c10 ON c10.doc_id = query_id * 100000 + rank), e1 AS (SELECT *, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM e0),
e2 AS (SELECT query_id, string_agg('[Source: ' || coalesce(kind, 'record') || ' | Section: ' || coalesce(section, 'None') || ' | RRF score: ' || printf('%.4f', score) || ']' || {_NL} || text, {_NL} || {_NL} || '---' || {_NL} || {_NL} ORDER BY rank) AS context, count(*) AS n, max(used) AS used FROM e1 WHERE used <= 7424 GROUP BY query_id),
e AS (SELECT query_id, keywords, 'CLINICAL RECORDS CONTEXT:' || {_NL} || {_NL} || coalesce(context, 'No relevant context retrieved.') || {_NL} || {_NL} || '---' || {_NL} || {_NL} || 'QUESTION: ' || coalesce(question, '') || {_NL} || {_NL} || 'Answer based solely on the context above. Cite source sections.' AS user_message, CAST(coalesce(n, 0) AS INTEGER) AS n_context, CAST(coalesce(used, 0) AS INTEGER) AS context_tokens FROM keys LEFT JOIN e2 USING (query_id))"""


@query(f"WITH {_EVALUATION} SELECT query_id, sha256(user_message) AS message, n_context, context_tokens, round(context_tokens / 7424, 6) AS utilisation FROM e")
def prompt_evaluation(spark, sf):
    p = answers.evaluation_prompts(_questions(spark, sf), _chunks(spark, sf))
    return p.select("query_id", F.sha2("user_message", 256).alias("message"), "n_context", "context_tokens", "utilisation")


_HITS = "list_filter(list_transform(found[1:5], lambda k: '  - ' || substr(regexp_replace(list_filter(ls, lambda x: contains(lower(x), k) AND length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 5)[1], '^\\s+|\\s+$', '', 'g'), 1, 100)), lambda x: x IS NOT NULL)"


@query(f"""WITH {_EVALUATION}, f AS (SELECT *, list_filter(keywords, lambda k: contains(lower(user_message), k)) AS found, string_split(user_message, {_NL}) AS ls FROM e), h AS (SELECT *, {_HITS} AS hits FROM f),
x AS (SELECT *, CASE WHEN len(found) = 0 THEN 'Not found in the provided records.' WHEN len(hits) > 0 THEN array_to_string(list_prepend('Based on [NOTE]:', hits), {_NL}) ELSE 'Found: ' || array_to_string(found, ', ') END AS answer FROM h)
SELECT query_id, sha256(answer) AS answer, CASE WHEN len(keywords) = 0 THEN 1.0 ELSE round(len(list_filter(keywords, lambda k: contains(lower(answer), k))) / len(keywords), 6) END AS coverage FROM x""")
def keyword_answers(spark, sf):
    p = answers.evaluation_prompts(_questions(spark, sf), _chunks(spark, sf)).join(_keywords(spark, sf).select("query_id", "keywords"), "query_id")
    a = p.withColumn("full", answers.keyword_answer(F.col("user_message"), F.lit("NOTE"), F.col("keywords")))
    return a.select("query_id", F.sha2("full", 256).alias("answer"), F.round(answers.coverage(F.col("full"), F.col("keywords")), 6).alias("coverage"))


@query(f"""WITH {_QUESTIONS}, {_CHUNKS}, {_KEYWORDS}, r AS (SELECT keys.query_id, keywords, list(lower(coalesce(text, ''))) FILTER (rank IS NOT NULL) AS ts FROM keys LEFT JOIN chunks ON chunks.query_id = keys.query_id GROUP BY ALL)
SELECT query_id, CASE WHEN len(keywords) = 0 THEN 1.0 ELSE round(len(list_filter(keywords, lambda k: len(list_filter(coalesce(ts, []), lambda x: contains(x, k))) > 0)) / len(keywords), 6) END AS recall,
 CASE WHEN len(keywords) = 0 OR ts IS NULL THEN 0.0 ELSE round(len(list_filter(ts, lambda x: len(list_filter(keywords, lambda k: contains(x, k))) > 0)) / len(ts), 6) END AS precision FROM r""")
def keyword_recall_precision(spark, sf):
    return answers.keyword_scores(_keywords(spark, sf).select("query_id", "keywords"), _chunks(spark, sf))


# ---------------------------------------------------------------- expansion


def _terms_sql() -> str:
    edge = "(?i)(?:^|[^\\p{L}\\p{N}_])"
    item = lambda x, w, k: f"{{'term': {q(x)}, 'weight': {w}, 'kind': '{k}'}}"
    xs = [f"CASE WHEN regexp_matches(query, {q(edge + a.replace('&', '[&]') + '(?:$|[^\\p{L}\\p{N}_])')}) THEN {item(x, 0.85, 'abbreviation')} END" for a, x in rules.rows(rules.ABBREVIATIONS)]
    for line in rules.SYNONYMS.strip().splitlines():
        term, *lists = line.split(" ~ ")
        xs += [f"CASE WHEN contains(lower(query), '{term}') THEN {item(x, w, k)} END" for ys, w, k in zip(lists, (0.9, 0.85, 0.7), ("synonym", "abbreviation", "related")) for x in ys.split(", ")]
    return f"{_TURNS}, planted_q AS (SELECT conv_id, turn, query || {_ASK_TAIL} AS query FROM a), e0 AS (SELECT conv_id, turn, query, list_prepend({{'term': query, 'weight': 1.0, 'kind': 'original'}}, list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)) AS ts FROM planted_q), e1 AS (SELECT *, list_transform(ts, lambda y: lower(y.term)) AS low FROM e0), e AS (SELECT conv_id, turn, query, list_filter(ts, lambda x, i: list_position(low, lower(x.term)) = i)[1:10] AS ts FROM e1)"


_ASK_TAIL = "CASE turn % 5 WHEN 0 THEN ' BP and hypertension after surgery' WHEN 1 THEN ' ECG of diabetes, pneumonia, allergy lab' WHEN 2 THEN ' HTN vital signs' ELSE '' END"


def _asked(spark, sf):
    c = t(spark, sf, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.concat("text", F.expr(_ASK_TAIL)).alias("query"))


@query(f"WITH {_terms_sql()} SELECT conv_id, turn, array_to_string(list_transform(ts, lambda x: md5(x.term) || ':' || x.kind), ' ') AS terms, md5(array_to_string(list_filter(strong, lambda x, i: list_position(strong, x) = i), ' ')) AS expanded FROM (SELECT *, list_prepend(query, list_transform(list_filter(ts, lambda x: x.weight >= 0.7 AND x.kind <> 'related'), lambda x: x.term)) AS strong FROM e) WHERE query IS NOT NULL")
def expand_synonyms(spark, sf):
    terms = intent.expansion_terms(F.col("query"))
    d = _asked(spark, sf).where("query is not null").withColumn("ts", terms)
    return d.select("conv_id", "turn", F.array_join(F.transform("ts", lambda x: F.concat(F.md5(x["term"]), F.lit(":"), x["kind"])), " ").alias("terms"), F.md5(intent.expanded_query(F.col("query"), F.col("ts"))).alias("expanded"))


def _reason_sql() -> str:
    groups: dict[str, list[str]] = {}
    for k, p in rules.rows(rules.INTENTS):
        groups.setdefault(k, []).append(p)
    per = ", ".join(f"'{k}=' || array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(query), {q(p)}) THEN {q(p)} END' for p in ps)}], lambda x: x IS NOT NULL)[1:2], ' ')" for k, ps in groups.items())
    return f"SELECT conv_id, turn, array_to_string(list_filter([{per}], lambda x: NOT ends_with(x, '=')), ';') AS reasons FROM (SELECT conv_id, turn, text || CASE turn % 4 WHEN 0 THEN ' list all labs when was the last month trend' ELSE ' why, which and overall?' END AS query FROM conversations WHERE role = 'user') WHERE query IS NOT NULL"


@query(_reason_sql())
def classification_reasons(spark, sf):
    c = t(spark, sf, "conversations").where("role = 'user' and text is not null")
    tail = F.when(F.col("turn") % 4 == 0, " list all labs when was the last month trend").otherwise(" why, which and overall?")
    reasons = F.transform(intent.reasoning(F.concat("text", tail)), lambda x: F.concat(x["query_type"], F.lit("="), F.array_join(x["patterns"], " ")))
    return c.select("conv_id", "turn", F.array_join(reasons, ";").alias("reasons"))


# ---------------------------------------------------------------- grounding: numbers and terms of a turn that the turn before lacks

_GROUND = r"""p AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations),
a AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ' AS mine, ' ' || array_to_string(regexp_extract_all(lower(before), '[\p{L}\p{N}_]+'), ' ') || ' ' AS other FROM p WHERE role = 'assistant'),
w AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark),
terms AS (SELECT DISTINCT term FROM (SELECT unnest(list_filter(w, lambda x: length(x) >= 6)) AS term FROM w UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)))"""


@query(rf"""WITH {_GROUND}, f AS (SELECT conv_id, turn, string_agg(term, ',' ORDER BY term) AS terms FROM a JOIN terms ON contains(mine, ' ' || term || ' ') AND NOT contains(other, ' ' || term || ' ') GROUP BY ALL),
n AS (SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?')), lambda x: NOT list_contains(regexp_extract_all(before, '[0-9]+(?:[.][0-9]+)?'), x))), ',') AS numbers FROM a)
SELECT conv_id, turn, numbers, coalesce(terms, '') AS terms, numbers = '' AND terms IS NULL AS grounded FROM n LEFT JOIN f USING (conv_id, turn)""")
def grounding(spark, sf):
    """Terms: the longer words and all word pairs of the benchmark."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")).alias("before")).where("role = 'assistant'")
    w = t(spark, sf, "benchmark").select(tokens(F.col("text")).alias("w"))
    pairs = w.select(F.explode(F.transform(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b")), lambda x: F.when(x["b"].isNotNull(), F.concat_ws(" ", x["a"], x["b"])))).alias("term"))
    terms = w.select(F.explode(F.filter("w", lambda x: F.length(x) >= 6)).alias("term")).union(pairs.where("term is not null")).distinct()
    return grounding_of.ungrounded(c, ["conv_id", "turn"], terms).select("conv_id", "turn", F.array_join("numbers", ",").alias("numbers"), F.array_join("terms", ",").alias("terms"), "grounded")
