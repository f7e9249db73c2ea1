"""Registered queries of the retrieval and analytics operators, each with the same query in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import answers, chunking, index, intent, ops, retrieval, service
from ..sources import loaders
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PII = dict(rules.rows(rules.PII))
TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
SMALL = 10_000  # rows of a stated query set or rule table that may be broadcast


def q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


# ---------------------------------------------------------------- text and personal data


@query(f"SELECT lang, CAST(sum(len({TOK})) AS BIGINT) AS n_tokens, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS estimate FROM documents GROUP BY lang")
def token_count_by_lang(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").groupBy("lang").agg(F.sum(F.size(text.tokens(c))).cast("long").alias("n_tokens"), F.sum(text.token_estimate(c)).cast("long").alias("estimate"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(text), 'discharge summary|discharge note') THEN 'discharge_summary'
 WHEN regexp_matches(lower(text), 'radiology|impression:|findings:|mri|ct scan|x-ray') THEN 'radiology_report'
 WHEN regexp_matches(lower(text), 'lab result|laboratory|specimen|result:') THEN 'lab_report' ELSE 'clinical_note' END AS kind FROM documents) GROUP BY kind""")
def clinical_type_detect(spark, sf):
    return t(spark, sf, "documents").groupBy(text.clinical_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, {q(p)}))) AS BIGINT) AS {k}" for k, p in PII.items()) + " FROM documents")
def pii_counts_by_type(spark, sf):
    return t(spark, sf, "documents").agg(*[F.sum(c).alias(k) for k, c in text.pii_counts(F.col("text")).items()])


_TYPES = "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN '{k}' END" for k, p in PII.items()) + "], lambda x: x IS NOT NULL))"


@query(f"SELECT doc_id, array_to_string(types, ',') AS types FROM (SELECT doc_id, {_TYPES} AS types FROM documents) WHERE len(types) > 0")
def pii_docs_flagged(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", text.pii_types(F.col("text")).alias("types"))
    return d.where(F.size("types") > 0).select("doc_id", F.array_join("types", ",").alias("types"))


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, {q(PII['phone'])}, '[PHONE_REDACTED]', 'g'), {q(PII['email'])}, '[EMAIL_REDACTED]', 'g')) AS masked FROM documents")
def pii_mask_constant(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(text.mask_constant(F.col("text"), ("phone", "email")), 256).alias("masked"))


@query(f"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, {q(PII['email'])}) AS a, list_transform(regexp_extract_all(text, {q(PII['email'])}), lambda x: '[EMAIL_' || sha256('salt:email:' || x)[:8] || ']') AS b FROM documents)
SELECT doc_id, sha256(array_to_string(list_transform(range(1, len(a) + 1), lambda i: a[i] || coalesce(b[i], '')), '')) AS masked FROM p""")
def pii_mask_hashed(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(text.mask_hashed(F.col("text"), "email", "EMAIL"), 256).alias("masked"))


@query(f"SELECT role, round(avg(CASE WHEN len({_TYPES}) > 0 THEN 1.0 ELSE 0.0 END), 6) AS leakage FROM conversations GROUP BY role")
def pii_leakage_rate(spark, sf):
    leaked = answers.validated(F.col("text"))["blocked"]
    return t(spark, sf, "conversations").groupBy("role").agg(F.round(F.avg(leaked.cast("double")), 6).alias("leakage"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dedup_hash(spark, sf):
    return t(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_passage_hits(spark, sf):
    """Items of six words and more are found by four words that lie inside them, shorter ones by a scan; then the texts are compared."""
    b = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"), text.whitespace_words(F.col("text")).alias("w"))
    four = lambda at: F.xxhash64(*[F.col("w")[at + k] for k in range(4)])
    long = b.where(F.size("w") >= 6).select("item_id", "item", four(F.lit(1)).alias("h"))
    d = t(spark, sf, "documents").select("doc_id", "text")
    places = F.explode(F.when(F.size("w") >= 4, F.sequence(F.lit(0), F.size("w") - 4)))
    grams = d.select("doc_id", text.whitespace_words(F.col("text")).alias("w")).select("doc_id", "w", places.alias("i")).select("doc_id", four(F.col("i")).alias("h"))
    hits = grams.join(F.broadcast(long.drop("item")) if long.count() <= SMALL else long.drop("item"), "h").select("doc_id", "item_id").distinct()
    held = hits.join(b.select("item_id", "item"), "item_id").join(d, "doc_id")
    short = b.where(F.size("w") < 6)
    few = F.broadcast(short) if short.count() <= SMALL else short
    return held.where("contains(text, item)").select("doc_id", "item_id").union(d.join(few, F.expr("contains(text, item)")).select("doc_id", "item_id"))


@query(r"SELECT conv_id, turn, CAST(len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda n: NOT list_contains(ctx, n))) AS INTEGER) AS ungrounded FROM (SELECT conv_id, turn, role, text, regexp_extract_all(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '[0-9]+') AS ctx FROM conversations) WHERE role = 'assistant'")
def numeric_grounding(spark, sf):
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    num = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    d = t(spark, sf, "conversations").withColumn("before", before).where("role = 'assistant'")
    return d.select("conv_id", "turn", F.size(F.array_except(num(F.col("text")), num(F.col("before")))).alias("ungrounded"))


# ---------------------------------------------------------------- chunks


def _windows_sql(size: int, step: int, least: int, keep_short: bool = False) -> str:
    return f"""WITH w AS (SELECT doc_id, text, {WORDS} AS w FROM documents),
k AS (SELECT doc_id, CASE WHEN {keep_short} AND len(w) <= {size} THEN text END AS whole, w, unnest(range(CASE WHEN len(w) <= {size} THEN 1 ELSE 1 + CAST(ceil((len(w) - {size}) / {step}) AS BIGINT) END)) AS k FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, k, whole, w[k * {step} + 1 : k * {step} + {size}] AS p FROM k),
f AS (SELECT doc_id, k, len(p) AS n, coalesce(whole, array_to_string(p, ' ')) AS s FROM c),
i AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index, CAST(n AS INTEGER) AS n_words, s FROM f WHERE greatest(1, length(s) // 4) >= {least})"""


@query(_windows_sql(1600, 1400, 20, True) + " SELECT doc_id, chunk_index, doc_id || '_chunk_' || chunk_index AS chunk_id, n_words, sha256(s) AS hash FROM i")
def sliding_windows_main(spark, sf):
    c = chunking.sliding_windows(t(spark, sf, "documents"), 1600, 1400, 20, keep_short=True)
    return c.select("doc_id", "chunk_index", "chunk_id", "n_words", F.sha2("text", 256).alias("hash"))


@query(_windows_sql(300, 250, 15) + " SELECT doc_id, chunk_index, n_words, chunk_index > 0 AS overlap_prev, chunk_index < max(chunk_index) OVER (PARTITION BY doc_id) AS overlap_next, replace(s[:120], chr(10), ' ') || CASE WHEN length(s) > 120 THEN '...' ELSE '' END AS preview FROM i")
def sliding_windows_eval(spark, sf):
    c = chunking.overlap_flags(chunking.sliding_windows(t(spark, sf, "documents"), 300, 250, 15))
    return c.select("doc_id", "chunk_index", "n_words", "overlap_prev", "overlap_next", text.preview(F.col("text")).alias("preview"))


@query(_windows_sql(300, 250, 15) + " SELECT count(*) AS chunks, round(avg(greatest(1, length(s) // 4)), 6) AS avg_tokens, count(DISTINCT doc_id) AS docs FROM i")
def chunk_stats(spark, sf):
    c = chunking.sliding_windows(t(spark, sf, "documents"), 300, 250, 15)
    return c.agg(F.count("*").alias("chunks"), F.round(F.avg(text.token_estimate(F.col("text"))), 6).alias("avg_tokens"), F.count_distinct("doc_id").alias("docs"))


_HEADERS = rules.HEADERS


@query(f"""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)) AS ls FROM documents), l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
m AS (SELECT doc_id, i, line, regexp_matches(line, '(?i)^(?:{_HEADERS})[:\\s]*$') AS h FROM l),
s AS (SELECT *, CAST(sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS section_no FROM m),
x AS (SELECT doc_id, section_no, coalesce(max(CASE WHEN h THEN upper(rtrim(line, ': ')) END), 'PREAMBLE') AS section, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS text FROM s GROUP BY doc_id, section_no)
SELECT doc_id, section_no, section, sha256(text) AS hash FROM x WHERE text <> ''""")
def section_split_all(spark, sf):
    return chunking.sections(t(spark, sf, "documents"), _HEADERS).select("doc_id", "section_no", "section", F.sha2("text", 256).alias("hash"))


@query()
def paragraph_pack_all(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.posexplode(chunking.pack_paragraphs(F.col("text"), 800)).alias("chunk_index", "text"))
    return d.select("doc_id", "chunk_index", text.token_estimate(F.col("text")).alias("n_tokens"), F.sha2("text", 256).alias("hash"))


# ---------------------------------------------------------------- retrieval

TERMS = ["the", "and", "thing", "der", "que"]
_IN = ", ".join(f"'{x}'" for x in TERMS)
_BM25 = f"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY doc_id), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, c GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT 0.25 * avg(raw) FROM df) ELSE raw END AS idf FROM df WHERE term IN ({_IN})),
s AS (SELECT doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, list_sort(list(DISTINCT term)) AS m FROM p JOIN idf USING (term) JOIN dl USING (doc_id), c GROUP BY doc_id)"""


def _bm25(spark, sf):
    """doc_id, score, matched_terms of the five terms, from the written index."""
    asked = spark.createDataFrame([(1, x) for x in TERMS], "query_id int, term string")
    return index.search(spark, index.built(t(spark, sf, "documents"), f"{sf}/documents"), asked).where("score > 0")


@query(_BM25 + " SELECT doc_id, score, array_to_string(m, ' ') AS matched FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf):
    s = _bm25(spark, sf)
    return s.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "score", F.array_join("matched_terms", " ").alias("matched"))


@query(_BM25 + " SELECT doc_id, score FROM s JOIN documents USING (doc_id) WHERE score > 0 AND source = 'src3' ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk_filtered(spark, sf):
    s = _bm25(spark, sf).join(t(spark, sf, "documents").where("source = 'src3'").select("doc_id"), "doc_id", "left_semi")
    return s.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "score")


_OVERLAP = f"o AS (SELECT doc_id, round(len(list_filter(list_distinct({TOK}), lambda x: x IN ({_IN}))) / greatest(len({TOK}), 1), 6) AS score FROM documents)"


@query(f"WITH {_OVERLAP} SELECT doc_id, score FROM o WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10")
def overlap_tf_topk(spark, sf):
    return _overlap(spark, sf).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(10)


def _overlap(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("w"))
    return d.select("doc_id", F.round(F.size(F.array_intersect("w", F.array(*map(F.lit, TERMS)))) / F.greatest(F.size("w"), F.lit(1)), 6).alias("score"))


@query(_BM25 + f""", {_OVERLAP}, a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM s WHERE score > 0 QUALIFY r < 20), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM o WHERE score > 0 QUALIFY r < 20),
u AS (SELECT doc_id, 0.7 / (61 + r) AS s FROM b UNION ALL SELECT doc_id, 0.3 / (61 + r) FROM a), g AS (SELECT doc_id, round(sum(s), 9) AS score FROM u GROUP BY doc_id)
SELECT doc_id, score FROM g ORDER BY score DESC, doc_id LIMIT 10""")
def rrf_fusion(spark, sf):
    def ranked(df):
        top = df.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(20).withColumn("query_id", F.lit(1))
        return retrieval.top_k(top, "query_id", 20, F.desc("score"), F.col("doc_id"))

    fused = retrieval.rrf([(ranked(_overlap(spark, sf)), 0.7), (ranked(_bm25(spark, sf)), 0.3)])
    return fused.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", "score")


_DOT = "round(list_inner_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
_DENSE = f"WITH x AS (SELECT q.vec_id AS query_id, q.label AS ql, v.vec_id, v.label, {_DOT} AS score FROM embeddings v, embeddings q WHERE q.vec_id < 5), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS INTEGER) AS rank FROM x)"


_DENSE_ALL = _DENSE.replace("WHERE q.vec_id < 5", "WHERE q.vec_id % 20 = 0")


def _asking(spark, sf):
    """The stated query set, every row whose id is divisible by 20, and all rows."""
    e = t(spark, sf, "embeddings")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("ql")), e


@query(_DENSE_ALL + " SELECT query_id, vec_id, score, rank FROM r WHERE rank < 10")
def dense_topk_batch_all(spark, sf):
    return retrieval.dense_search(*_asking(spark, sf), 10).drop("rel")


@query(_DENSE_ALL + " SELECT query_id, vec_id, score, rank FROM r WHERE rank < 20 AND score >= 0.3")
def dense_min_score_all(spark, sf):
    return retrieval.dense_search(*_asking(spark, sf), 20).where("score >= 0.3").drop("rel")


@query(_DENSE_ALL.replace("% 20 = 0", "% 20 = 0 AND v.label = q.label") + " SELECT query_id, vec_id, score, rank FROM r WHERE rank < 5")
def dense_topk_filtered_all(spark, sf):
    return retrieval.dense_search(*_asking(spark, sf), 5, same_label=True).drop("rel")


@query(r"SELECT b AS bucket, count(*) AS n FROM (SELECT ('0x' || md5(w)[:8])::BIGINT % 64 AS b FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM documents)) GROUP BY b")
def hash_embed(spark, sf):
    return t(spark, sf, "documents").select(F.explode(F.transform(retrieval.hash_buckets(F.col("text"), 64), lambda b: b.cast("long"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> ''), lambda w: ('0x' || md5(w)[:8])::BIGINT % 64) AS b FROM documents),
c AS (SELECT doc_id, list_transform(range(64), lambda k: len(list_filter(b, lambda x: x = k))) AS c FROM w)
SELECT doc_id, list_transform(c, lambda x: round(x / greatest(1.0::DOUBLE, sqrt(list_sum(list_transform(c, lambda y: y * y))::DOUBLE)), 6)) AS vector FROM c""")
def hash_embed_all(spark, sf):
    return retrieval.hash_vectors(t(spark, sf, "documents"), 64)


@query("SELECT d.lang, count(*) AS n FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY d.lang")
def semi_valid_ids(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT d.lang, count(*) AS n FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY d.lang")
def anti_removed_docs(spark, sf):
    return loaders.remove_document(t(spark, sf, "documents"), t(spark, sf, "labels").where("toxic = 1")).groupBy("lang").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- query intelligence


# The same over every user turn of the conversations.
_EDGE = r"(?i)(?:^|[^\p{{L}}\p{{N}}_]){}(?:$|[^\p{{L}}\p{{N}}_])"  # in DuckDB \b knows ASCII letters only
_TURNS = "a AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user')"


def _turns(spark, sf):
    return t(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))


def _intent_all_sql() -> str:
    groups: dict[str, list[str]] = {}
    for k, p in rules.rows(rules.INTENTS):
        groups.setdefault(k, []).append(p)
    hits = ", ".join("least(3, " + " + ".join(f"coalesce(CAST(regexp_matches(lower(query), {q(p)}) AS INT), 0)" for p in ps) + f") AS h{i}" for i, ps in enumerate(groups.values()))
    most = f"greatest({', '.join(f'h{i}' for i in range(len(groups)))})"
    kind = " ".join(f"WHEN h{i} = m THEN '{k}'" for i, k in enumerate(groups))
    return f"WITH {_TURNS}, h AS (SELECT *, {hits} FROM a), b AS (SELECT *, {most} AS m FROM h), c AS (SELECT conv_id, turn, CASE WHEN m = 0 THEN 'factual_lookup' {kind} END AS query_type, CAST(CASE WHEN m = 0 THEN 0.4 ELSE least(0.95, round(0.5 + 0.15 * m, 2)) END AS DOUBLE) AS confidence FROM b)"


@query(_intent_all_sql() + " SELECT conv_id, turn, query_type, confidence FROM c")
def classify_queries_all(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", intent.intent(F.col("query")).alias("i")).select("conv_id", "turn", "i.query_type", "i.confidence")


@query(_intent_all_sql() + ", r(query_type, route, k, latency_ms) AS (VALUES " + ", ".join(f"('{x[0]}', '{x[1]}', {x[2]}, {x[6]})" for x in (r.split() for r in rules.ROUTES.strip().splitlines())) + ") SELECT conv_id, turn, query_type, route, k, latency_ms FROM c JOIN r USING (query_type)")
def route_queries_all(spark, sf):
    turns = _turns(spark, sf)
    return turns.select("conv_id", "turn", intent.intent(F.col("query"))["query_type"].alias("query_type")).join(intent.routes(turns), "query_type").select("conv_id", "turn", "query_type", "route", "k", "latency_ms")


@query(f"WITH {_TURNS}, l AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(query, {q(_EDGE.format(a))}) THEN {q(x)} END" for a, x in rules.rows(rules.ABBREVIATIONS)) + "], lambda x: x IS NOT NULL) AS l FROM a) SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:10], '; ') AS expanded FROM l")
def expand_queries_all(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", F.array_join(intent.expand(F.col("query")), "; ").alias("expanded"))


@query(f"WITH {_TURNS} SELECT conv_id, turn, sha256('p1|' || array_to_string(list_sort(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+')), ' ')) AS cache_key, CASE WHEN regexp_matches(lower(query), 'medication|drug|prescription|rx') THEN 'medications' WHEN regexp_matches(lower(query), 'lab|result|test|observation|vital') THEN 'observations' WHEN regexp_matches(lower(query), 'condition|diagnosis|diagnos|problem') THEN 'conditions' ELSE 'all' END AS kind FROM a")
def cache_key_and_structured_route_all(spark, sf):
    return _turns(spark, sf).select("conv_id", "turn", intent.cache_key(F.lit("p1"), F.col("query")).alias("cache_key"), intent.structured_kind(F.col("query")).alias("kind"))


# ---------------------------------------------------------------- context and answers

_RANKED = "r AS (SELECT lang, doc_id, text, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS INTEGER) AS rank FROM documents QUALIFY rank < 20)"


def _ranked(spark, sf):
    return retrieval.top_k(t(spark, sf, "documents"), "lang", 20, F.desc("n_chars"), F.col("doc_id"))


@query(f"WITH {_RANKED}, s AS (SELECT *, CAST(sum(greatest(1, length(text) // 4)) OVER (PARTITION BY lang ORDER BY rank) AS BIGINT) AS running_tokens FROM r) SELECT lang, doc_id, rank, running_tokens FROM s WHERE running_tokens <= 24000")
def context_budget(spark, sf):
    return answers.within_budget(_ranked(spark, sf), "lang", 24000).select("lang", "doc_id", "rank", "running_tokens")


@query(f"WITH {_RANKED} SELECT lang, sha256(string_agg('--- Context ' || (rank + 1) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)) AS context FROM r WHERE rank < 5 GROUP BY lang")
def context_format(spark, sf):
    return answers.context(_ranked(spark, sf).where("rank < 5"), "lang").select("lang", F.sha2("context", 256).alias("context"))


_CONF = f"WITH a AS (SELECT conv_id, turn, text, turn % 4 AS n, turn % 3 AS attempt, (conv_id % 10) / 10.0 AS s FROM conversations WHERE role = 'assistant'), c AS (SELECT *, CAST(round(greatest(0.0, least(1.0, CASE WHEN regexp_matches(lower(text), '{rules.FALLBACK}') THEN 0.3 ELSE CAST(0.4 AS DOUBLE) * least(1.0, s) + CAST(0.3 AS DOUBLE) * least(1.0, CAST(n AS DOUBLE) / 3) + CAST(0.3 AS DOUBLE) * least(1.0, CAST(len({WORDS}) AS DOUBLE) / 20) END)), 3) AS DOUBLE) AS score FROM a)"


@query(_CONF + " SELECT conv_id, turn, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS level, CASE WHEN attempt >= 2 OR score >= 0.7 THEN 'stop' WHEN score >= 0.5 AND attempt = 0 THEN 'expand_query' WHEN score < 0.5 THEN 'increase_k' ELSE 'stop' END AS action FROM c")
def confidence_feedback(spark, sf):
    a = t(spark, sf, "conversations").where("role = 'assistant'")
    s = answers.confidence((F.col("conv_id") % 10) / 10.0, F.col("turn") % 4, F.col("text"))
    return a.select("conv_id", "turn", s.alias("score")).select("conv_id", "turn", "score", answers.level(F.col("score")).alias("level"), answers.feedback(F.col("score"), F.col("turn") % 3).alias("action"))


# ---------------------------------------------------------------- structured data

@query("SELECT c.c_custkey, count(*) AS n, string_agg(o.o_orderpriority, ', ' ORDER BY o.o_orderkey) AS answer FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P' GROUP BY c.c_custkey")
def structured_list(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), ", ").alias("answer"))
    return o.join(t(spark, sf, "customer").select("c_custkey"), "c_custkey", "left_semi")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY")
def structured_last_week(spark, sf):
    o = t(spark, sf, "orders")
    return o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("now")))).where(F.col("o_orderdate") >= F.col("now") - F.expr("INTERVAL 7 DAYS")).select("o_orderkey", "o_custkey")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment")
def structured_join(spark, sf):
    j = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).join(t(spark, sf, "customer"), F.expr("o_custkey = c_custkey"))
    return j.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def pagination(spark, sf):
    return t(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version FROM orders")
def version_numbering(spark, sf):
    return ops.version_numbers(t(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "version")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def latest_version(spark, sf):
    return t(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("o_orderkey"))


@query("WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type")
def version_diff(spark, sf):
    e = t(spark, sf, "events")
    a, b = (e.where(f"event_id % 2 = {i}").select("user_id", "event_type").distinct().withColumn(c, F.lit(1)) for i, c in ((0, "a"), (1, "b")))
    return a.join(b, ["user_id", "event_type"], "full").select("user_id", "event_type", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("same").alias("change"))


# ---------------------------------------------------------------- cache, metrics, audit


@query(f"WITH x AS (SELECT q.vec_id AS query_id, v.vec_id, {_DOT} AS score FROM embeddings v JOIN embeddings q ON v.label = q.label WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id) SELECT query_id, arg_max(vec_id, (score, -vec_id)) AS vec_id, max(score) AS score FROM x GROUP BY query_id HAVING max(score) >= 0.2")
def cache_lookup(spark, sf):
    best = retrieval.dense_search(*_asking(spark, sf), 1, same_label=True, others=True)
    return best.where("score >= 0.2").select("query_id", "vec_id", "score")


@query("SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AND event_type <> 'error'")
def cache_ttl(spark, sf):
    e = t(spark, sf, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where("event_type != 'error'").where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 1 DAY")).select("event_id", "user_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def cache_evict_fifo(spark, sf):
    return retrieval.top_k(t(spark, sf, "events"), "user_id", 5, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("SELECT event_type, count(*) AS total, round(avg(value), 6) AS avg_latency, round(CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS DOUBLE) / greatest(count(*), 1), 6) AS error_rate, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def metrics_summary(spark, sf):
    return ops.metrics_summary(t(spark, sf, "events"), "event_type")


@query("SELECT event_type, list_sort(list(value))[CAST(floor(0.95 * count(*)) AS INT) + 1] AS p95, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    p = service.percentiles(t(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p99": 0.99, "p95": 0.95}, between=("p50", "p99"))
    return p.select("event_type", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"), "p95")


@query("WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), s AS (SELECT avg(n) AS m, stddev_samp(n) AS d FROM n) SELECT user_id, n, round((n - m) / d, 6) AS z FROM n, s WHERE (n - m) / d > 1.5")
def anomalous_access(spark, sf):
    n = t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    s = n.agg(F.avg("n").alias("m"), F.stddev_samp("n").alias("d"))
    z = (F.col("n") - F.col("m")) / F.col("d")
    return n.crossJoin(F.broadcast(s)).where(z > 1.5).select("user_id", "n", F.round(z, 6).alias("z"))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY 1), l AS (SELECT day, v, lag(v) OVER (ORDER BY day) AS before FROM d) SELECT day, v, before, coalesce(v < 0.95 * before, false) AS regressed FROM l")
def regression_lag(spark, sf):
    d = t(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return d.withColumn("before", F.lag("v").over(Window.orderBy("day"))).withColumn("regressed", F.coalesce(F.col("v") < 0.95 * F.col("before"), F.lit(False)))


@query("SELECT event_id, recent, recent > 1 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent FROM events)")
def rate_limit_window(spark, sf):
    return ops.rate_limited(t(spark, sf, "events"), 3600, 1).select("event_id", "recent", "limited")


@query("SELECT user_id, count(*) AS sessions, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id")
def session_metrics(spark, sf):
    return ops.sessions(t(spark, sf, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n_events").alias("longest"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY ALL")
def tumbling_metrics(spark, sf):
    return streams.tumbling_metrics(t(spark, sf, "events")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "avg_value")


# ---------------------------------------------------------------- evaluation


@query(_DENSE_ALL.replace("% 20 = 0", "% 20 = 0 AND v.vec_id <> q.vec_id") + """, k AS (SELECT *, CASE WHEN ql = label THEN 1 ELSE 0 END AS rel, sum(CASE WHEN ql = label THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS total FROM r)
 SELECT query_id, round(coalesce(max(CASE WHEN rel = 1 THEN 1.0 / (rank + 1) END), 0), 6) AS mrr, round(CAST(sum(CASE WHEN rank < 10 THEN rel ELSE 0 END) AS DOUBLE) / 10, 6) AS precision_at_10, round(CAST(sum(CASE WHEN rank < 10 THEN rel ELSE 0 END) AS DOUBLE) / nullif(max(total), 0), 6) AS recall_at_10, round(sum(CASE WHEN rank < 10 THEN rel / log2(rank + 2) ELSE 0 END) / nullif(sum(CASE WHEN rank < least(10, total) THEN 1 / log2(rank + 2) ELSE 0 END), 0), 6) AS ndcg_at_10 FROM k GROUP BY query_id""")
def retrieval_quality_all(spark, sf):
    mine, e = _asking(spark, sf)
    top = retrieval.dense_search(mine, e, 10, others=True).groupBy("query_id").agg(F.sum("rel").alias("hits"), F.sum(F.col("rel") / F.log2(F.col("rank") + 2)).alias("gain"))
    total = mine.select("query_id", F.col("ql").alias("label")).join(e.groupBy("label").agg((F.count("*") - 1).alias("total")), "label").drop("label")
    ideal = F.element_at(F.array(*[F.lit(sum(1 / math.log2(i + 2) for i in range(n))) for n in range(1, 11)]), F.greatest(F.lit(1), F.least(F.lit(10), F.col("total"))).cast("int"))
    r = top.join(total, "query_id").join(retrieval.first_relevant(mine, e), "query_id", "left")
    some = F.col("total") > 0
    return r.select("query_id", F.round(F.coalesce(1 / (F.col("rank") + 1), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("hits") / 10, 6).alias("precision_at_10"), F.round(F.when(some, F.col("hits") / F.col("total")), 6).alias("recall_at_10"), F.round(F.when(some, F.col("gain") / ideal), 6).alias("ndcg_at_10"))


@query("SELECT lang, quality, count(*) AS n, round(avg(toxic), 6) AS toxic_share FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang), (quality), ())")
def eval_grouping_sets(spark, sf):
    j = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return j.groupingSets([["lang"], ["quality"], []], "lang", "quality").agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 6).alias("toxic_share"))


@query(f"""WITH c AS (SELECT conv_id, turn, role, {TOK} AS w, lead({TOK}) OVER (PARTITION BY conv_id ORDER BY turn) AS x FROM conversations), p AS (SELECT conv_id, turn, w, coalesce(x, []) AS x FROM c WHERE role = 'user'),
o AS (SELECT *, CAST(coalesce(list_sum(list_transform(list_distinct(w), lambda v: least(len(list_filter(w, lambda y: y = v)), len(list_filter(x, lambda y: y = v))))), 0) AS BIGINT) AS common FROM p)
SELECT conv_id, turn, round(CASE WHEN len(w) + len(x) = 0 THEN 0 ELSE 2.0 * common / (len(w) + len(x)) END, 6) AS f1 FROM o""")
def token_f1(spark, sf):
    c = t(spark, sf, "conversations").withColumn("x", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'user'")
    p = c.select("conv_id", "turn", text.tokens(F.col("text")).alias("w"), text.tokens(F.coalesce("x", F.lit(""))).alias("x"))
    # words of both, sorted: what is left of an array after the other's words, each once, is what isn't common
    merged = F.array_sort(F.concat(F.transform("w", lambda v: F.struct(v.alias("v"), F.lit(1).alias("side"))), F.transform("x", lambda v: F.struct(v.alias("v"), F.lit(-1).alias("side")))))
    start = F.struct(F.lit("").alias("v"), F.lit(0).alias("mine"), F.lit(0).alias("other"), F.lit(0).alias("common"))

    def step(s, e):
        same = s["v"] == e["v"]
        mine, other = F.when(same, s["mine"]).otherwise(0) + (e["side"] == 1).cast("int"), F.when(same, s["other"]).otherwise(0) + (e["side"] == -1).cast("int")
        before = F.when(same, F.least(s["mine"], s["other"])).otherwise(0)
        return F.struct(e["v"].alias("v"), mine.alias("mine"), other.alias("other"), (s["common"] + F.least(mine, other) - before).alias("common"))

    common = F.aggregate(merged, start, step)["common"]
    n = F.size("w") + F.size("x")
    return p.select("conv_id", "turn", F.round(F.when(n == 0, 0.0).otherwise(2.0 * common / F.nullif(n, F.lit(0))), 6).alias("f1"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 search with personal data masked in the returned previews."""
    hits = bm25_topk(spark, sf_dir)
    docs = t(spark, sf_dir, "documents").select("doc_id", text.preview(text.mask_constant(F.col("text"), ("phone", "email"))).alias("preview"))
    return docs.join(F.broadcast(hits), "doc_id")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
