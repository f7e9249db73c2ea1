"""Registered queries of cache, versions, logs, traces and metrics, each with SQL.

Orders stand for cached answers (their parts for the documents used), lineitem rows for chunks and document versions,
events for the query and audit log.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import whitespace_words
from ..operators import service, similarity, webhooks
from .catalogue import query, t

_NOW = "TIMESTAMP '1998-08-02 00:20:00'"
_KINDS = ("factual_lookup", "summarization", "temporal", "comparison")
_CACHE = "cache AS (SELECT o_orderkey AS entry_id, 'p' || o_custkey AS patient_id, (['factual_lookup','summarization','temporal','comparison'])[1 + o_orderkey % 4] AS query_type, TIMESTAMP '1998-08-02 00:00:00' - to_seconds(o_orderkey % 5000) AS created_at, (o_orderkey % 100) / 100.0 AS confidence, o_orderstatus = 'P' AS pii_detected, o_orderkey % 3 AS hit_count FROM orders)"
_DEPS = "deps AS (SELECT l_orderkey AS entry_id, l_partkey AS doc_id FROM lineitem)"
_TTL_SQL = "CASE query_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.TTL.items()) + f" ELSE {rules.TTL_DEFAULT} END"


def _cache(spark, sf):
    k = F.col("o_orderkey")
    made = F.timestamp_seconds(F.lit(902016000) - k % 5000)  # 1998-08-02 00:00 UTC
    return t(spark, sf, "orders").select(k.alias("entry_id"), F.concat(F.lit("p"), "o_custkey").alias("patient_id"), F.array(*map(F.lit, _KINDS))[(k % 4).cast("int")].alias("query_type"), made.alias("created_at"), (k % 100 / 100).alias("confidence"), (F.col("o_orderstatus") == "P").alias("pii_detected"), (k % 3).alias("hit_count"))


def _now():
    return F.timestamp_seconds(F.lit(902016000 + 1200))


def _deps(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_partkey").alias("doc_id"))


@query(f"WITH {_CACHE} SELECT query_type, count(*) AS n, min(entry_id) AS first FROM cache WHERE epoch_us({_NOW}) - epoch_us(created_at) <= {_TTL_SQL} * 1000000::BIGINT GROUP BY query_type")
def cache_alive_by_type(spark, sf):
    return service.alive(_cache(spark, sf), _now()).groupBy("query_type").agg(F.count("*").alias("n"), F.min("entry_id").alias("first"))


@query(f"WITH {_CACHE} SELECT entry_id, query_type FROM cache WHERE confidence >= 0.5 AND NOT pii_detected")
def cache_admission(spark, sf):
    return service.admitted(_cache(spark, sf)).select("entry_id", "query_type")


@query(f"WITH {_CACHE}, {_DEPS} SELECT entry_id FROM cache WHERE entry_id NOT IN (SELECT entry_id FROM deps WHERE doc_id IN (SELECT p_partkey FROM part WHERE p_size <= 5))")
def cache_invalidation(spark, sf):
    changed = t(spark, sf, "part").where("p_size <= 5").select(F.col("p_partkey").alias("doc_id"))
    return service.invalidated(_cache(spark, sf), _deps(spark, sf), changed).select("entry_id")


@query(f"WITH {_CACHE} SELECT patient_id AS scope, count(*) AS entries_cleared FROM cache WHERE patient_id IN (SELECT 'p' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY patient_id UNION ALL SELECT 'all', count(*) FROM cache")
def cache_clear(spark, sf):
    c = _cache(spark, sf)
    mine = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("p"), "c_custkey").alias("patient_id"))
    return service.cleared(c, mine).unionByName(service.cleared(c))


@query(f"WITH {_CACHE}, look AS (SELECT user_id AS entry_id, event_type <> 'error' AS hit FROM events), s AS (SELECT entry_id, hit_count + coalesce((SELECT count(*) FROM look WHERE look.entry_id = cache.entry_id AND hit), 0) AS hit_count, created_at FROM cache) SELECT (SELECT count(*) FROM s) AS size, (SELECT CAST(sum(hit_count) AS BIGINT) FROM s) AS total_hits, (SELECT round(avg((epoch_us({_NOW}) - epoch_us(created_at)) / 1000000), 3) FROM s) AS avg_age_seconds, count(*) AS lookups, count(*) FILTER (NOT hit) AS misses, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM look")
def cache_statistics(spark, sf):
    look = t(spark, sf, "events").select(F.col("user_id").alias("entry_id"), (F.col("event_type") != "error").alias("hit"))
    return service.cache_statistics(service.hits(look.where("hit"), _cache(spark, sf)), look, _now())


@query(f"""WITH {_CACHE}, {_DEPS}, gone AS (SELECT entry_id, {_NOW} - to_seconds(p_partkey % 7200) AS gone_at FROM deps JOIN part ON p_partkey = doc_id WHERE p_size <= 5),
look AS (SELECT event_type <> 'error' AS hit FROM events)
SELECT (SELECT count(*) FROM cache) AS entries, (SELECT round(avg((epoch_us({_NOW}) - epoch_us(created_at)) / 1000000), 3) FROM cache) AS avg_age_seconds, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN hit THEN 0.0 ELSE 1.0 END), 6) AS miss_rate,
 (SELECT count(DISTINCT entry_id) FROM gone WHERE gone_at > {_NOW} - INTERVAL 1 HOUR) AS invalidations_last_hour FROM look""")
def cache_rates(spark, sf):
    """Changes of parts, at times that follow from their keys, take answers away that used them."""
    at = F.timestamp_seconds(F.lit(902016000 + 1200) - F.col("p_partkey") % 7200)
    changed = t(spark, sf, "part").where("p_size <= 5").select(F.col("p_partkey").alias("doc_id"), at.alias("at"))
    gone = _deps(spark, sf).join(changed, "doc_id").select("entry_id", "at")
    return service.cache_rates(_cache(spark, sf), t(spark, sf, "events").select((F.col("event_type") != "error").alias("hit")), gone, _now())


# ---------------------------------------------------------------- versions: the shipments of an order are versions of a document

_VERSIONS = "v AS (SELECT l_orderkey AS document_id, l_partkey, l_shipdate, row_number() OVER w AS version, lead(l_shipdate) OVER w AS valid_to FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_extendedprice))"


def _versions(spark, sf):
    li = t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "document_id")
    return service.history(li, "document_id", "l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice")


@query(f"WITH {_VERSIONS} SELECT document_id, CAST(version AS INTEGER) AS version, CAST(CASE WHEN version > 1 THEN version - 1 END AS INTEGER) AS parent_version, strftime(valid_to, '%Y-%m-%d') AS valid_to, CASE WHEN valid_to IS NULL THEN 'active' ELSE 'archived' END AS status FROM v")
def version_history(spark, sf):
    return _versions(spark, sf).select("document_id", "version", "parent_version", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"), "status")


@query(f"WITH {_VERSIONS}, w AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS asked FROM orders) SELECT document_id, CAST(version AS INTEGER) AS version, l_partkey FROM v JOIN w USING (document_id) WHERE asked = version OR (asked IS NULL AND valid_to IS NULL)")
def version_fetch(spark, sf):
    wanted = t(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.expr("o_orderkey % 2 = 0"), 1).alias("version"))
    return service.fetch(_versions(spark, sf), wanted, "document_id").select("document_id", "version", "l_partkey")


@query(f"WITH {_VERSIONS} SELECT document_id, CAST(max(version) AS INTEGER) AS version, arg_max(l_partkey, version) AS chunk FROM v GROUP BY document_id")
def reingest_keeps_last(spark, sf):
    v = _versions(spark, sf)
    return service.reingested(v.select("document_id", "version", F.col("l_partkey").alias("chunk")), v.select("document_id", "version"))


@query(f"WITH {_VERSIONS} SELECT v.document_id, o_orderpriority, count(*) AS chunks FROM v JOIN orders ON o_orderkey = document_id WHERE valid_to IS NULL AND o_orderstatus <> 'P' GROUP BY ALL")
def chunks_of_active_documents(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus <> 'P'").withColumnRenamed("o_orderkey", "document_id")
    return _versions(spark, sf).where("status = 'active'").join(o, "document_id").groupBy("document_id", "o_orderpriority").agg(F.count("*").alias("chunks"))


# ---------------------------------------------------------------- logs


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05' - 3")
def log_retention(spark, sf):
    return service.retained(t(spark, sf, "events"), "ts", F.lit("2024-01-05").cast("date"), days=3).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2002-08-02' - INTERVAL 84 MONTH")
def audit_retention(spark, sf):
    return service.retained(t(spark, sf, "orders"), "o_orderdate", F.lit("2002-08-02").cast("date"), months=84).select("o_orderkey")


@query("SELECT user_id, event_type, count(*) AS accesses, count(DISTINCT props) AS resources, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY user_id, event_type")
def access_report(spark, sf):
    return service.access_report(t(spark, sf, "events").withColumn("resource", F.col("props")), "user_id", "event_type")


@query("SELECT user_id, count(DISTINCT props) AS documents, array_to_string(list_sort(list(DISTINCT props))[:3], ';') AS first FROM events WHERE event_type = 'view' GROUP BY user_id")
def distinct_documents_accessed(spark, sf):
    seen = t(spark, sf, "events").where("event_type = 'view'").select("user_id", "props").distinct()
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("props"))
    return seen.withColumn("k", place).groupBy("user_id").agg(F.count("*").alias("documents"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("props")))), ";").alias("first"))


_SPANS = "spans AS (SELECT user_id AS trace_id, event_id AS span_id, CASE WHEN event_type <> 'view' THEN lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) END AS parent_id, value AS duration_ms FROM events)"


@query(f"WITH {_SPANS}, i AS (SELECT parent_id AS span_id, sum(duration_ms) AS inner_ms, count(*) AS children FROM spans WHERE parent_id IS NOT NULL GROUP BY parent_id) SELECT trace_id, span_id, parent_id, duration_ms, coalesce(children, 0) AS children, round(duration_ms - coalesce(inner_ms, 0.0), 3) AS own_ms FROM spans LEFT JOIN i USING (span_id)")
def trace_durations(spark, sf):
    parent = F.when(F.col("event_type") != "view", F.lag("event_id", 2).over(Window.partitionBy("user_id").orderBy("event_id")))
    spans = t(spark, sf, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("span_id"), parent.alias("parent_id"), F.col("value").alias("duration_ms"))
    return service.trace_durations(spans)


# ---------------------------------------------------------------- metrics


@query("SELECT event_type AS name, round(sum(value), 4) AS value FROM events GROUP BY event_type")
def counters(spark, sf):
    return service.counters(t(spark, sf, "events").select(F.col("event_type").alias("name"), "value")).withColumn("value", F.round("value", 4))


@query("SELECT event_type, list_sort(list(value))[CAST(floor(0.5 * count(value)) AS BIGINT) + 1] AS p50, list_sort(list(value))[CAST(floor(0.95 * count(value)) AS BIGINT) + 1] AS p95, list_sort(list(value))[CAST(floor(0.99 * count(value)) AS BIGINT) + 1] AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_from_value_counts(spark, sf):
    return service.percentiles(t(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS queries, round(count(*) / 86400.0, 8) AS per_second, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS failure_rate FROM events GROUP BY ALL")
def queries_per_user_day(spark, sf):
    g = t(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day"))
    return g.agg(F.count("*").alias("queries"), F.round(F.count("*") / 86400, 8).alias("per_second"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("failure_rate"))


_METRICS = "m(metric, value) AS (SELECT 'p95_latency_ms', 20 * list_sort(list(value))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] FROM events UNION ALL SELECT 'pii_leakage_count', count(*) FILTER (event_type = 'signup') * 1.0::DOUBLE FROM events UNION ALL SELECT 'cache_hit_rate', round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) FROM events UNION ALL SELECT 'retry_rate', round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) FROM events UNION ALL SELECT 'validation_failure_rate', round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) FROM events)"


@query(f"WITH {_METRICS}, r(metric, op, threshold, severity) AS (VALUES " + ", ".join("('{}', '{}', {}, '{}')".format(*x.split()) for x in rules.ALERTS.strip().splitlines()) + ") SELECT metric, value, severity FROM m JOIN r USING (metric) WHERE CASE WHEN op = '>' THEN value > threshold ELSE value < threshold END")
def alerts(spark, sf):
    e = t(spark, sf, "events")
    share = lambda k: F.round(F.avg((F.col("event_type") == k).cast("double")), 6)
    one = e.agg(F.count(F.when(F.col("event_type") == "signup", 1)).cast("double").alias("pii_leakage_count"), share("view").alias("cache_hit_rate"), share("click").alias("retry_rate"), share("error").alias("validation_failure_rate"))
    p95 = service.percentiles(e, [], "value", {"p": 0.95}).select(F.lit("p95_latency_ms").alias("metric"), (20 * F.col("p")).alias("value"))
    return service.alerts(one.unpivot([], one.columns, "metric", "value").unionByName(p95))


@query("SELECT l_partkey, arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_quantity)) AS first, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_quantity)) AS last, CASE WHEN arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_quantity)) > arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_quantity)) THEN 'rising' WHEN arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_quantity)) < arg_min(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_quantity)) THEN 'falling' ELSE 'stable' END AS trend FROM lineitem GROUP BY l_partkey")
def observation_trend(spark, sf):
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    g = t(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min_by("l_quantity", order).alias("first"), F.max_by("l_quantity", order).alias("last"))
    return g.withColumn("trend", F.when(F.col("last") > F.col("first"), "rising").when(F.col("last") < F.col("first"), "falling").otherwise("stable"))


@query("SELECT c_custkey, count(o_orderkey) AS hospitalisations FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
def count_hospitalisations(spark, sf):
    o = t(spark, sf, "orders").where("o_orderstatus = 'F'")
    return t(spark, sf, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("hospitalisations"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 3")
def latest_first(spark, sf):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("int")
    return t(spark, sf, "orders").withColumn("place", place).where("place <= 3").select("o_custkey", "o_orderkey", "place")


def _page_sql(page: int, per_page: int) -> str:
    last = f"(SELECT max((n - 1) // {per_page} + 1) FROM (SELECT row_number() OVER () AS n FROM orders))"
    return f"SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, {last} AS pages, {page} < {last} AS has_next, {page > 1} AS has_prev FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT {per_page} OFFSET {(page - 1) * per_page}"


@query(_page_sql(2, 100))
def page_with_total(spark, sf):
    return service.page(t(spark, sf, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 2, 100).select("o_orderkey", "total", "pages", "has_next", "has_prev")


@query(_page_sql(5, 70))
def page_of_another_size(spark, sf):
    return service.page(t(spark, sf, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 5, 70).select("o_orderkey", "total", "pages", "has_next", "has_prev")


@query(_page_sql(3, 100))
def page_within_the_ceiling(spark, sf):
    """250 rows a page are asked for; no page has more than the ceiling."""
    return service.page(t(spark, sf, "orders"), [F.desc("o_totalprice"), "o_orderkey"], 3, 250).select("o_orderkey", "total", "pages", "has_next", "has_prev")


@query("""WITH m AS (SELECT user_id, count(*) AS total_queries, list_sort(list(value))[CAST(floor(0.95 * count(value)) AS BIGINT) + 1] AS p95, round(avg(value), 6) AS avg_latency, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6) AS cache_hit_rate,
 round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS retry_rate, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS validation_failure_rate, round(avg(CASE WHEN event_type = 'purchase' THEN value / 1000.0 END), 6) AS avg_confidence FROM events GROUP BY user_id),
k AS (SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS top_types FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)) WHERE k <= 3 GROUP BY user_id)
SELECT m.*, top_types FROM m JOIN k USING (user_id)""")
def query_report(spark, sf):
    """One row a user: latency, cache hits, retries, failed validations, confidence and the commonest kinds of query."""
    e, kind = t(spark, sf, "events"), F.col("event_type")
    share = lambda k, name: F.round(F.avg((kind == k).cast("double")), 6).alias(name)
    rates = e.groupBy("user_id").agg(F.count("*").alias("total_queries"), F.round(F.avg("value"), 6).alias("avg_latency"), share("view", "cache_hit_rate"), share("click", "retry_rate"), share("error", "validation_failure_rate"), F.round(F.avg(F.when(kind == "purchase", F.col("value") / 1000)), 6).alias("avg_confidence"))
    n = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where("k <= 3")
    top = top.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "event_type", "n"))), lambda x: F.concat_ws(":", x["event_type"], x["n"].cast("string"))), ",").alias("top_types"))
    return rates.join(service.percentiles(e, ["user_id"], "value", {"p95": 0.95}), "user_id", "left").join(top, "user_id")


@query("SELECT conv_id, string_agg(turn || ':' || role, ' ' ORDER BY role, turn) AS ordered FROM conversations GROUP BY conv_id")
def context_ordering(spark, sf):
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role", "turn"))), lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), " ").alias("ordered"))


@query("SELECT conv_id, turn, sha256('q' || '|' || conv_id || '|' || turn)[:16] AS query_id, printf('%05d', turn) AS padded, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(turn AS INTEGER)), '%Y-%m-%dT%H:%M:%SZ') AS at FROM conversations")
def identifiers_and_formats(spark, sf):
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t(spark, sf, "conversations").select("conv_id", "turn", F.substring(F.sha2(F.concat_ws("|", F.lit("q"), "conv_id", "turn"), 256), 1, 16).alias("query_id"), F.format_string("%05d", "turn").alias("padded"), at.alias("at"))


_PAIR = """p AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '') AS b,
 list_filter(regexp_split_to_array(lower(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')), '\\s+'), lambda w: w <> '') AS a FROM conversations)"""


def _turn_pairs(spark, sf):
    """Each turn (b) with the turn before it in its conversation (a), as words."""
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    words = lambda c: whitespace_words(F.lower(c))
    return t(spark, sf, "conversations").select("conv_id", "turn", words(F.col("text")).alias("b"), words(before).alias("a"))


@query(f"""WITH RECURSIVE {_PAIR}, aw AS (SELECT conv_id, turn, generate_subscripts(a, 1) AS i, unnest(a) AS w FROM p),
r AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, generate_subscripts(b, 1) AS j, unnest(b) AS w, CAST(0 AS INTEGER) AS v FROM p
 UNION ALL SELECT conv_id, turn, i, j, w, CAST(max(c) OVER (PARTITION BY conv_id, turn ORDER BY j) AS INTEGER) FROM (
  SELECT r.conv_id, r.turn, aw.i, r.j, r.w, CASE WHEN r.w = aw.w THEN coalesce(lag(r.v) OVER (PARTITION BY r.conv_id, r.turn ORDER BY r.j), 0) + 1 ELSE r.v END AS c
  FROM r JOIN aw ON aw.conv_id = r.conv_id AND aw.turn = r.turn AND aw.i = r.i + 1)),
l AS (SELECT conv_id, turn, max(v) AS lcs FROM r GROUP BY ALL)
SELECT p.conv_id, p.turn, a = b AS exact_match, CASE WHEN coalesce(lcs, 0) = 0 THEN 0.0 ELSE round(2 * lcs / (len(a) + len(b)), 6) END AS rouge_l FROM p LEFT JOIN l USING (conv_id, turn)""")
def rouge_l_turns(spark, sf):
    return similarity.rouge_l(_turn_pairs(spark, sf)).select("conv_id", "turn", "exact_match", "rouge_l")


@query(f"""WITH {_PAIR}, n AS (SELECT count(*) AS n FROM p), df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(b)) AS token FROM p) GROUP BY token),
c AS (SELECT conv_id, turn, side, token, count(*) AS n FROM (SELECT conv_id, turn, 'a' AS side, unnest(a) AS token FROM p UNION ALL SELECT conv_id, turn, 'b', unnest(b) FROM p) GROUP BY ALL),
w AS (SELECT c.*, c.n * ln((n.n + 1.0) / (coalesce(df, 0) + 1)) AS weight FROM c LEFT JOIN df USING (token), n),
g AS (SELECT token, ('0x' || md5(('#' || token || '#')[i : i + 2])[:8])::BIGINT % 64 AS bucket FROM (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM (SELECT DISTINCT token FROM c))),
h AS (SELECT token, list(bucket) AS h FROM g GROUP BY token), k AS (SELECT token, list_transform(range(64), lambda x: CAST(len(list_filter(h, lambda y: y = x)) AS DOUBLE)) AS v FROM h),
s AS (SELECT token, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM k),
m AS (SELECT x.conv_id, x.turn, x.side, x.token, max(list_inner_product(sx.v, sy.v)) AS best FROM c x JOIN c y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.side <> y.side JOIN s sx ON sx.token = x.token JOIN s sy ON sy.token = y.token GROUP BY ALL),
o AS (SELECT conv_id, turn, side, sum(weight) AS total, sum(weight * coalesce(best, 0)) AS found FROM w LEFT JOIN m USING (conv_id, turn, side, token) GROUP BY ALL),
f AS (SELECT conv_id, turn, coalesce(max(found / total) FILTER (side = 'b' AND total > 0), 0) AS p, coalesce(max(found / total) FILTER (side = 'a' AND total > 0), 0) AS r FROM o GROUP BY ALL)
SELECT p.conv_id, p.turn, round(coalesce(f.p, 0), 6) AS precision, round(coalesce(f.r, 0), 6) AS recall, CASE WHEN coalesce(f.p + f.r, 0) = 0 THEN 0.0 ELSE round(2 * f.p * f.r / (f.p + f.r), 6) END AS f1 FROM p LEFT JOIN f USING (conv_id, turn)""")
def bert_score_turns(spark, sf):
    return similarity.bert_score(_turn_pairs(spark, sf), ["conv_id", "turn"])


# ---------------------------------------------------------------- webhooks

_HOOKS = [("https://one.example.com/hook", ["document.ingested", "pii.detected"], "first secret"), ("https://two.example.com/hook", ["pii.detected", "query.low_confidence"], "k" * 90)]
_HOOK_ROWS = ", ".join(f"('{webhooks.webhook_id(u, es)}', '{u}', '{e}', '{webhooks.pads(k)[0].hex()}', '{webhooks.pads(k)[1].hex()}')" for u, es, k in _HOOKS for e in es)


@query(f"""WITH h(webhook_id, url, event, inner_pad, outer_pad) AS (VALUES {_HOOK_ROWS}),
e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'document.ingested' WHEN 'error' THEN 'pii.detected' WHEN 'purchase' THEN 'query.low_confidence' END AS event FROM events),
b AS (SELECT webhook_id, url, event_id, inner_pad, outer_pad, '{{"event":"' || event || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","data":{{"severity":"' || CASE event WHEN 'pii.detected' THEN 'critical' ELSE 'info' END || '","query_id":"qry_' || user_id || '"}}}}' AS body FROM e JOIN h USING (event)),
i AS (SELECT *, sha256(from_hex(inner_pad) || encode(body)) AS mid FROM b)
SELECT sha256(webhook_id || '|' || event_id) AS delivery_id, webhook_id, url, event_id, sha256(body) AS body, sha256(from_hex(outer_pad) || from_hex(mid)) AS signature FROM i""")
def webhook_payloads(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "document.ingested").when(F.col("event_type") == "error", "pii.detected").when(F.col("event_type") == "purchase", "query.low_confidence")
    data = F.struct(F.when(kind == "pii.detected", "critical").otherwise("info").alias("severity"), F.concat(F.lit("qry_"), "user_id").alias("query_id"))
    e = t(spark, sf, "events").select("event_id", kind.alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), data.alias("data")).where("event is not null")
    return webhooks.payloads(e, webhooks.configure(spark, _HOOKS)).withColumn("body", F.sha2("body", 256))


_META = "SELECT doc_id, 'doc_' || doc_id AS document_id, CASE WHEN doc_id % 5 = 0 THEN 'p1' ELSE '[PATIENT_' || doc_id || ']' END AS patient_id, CASE doc_id % 3 WHEN 0 THEN 'lab_report' WHEN 1 THEN 'progress_note' ELSE lang END AS document_type, CASE WHEN doc_id % 7 = 0 THEN 'soon' ELSE '2024-01-02' END AS document_date, text FROM documents"
_CHECKS = r"""array_to_string(list_filter([CASE WHEN NOT regexp_matches(document_id, '^doc_[a-zA-Z0-9]+$') THEN 'document_id' END, CASE WHEN NOT regexp_matches(patient_id, '^\[PATIENT_[a-zA-Z0-9]+\]$') THEN 'patient_id' END,
 CASE WHEN document_type NOT IN ('discharge_summary','progress_note','lab_report','radiology_report','operative_note','consult_note') THEN 'document_type' END, CASE WHEN NOT regexp_matches(document_date, '^\d{4}-\d{2}-\d{2}$') THEN 'document_date' END, CASE WHEN length(text) NOT BETWEEN 3 AND 1000 THEN 'query' END], lambda x: x IS NOT NULL), ',')"""


@query(f"SELECT doc_id, {_CHECKS} AS broken FROM ({_META})")
def schema_validation(spark, sf):
    d = t(spark, sf, "documents")
    meta = d.selectExpr("doc_id", "concat('doc_', doc_id) as document_id", "case when doc_id % 5 = 0 then 'p1' else concat('[PATIENT_', doc_id, ']') end as patient_id", "case doc_id % 3 when 0 then 'lab_report' when 1 then 'progress_note' else lang end as document_type", "case when doc_id % 7 = 0 then 'soon' else '2024-01-02' end as document_date", "text")
    kinds = ("discharge_summary", "progress_note", "lab_report", "radiology_report", "operative_note", "consult_note")
    bad = {"document_id": ~F.col("document_id").rlike("^doc_[a-zA-Z0-9]+$"), "patient_id": ~F.col("patient_id").rlike(r"^\[PATIENT_[a-zA-Z0-9]+\]$"), "document_type": ~F.col("document_type").isin(*kinds), "document_date": ~F.col("document_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), "query": ~F.length("text").between(3, 1000)}
    return meta.select("doc_id", F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in bad.items()]).alias("broken"))
