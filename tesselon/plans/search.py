"""Registered searches of all documents by a stated query set (benchmark items whose id is divisible by 20), each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import answers, chunking, hops, index, intent, ivf, pii, pq, retrieval
from ..session import shared_folder
from .catalogue import TOK, _asking, _windows_sql, query, t
from .notes import _MASK_SQL, _planted, _spans_sql
from .service import _VERSIONS, _versions

_POSTINGS = f"""pt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM pt GROUP BY doc_id), cp AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
dfs AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM pt, cp GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT 0.25 * avg(raw) FROM dfs) ELSE raw END AS idf FROM dfs),
qt AS (SELECT item_id AS query_id, unnest({TOK}) AS term FROM benchmark WHERE item_id % 20 = 0)"""


def _scored_sql(weight: str = "1.0") -> str:
    return f"{_POSTINGS}, bm AS (SELECT query_id, doc_id, round(sum({weight} * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN pt USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), cp GROUP BY query_id, doc_id)"


def _ranked_sql(source: str, k: int, to: str) -> str:
    return f"{to} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM {source} WHERE score > 0 QUALIFY rank < {k})"


_VECTOR = r"list_transform({0}, lambda x: round(x / greatest(1.0::DOUBLE, sqrt(list_sum(list_transform({0}, lambda y: y * y))::DOUBLE)), 6))"
_BUCKETS = r"list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> ''), lambda w: ('0x' || md5(w)[:8])::BIGINT % 64)"
_COUNTS = "list_transform(range(64), lambda k: len(list_filter(b, lambda x: x = k)))"
_DENSE = f"""dvec AS (SELECT doc_id, {_VECTOR.format('c')} AS v FROM (SELECT doc_id, {_COUNTS} AS c FROM (SELECT doc_id, {_BUCKETS} AS b FROM documents))),
qvec AS (SELECT item_id AS query_id, {_VECTOR.format('c')} AS v FROM (SELECT item_id, {_COUNTS} AS c FROM (SELECT item_id, {_BUCKETS} AS b FROM benchmark WHERE item_id % 20 = 0))),
dn AS (SELECT query_id, doc_id, round(list_inner_product(dvec.v, qvec.v), 6) AS score FROM dvec, qvec)"""


def _asked(spark, sf):
    """(query_id, term), a row a token."""
    b = t(spark, sf, "benchmark").where("item_id % 20 = 0")
    return b.select(F.col("item_id").alias("query_id"), F.explode(text.tokens(F.col("text"))).alias("term"))


def _search(spark, sf, asked=None):
    docs = t(spark, sf, "documents")
    return index.search(spark, index.built(docs, f"{sf}/documents"), _asked(spark, sf) if asked is None else asked).where("score > 0")


def _sparse(spark, sf, k):
    return retrieval.top_k(_search(spark, sf), "query_id", k, F.desc("score"), F.col("doc_id"))


def _dense(spark, sf, k):
    docs = retrieval.hash_vectors(t(spark, sf, "documents"), 64).select(F.col("doc_id").alias("vec_id"), F.col("vector").alias("embedding"), F.lit(0).alias("label"))
    b = t(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("doc_id"), "text")
    queries = retrieval.hash_vectors(b, 64).select(F.col("doc_id").alias("query_id"), F.col("vector").alias("q"), F.lit(0).alias("ql"))
    return retrieval.dense_search(queries, docs, k, parts=retrieval.streams_for(t(spark, sf, "documents").count())).where("score > 0").select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")


@query(f"WITH {_scored_sql()}, {_ranked_sql('bm', 10, 'r')} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r")
def bm25_batch(spark, sf):
    return _sparse(spark, sf, 10).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {_scored_sql()}, {_ranked_sql('bm', 30, 'r')} SELECT query_id, doc_id, score FROM r JOIN documents USING (doc_id) WHERE source = 'src3'")
def bm25_post_filter(spark, sf):
    valid = t(spark, sf, "documents").where("source = 'src3'").select("doc_id")
    return _sparse(spark, sf, 30).join(valid, "doc_id", "left_semi").select("query_id", "doc_id", "score")


_KEPT = "WITH docs AS (SELECT * FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 14 = 0)"


def _of_kept(sql: str) -> str:
    return f"{_KEPT}, {sql.replace('FROM documents', 'FROM docs')}"


def _updated(spark, sf, compacted=False):
    """An index of all documents in three appends, with a removal, documents that come again, and stale texts that are replaced."""
    d = t(spark, sf, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}-updated"
    index.append(d.where("doc_id % 3 = 0").withColumn("text", F.when(F.expr("doc_id % 9 = 0"), F.concat(F.lit("stale zzqx "), "text")).otherwise(F.col("text"))), path)
    index.append(d.where("doc_id % 3 = 1 or doc_id % 9 = 0"), path)
    index.delete(d.where("doc_id % 7 = 0").select("doc_id"), path)
    index.append(d.where("doc_id % 3 = 2 and (doc_id % 7 <> 0 or doc_id % 14 = 0) or doc_id % 14 = 0"), path)
    if compacted:
        index.compact(spark, path)
        index.vacuum(spark, path)
    return path


def _best(spark, sf, path):
    found = index.search(spark, path, _asked(spark, sf)).where("score > 0")
    return retrieval.top_k(found, "query_id", 10, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "score", "rank", F.array_join("matched_terms", " ").alias("matched"))


_MATCHED = "m AS (SELECT query_id, doc_id, string_agg(DISTINCT term, ' ' ORDER BY term) AS matched FROM qt JOIN pt USING (term) GROUP BY ALL) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank, matched FROM r JOIN m USING (query_id, doc_id)"


@query(f"{_of_kept(_scored_sql())}, {_ranked_sql('bm', 10, 'r')}, {_MATCHED}")
def index_after_updates(spark, sf):
    return _best(spark, sf, _updated(spark, sf))


@query(f"{_of_kept(_scored_sql())}, {_ranked_sql('bm', 10, 'r')}, {_MATCHED}")
def index_after_compaction(spark, sf):
    return _best(spark, sf, _updated(spark, sf, compacted=True))


@query(f"{_of_kept(_POSTINGS)} SELECT term, count(*) AS df, round(any_value(idf), 6) AS idf, any_value(n) AS n, round(any_value(avgdl), 6) AS avgdl FROM pt JOIN idf USING (term), cp GROUP BY term")
def index_statistics(spark, sf):
    s = index.statistics(spark, _updated(spark, sf))
    return s.select("term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_scored_sql('(1 + length(qt.term) % 3 / 10.0::DOUBLE)')}, {_ranked_sql('bm', 10, 'r')} SELECT query_id, doc_id, score FROM r")
def bm25_term_boost(spark, sf):
    boosted = _asked(spark, sf).withColumn("weight", 1 + F.length("term") % 3 / 10)
    return retrieval.top_k(_search(spark, sf, boosted), "query_id", 10, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "score")


@query(f"WITH {_DENSE}, {_ranked_sql('dn', 10, 'r')} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r")
def hash_dense_batch(spark, sf):
    return _dense(spark, sf, 10)


def _fused_sql(a: float, b: float) -> str:
    return f"rrf AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM (SELECT query_id, doc_id, {a} / (61 + rank) AS s FROM rd UNION ALL SELECT query_id, doc_id, {b} / (61 + rank) FROM rs) GROUP BY ALL)"


_BOTH = f"{_scored_sql()}, {_DENSE}, {_ranked_sql('bm', 20, 'rs')}, {_ranked_sql('dn', 20, 'rd')}"


@query(f"WITH {_BOTH}, {_fused_sql(0.7, 0.3)}, {_ranked_sql('rrf', 10, 'r')} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r")
def hybrid_main(spark, sf):
    return retrieval.fuse(_dense(spark, sf, 20), _sparse(spark, sf, 20), 10).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {_scored_sql()}, {_DENSE}, {_ranked_sql('bm', 20, 'rs0')}, {_ranked_sql('dn', 20, 'rd')}, rs AS (SELECT * FROM rs0 WHERE query_id % 40 = 0), {_fused_sql(0.7, 0.3)},
u AS (SELECT * FROM rrf WHERE query_id % 40 = 0 UNION ALL SELECT query_id, doc_id, score FROM rd WHERE query_id % 40 <> 0), {_ranked_sql('u', 10, 'r')} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r""")
def single_list_fallback(spark, sf):
    sparse = _sparse(spark, sf, 20).where("query_id % 40 = 0")
    return retrieval.fuse(_dense(spark, sf, 20), sparse, 10).select("query_id", "doc_id", "score", "rank")


def _overlap(results, spark, sf):
    """Adds the share of a query's distinct tokens that a result holds."""
    q = _asked(spark, sf).distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    return results.join(q, "query_id").withColumn("rerank_score", F.round(F.size("matched_terms") / F.col("n"), 6))


_OVERLAPS = "ov AS (SELECT query_id, doc_id, round(count(DISTINCT term) / any_value(n), 6) AS overlap FROM (SELECT DISTINCT query_id, term FROM qt) JOIN pt USING (term) JOIN (SELECT query_id, count(DISTINCT term) AS n FROM qt GROUP BY query_id) USING (query_id) GROUP BY query_id, doc_id)"


@query(f"""WITH {_BOTH}, {_fused_sql(0.65, 0.35)}, {_OVERLAPS}, v AS (SELECT query_id, doc_id, rrf.score AS rrf, CASE WHEN doc_id % 2 = 0 THEN coalesce(overlap, 0) ELSE 0 END AS rerank FROM rrf LEFT JOIN ov USING (query_id, doc_id) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'de')),
b AS (SELECT query_id, doc_id, CASE WHEN rerank <> 0 THEN rerank ELSE rrf END AS score FROM v), {_ranked_sql('b', 5, 'r')} SELECT query_id, doc_id, score AS best_score, CAST(rank AS INTEGER) AS final_rank FROM r""")
def hybrid_evaluation(spark, sf):
    found = _search(spark, sf)
    sparse = retrieval.top_k(found, "query_id", 20, F.desc("score"), F.col("doc_id"))
    fused = retrieval.rrf([(_dense(spark, sf, 20), 0.65), (sparse, 0.35)])
    valid = t(spark, sf, "documents").where("lang <> 'de'").select("doc_id")
    scores = _overlap(found, spark, sf).select("query_id", "doc_id", "rerank_score")
    both = fused.join(valid, "doc_id", "left_semi").join(scores, ["query_id", "doc_id"], "left")
    rerank = F.when(F.col("doc_id") % 2 == 0, F.coalesce("rerank_score", F.lit(0.0))).otherwise(0.0)
    best = both.withColumn("best_score", F.when(rerank != 0, rerank).otherwise(F.col("score")))
    return retrieval.top_k(best, "query_id", 5, F.desc("best_score"), F.col("doc_id")).select("query_id", "doc_id", "best_score", F.col("rank").alias("final_rank"))


@query(f"WITH {_scored_sql()}, {_ranked_sql('bm', 20, 'rs')}, {_ranked_sql('rs', 5, 'r')} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r")
def rerank_pass_through(spark, sf):
    return retrieval.rerank(_sparse(spark, sf, 20).withColumn("rerank_score", F.col("score"))).select("query_id", "doc_id", "rank")


@query(f"""WITH {_scored_sql()}, {_OVERLAPS}, {_ranked_sql('bm', 20, 'rs')}, k AS (SELECT rs.*, overlap, max(overlap) OVER (PARTITION BY query_id) AS best FROM rs JOIN ov USING (query_id, doc_id)),
r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN best >= 0.6 THEN overlap ELSE score END DESC, score DESC, doc_id) - 1 AS place FROM k QUALIFY place < 5) SELECT query_id, doc_id, CAST(place AS INTEGER) AS rank FROM r""")
def rerank_threshold(spark, sf):
    return retrieval.rerank(_overlap(_sparse(spark, sf, 20), spark, sf), 5, 0.6).select("query_id", "doc_id", "rank")


@query(f"""WITH {_BOTH}, {_OVERLAPS}, {_ranked_sql('(SELECT query_id, doc_id, overlap AS score FROM ov)', 20, 'rt')},
u AS (SELECT query_id, doc_id, 1.0 / (61 + rank) AS s, 'dense' AS src, rank FROM rd UNION ALL SELECT query_id, doc_id, 0.8 / (61 + rank), 'sparse', rank FROM rs UNION ALL SELECT query_id, doc_id, 1.2 / (61 + rank), 'structured', rank FROM rt),
g AS (SELECT query_id, doc_id, round(sum(s), 9) AS score, array_to_string(list_sort(list(DISTINCT src)), ',') AS sources, CAST(max(rank) FILTER (src = 'dense') AS INTEGER) AS dense_rank, CAST(max(rank) FILTER (src = 'sparse') AS INTEGER) AS sparse_rank FROM u GROUP BY ALL)
SELECT query_id, doc_id, score, sources, dense_rank, sparse_rank FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""")
def three_list_fusion(spark, sf):
    found = _search(spark, sf)
    sparse = retrieval.top_k(found, "query_id", 20, F.desc("score"), F.col("doc_id"))
    structured = retrieval.top_k(_overlap(found, spark, sf).select("query_id", "doc_id", F.col("rerank_score").alias("score")), "query_id", 20, F.desc("score"), F.col("doc_id"))
    fused = retrieval.fuse_lists({"dense": (_dense(spark, sf, 20), 1.0), "sparse": (sparse, 0.8), "structured": (structured, 1.2)}, 10)
    return fused.select("query_id", "doc_id", "score", F.array_join("sources", ",").alias("sources"), "dense_rank", "sparse_rank")


def _scaled_sql(source: str, weight: float) -> str:
    return f"SELECT query_id, doc_id, {weight} * CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM {source} WINDOW w AS (PARTITION BY query_id)"


@query(f"WITH {_BOTH}, g AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM ({_scaled_sql('rd', 0.7)} UNION ALL {_scaled_sql('rs', 0.3)}) GROUP BY ALL) SELECT query_id, doc_id, score FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10")
def weighted_sum_fusion(spark, sf):
    return retrieval.weighted_sum([(_dense(spark, sf, 20), 0.7), (_sparse(spark, sf, 20), 0.3)], 10).select("query_id", "doc_id", "score")


@query(f"""WITH {_scored_sql()}, {_ranked_sql('bm', 20, 'rs')}, w AS (SELECT query_id, doc_id, rank, list_distinct({TOK}) AS w FROM rs JOIN documents USING (doc_id)),
worse AS (SELECT DISTINCT a.query_id, a.doc_id FROM w a JOIN w b ON a.query_id = b.query_id AND a.rank > b.rank WHERE len(list_intersect(a.w, b.w)) / greatest(least(len(a.w), len(b.w)), 1) > 0.8)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM rs WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM worse)""")
def results_without_near_copies(spark, sf):
    found = _sparse(spark, sf, 20).select("query_id", "doc_id", "rank")
    words = t(spark, sf, "documents").join(found.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.array_distinct(text.tokens(F.col("text"))).alias("w"))
    return retrieval.without_near_copies(found, words)


@query(f"WITH {_scored_sql()}, {_ranked_sql('bm', 50, 'rs')} SELECT query_id, source, max(score) AS score, count(*) AS chunks, min(doc_id) AS first FROM rs JOIN documents USING (doc_id) GROUP BY query_id, source")
def document_level_retrieval(spark, sf):
    of = t(spark, sf, "documents").select("doc_id", "source")
    return _sparse(spark, sf, 50).join(of, "doc_id").groupBy("query_id", "source").agg(F.max("score").alias("score"), F.count("*").alias("chunks"), F.min("doc_id").alias("first"))


_ANALYZED = "list_filter({}, lambda w: NOT list_contains(['" + "','".join(rules.STOPWORDS.split()) + "'], w))"


def _synonyms_sql(column: str) -> str:
    out = f"lower({column})"
    for line in rules.SYNONYM_GROUPS.strip().splitlines():
        head, *others = line.split(", ")
        for x in sorted(others, key=len, reverse=True):
            out = f"regexp_replace({out}, '\\b{x}\\b', '{head}', 'g')"
    return out


@query(f"SELECT conv_id, turn, array_to_string({_ANALYZED.format(TOK.replace('lower(text)', _synonyms_sql('text')))}, ' ') AS terms FROM (SELECT conv_id, turn, text || CASE turn % 3 WHEN 0 THEN ' the Heart Attack at blood pressure' WHEN 1 THEN ' which is myocardial infarction, Heart rate' ELSE '' END AS text FROM conversations)")
def analyzed_terms(spark, sf):
    tail = F.when(F.col("turn") % 3 == 0, " the Heart Attack at blood pressure").when(F.col("turn") % 3 == 1, " which is myocardial infarction, Heart rate").otherwise("")
    d = t(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("text"))
    return d.select("conv_id", "turn", F.array_join(intent.analyzed(F.col("text")), " ").alias("terms"))


@query(f"WITH {_VERSIONS} SELECT document_id, CAST(version AS INTEGER) AS version FROM v JOIN orders ON o_orderkey = document_id WHERE valid_to IS NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def filtered_latest(spark, sf):
    o = t(spark, sf, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(F.col("o_orderkey").alias("document_id"))
    v = _versions(spark, sf).where("status = 'active' and to_date(l_shipdate) between date'1995-01-01' and date'1996-12-31'")
    return v.join(o, "document_id", "left_semi").select("document_id", "version")


@query()
def ivf_search(spark, sf):
    """Approximate: no SQL.  Two thirds of the cells are read, as these vectors hardly cluster; a test measures recall against the exact search."""
    queries, vectors = _asking(spark, sf)
    centroids = ivf.fit(vectors)
    filed = ivf.build(vectors, centroids, f"{shared_folder(spark)}-ivf")
    return ivf.search(queries, filed, centroids, 10, max(1, -(-2 * len(centroids) // 3)))


@query()
def pq_search(spark, sf):
    """Approximate: no SQL; ``pq_quality`` measures it."""
    queries, vectors = _asking(spark, sf)
    books = pq.fit(vectors)
    return pq.search(queries, vectors, pq.encode(vectors, books, f"{shared_folder(spark)}-codes"), books, 10)[0]


@query("""SELECT count(DISTINCT q.vec_id) AS queries, count(DISTINCT q.vec_id) * least(10, (SELECT count(*) FROM embeddings)) AS exact_pairs, true AS recall_of_nine_tenths, true AS reads_a_tenth
FROM embeddings q WHERE q.vec_id % 20 = 0""")
def pq_quality(spark, sf):
    """Coded search held against the exact search of the same queries: recall, and the share of vectors compared in full."""
    queries, vectors = _asking(spark, sf)
    books = pq.fit(vectors)
    found, most = pq.search(queries, vectors, pq.encode(vectors, books, f"{shared_folder(spark)}-codes"), books, 10)
    exact = retrieval.dense_search(queries, vectors, 10).select("query_id", "vec_id")
    both = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    rows = vectors.agg(F.count("*").alias("rows"))
    measured = both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("exact_pairs"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall")).crossJoin(rows)  # a row each
    return measured.select("queries", "exact_pairs", (F.col("recall") >= 0.9).alias("recall_of_nine_tenths"), (F.lit(most) <= 0.1 * F.col("rows")).alias("reads_a_tenth"))


def _hop_sql(n: int) -> str:
    seen = " UNION ALL ".join(f"SELECT query_id, doc_id FROM h{i}" for i in range(1, n))
    used = " UNION ALL ".join(["SELECT query_id, term FROM qt", *(f"SELECT query_id, term FROM b{i}" for i in range(2, n))])
    return f"""b{n} AS (SELECT query_id, doc_id, term FROM h{n - 1} JOIN pt USING (doc_id) JOIN tdf USING (term) WHERE df >= 2 AND (query_id, term) NOT IN ({used})
 QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY df, term) <= 2),
g{n} AS (SELECT b.query_id, b.doc_id AS via, pt.doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS gain FROM b{n} b JOIN pt USING (term) JOIN idf USING (term) JOIN dl ON dl.doc_id = pt.doc_id, cp GROUP BY ALL),
k{n} AS (SELECT g.query_id, g.doc_id, g.via, h.path, round(h.score + {0.5 ** (n - 1)} * gain, 6) AS score FROM g{n} g JOIN h{n - 1} h ON h.query_id = g.query_id AND h.doc_id = g.via WHERE gain > 0 AND (g.query_id, g.doc_id) NOT IN ({seen})
 QUALIFY row_number() OVER (PARTITION BY g.query_id, g.doc_id ORDER BY round(h.score + {0.5 ** (n - 1)} * gain, 6) DESC, g.via) = 1),
h{n} AS (SELECT query_id, {n} AS hop, doc_id, via, path || '>' || doc_id AS path, score FROM k{n} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 3)"""


@query(f"WITH {_scored_sql()}, tdf AS (SELECT term, count(*) AS df FROM pt GROUP BY term), {_ranked_sql('bm', 3, 'r')}, h1 AS (SELECT query_id, 1 AS hop, doc_id, CAST(NULL AS BIGINT) AS via, CAST(doc_id AS VARCHAR) AS path, score FROM r), {_hop_sql(2)}, {_hop_sql(3)} SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3")
def multi_hop_retrieval(spark, sf):
    docs = t(spark, sf, "documents")
    return hops.multi_hop(docs, index.built(docs, f"{sf}/documents"), _asked(spark, sf))


@query(f"""WITH {_scored_sql()}, {_ranked_sql('bm', 10, 'r')}, {_spans_sql()} SELECT query_id, bool_or(es IS NOT NULL) AS guard, array_to_string(list_sort(list_distinct(flatten(list(list_transform(coalesce(es, []), lambda x: x.kind))))), ',') AS types,
sha256(string_agg({_MASK_SQL}, chr(10) ORDER BY rank)) AS context FROM r JOIN planted USING (doc_id) LEFT JOIN e USING (doc_id) GROUP BY query_id""")
def prompt_guard(spark, sf):
    """The ten best documents of each query as one context, masked; only these are read for personal data."""
    hits = _sparse(spark, sf, 10).select("query_id", "doc_id", "rank")
    wanted = hits.select("doc_id").distinct()
    d = pii.detect(_planted(spark, sf).join(wanted, "doc_id", "left_semi")).join(hits, "doc_id")
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities.kind"))))
    safe = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n")
    return d.groupBy("query_id").agg(F.max(F.size("entities") > 0).alias("guard"), F.array_join(kinds, ",").alias("types"), F.sha2(safe, 256).alias("context"))


@query(f"""WITH {_scored_sql()}, {_ranked_sql('bm', 50, 'rs')} SELECT query_id, source, max(score) AS score, count(*) AS chunks, string_agg(doc_id, ',' ORDER BY n_chars, doc_id) AS in_order FROM rs JOIN documents USING (doc_id) GROUP BY query_id, source""")
def document_level_in_order(spark, sf):
    """Document-level results with their chunks in the order of time; lengths stand for dates here."""
    of = t(spark, sf, "documents").select("doc_id", "source", "n_chars")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_chars", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",")
    return _sparse(spark, sf, 50).join(of, "doc_id").groupBy("query_id", "source").agg(F.max("score").alias("score"), F.count("*").alias("chunks"), listed.alias("in_order"))


_CHUNK_CTE = _windows_sql(300, 250, 15).removeprefix("WITH ")


@query(f"""WITH {_scored_sql()}, {_ranked_sql('bm', 10, 'r')}, {_CHUNK_CTE},
x AS (SELECT query_id, rank, i.doc_id, chunk_index, CASE WHEN chunk_index = 0 THEN s ELSE array_to_string(string_split(s, ' ')[51:], ' ') END AS part FROM r JOIN i USING (doc_id)),
u AS (SELECT *, sum(greatest(1, length(part) // 4)) OVER (PARTITION BY query_id ORDER BY rank, chunk_index) AS used FROM x WHERE part <> ''),
b AS (SELECT * FROM u WHERE used <= 3000),
g AS (SELECT query_id, rank, doc_id, '=== Document ' || doc_id || ' ===' || chr(10) || string_agg(part, chr(10) ORDER BY chunk_index) AS told, count(*) AS n, max(used) AS used FROM b GROUP BY query_id, rank, doc_id)
SELECT query_id, sha256(string_agg(told, chr(10) || chr(10) ORDER BY rank)) AS context, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS documents, CAST(max(used) AS BIGINT) AS tokens FROM g GROUP BY query_id""")
def context_by_document(spark, sf):
    """The chunks of the best documents: documents by rank, chunks in their order, what a chunk repeats of the one before left out, within a budget."""
    hits = _sparse(spark, sf, 10).select("query_id", "doc_id", "rank")
    chunks = chunking.sliding_windows(t(spark, sf, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), 300, 250, 15)
    return answers.context_by_document(hits.join(chunks, "doc_id"), 50, 3000).withColumn("context", F.sha2("context", 256))
