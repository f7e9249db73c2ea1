"""The registered queries of these operators, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, decontam, gif, infill, minhash, packing, secrets, shards, substrings, suffixes, token_files, toxicity, urls
from .common import documents

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.text_media(documents(spark, sf_dir))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), vocabulary(WORD_VOCABULARY), spaces=False, end_id=2)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_suffixes(documents(spark, sf_dir), span=50, keep_text=False)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    s = shards.hilbert_shards(documents(spark, sf_dir), 16)
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", "patterns")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), [urls.prefix_rule(*r) for r in URL_RULES])


def op8_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary(BYTE_VOCABULARY), spaces=True, end_id=0, size=1024)


def op9_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=5, percent=85)


def op10_difference_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_windows(documents(spark, sf_dir), span=13).drop("kept")


def op11_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    cut = infill.transform(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_gif_media, op2_spaced_seed_decontamination, op3_bit_plane_tokens, op4_suffix_dedup, op5_hilbert_shards, op6_toxicity_grammar, op7_url_rules, op8_shortest_pack_first, op9_minhash_components, op10_difference_cover_dedup, op11_markov_secrets, op12_filter_interactions, op13_infill)
    return {f.__name__: f for f in found}


_HOST = "translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's')"

OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path, row_number() OVER () AS n FROM pages),
r(verdict, host, path) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
m AS (SELECT p.n, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC) AS k
      FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.n = p.n AND m.k = 1
"""

OP2_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS i FROM benchmark),
dt AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM d),
bt AS (SELECT item_id, len(i) AS n, unnest(i) AS w, generate_subscripts(i, 1) AS q FROM b),
m AS (SELECT doc_id, item_id, n, p - q AS line, list(q ORDER BY q) AS qs FROM dt JOIN bt USING (w)
      GROUP BY ALL HAVING count(*) >= ceil(least(n, 13) * 0.8)),
r AS (SELECT *, len(qs) AS matched, row_number() OVER (PARTITION BY doc_id, item_id, n ORDER BY len(qs) DESC, line) AS k FROM m
      WHERE len(list_filter(range(1, len(qs) - CAST(ceil(least(n, 13) * 0.8) AS BIGINT) + 2), lambda x: qs[x + CAST(ceil(least(n, 13) * 0.8) AS BIGINT) - 1] - qs[x] < least(n, 13))) > 0)
SELECT doc_id, item_id, CAST(matched AS INTEGER) AS matched, CAST(n AS INTEGER) AS item_tokens, CAST(line AS INTEGER) AS "at" FROM r WHERE k = 1
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
p AS (SELECT doc_id, generate_subscripts(t, 1) AS i, t FROM d),
w AS (SELECT doc_id, i, t[i : i + 12] AS v FROM p WHERE i + 12 <= len(t)),
f AS (SELECT v, min(doc_id) AS low FROM w GROUP BY v),
c AS (SELECT DISTINCT w.doc_id, unnest(range(w.i, w.i + 13)) AS i FROM w JOIN f USING (v) WHERE f.low < w.doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(t) AS n, coalesce(len(gone), 0) AS r,
             list_transform(list_filter(range(1, len(t) + 1), lambda x: gone IS NULL OR NOT list_contains(gone, x)), lambda x: t[x]) AS kept
      FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, part, t, length(t) AS chars, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
f AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS q, max(CAST(toxic = 1 AS INT)) AS x FROM labels GROUP BY doc_id),
j AS (SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x,
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (chars - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * chars,
              regexp_matches(t, '[#$%&*|]'), coalesce(f.low < m.doc_id, false)] AS fails
      FROM m JOIN f USING (t) LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(q) AS q, sum(x) AS x FROM j GROUP BY ALL),
one AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || e.c || h.c || k.c AS filter_order FROM one a, one b, one e, one h, one k WHERE len(list_distinct([a.c, b.c, e.c, h.c, k.c])) = 5),
s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS c, n, q, x, fails[ascii(filter_order[step]) - 64] AS here,
             len(list_filter(range(1, step), lambda i: fails[ascii(filter_order[i]) - 64])) > 0 AS earlier, len(list_filter(fails, lambda y: y)) AS many
      FROM s, g),
z AS (SELECT part, filter_order, step, c, coalesce(sum(n) FILTER (NOT here AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT earlier), 0) AS removed,
             coalesce(sum(n) FILTER (here AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (here AND many = 1), 0) AS unique_fails,
             coalesce(sum(q) FILTER (here AND NOT earlier), 0) AS good_lost, coalesce(sum(x) FILTER (here AND NOT earlier), 0) AS toxic_lost
      FROM r GROUP BY part, filter_order, step, c)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM z
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b, CAST('0x' || h[25:32] AS BIGINT) % 100 AS f FROM d),
c AS (SELECT doc_id, t, n, coalesce(array_to_string(u[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(u[least(a, b) + 1:greatest(a, b)], ''), '') AS m, coalesce(array_to_string(u[greatest(a, b) + 1:n], ''), '') AS s,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN f < 50 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_interactions": OP12_SQL, "op13_infill": OP13_SQL, "op2_spaced_seed_decontamination": OP2_SQL, "op7_url_rules": OP7_SQL, "op10_difference_cover_dedup": OP10_SQL}
