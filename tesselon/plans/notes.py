"""Registered queries over notes made of all documents: chunkers and personal data, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import chunking, pii
from .catalogue import _TYPES, PII, SQL, q, query, t

# Documents as notes: every fifth line begins a section of medications, every other fifth a plan; blank lines between.
_NOTE_SQL = "array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 5 = 2 THEN 'MEDICATIONS:' || chr(10) || l WHEN i % 5 = 4 THEN 'Plan ' || chr(10) || chr(10) || l WHEN i % 2 = 1 THEN l || chr(10) ELSE l END), chr(10))"
_NOTES = f"notes AS (SELECT doc_id, {_NOTE_SQL} AS text FROM documents)"


def _notes(spark, sf):
    line = lambda l, i: F.when(i % 5 == 1, F.concat(F.lit("MEDICATIONS:\n"), l)).when(i % 5 == 3, F.concat(F.lit("Plan \n\n"), l)).when(i % 2 == 0, F.concat(l, F.lit("\n"))).otherwise(l)  # noqa: E731, E741
    return t(spark, sf, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


def _sections_sql(headers: str, keep: bool, default: str) -> str:
    """CTEs up to s(doc_id, section_no, section, char_start, text)."""
    body = "line" if keep else "CASE WHEN NOT h THEN line END"
    return f"""{_NOTES}, l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM notes),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l0),
m AS (SELECT *, regexp_matches(trim(line), '(?i)^(?:{headers})[:\\s]*$') AS h, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM l),
g AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS section_no FROM m),
s0 AS (SELECT doc_id, section_no, coalesce(max(CASE WHEN h THEN upper(trim(rtrim(trim(line), ':'))) END), '{default}') AS section, CAST(min(off) AS INTEGER) AS char_start,
  regexp_replace(coalesce(string_agg({body}, chr(10) ORDER BY i), ''), '^\\s+|\\s+$', '', 'g') AS text FROM g GROUP BY doc_id, section_no),
s1 AS (SELECT * FROM s0 WHERE text <> ''),
s AS (SELECT * FROM s1 UNION ALL SELECT doc_id, 0, 'DOCUMENT', 0, text FROM notes WHERE doc_id NOT IN (SELECT doc_id FROM s1))"""


@query(f"WITH {_sections_sql(rules.EVALUATION_HEADERS, False, 'HEADER')} SELECT doc_id, section, char_start, sha256(text) AS hash FROM s")
def section_split_evaluation(spark, sf):
    d = _notes(spark, sf).select("doc_id", F.inline(chunking.section_list(F.col("text"), rules.EVALUATION_HEADERS, False, "HEADER")))
    return d.select("doc_id", "section", "char_start", F.sha2("text", 256).alias("hash"))


_EST = "greatest(1, length({}) // 4)"


def _pieces_sql(most: int, size: int, step: int, evaluation: bool) -> str:
    """CTEs from s to p(doc_id, section_no, section, char_start, pieces)."""
    est, p, last = _EST.format("x.p"), "x.p", "a.now[len(a.now)]"
    words = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
    windows = lambda c: f"CASE WHEN {not evaluation} AND len({words.format(c)}) <= {size} THEN [{c}] ELSE list_transform(range(CASE WHEN len({words.format(c)}) <= {size} THEN 1 ELSE 1 + CAST(ceil((len({words.format(c)}) - {size}) / {step}) AS BIGINT) END), lambda k: array_to_string({words.format(c)}[k * {step} + 1 : k * {step} + {size}], ' ')) END"
    both = f"{_EST.format(last)} + {est}" if evaluation else _EST.format(f"({last} || chr(10) || chr(10) || {p})")
    closed = "CASE WHEN len(a.now) > 0 THEN list_append(a.done, array_to_string(a.now, chr(10) || chr(10))) ELSE a.done END"
    single = "" if evaluation else f"WHEN len(ps) = 1 THEN {windows('text')} "
    return f""", p0 AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM s),
p1 AS (SELECT *, list_reduce(list_prepend({{'p': '', 'done': []::VARCHAR[], 'now': []::VARCHAR[], 'n': 0::BIGINT}}, list_transform(ps, lambda y: {{'p': y, 'done': {windows('y')}, 'now': []::VARCHAR[], 'n': 0::BIGINT}})), lambda a, x:
 CASE WHEN {est} > {most} THEN {{'p': '', 'done': list_concat({closed}, x.done), 'now': []::VARCHAR[], 'n': 0::BIGINT}}
 WHEN len(a.now) > 0 AND a.n + {est} > {most} THEN {{'p': '', 'done': {closed}, 'now': [{last}, {p}], 'n': CAST({both} AS BIGINT)}}
 ELSE {{'p': '', 'done': a.done, 'now': list_append(a.now, {p}), 'n': CAST(a.n + {est} AS BIGINT)}} END) AS a FROM p0),
p AS (SELECT doc_id, section_no, section, char_start, CASE {single}WHEN len(a.now) > 0 THEN list_append(a.done, array_to_string(a.now, chr(10) || chr(10))) ELSE a.done END AS pieces FROM p1)"""


@query(f"""WITH {_sections_sql(rules.HEADERS, True, 'PREAMBLE')}{_pieces_sql(150, 160, 140, False)},
x AS (SELECT doc_id, section_no, section, unnest(pieces) AS text, generate_subscripts(pieces, 1) AS k FROM p),
y AS (SELECT *, {_EST.format('text')} AS n FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, k) - 1 AS i FROM y WHERE n >= 20)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, section, CAST(n AS INTEGER) AS n_tokens, sha256(text) AS hash, i > 0 AS overlap_prev, i < max(i) OVER (PARTITION BY doc_id) AS overlap_next FROM z""")
def chunk_document(spark, sf):
    c = chunking.chunk_documents(_notes(spark, sf), rules.HEADERS, 150, 160, 140, 20)
    return c.withColumn("hash", F.sha2("text", 256)).drop("text")


@query(f"SELECT section, count(*) AS chunks, round(avg(n_tokens), 6) AS avg_tokens, count(DISTINCT doc_id) AS docs, arg_min(hash, (doc_id, chunk_index)) AS first FROM ({SQL['chunk_document']}) GROUP BY section")
def chunk_report(spark, sf):
    """Each section that occurs: its chunks, their size, its documents and the hash of its first chunk."""
    c = chunking.chunk_documents(_notes(spark, sf), rules.HEADERS, 150, 160, 140, 20)
    return c.groupBy("section").agg(F.count("*").alias("chunks"), F.round(F.avg("n_tokens"), 6).alias("avg_tokens"), F.count_distinct("doc_id").alias("docs"), F.min_by(F.sha2("text", 256), F.struct("doc_id", "chunk_index")).alias("first"))


_OVER = "array_to_string(w[greatest(len(w) - 49, 1) : len(w)], ' ')"


@query(f"""WITH RECURSIVE {_sections_sql(rules.EVALUATION_HEADERS, False, 'HEADER')}{_pieces_sql(150, 90, 60, True)},
x AS (SELECT doc_id, section_no, section, char_start, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM p),
r AS (SELECT doc_id, section_no, section, char_start, k, piece, piece AS full_text, false AS overlapped FROM x WHERE k = 1 UNION ALL
 SELECT x.doc_id, x.section_no, x.section, x.char_start, x.k, x.piece, CASE WHEN {_EST.format('x.piece')} < 15 THEN x.piece ELSE (SELECT {_OVER} FROM (SELECT list_filter(regexp_split_to_array(r.full_text, '\\s+'), lambda v: v <> '') AS w)) || chr(10) || x.piece END, true
 FROM r JOIN x ON x.doc_id = r.doc_id AND x.section_no = r.section_no AND x.k = r.k + 1),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, k) - 1 AS i FROM r WHERE {_EST.format('piece')} >= 15)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, section, char_start, CAST({_EST.format('full_text')} AS INTEGER) AS n_tokens, sha256(regexp_replace(full_text, '^\\s+|\\s+$', '', 'g')) AS hash, overlapped AS overlap_prev FROM z""")
def overlap_prepend(spark, sf):
    c = chunking.chunk_for_evaluation(_notes(spark, sf), rules.EVALUATION_HEADERS, 150, 90, 60, 15, 50)
    return c.withColumn("hash", F.sha2("text", 256)).drop("text")


# ---------------------------------------------------------------- personal data: all texts, each with planted entities after it

_PLANTED = """CASE doc_id % 9 WHEN 0 THEN ' SSN 123-45-' || (1000 + doc_id % 9000) WHEN 1 THEN ' MRN: ' || (100000 + doc_id) || ' seen' WHEN 2 THEN ' DOB: 01/02/' || (1950 + doc_id % 40) || ' on 3/4/2021'
 WHEN 3 THEN ' Patient: Ann Lee Smith of ward' || doc_id WHEN 4 THEN ' a 95 years old man, March 3, 2020.' WHEN 5 THEN ' Serial No: ABC' || (10000 + doc_id) || ' (555) 123-4567' WHEN 6 THEN ' Dr. Jo Ray, 40-year-old, 1/2/2020, clinic of Bern'
 WHEN 7 THEN ' MRN 55555' || doc_id || ' Date of Birth: 1-2-1960' ELSE ' nothing here' END"""
_PLANTED_SQL = f"planted AS (SELECT doc_id, text || {_PLANTED} AS text FROM documents)"


def _planted(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.concat("text", F.expr(_PLANTED)).alias("text"))


def _spans_sql() -> str:
    forms = dict(rules.rows(rules.PSEUDONYMS))
    parts = []
    for n, (k, p) in enumerate(PII.items()):
        group = 1 if k == "person_name" else 0
        length = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda y: length(y))), 0)"
        mark = f"substr(sha256('salt:{k}:' || o), 1, 8)"
        label = f"'{forms[k].split('#')[0]}' || {mark} || '{forms[k].split('#')[1]}'" if "#" in forms[k] else f"'{forms[k]}'"
        parts.append(f"""SELECT doc_id, {n} AS n, '{k}' AS kind, stop - length(o) AS start, stop, {label} AS pseudonym FROM (SELECT doc_id, unnest(list_transform(range(1, len(f) + 1), lambda j: {{'o': g[j], 'stop': {length('a[1:j]')} + {length('f[1:j]')}}}), recursive := true) FROM
 (SELECT doc_id, regexp_split_to_array(text, {q(p)}) AS a, regexp_extract_all(text, {q(p)}) AS f, regexp_extract_all(text, {q(p)}, {group}) AS g FROM planted))""")
    return f"""{_PLANTED_SQL}, every AS ({' UNION ALL '.join(parts)}),
o AS (SELECT doc_id, list({{'start': start, 'n': n, 'stop': stop, 'kind': kind, 'pseudonym': pseudonym}} ORDER BY start, n) AS es FROM every GROUP BY doc_id),
e AS (SELECT doc_id, list_reduce(list_transform(es, lambda x: [x]), lambda a, x: CASE WHEN x[1].start >= a[len(a)].stop THEN list_concat(a, x) ELSE a END) AS es FROM o)"""


@query(f"WITH {_spans_sql()}, u AS (SELECT doc_id, unnest(es) AS x FROM e) SELECT doc_id, x.kind AS kind, CAST(x.start AS INTEGER) AS start, CAST(x.stop AS INTEGER) AS stop, x.pseudonym AS pseudonym FROM u")
def pii_entities(spark, sf):
    return pii.detect(_planted(spark, sf)).select("doc_id", F.inline("entities"))


_MASK_SQL = "coalesce(array_to_string(list_transform(range(1, len(es) + 1), lambda i: substr(text, CAST(CASE WHEN i = 1 THEN 1 ELSE es[i - 1].stop + 1 END AS BIGINT), CAST(es[i].start - CASE WHEN i = 1 THEN 0 ELSE es[i - 1].stop END AS BIGINT)) || es[i].pseudonym), '') || substr(text, CAST(es[len(es)].stop + 1 AS BIGINT)), text)"


@query(f"WITH {_spans_sql()} SELECT doc_id, sha256({_MASK_SQL}) AS masked, CAST(coalesce(len(es), 0) AS INTEGER) AS n FROM planted LEFT JOIN e USING (doc_id)")
def pii_process(spark, sf):
    return pii.detect(_planted(spark, sf)).select("doc_id", F.sha2("text", 256).alias("masked"), F.size("entities").alias("n"))


@query(f"WITH {_PLANTED_SQL} SELECT doc_id, sha256(text) AS masked, 0 AS n FROM planted")
def pii_process_disabled(spark, sf):
    return pii.detect(_planted(spark, sf), enabled=False).select("doc_id", F.sha2("text", 256).alias("masked"), F.size("entities").alias("n"))


@query(f"WITH {_spans_sql()}, u AS (SELECT unnest(es) AS x FROM e) SELECT DISTINCT x.kind AS kind, x.pseudonym AS pseudonym FROM u")
def pii_mappings(spark, sf):
    return pii.mapping(pii.detect(_planted(spark, sf)))


_ANSWERS = "planted_answers AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN '[LLM Error: timeout]' ELSE text END AS text FROM planted)"


def _answers(spark, sf):
    return _planted(spark, sf).withColumn("text", F.when(F.col("doc_id") % 10 == 9, "[LLM Error: timeout]").otherwise(F.col("text")))


def _validated_sql(block: bool) -> str:
    if block:
        hit = (f"'{pii.BLOCKED}'", "'PII types detected: ' || ts", "NULL")
    else:
        hit = (_MASK_SQL, "NULL", "'PII was sanitized from output: ' || ts")
    return f"""WITH {_spans_sql()}, {_ANSWERS}, v AS (SELECT a.doc_id, a.text, es, array_to_string({_TYPES.replace('text', 'a.text')}, ', ') AS ts FROM planted_answers a LEFT JOIN e USING (doc_id))
SELECT doc_id, CASE WHEN ts <> '' THEN {not block} WHEN starts_with(text, '[LLM Error') THEN false ELSE true END AS is_valid, sha256(CASE WHEN ts <> '' THEN {hit[0]} WHEN starts_with(text, '[LLM Error') THEN '{pii.FAILED}' ELSE text END) AS answer,
 ts <> '' AND {block} AS blocked, CASE WHEN ts <> '' THEN {hit[1]} END AS reason, CASE WHEN ts <> '' THEN {hit[2]} WHEN starts_with(text, '[LLM Error') THEN 'LLM generation error' END AS warning FROM v"""


def _validated(spark, sf, block):
    a = _answers(spark, sf).withColumn("original", F.col("text"))
    both = a if block else pii.detect(a, keep=("original",))
    v = both.select("doc_id", pii.validate(F.col("original"), F.lit("") if block else F.col("text"), block).alias("v")).select("doc_id", "v.*")
    return v.withColumn("answer", F.sha2("answer", 256))


@query(_validated_sql(True))
def validate_blocking(spark, sf):
    return _validated(spark, sf, True)


@query(_validated_sql(False))
def validate_sanitising(spark, sf):
    return _validated(spark, sf, False)


def _clean_sql() -> str:
    sql = "text"
    steps = [f"c0 AS (SELECT doc_id, {sql} AS text FROM planted)"]
    for n, (k, p) in enumerate(rules.rows(rules.EVALUATION_PII)):
        form = dict(rules.rows(rules.EVALUATION_PSEUDONYMS))[k]
        if "#" in form:
            a, b = form.split("#")
            one = f"array_to_string(list_transform(range(1, len(regexp_split_to_array(text, {q(p)})) + 1), lambda i: regexp_split_to_array(text, {q(p)})[i] || coalesce('{a}' || substr(sha256('salt:{k}:' || regexp_extract_all(text, {q(p)})[i]), 1, 8) || '{b}', '')), '')"
        else:
            one = f"regexp_replace(text, {q(p)}, '{form}', 'g')"
        steps.append(f"c{n + 1} AS (SELECT doc_id, {one} AS text FROM c{n})")
    return ", ".join(steps)


@query(f"WITH {_PLANTED_SQL}, {_clean_sql()} SELECT doc_id, sha256(text) AS cleaned FROM c10")
def pii_clean_evaluation(spark, sf):
    return _planted(spark, sf).select("doc_id", F.sha2(pii.clean(F.col("text")), 256).alias("cleaned"))


@query(f"WITH {_PLANTED_SQL} SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {q(p)}) THEN '{k}' END" for k, p in rules.rows(rules.EVALUATION_PII)) + "], lambda x: x IS NOT NULL), ',') AS types FROM planted")
def pii_scan_evaluation(spark, sf):
    return _planted(spark, sf).select("doc_id", F.array_join(pii.evaluation_types(F.col("text")), ",").alias("types"))


_QUASI = [f"regexp_matches(text, {q(p)})" for _, p in rules.rows(rules.QUASI_IDENTIFIERS)]
_DIRECT = " OR ".join(f"regexp_matches(text, {q(PII[k])})" for k in ("ssn", "mrn", "person_name"))


@query(f"""WITH {_PLANTED_SQL}, f AS (SELECT doc_id, {' + '.join(f'CAST({x} AS INT)' for x in _QUASI)} AS n, {_DIRECT} AS direct, concat_ws(',', {', '.join(f"CASE WHEN {x} THEN '{k}' END" for x, (k, _) in zip(_QUASI, rules.rows(rules.QUASI_IDENTIFIERS)))}) AS categories FROM planted)
SELECT doc_id, categories, CASE WHEN direct AND n >= 1 THEN 'CRITICAL' WHEN direct OR n >= 3 THEN 'HIGH' WHEN n = 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM f""")
def quasi_identifiers(spark, sf):
    r = _planted(spark, sf).select("doc_id", pii.reidentification(F.col("text")).alias("r"))
    return r.select("doc_id", F.array_join("r.categories", ",").alias("categories"), "r.severity")


@query(f"""WITH {_spans_sql()}, p AS (SELECT doc_id, len(es) > 0 AS found, doc_id % 9 <> 8 AS planted FROM planted LEFT JOIN e USING (doc_id)), c AS (SELECT planted, coalesce(found, false) AS found FROM p)
SELECT count(*) FILTER (found AND NOT planted) AS false_positives, count(*) FILTER (planted AND NOT found) AS false_negatives, round(count(*) FILTER (found AND NOT planted) / greatest(count(*) FILTER (NOT planted), 1), 6) AS fpr, round(count(*) FILTER (planted AND NOT found) / greatest(count(*) FILTER (planted), 1), 6) AS fnr FROM c""")
def pii_error_rates(spark, sf):
    d = pii.detect(_planted(spark, sf)).select((F.size("entities") > 0).alias("found"), (F.col("doc_id") % 9 != 8).alias("planted"))
    n = lambda c: F.count(F.when(c, 1))
    fp, fn = n(F.col("found") & ~F.col("planted")), n(F.col("planted") & ~F.col("found"))
    return d.agg(fp.alias("false_positives"), fn.alias("false_negatives"), F.round(fp / F.greatest(n(~F.col("planted")), F.lit(1)), 6).alias("fpr"), F.round(fn / F.greatest(n(F.col("planted")), F.lit(1)), 6).alias("fnr"))
