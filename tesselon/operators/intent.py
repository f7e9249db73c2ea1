"""Query classification, routing, expansion and cache keys from rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import first_match, tokens


def intent(query: Column) -> Column:
    """struct(query_type, confidence): most matched patterns win, earlier types win ties, none gives factual_lookup at 0.4."""
    groups: dict[str, list[str]] = {}
    for k, p in rules.rows(rules.INTENTS):
        groups.setdefault(k, []).append(p)
    q, found = F.lower(query), []
    for n, (k, ps) in enumerate(groups.items()):
        hits = sum((q.rlike(p).cast("int") for p in ps), F.lit(0))
        found.append(F.struct(F.when(hits > 0, F.least(F.lit(0.95), F.round(0.5 + 0.15 * hits, 2))).otherwise(F.lit(0.0)).alias("confidence"), F.lit(-n).alias("order"), F.lit(k).alias("query_type")))
    best = F.array_max(F.array(*found))
    return F.when(best["confidence"] > 0.4, F.struct(best["query_type"].alias("query_type"), best["confidence"].alias("confidence"))).otherwise(F.struct(F.lit("factual_lookup").alias("query_type"), F.lit(0.4).alias("confidence")))


def routes(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    rows = [(a, b, int(k), r == "true", d == "true", s == "true", int(ms)) for a, b, k, r, d, s, ms in (x.split() for x in rules.ROUTES.strip().splitlines())]
    return F.broadcast(spark.createDataFrame(rows, "query_type string, route string, k int, rerank boolean, use_dense boolean, use_sparse boolean, latency_ms int"))


def expand(query: Column) -> Column:
    """Up to ten full forms of the abbreviations in a query, in table order."""
    found = [F.when(query.rlike(rf"(?i)\b\Q{a}\E\b"), F.lit(x)) for a, x in rules.rows(rules.ABBREVIATIONS)]
    return F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, 10)


def expansion_terms(query: Column) -> Column:
    """array<struct(term, weight, kind)>: the query, abbreviations, then synonyms; distinct without regard to case, ten at most."""
    item = lambda term, weight, kind: F.struct(F.lit(term).alias("term"), F.lit(weight).alias("weight"), F.lit(kind).alias("kind"))
    found = [F.when(query.rlike(rf"(?i)\b\Q{a}\E\b"), item(x, 0.85, "abbreviation")) for a, x in rules.rows(rules.ABBREVIATIONS)]
    for line in rules.SYNONYMS.strip().splitlines():
        term, *lists = line.split(" ~ ")
        on = F.lower(query).contains(term)
        found += [F.when(on, item(x, w, k)) for xs, w, k in zip(lists, (0.9, 0.85, 0.7), ("synonym", "abbreviation", "related")) for x in xs.split(", ")]
    first = F.struct(query.alias("term"), F.lit(1.0).alias("weight"), F.lit("original").alias("kind"))
    every = F.concat(F.array(first), F.array_compact(F.array(*found)))
    once = lambda ts: F.filter(ts, lambda x, i: F.array_position(F.transform(ts, lambda y: F.lower(y["term"])), F.lower(x["term"])) == i + 1)
    return F.slice(F.transform(F.array(every), once)[0], 1, 10)


def expanded_query(query: Column, terms: Column) -> Column:
    """The query and its terms of weight 0.7 and more that aren't only related, each once."""
    strong = F.filter(terms, lambda x: (x["weight"] >= 0.7) & (x["kind"] != "related"))
    return F.array_join(F.array_distinct(F.concat(F.array(query), F.transform(strong, lambda x: x["term"]))), " ")


def analyzed(text: Column) -> Column:
    """Search terms: synonyms of a group become its first word, stop words go."""
    out = F.lower(text)
    for line in rules.SYNONYM_GROUPS.strip().splitlines():
        head, *others = line.split(", ")
        for x in sorted(others, key=len, reverse=True):
            out = F.regexp_replace(out, rf"\b{x}\b", head)
    stop = F.array(*map(F.lit, rules.STOPWORDS.split()))
    return F.filter(tokens(out), lambda w: ~F.array_contains(stop, w))


def reasoning(query: Column) -> Column:
    """Of each query type that matches, its first two patterns."""
    groups: dict[str, list[str]] = {}
    for k, p in rules.rows(rules.INTENTS):
        groups.setdefault(k, []).append(p)
    q = F.lower(query)
    per = [F.struct(F.lit(k).alias("query_type"), F.slice(F.array_compact(F.array(*[F.when(q.rlike(p), F.lit(p)) for p in ps])), 1, 2).alias("patterns")) for k, ps in groups.items()]
    return F.filter(F.array(*per), lambda x: F.size(x["patterns"]) > 0)


def cache_key(scope: Column, query: Column) -> Column:
    """Scope and sorted terms: the same words in another order hit, another scope never does."""
    return F.sha2(F.concat(scope, F.lit("|"), F.array_join(F.array_sort(tokens(query)), " ")), 256)


def structured_kind(query: Column) -> Column:
    return first_match(query, rules.STRUCTURED_KINDS, "all")
