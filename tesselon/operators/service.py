"""State as tables: answer cache, document versions, audit and query logs, traces, metrics and alerts.

Nothing is changed in place: each operation reads a table and gives the table after it.
The present is an argument everywhere, so results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..session import shared_folder

PIECES, PIECE = 100, 200_000  # ranges of a group's values, and different values that one task may sort
KEYS = 10_000  # groups whose cuts or ranges may be broadcast


# ---------------------------------------------------------------- cache


def ttl_seconds(query_type: Column) -> Column:
    out = F.lit(rules.TTL_DEFAULT)
    for k, v in rules.TTL.items():
        out = F.when(query_type == k, v).otherwise(out)
    return out


def alive(cache: DataFrame, now: Column) -> DataFrame:
    """Entries that are not older than the time their query type is kept."""
    age = F.unix_micros(now) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return cache.where(age <= ttl_seconds(F.col("query_type")).cast("long") * 1_000_000)


def admitted(entries: DataFrame) -> DataFrame:
    """Only answers of some confidence and without personal data are kept."""
    return entries.where((F.col("confidence") >= 0.5) & ~F.col("pii_detected"))


def invalidated(cache: DataFrame, dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """The cache without entries that used a changed document.  dependencies: entry_id, doc_id.  changed: doc_id."""
    stale = dependencies.join(changed.select("doc_id").distinct(), "doc_id", "left_semi").select("entry_id").distinct()
    return cache.join(stale, "entry_id", "left_anti")


def cleared(cache: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """How many entries a clearing removes: scope, entries_cleared; all of them without ``patients``."""
    if patients is None:
        return cache.agg(F.lit("all").alias("scope"), F.count("*").alias("entries_cleared"))
    gone = cache.join(patients.select("patient_id").distinct(), "patient_id", "left_semi")
    return gone.groupBy(F.col("patient_id").alias("scope")).agg(F.count("*").alias("entries_cleared"))


def hits(lookups: DataFrame, cache: DataFrame) -> DataFrame:
    """The cache with its hit counts raised by lookups (entry_id) that hit."""
    n = lookups.groupBy("entry_id").agg(F.count("*").alias("new_hits"))
    return cache.join(n, "entry_id", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("new_hits", F.lit(0))).drop("new_hits")


def cache_statistics(cache: DataFrame, lookups: DataFrame, now: Column) -> DataFrame:
    """size, total_hits, avg_age_seconds beside hit_rate and misses of the lookups (hit)."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1_000_000
    store = cache.agg(F.count("*").alias("size"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("total_hits"), F.round(F.avg(age), 3).alias("avg_age_seconds"))
    rate = lookups.agg(F.count("*").alias("lookups"), F.sum((~F.col("hit")).cast("long")).alias("misses"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))
    return store.crossJoin(rate)  # one row each


def cache_rates(cache: DataFrame, lookups: DataFrame, invalidations: DataFrame, now: Column) -> DataFrame:
    """One row: entries, hit_rate, miss_rate, avg_age_seconds, and the entries (entry_id, at) invalidated within the last hour."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    store = cache.agg(F.count("*").alias("entries"), F.round(F.avg((micros(now) - micros(F.col("created_at"))) / 1_000_000), 3).alias("avg_age_seconds"))
    rate = lookups.agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.round(F.avg((~F.col("hit")).cast("double")), 6).alias("miss_rate"))
    recent = invalidations.where((micros(F.col("at")) > micros(now) - 3_600_000_000) & (micros(F.col("at")) <= micros(now)))
    return store.crossJoin(rate).crossJoin(recent.agg(F.count_distinct("entry_id").alias("invalidations_last_hour")))  # one row each


# ---------------------------------------------------------------- versions


def reingested(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of all versions less those of documents (document_id, version) ingested anew: only the last version stays."""
    last = documents.groupBy("document_id").agg(F.max("version").alias("version"))
    return chunks.join(last, ["document_id", "version"], "left_semi")


def history(versions: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds version, parent_version, valid_from / valid_to and status: the last is active, the others archived."""
    w = Window.partitionBy(key).orderBy(*order)
    n = F.row_number().over(w).cast("int")
    return versions.withColumns({"version": n, "parent_version": F.when(n > 1, n - 1), "valid_to": F.lead(order[0]).over(w)}).withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("archived"))


def fetch(versions: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The asked version of each (key, version); a null version asks for the active one."""
    v, w = versions.alias("v"), wanted.withColumnRenamed("version", "asked").alias("w")
    return v.join(w, key).where((F.col("asked") == F.col("version")) | (F.col("asked").isNull() & (F.col("status") == "active")))


# ---------------------------------------------------------------- logs


def retained(log: DataFrame, at: str, now: Column, **interval: int) -> DataFrame:
    """Rows of the last ``days``, or of the last ``months``."""
    first = F.add_months(now, -interval["months"]) if "months" in interval else F.date_sub(now, interval["days"])
    return log.where(F.to_date(at) >= first)


def access_report(log: DataFrame, *keys: str) -> DataFrame:
    """Accesses, distinct counterparts, first and last time, by any keys."""
    return log.groupBy(*keys).agg(F.count("*").alias("accesses"), F.count_distinct("resource").alias("resources"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def trace_durations(spans: DataFrame) -> DataFrame:
    """span_id, parent_id, own_ms: a span's duration without that of its children."""
    inner = spans.where("parent_id is not null").groupBy(F.col("parent_id").alias("span_id")).agg(F.sum("duration_ms").alias("inner_ms"), F.count("*").alias("children"))
    return spans.join(inner, "span_id", "left").select("trace_id", "span_id", "parent_id", "duration_ms", F.coalesce("children", F.lit(0)).alias("children"), F.round(F.col("duration_ms") - F.coalesce("inner_ms", F.lit(0.0)), 3).alias("own_ms"))


def page(rows: DataFrame, order: list, number: int, per_page: int = 20, max_results: int = 100) -> DataFrame:
    """The rows of a page (from 1) with total, pages, has_next and has_prev; a page behind the last has none.  No page has more than ``max_results`` rows."""
    per_page = min(per_page, max_results)
    total = rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / per_page))
    some = rows.orderBy(*order).offset((number - 1) * per_page).limit(per_page)
    return some.crossJoin(F.broadcast(total)).withColumns({"has_next": F.lit(number) < F.col("pages"), "has_prev": F.lit(number > 1)})  # one row


# ---------------------------------------------------------------- metrics


def counters(increments: DataFrame) -> DataFrame:
    return increments.groupBy("name").agg(F.sum("value").alias("value"))


def _held(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pieces(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi, below, inside, distinct: about a hundred ranges of each key's values, with the rows below and inside each."""
    cuts = values.groupBy(*keys).agg(F.percentile_approx("q_value", [i / PIECES for i in range(1, PIECES)], 10 * PIECES).alias("q_cuts"))
    cuts = F.broadcast(cuts) if cuts.count() <= KEYS else cuts
    piece = F.size(F.filter("q_cuts", lambda c: c < F.col("q_value")))
    ranges = values.join(cuts, keys).groupBy(*keys, piece.alias("q_piece")).agg(F.min("q_value").alias("q_lo"), F.max("q_value").alias("q_hi"), F.sum("q_count").alias("q_inside"), F.count("*").alias("q_distinct"))
    upto = F.sum("q_inside").over(Window.partitionBy(*keys).orderBy("q_piece"))
    return ranges.withColumn("q_below", upto - F.col("q_inside"))


def values_at(values: DataFrame, targets: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """keys, name, value: the value of rank k (from 0) of each target (keys, name, k), from value counts (keys, value, c).

    Ranges are counted first, then only the range that holds the rank is looked into, until it has at most ``PIECE``
    different values; so no task holds or sorts more than that of a group, whatever the group's size.
    """
    by, turn = keys, 0
    most = values.groupBy(*by).agg(F.count("*").alias("q_n")).agg(F.max("q_n").alias("most")).first()["most"] or 0
    while most > PIECE:
        on = targets.join(_pieces(values, by), by).where("q_rank >= q_below and q_rank < q_below + q_inside")
        targets = _held(on.select(*keys, "q_name", (F.col("q_rank") - F.col("q_below")).alias("q_rank"), "q_lo", "q_hi", "q_distinct"), f"{folder}/targets={turn}")
        few = F.broadcast(targets) if targets.count() <= KEYS else targets
        narrowed = values.join(few.select(*by, *(["q_name"] if "q_name" not in by else []), "q_lo", "q_hi"), by).where("q_value between q_lo and q_hi")
        by, turn = [*keys, "q_name"], turn + 1
        values = _held(narrowed.select(*by, "q_value", "q_count"), f"{folder}/values={turn}")
        most = targets.agg(F.max("q_distinct").alias("most")).first()["most"]
        targets = targets.select(*by, "q_rank")
    values = values if turn else values.join(F.broadcast(targets.select("q_name").distinct()))  # a row a share
    by = [*keys, "q_name"]
    upto = F.sum("q_count").over(Window.partitionBy(*by).orderBy("q_value"))
    seen = values.withColumn("q_upto", upto).join(targets, by).where("q_upto > q_rank")
    return seen.groupBy(*by).agg(F.min("q_value").alias("q_value"))


def percentiles(rows: DataFrame, keys: list[str], column: str, shares: dict[str, float], between: tuple[str, ...] = ()) -> DataFrame:
    """Exact percentiles of a column that isn't null, by keys (none: of all rows): sorted(x)[int(p * n)], or for the names ``between`` on the line between the two neighbours of p * (n - 1)."""
    folder = f"{shared_folder(rows.sparkSession)}-percentiles"
    by = keys or ["q_every"]
    base = rows if keys else rows.withColumn("q_every", F.lit(1))
    values = _held(base.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("q_value")).agg(F.count("*").alias("q_count")), f"{folder}/counts")
    at = {name: F.lit(p) * (F.col("q_n") - 1) if name in between else F.lit(p) * F.col("q_n") for name, p in shares.items()}
    wanted = {f"{name}|{side}": F.least(F.floor(at[name]) + side, F.col("q_n") - 1).cast("long") for name in shares for side in range(1 + (name in between))}
    sizes = values.groupBy(*by).agg(F.sum("q_count").alias("q_n"))
    targets = sizes.select(*by, F.explode(F.array(*[F.struct(F.lit(w).alias("q_name"), k.alias("q_rank")) for w, k in wanted.items()])).alias("x")).select(*by, "x.*")
    found = values_at(values, targets, by, folder).groupBy(*by).agg(*[F.max(F.when(F.col("q_name") == w, F.col("q_value"))).alias(w) for w in wanted]).join(sizes, by)
    one = lambda name, side: F.col(f"`{name}|{side}`")
    part = lambda name: (at[name] - F.floor(at[name])) * (one(name, 1) - one(name, 0)) + one(name, 0) if name in between else one(name, 0)
    return found.select(*keys, *[part(name).alias(name) for name in shares])


def alerts(metrics: DataFrame) -> DataFrame:
    """metric, value, severity of each rule that a metric (metric, value) breaks; the rule table is a handful of rows."""
    table = [(m, op, float(x), s) for m, op, x, s in (r.split() for r in rules.ALERTS.strip().splitlines())]
    rules_ = F.broadcast(metrics.sparkSession.createDataFrame(table, "metric string, op string, threshold double, severity string"))
    broken = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return metrics.join(rules_, "metric").where(broken).select("metric", "value", "severity")
