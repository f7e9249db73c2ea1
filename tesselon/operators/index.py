"""A written BM25 index of immutable segments, with tombstones and a manifest.

An index is a folder.  ``postings/segment=<id>/bucket=<n>`` holds (term, doc_id, tf, dl), ``terms/segment=<id>`` the number
of documents of each term, ``gone/segment=<id>`` the doc_ids that later commits took away, each with the segment that it was
taken from.  ``manifest/version=<n>`` is the list of what is in force; it is written last, by one committed job, so a search
sees the index as before or as after a commit, and a commit that failed leaves files that no manifest names.  One writer at a time.

Tokens are counted document by document, in Arrow batches, and their counts exchanged once: a task and a file for each bucket
of terms and share of documents, so that none gets two of them by the chance of a hash.  Buckets follow the bytes of text,
shares are so many that a file has about ``TASK_BYTES`` of it, and a term that a third of all documents hold is spread over all
shares.  Within a file postings stand by term.
``append`` of doc_ids that are there takes the older ones away; ``delete`` takes them all.  What was taken away is
subtracted from the statistics by a term table with negative counts, so searches merge sums and never read whole postings.
``compact`` writes what is alive into one new segment; scores after any of these equal those of a new index.

Documents without tokens, and rows without doc_id, are not in the index.  A doc_id that comes twice in one append counts
as one document with all its rows' tokens.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import exists, remove, shared_folder

BUCKET_BYTES = 64 << 20  # text for which there is an eighth of a bucket more
TASK_BYTES = 8 << 20  # text whose postings a task sorts; less where that gives fewer files than tasks run at once
MOST_BUCKETS, SPREAD = 1024, 8
ASKED = 100_000  # terms of a stated query set that may be broadcast
_BUILT: dict[tuple[str, str], str] = {}

POSTINGS = "term string, doc_id long, tf int, dl int, segment string, bucket int"
TERMS = "term string, df long, segment string"
GONE = "doc_id long, taken_from string, segment string"
MANIFEST = "segment string, kind string, seq int, buckets int, docs long, tokens long, floor double, version int"


def bucket(term: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(term), buckets).cast("int")


# ---------------------------------------------------------------- manifest


def manifest(spark: SparkSession, path: str) -> list:
    """What is in force: a row a segment, and a row a commit of tombstones; few, as compaction merges them."""
    if not exists(spark, f"{path}/manifest"):
        return []
    m = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    return sorted(m.join(m.agg(F.max("version").alias("version")), "version").collect(), key=lambda r: r["seq"])


def _commit(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Statistics of the new state, then the manifest: the folder of its version appears by the job's commit or not at all."""
    last = max((r["version"] for r in manifest(spark, path)), default=0)
    n = sum(r["docs"] for r in rows)
    terms = _merged(_files(spark, path, "terms", TERMS, [r["segment"] for r in rows]))
    raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    floor = terms.agg((0.25 * F.avg(raw)).alias("floor")).first()["floor"] if n else None
    new = [(r["segment"], r["kind"], r["seq"], r["buckets"], r["docs"], r["tokens"], floor) for r in rows] or [("", "empty", 0, 1, 0, 0, None)]
    spark.createDataFrame(new, MANIFEST.rpartition(",")[0]).coalesce(1).write.json(f"{path}/manifest/version={last + 1}")


def _files(spark: SparkSession, path: str, kind: str, schema: str, segments: list[str]) -> DataFrame:
    held = [f"{path}/{kind}/segment={s}" for s in segments if s]
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/{kind}").parquet(*held)


def _merged(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


def _alive(spark: SparkSession, path: str, rows: list) -> DataFrame:
    """Postings of all segments without those that a later commit took away."""
    post = _files(spark, path, "postings", POSTINGS, [r["segment"] for r in rows if r["kind"] == "segment"])
    gone = [r["segment"] for r in rows if r["kind"] == "gone"]
    if not gone:
        return post
    taken = _files(spark, path, "gone", GONE, gone).select("doc_id", F.col("taken_from").alias("segment"))
    return post.join(taken, ["doc_id", "segment"], "left_anti")


# ---------------------------------------------------------------- commits


def _write_segment(spark: SparkSession, path: str, rows: DataFrame, size: int, seq: int) -> dict:
    """rows: term, doc_id, dl and n, one row a term of a document.  One exchange; gives the segment's row of the manifest."""
    name = f"s{seq}-{uuid.uuid4().hex[:8]}"
    buckets = min(MOST_BUCKETS, max(1, math.ceil(size / BUCKET_BYTES) // SPREAD))
    files = max(math.ceil(size / TASK_BYTES), min(spark.sparkContext.defaultParallelism, math.ceil(size / (1 << 20))), 1)
    spread = math.ceil(files / buckets)
    post = rows.select("term", "doc_id", F.col("n").cast("int").alias("tf"), "dl", bucket(F.col("term"), F.lit(buckets)).alias("bucket"))
    dealt = post.repartitionById(buckets * spread, F.col("bucket") * spread + F.pmod(F.hash("doc_id"), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", "term", "doc_id").write.partitionBy("bucket").parquet(f"{path}/postings/segment={name}")
    saved = _files(spark, path, "postings", POSTINGS, [name])
    saved.groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{path}/terms/segment={name}")
    # every posting carries its share of a document, so no second pass over the documents is needed
    total = saved.select("doc_id", "dl").distinct().agg(F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tokens")).first()
    return {"segment": name, "kind": "segment", "seq": seq, "buckets": buckets, "docs": total["docs"], "tokens": total["tokens"]}


def _take_away(spark: SparkSession, path: str, rows: list[dict], ids: DataFrame, seq: int) -> list[dict]:
    """Tombstones for the doc_ids in the segments so far, and the counts to subtract; none if nothing was hit."""
    hit = _alive(spark, path, rows).join(ids, "doc_id", "left_semi")
    name = f"g{seq}-{uuid.uuid4().hex[:8]}"
    hit.select("doc_id", F.col("segment").alias("taken_from")).distinct().write.parquet(f"{path}/gone/segment={name}")
    taken = _files(spark, path, "gone", GONE, [name])
    hit.groupBy("term").agg((-F.count("*")).alias("df")).sortWithinPartitions("term").write.parquet(f"{path}/terms/segment={name}")
    total = hit.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).first()["tokens"]
    docs = taken.count()
    return [{"segment": name, "kind": "gone", "seq": seq, "buckets": 1, "docs": -docs, "tokens": -total}] if docs else []


def _counted(docs: DataFrame, repeated: bool) -> DataFrame:
    """term, doc_id, dl, n; of doc_ids that come more than once the lengths are added first."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            lists = b.column("w")
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            coded = lists.flatten().dictionary_encode()
            most = max(1, len(coded.dictionary))
            key, n = np.unique(np.repeat(np.arange(len(size)), size) * most + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row = key // most
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key % most)), pa.array(ids, pa.int64()), pa.array(size[row], pa.int32()), pa.array(n, pa.int64())], ["term", "doc_id", "dl", "n"])

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    words = known.where(F.size("w") > 0).mapInArrow(count, "term string, doc_id long, dl int, n long")
    if repeated:
        words = words.groupBy("doc_id", "term").agg(F.sum("n").alias("n")).withColumn("dl", F.sum("n").over(Window.partitionBy("doc_id")).cast("int"))
    return words


def append(docs: DataFrame, path: str) -> str:
    """One new segment of docs (doc_id, text); older documents of the same doc_ids are taken away in the same commit."""
    spark = docs.sparkSession
    rows = [r.asDict() for r in manifest(spark, path) if r["segment"]]
    seq = max((r["seq"] for r in rows), default=0) + 1
    found = docs.agg(F.sum(F.octet_length("text")).alias("size"), F.count("doc_id").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    new = _write_segment(spark, path, _counted(docs, found["rows"] != found["ids"]), found["size"] or 0, seq)
    old = _take_away(spark, path, rows, docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), seq) if rows else []
    _commit(spark, path, [*rows, *old, new])
    return path


build = append


def delete(ids: DataFrame, path: str) -> str:
    """Takes documents (doc_id) away; ids that aren't there don't matter."""
    spark = ids.sparkSession
    rows = [r.asDict() for r in manifest(spark, path) if r["segment"]]
    seq = max((r["seq"] for r in rows), default=0) + 1
    if gone := _take_away(spark, path, rows, ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), seq) if rows else []:
        _commit(spark, path, [*rows, *gone])
    return path


def compact(spark: SparkSession, path: str) -> str:
    """All that is alive in one segment; ``vacuum`` then removes the files of the others."""
    rows = [r.asDict() for r in manifest(spark, path) if r["segment"]]
    if len(rows) > 1:
        seq = max(r["seq"] for r in rows) + 1
        size = 6 * sum(r["tokens"] for r in rows)  # a token and the space after it
        _commit(spark, path, [_write_segment(spark, path, _alive(spark, path, rows).select("term", "doc_id", "dl", F.col("tf").alias("n")), size, seq)])
    return path


def vacuum(spark: SparkSession, path: str) -> None:
    """Removes the files of segments that older manifests name and the one in force doesn't, and those manifests."""
    held = {r["segment"] for r in manifest(spark, path)}
    every = spark.read.schema(MANIFEST).json(f"{path}/manifest").select("segment", "version").collect()
    for s in {r["segment"] for r in every} - held - {""}:
        for kind in ("postings", "terms", "gone"):
            remove(spark, f"{path}/{kind}/segment={s}")
    for v in sorted({r["version"] for r in every})[:-1]:
        remove(spark, f"{path}/manifest/version={v}")


def built(docs: DataFrame, name: str) -> str:
    """The index of a table, built at the first search of this application; built anew when the table's files have changed."""
    spark = docs.sparkSession
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    stamp = files.agg(F.sum(F.xxhash64(*files.columns).cast("decimal(38,0)")).alias("stamp")).first()["stamp"]
    key = (spark.sparkContext.applicationId, f"{name} {stamp}")
    if key not in _BUILT:
        _BUILT[key] = build(docs, f"{shared_folder(spark)}-index")
    return _BUILT[key]


# ---------------------------------------------------------------- reading


def statistics(spark: SparkSession, path: str, asked: DataFrame | None = None) -> DataFrame:
    """term, df, idf, n, avgdl of all terms, or of those asked for, merged from the segments."""
    rows = manifest(spark, path)
    n, total, floor = sum(r["docs"] for r in rows), sum(r["tokens"] for r in rows), next((r["floor"] for r in rows), None)
    terms = _files(spark, path, "terms", TERMS, [r["segment"] for r in rows])
    terms = terms if asked is None else terms.join(asked, "term", "left_semi")
    raw = F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return _merged(terms).select("term", "df", F.when(raw < 0, F.lit(floor)).otherwise(raw).alias("idf"), F.lit(n).alias("n"), F.lit(total / n if n else 0.0).alias("avgdl"))


def search(spark: SparkSession, path: str, asked: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, matched_terms for asked(query_id, term[, weight]); a term asked twice counts twice.

    The query set is broadcast if it is small; its segments and buckets then prune the folders of postings that are read.
    """
    if "weight" not in asked.columns:
        asked = asked.withColumn("weight", F.lit(1.0))
    asked = asked.groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
    rows = manifest(spark, path)
    parts = [(r["segment"], r["buckets"]) for r in rows if r["kind"] == "segment"]
    small = asked.count() * max(1, len(parts)) <= ASKED
    of = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    weights = statistics(spark, path, of(asked.select("term").distinct())).join(of(asked), "term")
    where = F.broadcast(spark.createDataFrame(parts or [("", 1)], "segment string, buckets int"))  # a row a segment
    weights = weights.crossJoin(where).withColumn("bucket", bucket(F.col("term"), F.col("buckets"))).drop("buckets")
    hits = _alive(spark, path, rows).join(of(weights), ["term", "segment", "bucket"])
    part = F.col("weight") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.array_sort(F.collect_set("term")).alias("matched_terms"))
