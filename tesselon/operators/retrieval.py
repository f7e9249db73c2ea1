"""Dense vectors over sets of queries, hash embeddings, fusion of lists and reranking (BM25 is in ``index``)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import whitespace_words

QUERY_BLOCK, VECTOR_PARTS, VECTOR_SLICE, STREAM_ROWS = 4096, 16, 512, 1 << 16


def dot(a: Column, b: Column) -> Column:
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    return F.round(F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 6)


def streams_for(rows: int) -> int:
    """Streams over which so many vectors are dealt."""
    return max(VECTOR_PARTS, math.ceil(rows / STREAM_ROWS))


def in_blocks(queries: DataFrame, vectors: DataFrame, start, fold, finish, schema: str, parts: int = VECTOR_PARTS, block: int | None = None, cells: int = 1) -> DataFrame:
    """Each block of queries meets all vectors, dealt over ``parts`` streams: no task or broadcast holds a whole side.

    start(queries) gives a state, fold(state, vectors) takes a slice of a stream, in order of vec_id, and
    finish(state) gives an Arrow table; arguments are Arrow tables.  With ``cells``, both sides have a number ``cell``
    below it, and a query meets the vectors of its cell.
    """
    asked = queries.count() if cells == 1 else queries.select("query_id").distinct().count()
    blocks = max(1, math.ceil(asked / (block or QUERY_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = F.col("cell").cast("int") if cells > 1 else F.lit(0)
    more = [c for c in queries.columns if c not in ("query_id", "q", "ql", "cell")]
    q = queries.select("*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qb")).select("*", every(parts).alias("vb"))
    q = q.select(cell.alias("cell"), "qb", "vb", F.lit(0).alias("kind"), F.col("query_id").alias("id"), F.col("q").alias("v"), F.col("ql").alias("label"), *more)
    v = vectors.select("vec_id", "embedding", "label", cell.alias("cell"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("vb")).select("*", every(blocks).alias("qb"))
    v = v.select("cell", "qb", "vb", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    key = ["cell", "qb", "vb"]
    meeting = (F.col("cell") * blocks + F.col("qb")) * parts + F.col("vb")  # a task each: none gets two by the chance of a hash
    dealt = q.unionByName(v, allowMissingColumns=True).repartitionById(cells * blocks * parts, meeting).sortWithinPartitions(*key, "kind", "id")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def done(asked, state):
            out = finish(start(asked) if state is None else state)
            return out.to_batches()

        now, asked, state = None, None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            at = np.stack([table.column(c).to_numpy() for c in (*key, "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for x, y in zip(cuts, cuts[1:]):
                part, (*at_key, kind) = table.slice(x, y - x), at[x].tolist()
                if at_key != now:
                    if asked is not None:
                        yield from done(asked, state)
                    now, asked, state = at_key, None, None
                if kind == 0:
                    asked = part if asked is None else pa.concat_tables([asked, part])
                elif asked is not None:
                    state = start(asked) if state is None else state
                    for i in range(0, part.num_rows, VECTOR_SLICE):
                        state = fold(state, part.slice(i, VECTOR_SLICE))
        if asked is not None:
            yield from done(asked, state)

    return dealt.mapInArrow(run, schema)


def matrix(table):
    import numpy as np

    return np.array(table.column("v").to_pylist(), dtype=np.float64)


def block_scores(q, a, v, same_label: bool, others: bool):
    """Scores of all queries, of matrix a, with a slice of vectors (-inf where a vector may not be found)."""
    import numpy as np

    s = np.round(a @ matrix(v).T, 6) + 0.0
    column = lambda t, c: t.column(c).to_numpy()
    if same_label:
        s[column(q, "label")[:, None] != column(v, "label")[None, :]] = -np.inf
    if others:
        s[column(q, "id")[:, None] == column(v, "id")[None, :]] = -np.inf
    return s


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, same_label: bool = False, others: bool = False, parts: int = VECTOR_PARTS, cells: int = 1) -> DataFrame:
    """query_id, vec_id, score, rel, rank (0-based): the k best of all vectors for each of (query_id, q, ql).

    rel: the labels agree.  same_label: only such vectors are found; others: a query does not find itself.
    Each stream gives its k best of a query, and these are ranked.
    """

    def start(q):
        import numpy as np

        none = lambda x, t: np.full((q.num_rows, k), x, dtype=t)
        return q, matrix(q), none(-np.inf, np.float64), none(-1, np.int64), none(0, np.int32)

    def fold(state, v):
        import numpy as np

        q, a, score, found, rel = state
        new = block_scores(q, a, v, same_label, others)
        hit = np.flatnonzero((new > score[:, -1:]).any(axis=1))  # equal scores stay with the smaller ids, which came before
        s = np.concatenate([score[hit], new[hit]], axis=1)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        wide = lambda old, x: np.take_along_axis(np.concatenate([old[hit], x], axis=1), order, axis=1)
        same = q.column("label").to_numpy()[hit][:, None] == v.column("label").to_numpy()[None, :]
        found[hit] = wide(found, np.broadcast_to(v.column("id").to_numpy(), (len(hit), v.num_rows)))
        rel[hit] = wide(rel, same.astype(np.int32))
        score[hit] = np.take_along_axis(s, order, axis=1)
        return q, a, score, found, rel

    def finish(state):
        import numpy as np
        import pyarrow as pa

        q, _, score, found, rel = state
        i, j = np.nonzero(np.isfinite(score))
        return pa.table({"query_id": pa.array(q.column("id").to_numpy()[i], pa.int64()), "vec_id": pa.array(found[i, j], pa.int64()), "score": score[i, j], "rel": pa.array(rel[i, j], pa.int32())})

    best = in_blocks(queries, vectors, start, fold, finish, "query_id long, vec_id long, score double, rel int", parts, cells=cells)
    return top_k(best, "query_id", k, F.desc("score"), F.col("vec_id"))


def first_relevant(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """query_id, rank: the place of the best other vector of the query's label among all other vectors."""
    best = dense_search(queries, vectors, 1, same_label=True, others=True).select("query_id", F.col("vec_id").alias("best_id"), F.col("score").alias("best"))

    def start(q):
        import numpy as np

        return q, matrix(q), np.zeros(q.num_rows, dtype=np.int64)

    def fold(state, v):
        q, a, n = state
        s = block_scores(q, a, v, False, True)
        best, best_id = (q.column(c).to_numpy()[:, None] for c in ("best", "best_id"))
        return q, a, n + ((s > best) | ((s == best) & (v.column("id").to_numpy()[None, :] < best_id))).sum(axis=1)

    def finish(state):
        import pyarrow as pa

        return pa.table({"query_id": state[0].column("id"), "ahead": pa.array(state[2], pa.int64())})

    counted = in_blocks(queries.join(best, "query_id"), vectors, start, fold, finish, "query_id long, ahead long")
    return counted.groupBy("query_id").agg(F.sum("ahead").alias("rank"))


def hash_buckets(text: Column, dim: int) -> Column:
    return F.transform(whitespace_words(F.lower(text)), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim).cast("int"))


def hash_vectors(docs: DataFrame, dim: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, vector and the columns ``keep``: the word counts of each document by bucket, over their L2 norm; zeros without words."""
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists, n = batch.column("b"), batch.num_rows
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
            m = np.bincount(row * dim + lists.flatten().to_numpy(zero_copy_only=False), minlength=n * dim).reshape(n, dim).astype(np.float64)
            m = np.round(m / np.maximum(1.0, np.sqrt((m * m).sum(axis=1)))[:, None], 6)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(m.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), vector, *(batch.column(c) for c in keep)], names=["doc_id", "vector", *keep])

    buckets = docs.select("doc_id", hash_buckets(F.coalesce("text", F.lit("")), dim).alias("b"), *keep)
    return buckets.mapInArrow(count, f"doc_id long, vector array<double>{more}")


def rrf(lists: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of (query_id, doc_id, rank) lists: query_id, doc_id, score."""
    every = None
    for df, weight in lists:
        x = df.select("query_id", "doc_id", (F.lit(weight) / (k + 1 + F.col("rank"))).alias("s"))
        every = x if every is None else every.union(x)
    return every.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score"))


def top_k(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """Adds rank (0-based).  The limit is on the row number itself, so that each task keeps k rows of a key before the exchange."""
    numbered = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
    return numbered.withColumn("rank", F.col("rank") - 1)


def fuse(dense: DataFrame, sparse: DataFrame, k: int, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """query_id, doc_id, score, rank: reciprocal ranks of two lists (query_id, doc_id, score, rank); of a query with one list only, that one, raw scores kept."""
    both = rrf([(dense, weights[0]), (sparse, weights[1])])
    here = lambda d, n: d.select("query_id").distinct().withColumn(n, F.lit(True))
    held = here(dense, "d").join(here(sparse, "s"), "query_id", "full_outer")
    single = held.where("d is null or s is null").select("query_id")
    raw = dense.select("query_id", "doc_id", "score").union(sparse.select("query_id", "doc_id", "score")).join(single, "query_id", "left_semi")
    return top_k(both.join(single, "query_id", "left_anti").unionByName(raw), "query_id", k, F.desc("score"), F.col("doc_id"))


def fuse_lists(lists: dict[str, tuple[DataFrame, float]], k: int) -> DataFrame:
    """query_id, doc_id, score, rank, sources, and the rank in each list: reciprocal ranks of any number of lists."""
    every = None
    for name, (df, weight) in lists.items():
        x = df.select("query_id", "doc_id", (F.lit(weight) / (61 + F.col("rank"))).alias("s"), F.lit(name).alias("source"), F.col("rank").alias("r"))
        every = x if every is None else every.union(x)
    ranks = [F.max(F.when(F.col("source") == n, F.col("r"))).alias(f"{n}_rank") for n in lists]
    return top_k(every.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"), *ranks), "query_id", k, F.desc("score"), F.col("doc_id"))


def weighted_sum(lists: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """query_id, doc_id, score, rank: scores scaled to 0..1 within each list and query, weighted and added."""
    every = None
    for df, weight in lists:
        w = Window.partitionBy("query_id")
        low, high = F.min("score").over(w), F.max("score").over(w)
        x = df.select("query_id", "doc_id", (F.lit(weight) * F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)).alias("s"))
        every = x if every is None else every.union(x)
    return top_k(every.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score")), "query_id", k, F.desc("score"), F.col("doc_id"))


def rerank(results: DataFrame, k: int = 5, threshold: float | None = None) -> DataFrame:
    """query_id, doc_id, rank of the k best by ``rerank_score``; below the threshold a query keeps its order by ``score``."""
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    key = F.col("rerank_score") if threshold is None else F.when(best >= threshold, F.col("rerank_score")).otherwise(F.col("score"))
    return top_k(results.withColumn("key", key), "query_id", k, F.desc("key"), F.desc("score"), F.col("doc_id")).drop("key")


def without_near_copies(results: DataFrame, words: DataFrame, most: float = 0.8) -> DataFrame:
    """Results (query_id, doc_id, rank) without those that share more than ``most`` of the smaller word set with a better one.

    Lists are top-k lists: pairs are formed within them only.  words: doc_id, w (distinct words).
    """
    own = results.join(words, "doc_id")
    a, b = own.alias("a"), own.alias("b")
    shared = F.size(F.array_intersect("a.w", "b.w")) / F.greatest(F.least(F.size("a.w"), F.size("b.w")), F.lit(1))
    worse = a.join(b, F.expr("a.query_id = b.query_id and a.rank > b.rank")).where(shared > most).select("a.query_id", "a.doc_id").distinct()
    return results.join(worse, ["query_id", "doc_id"], "left_anti")
