"""Product quantisation of unit vectors: a vector is written as a few bytes, one a slice of its dimensions.

Only the codebooks are fitted on a sample (``SAMPLE`` rows at most, by hash of the id); every row is coded.  A search reads
the codes of all vectors, dealt in streams, with a table of the query's products with every code word; the best candidates
alone are compared in full: ``CANDIDATES`` of them a query, and at most a tenth of all vectors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import dot, in_blocks, streams_for, top_k

SAMPLE, ROUNDS, WORDS, SLICES = 16_384, 10, 256, 16
CANDIDATES = 200
BLOCK = 1024  # queries that meet a stream at once, each with a table of SLICES x WORDS products


def fit(vectors: DataFrame, slices: int = SLICES):
    """Codebooks (slices x words x dimensions of a slice) by k-means on the sample; None for a table without vectors."""
    import numpy as np

    n = vectors.count()
    keep = max(1, math.ceil(n / SAMPLE))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.pmod(F.xxhash64("vec_id"), F.lit(keep)) == 0)).select("vec_id", "embedding").collect()
    if not rows:
        return None
    x = np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])], dtype=np.float64)
    books = []
    for part in np.split(x, slices, axis=1):
        words = part[np.linspace(0, len(part) - 1, min(WORDS, len(part))).astype(int)].copy()
        for _ in range(ROUNDS):
            near = _nearest(part, words)
            size = np.bincount(near, minlength=len(words))
            sums = np.stack([np.bincount(near, weights=part[:, d], minlength=len(words)) for d in range(part.shape[1])], axis=1)
            words[size > 0] = sums[size > 0] / size[size > 0, None]
        books.append(words)
    return np.stack(books)


def _nearest(x, words):
    return ((words * words).sum(axis=1)[None, :] - 2 * x @ words.T).argmin(axis=1)


def encode(vectors: DataFrame, books, path: str) -> DataFrame:
    """Writes vec_id and code (a byte a slice) of every vector that isn't null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.array(b.column("embedding").to_pylist(), dtype=np.float64).reshape(b.num_rows, -1)
            parts = np.split(x, len(books), axis=1)
            code = np.stack([_nearest(p, w) for p, w in zip(parts, books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([c.tobytes() for c in code], pa.binary())], ["vec_id", "code"])

    coded = vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, "vec_id long, code binary")
    coded.write.parquet(path)
    return vectors.sparkSession.read.schema(coded.schema).parquet(path)


def candidates(queries: DataFrame, codes: DataFrame, books, most: int) -> DataFrame:
    """query_id, vec_id of the ``most`` vectors with the greatest coded product, for each (query_id, q)."""
    packed = queries.select("query_id", F.col("q").cast("array<double>").alias("q"), F.lit(0).alias("ql"))

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(v, dtype=np.float64).tobytes() for v in b.column(1).to_pylist()], pa.binary()), b.column(2)], ["query_id", "q", "ql"])

    def start(q):
        import numpy as np

        x = np.stack([np.frombuffer(v, np.float64) for v in q.column("v").to_pylist()])
        table = np.stack([p @ w.T for p, w in zip(np.split(x, len(books), axis=1), books)], axis=1)
        return q, table, np.full((q.num_rows, most), -np.inf), np.full((q.num_rows, most), -1, np.int64)

    def fold(state, v):
        import numpy as np

        q, table, score, found = state
        code = np.stack([np.frombuffer(c, np.uint8) for c in v.column("v").to_pylist()])
        new = sum(table[:, s, code[:, s]] for s in range(len(books)))
        both = np.concatenate([score, new], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :most]
        ids = np.concatenate([found, np.broadcast_to(v.column("id").to_numpy(), new.shape)], axis=1)
        return q, table, np.take_along_axis(both, order, axis=1), np.take_along_axis(ids, order, axis=1)

    def finish(state):
        import numpy as np
        import pyarrow as pa

        q, _, score, found = state
        i, j = np.nonzero(np.isfinite(score))
        return pa.table({"query_id": pa.array(q.column("id").to_numpy()[i], pa.int64()), "vec_id": pa.array(found[i, j], pa.int64()), "coded": score[i, j]})

    asked = packed.mapInArrow(pack, "query_id long, q binary, ql int")
    held = codes.select("vec_id", F.col("code").alias("embedding"), F.lit(0).alias("label"))
    best = in_blocks(asked, held, start, fold, finish, "query_id long, vec_id long, coded double", streams_for(codes.count()), BLOCK)
    return top_k(best, "query_id", most, F.desc("coded"), F.col("vec_id")).select("query_id", "vec_id")


def search(queries: DataFrame, vectors: DataFrame, codes: DataFrame, books, k: int) -> tuple[DataFrame, int]:
    """(query_id, vec_id, score, rank of the k best; how many vectors are compared in full for a query)."""
    most = max(1, min(CANDIDATES, codes.count() // 10))
    some = candidates(queries, codes, books, most)
    full = some.join(vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("query_id", "q"), "query_id")
    scored = full.select("query_id", "vec_id", dot(F.col("embedding"), F.col("q")).alias("score"))
    return top_k(scored, "query_id", k, F.desc("score"), F.col("vec_id")), most
