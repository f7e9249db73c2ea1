"""An inverted-file index of unit vectors: every row is filed under its nearest centroid, a query reads the cells nearest to it.

Only the centroids are fitted on a sample, of at most about ``SAMPLE`` rows chosen by the hash of the id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import STREAM_ROWS, dense_search

SAMPLE, ROUNDS = 4096, 12


def fit(vectors: DataFrame, cells: int | None = None):
    """Centroids (cells x dimensions) by spherical k-means on the sample; about the square root of the table, if ``cells`` isn't given."""
    import numpy as np

    n = vectors.count()
    parts = max(1, math.ceil(n / SAMPLE))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == 0).select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in sorted(rows, key=lambda r: r["vec_id"])], dtype=np.float64)
    k = min(len(x), cells or max(1, min(SAMPLE // 8, math.isqrt(n))))
    if not k:
        return np.zeros((0, 0))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def nearest(df: DataFrame, column: str, centroids, n: int) -> DataFrame:
    """Adds cells: the numbers of the n nearest centroids; null vectors have none."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            found = [[] if v is None or not len(centroids) else np.argsort(-(centroids @ np.asarray(v, dtype=np.float64)), kind="stable")[:n].tolist() for v in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    return df.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, cells array<int>")


def build(vectors: DataFrame, centroids, path: str) -> DataFrame:
    """Writes every vector under its cell."""
    filed = nearest(vectors.select("vec_id", "embedding"), "embedding", centroids, 1).select("vec_id", "embedding", F.get("cells", 0).alias("cell")).where("cell is not null")
    filed.repartition("cell").write.partitionBy("cell").parquet(path)
    return vectors.sparkSession.read.schema(filed.schema).parquet(path)


def search(queries: DataFrame, index: DataFrame, centroids, k: int, probes: int) -> DataFrame:
    """query_id, vec_id, score, rank (0-based) of the k best in the ``probes`` cells nearest to each query (query_id, q)."""
    asked = nearest(queries.select("query_id", "q"), "q", centroids, probes).select("query_id", "q", F.lit(0).alias("ql"), F.explode("cells").alias("cell"))
    filed = index.withColumn("label", F.lit(0))
    most = index.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    return dense_search(asked, filed, k, parts=max(1, -(-most // STREAM_ROWS)), cells=max(1, len(centroids))).drop("rel")
