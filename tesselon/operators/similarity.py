"""Scores of one text against another on whole texts: longest common subsequence and greedy token alignment."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

DIMENSIONS = 64
BLOCK = 1024  # tokens of one text that meet all tokens of the other at a time
KNOWN = 200_000  # token vectors that a task keeps


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence: a column of the table is one integer, a bit a place of the shorter list."""
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    bits = {}
    for w, at in places.items():
        mask = bytearray(len(a) // 8 + 1)
        for i in at:
            mask[i >> 3] |= 1 << (i & 7)
        bits[w] = int.from_bytes(mask, "little")
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if mask := bits.get(w):
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with exact_match and rouge_l, the F-measure, of two word lists; 0 where one has no word, whole texts of any length."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            same, score = [], []
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist()):
                x, y = x or [], y or []
                n = common_length(x, y)
                same.append(x == y)
                score.append(2 * n / (len(x) + len(y)) if n else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.bool_()), pa.array(score, pa.float64())], [*batch.schema.names, "exact_match", "rouge_l"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInArrow(run, f"{fields}, exact_match boolean, rouge_l double").withColumn("rouge_l", F.round("rouge_l", 6))


# ---------------------------------------------------------------- greedy alignment of token vectors


class TokenVectors(dict):
    """Counts of a token's letter triples (with a mark at both ends) by bucket of their md5, scaled to length one."""

    def __missing__(self, token: str):
        import hashlib

        import numpy as np

        if len(self) >= KNOWN:
            self.clear()
        marked = f"#{token}#"
        v = np.zeros(DIMENSIONS)
        for i in range(max(1, len(marked) - 2)):
            v[int(hashlib.md5(marked[i : i + 3].encode()).hexdigest()[:8], 16) % DIMENSIONS] += 1
        v = self[token] = v / math.sqrt((v * v).sum())
        return v


def greedy_match(mine: list[dict], other: list[dict], vectors: TokenVectors) -> float:
    """Weighted mean, over my tokens (token, n, idf), of the greatest cosine with any token of the other; 0 without either."""
    import numpy as np

    total = sum(t["n"] * t["idf"] for t in mine)
    if not other or not total:
        return 0.0
    y = np.stack([vectors[t["token"]] for t in other])
    found = 0.0
    for at in range(0, len(mine), BLOCK):
        part = mine[at : at + BLOCK]
        x = np.stack([vectors[t["token"]] for t in part])
        best = np.max([(x @ y[k : k + BLOCK].T).max(axis=1) for k in range(0, len(y), BLOCK)], axis=0)
        found += float(best @ np.array([t["n"] * t["idf"] for t in part]))
    return found / total


def bert_score(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, precision, recall, f1 of candidate ``b`` against reference ``a`` (token lists); keys name a row.

    Weights are inverse document frequencies over all candidates, ln((rows + 1) / (rows with the token + 1)).  Only the
    distinct tokens of a text are exchanged, with their counts; the frequencies are written before they are joined, so
    that a token which most texts hold is split over tasks.
    """
    spark, held = pairs.sparkSession, f"{shared_folder(pairs.sparkSession)}-tokens"
    df = pairs.select(F.explode(F.array_distinct("b")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    df.write.parquet(held)
    df, n = spark.read.schema(df.schema).parquet(held), pairs.count()
    sides = pairs.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("tokens")) for s in ("a", "b")])).alias("x"))
    counted = sides.select(*keys, "x.side", F.explode("x.tokens").alias("token")).groupBy(*keys, "side", "token").agg(F.count("*").alias("n"))
    weighed = counted.join(df, "token", "left").withColumn("idf", F.log(F.lit(float(n + 1)) / (F.coalesce("df", F.lit(0)) + 1)))
    texts = weighed.groupBy(*keys).agg(F.collect_list(F.struct("side", "token", "n", "idf")).alias("tokens"))

    def run(batches):
        import pyarrow as pa

        vectors = TokenVectors()
        for batch in batches:
            rows = []
            for tokens in batch.column("tokens").to_pylist():
                a, b = ([t for t in sorted(tokens, key=lambda t: t["token"]) if t["side"] == s] for s in ("a", "b"))
                p, r = greedy_match(b, a, vectors), greedy_match(a, b, vectors)
                rows.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([x[i] for x in rows], pa.float64()) for i in range(3))], [*keys, "precision", "recall", "f1"])

    fields = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    scored = texts.mapInArrow(run, f"{fields}, precision double, recall double, f1 double")
    zero = {c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("precision", "recall", "f1")}
    return pairs.select(*keys).join(scored, keys, "left").select(*keys, *zero.values())  # rows without any token too
