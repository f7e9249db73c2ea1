"""Hilbert-curve sharding: quantise metadata, order by curve index, cut equal runs.

Rows near each other on the curve agree in several metadata columns, so the value
ranges of each shard are narrow in all of them and files can be pruned on any.
All work is done by built-in expressions.  The order is total (curve index, then the
doc_id, then the text's crc32), hence shards are the same in every run.

Values are quantised in their order, so that a shard's least and greatest lie close: a string
by the seven bytes behind the prefix that all its column's values share, as a number, a size
as it is.  A sketch of the quantiles gives the limits of the cells (values may share a cell;
more ``bits`` part them), which are spread over the axis; null counts as the lowest cell.  An empty table gives an empty result; repeated
rows get slots of their own, as equal neighbours; rows without doc_id are left out; texts
count by their bytes, whatever their length; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialise


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of integer coordinates in [0, 2**bits), as nested structs of plain expressions."""
    n = len(axes)
    state = F.struct(*[a.cast("int").alias(f"x{i}") for i, a in enumerate(axes)])
    get = lambda s: [s[f"x{i}"] for i in range(n)]
    pack = lambda xs: F.struct(*[x.alias(f"x{i}") for i, x in enumerate(xs)])

    def unturn(q: int, i: int):
        def step(s):
            x = get(s)
            low = F.lit(q - 1)
            on = x[i].bitwiseAND(F.lit(q)) != 0
            t = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
            first = F.when(on, x[0].bitwiseXOR(low)).otherwise(x[0].bitwiseXOR(t))
            y = list(x)
            y[0] = first
            if i:
                y[i] = F.when(on, x[i]).otherwise(x[i].bitwiseXOR(t))
            return pack(y)

        return step

    steps = [unturn(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]

    def gray(s):
        x = get(s)
        for i in range(1, n):
            x[i] = x[i].bitwiseXOR(x[i - 1])
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = F.when(x[n - 1].bitwiseAND(F.lit(1 << b)) != 0, t.bitwiseXOR(F.lit((1 << b) - 1))).otherwise(t)
        return pack([a.bitwiseXOR(t) for a in x])

    for f in [*steps, gray]:  # a let: each state is evaluated once
        state = F.transform(F.array(state), f)[0]

    def interleave(s):
        x, out = get(s), F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for a in x:
                out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(a, b).bitwiseAND(F.lit(1)).cast("long"))
        return out

    return F.transform(F.array(state), interleave)[0]


def _number(c: Column, skip: int) -> Column:
    """Seven bytes of a string from byte ``skip`` on, as a number in the strings' order."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), skip + 1, 7)), 14, "0"), 16, 10).cast("long")


def cells(docs: DataFrame, strings: list[str], size: Column, bits: int) -> list[Column]:
    """A cell for each string column and for the size: by the quantiles of its number, spread over all of 1 .. 2**bits - 1; 0 for null."""
    text = [F.col(c).cast("string") for c in strings]
    ends = docs.agg(*[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(text) for f in (F.min, F.max)]).first()
    skip = [len(os.path.commonprefix([(ends[f"{f}_{i}"] or "").encode() for f in ("min", "max")])) for i in range(len(text))]
    numbers = [*(_number(c, n) for c, n in zip(text, skip)), size]
    parts = (1 << bits) - 1
    shares = [k / parts for k in range(1, parts)]
    cuts = docs.agg(*[F.percentile_approx(x, shares, 50 * parts).alias(f"cuts_{i}") for i, x in enumerate(numbers)]).first()

    def cell(x: Column, limits: list[int]) -> Column:
        place = F.size(F.filter(F.array(*map(F.lit, limits)).cast("array<bigint>"), lambda y: y < x))
        return F.when(x.isNull(), 0).otherwise(1 + F.floor(place * (parts - 1) / max(len(limits), 1))).cast("int")

    return [cell(x, sorted(set(cuts[f"cuts_{i}"] or []))) for i, x in enumerate(numbers)]


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = 5) -> DataFrame:
    """Row-balanced shards (law ``rows``): doc_id, size, text_crc32, curve, shard, slot.

    Only the row count of each sorted partition goes to the driver.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    known = docs.where("doc_id is not null")
    curve = hilbert_index(cells(known, ["source", "lang"], size, bits), bits)
    rows = known.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), curve.alias("curve"))
    ordered = rows.repartitionByRange("curve", "doc_id", "text_crc32").sortWithinPartitions("curve", "doc_id", "text_crc32", "size")
    mono = F.monotonically_increasing_id()
    placed = materialise(ordered.withColumns({"part": F.shiftright(mono, 33).cast("int"), "nth": mono.bitwiseAND(F.lit((1 << 33) - 1))}), "curve")
    starts, n = [], 0
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r["part"], n))
        n += r["n"]
    ranks = placed.join(placed.sparkSession.createDataFrame(starts, "part int, before long"), "part").withColumn("rank", F.col("before") + F.col("nth"))
    shard = F.expr(f"rank * {shards} div {max(n, 1)}").cast("int")
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return ranks.withColumn("shard", shard).withColumn("slot", (F.col("rank") - first).cast("long")).drop("part", "nth", "before", "rank")


def write_shards(docs: DataFrame, out: str, shards: int = 16, file_bytes: int = 256 << 20) -> None:
    """The documents themselves, one folder a shard, in files of consecutive slots, about ``file_bytes`` of text each; no column of docs may be named ``shard``."""
    total = docs.agg(F.count("doc_id").alias("n"), F.sum(F.octet_length("text")).alias("size")).first()
    files = max(1, math.ceil((total["size"] or 0) / file_bytes))  # over all shards
    rows = max(1, math.ceil(total["n"] / max(shards, files)))
    placed = hilbert_shards(docs, shards).select("doc_id", "text_crc32", "shard", "slot")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc, crc, nth, shard, slot, run = free_names(6, docs.columns)
    # repeated rows are equal in both tables: the n-th of one takes the n-th place of the other
    order = lambda *by: F.row_number().over(Window.partitionBy(doc, crc).orderBy(*by))
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), crc: F.crc32(F.encode(text, "UTF-8"))}).withColumn(nth, order(F.xxhash64("text")))
    named = placed.select(F.col("doc_id").alias(doc), F.col("text_crc32").alias(crc), F.col("shard").alias(shard), F.col("slot").alias(slot)).withColumn(nth, order(slot))
    both = keyed.join(named, [doc, crc, nth]).drop(doc, crc, nth)
    both.withColumn(run, F.floor(F.col(slot) / rows)).repartition(max(shards, files), shard, run).sortWithinPartitions(shard, slot).drop(slot, run).withColumnRenamed(shard, "shard").write.partitionBy("shard").parquet(out)
