"""Benchmark decontamination by spaced-seed hashing, in DataFrame expressions only.

A text's tokens are its lower-cased runs of letters and digits.  A seed is the hash of the
tokens that a fixed mask selects from consecutive ones; the others are ignored, so a
substitution there leaves the seed as it is.  Seeds of the training documents are joined
with those of the benchmark.  A hit gives a diagonal (place in the document minus place in
the item), along which the whole item is laid over the document and compared token by
token: the document is contaminated by the item if in some stretch of ``WINDOW`` tokens
(the item's length if shorter) at least ``AGREE`` of them are equal.

No stretch that this rule accepts is missed: it allows two substitutions in 10 to 13
tokens and one in 5 to 9.  For items of 9 tokens and more, the three ``MASKS`` leave, for
each two of any ten successive places and for each one of nine, some seed that ignores
them.  Shorter items have masks of their own length: three that each ignore every third
place where the rule allows a substitution, else one that ignores nothing.

Null or empty texts and items match nothing; a null item_id is a value like any other;
rows without doc_id can't be reported by ``contaminated``, but ``without_leaks`` judges
them too.  Texts of any length are searched whole.  Rows that share a doc_id are judged by
their own texts, repeated rows are reported once, ties go to the smallest place.  Other
columns play no part, whatever their names.  An empty table on either side gives an empty
result.  The benchmark's seeds are broadcast only if they number at most
``BROADCAST_SEEDS``; otherwise the join is a shuffle join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

#: Fixed masks: 1 selects a token.
MASKS = ("11110001", "10101101", "10011011")
LONG = 9
WINDOW, AGREE = 13, 0.8
BROADCAST_SEEDS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def masks_of(size: int) -> tuple[str, ...]:
    """The masks for items of ``size`` tokens."""
    if size >= LONG:
        return MASKS
    if size == math.ceil(size * AGREE):
        return ("1" * size,)
    return tuple("".join("0" if k % 3 == r else "1" for k in range(size)) for r in range(3))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _seeds(rows: DataFrame, sizes: list[int], own_size: bool) -> DataFrame:
    """(key, seed, place) of rows (key, t): a row a place and mask.  With ``own_size``, only the masks of the row's length."""
    t, i = F.col("t"), F.col("i")
    kinds = sorted({min(k, LONG) for k in sizes})
    seeds = []
    for k in kinds:
        for n, mask in enumerate(masks_of(k)):
            fits = i + len(mask) <= F.size(t)
            if own_size:
                fits &= F.least(F.size(t), F.lit(LONG)) == k
            chosen = [t[i + j] for j, m in enumerate(mask) if m == "1"]
            seeds.append(F.when(fits, F.xxhash64(F.lit(100 * k + n), *chosen)))
    places = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    placed = rows.select("key", "t", F.explode(places).alias("i"))
    return placed.select("key", i.alias("place"), F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def _found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key, doc_id, item_id, at, item_tokens, matched of every diagonal that meets the rule.

    A key is a hash of id and text; what it joins is compared again, so equal keys of
    different rows do no harm.
    """
    name = lambda c: F.xxhash64(F.col(c), F.col("text")).alias("key")
    items = benchmark.select(name("item_id"), "item_id", words(F.col("text")).alias("item")).where("size(item) > 0").dropDuplicates(["key"])
    sizes = [r["k"] for r in items.select(F.least(F.size("item"), F.lit(LONG)).alias("k")).distinct().collect()]  # at most LONG values
    hashes = lambda a: F.transform(a, lambda w: F.xxhash64(w)).alias("t")
    if not sizes:
        items, sizes = items.where("false"), [LONG]
    theirs = _seeds(items.select("key", hashes(F.col("item"))), sizes, True).select("seed", F.col("key").alias("item_key"), F.col("place").alias("item_at"))
    ours = _seeds(docs.select(name("doc_id"), hashes(words(F.col("text")))), sizes, False)
    few = theirs.count() <= BROADCAST_SEEDS
    hits = ours.join(F.broadcast(theirs) if few else theirs, "seed")
    lines = hits.select("key", "item_key", (F.col("place") - F.col("item_at")).alias("line")).distinct()
    placed = lines.join(items.withColumnRenamed("key", "item_key"), "item_key")
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name("doc_id"), "text").join(placed, "key")
    item, line = F.col("item"), F.col("line")
    size = F.size(item)
    width = F.least(size, F.lit(WINDOW))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    equal = lambda t: F.transform(item, lambda x, j: F.when((j + line >= 0) & F.coalesce(F.get(t, j + line) == x, F.lit(False)), 1).otherwise(0))
    best = lambda e: F.array_max(F.transform(F.sequence(F.lit(1), size - width + 1), lambda i: total(F.slice(e, i, width))))
    judged = _let(words(F.col("text")), lambda t: _let(equal(t), lambda e: F.struct(total(e).alias("matched"), best(e).alias("best"))))
    laid = both.select("key", "doc_id", "item_id", line.alias("at"), size.alias("item_tokens"), width.alias("width"), F.inline(F.array(judged)))
    return laid.where(F.col("best") >= F.ceil(F.col("width") * AGREE))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched, item_tokens, at: one row for each contaminated document and item.

    ``matched`` counts the equal tokens on the best diagonal; ``at`` is the document token
    where the item's first token lies on it.
    """
    top = _found(docs.where("doc_id is not null"), benchmark).groupBy("doc_id", "item_id", "item_tokens").agg(F.max(F.struct("matched", (-F.col("at")).alias("back"))).alias("m"))
    return top.select("doc_id", "item_id", F.col("m.matched").cast("int").alias("matched"), F.col("item_tokens").cast("int").alias("item_tokens"), (-F.col("m.back")).cast("int").alias("at"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows whose own text holds a benchmark item."""
    (key,) = free_names(1, docs.columns)
    leaks = _found(docs, benchmark).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64(F.col("doc_id"), F.col("text"))).join(leaks, key, "left_anti").select(docs.columns)
