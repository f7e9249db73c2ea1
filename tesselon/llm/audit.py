"""Filter interaction audit: what each filter removes in every order of the filters.

Filters are conditions of failure, so a document is one of ``2 ** filters`` masks.  The incidence of masks is counted a
part (source): a row of documents, one of good and one of toxic documents, each of 32 numbers for five filters.  These
rows, stacked, are multiplied by integer matrices of 32 by 600 (120 orders of 5 steps): ``kept`` has a one where none of
the filters so far fails the mask, ``removed`` where this one is the first that does, ``redundant`` where it fails but an
earlier one did too, ``unique`` where it alone fails.  One pass over texts gives all orders at once.

Whole texts are read by built-in expressions and only (text hash, doc_id, part, mask) is shuffled.  The filter on repeated
texts needs the smallest doc_id of a text: partial minima go to the text's hash, so a group of copies is one row a task,
and come back joined by (doc_id, hash), which no group of copies shares; neither exchange knows a hot text.  The histogram
has a row for each part at most, whatever the input; the product is made in Arrow batches of parts.

A null text is empty.  A row without doc_id has no smaller doc_id, gives none to others and has no label; it is counted in
its part.  Repeated rows count each; equal doc_ids don't make a text repeated.  A null source is the part ''.  Of several
labels of a doc_id, any 1 counts.  Other columns play no part, whatever their names; no rows give no result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "ABCDE"
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails")


def text_conditions(text: Column) -> list[Column]:
    """Failures A to D of a text that isn't null: few words, repeated words, capitals, marks."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of the mask, bit i the filter LETTERS[i]."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(text_conditions(text))), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), bits.cast("int").alias("mask"))
    first = rows.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("leads", F.lit(True))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")])
    judged = rows.join(first, ["doc_id", "same"], "left").join(marks, "doc_id", "left")
    repeats = F.when(F.col("leads").isNull() & F.col("doc_id").isNotNull(), 1 << LETTERS.index("E")).otherwise(0)
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return judged.groupBy("part", (F.col("mask") + repeats).alias("mask")).agg(F.count("*").alias("n"), count("quality").alias("good"), count("toxic").alias("toxic"))


def outcome_matrices(filters: int):
    """The four matrices of masks by (order, step), and the order and filter of each column."""
    import numpy as np

    orders = list(permutations(range(filters)))
    mask = np.arange(1 << filters)[:, None, None]
    step = np.array([[1 << f for f in o] for o in orders])
    before = np.cumsum(step, axis=1) - step
    fails, earlier = (mask & step) != 0, (mask & before) != 0
    shape = (1 << filters, -1)
    cubes = (~fails & ~earlier, fails & ~earlier, fails & earlier, (mask == step) & fails)
    return [c.reshape(shape).astype(np.int64) for c in cubes], orders


def interactions(incidence: DataFrame, letters: str = LETTERS) -> DataFrame:
    """A row for each part, order and step, zeros included, from ``masks``."""
    width = 1 << len(letters)

    def product(batches):
        import numpy as np
        import pyarrow as pa

        (kept, removed, redundant, unique), orders = outcome_matrices(len(letters))
        names = np.repeat(["".join(letters[f] for f in o) for o in orders], len(letters))
        steps = np.tile(np.arange(1, len(letters) + 1), len(orders))
        here = np.array(orders).ravel()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                rows = [np.zeros((b.num_rows, width), np.int64) for _ in range(3)]
                for i, cells in enumerate(b.column(1).to_pylist()):
                    for c in cells:
                        for x, k in zip(rows, ("n", "good", "toxic")):
                            x[i, c["mask"]] += c[k]
                n, good, toxic = rows
                gone = n @ removed
                shapley = np.stack([gone[:, here == f].sum(axis=1) for f in range(len(letters))], axis=1)[:, here]
                found = (n @ kept, gone, n @ redundant, n @ unique, good @ removed, toxic @ removed, shapley)
                part = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), len(names))))
                yield pa.RecordBatch.from_arrays([part, pa.array(np.tile(names, b.num_rows), pa.string()), pa.array(np.tile(steps, b.num_rows), pa.int32()), *(pa.array(x.ravel(), pa.int64()) for x in found)], [*("part", "filter_order", "step"), *COUNTS, "good_lost", "toxic_lost", "shapley"])

    stacked = incidence.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 cells at most
    return stacked.mapInArrow(product, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*COUNTS, "good_lost", "toxic_lost", "shapley")))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(masks(docs, labels))
