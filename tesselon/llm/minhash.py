"""Near-duplicate components by MinHash.

A document's set holds its distinct shingles of ``shingle`` words (lower-cased; a shorter
text is one shingle).  ``BANDS * ROWS`` universal hash minima form its signature.  Equal
sets are one class (a 128-bit set hash); only one representative of a class goes on.
Documents that agree on a band are candidates.  With 32 bands of 4 minima a pair at
similarity 0.85 is missed with probability (1 - 0.85**4)**32 = 6e-11, at 0.8 with 5e-8.

Candidates are confirmed on the full sets in two steps, so no bucket emits all its pairs:

1. Each member of a bucket is compared with the bucket's smallest member.  Confirmed links
   give components.
2. Only in buckets of three and more whose members still lie in several components, pairs
   across components are compared, if their signatures allow the threshold (agreement
   below ``threshold - 0.17`` has a probability under 1e-6 at the threshold), in place and
   on their sets; only pairs that pass leave the task, to be confirmed on 64-bit hashes.
   Buckets of over ``TILE`` members are cut into tiles, each pair of which is a group.

Null or empty texts have empty sets and are linked with nothing.  Rows that share a
doc_id count as one node, which has the links of all its texts.  Texts of any length are
shingled whole.  Other columns play no part, whatever their names.  Rows without doc_id are
left out (``keep_one`` lets them stay).  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialise, texts_of
from .components import components
from .words import WordHashes, hash_words, mix, split_words, windows

BANDS, ROWS, TILE = 32, 4, 1500
_WORDS = WordHashes()


def _shingles(texts: list[str | None], width: int):
    """Sorted distinct shingle hashes of each text."""
    import numpy as np

    lists = [split_words(t, lower=True) for t in texts]
    flat, starts = hash_words(lists, _WORDS)
    full, out = windows(flat, width), []
    for a, b in zip(starts.tolist(), starts[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(full[a : b - width + 1]))
        elif b > a:
            out.append(windows(flat[a:b], b - a) + np.uint64(b - a))
        else:
            out.append(flat[:0])
    return out


def _perms():
    import numpy as np

    a = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    return a, mix(a)


def signature(hashes):
    """Minima of (a * x + b) mod 2**64, upper halves, over a set of 64-bit hashes."""
    import numpy as np

    a, b = _perms()
    low = np.full(len(a), 0xFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        h = hashes[i : i + 1024, None] * a + b
        low = np.minimum(low, h.min(axis=0) >> np.uint64(32))
    return low.astype(np.uint32)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, one, two (set hash; null for empty sets), sig."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 500):
                ids, texts = (b.column(c).slice(i, 500).to_pylist() for c in (0, 1))
                n, one, two, sig = [], [], [], []
                for s in _shingles(texts, width):
                    n.append(len(s))
                    if len(s):
                        x = mix(s)
                        one.append(int((x * np.uint64(0x9E3779B97F4A7C15)).sum().astype(np.int64)))
                        two.append(int(mix(x + np.uint64(len(s))).sum().astype(np.int64)))
                        sig.append(signature(s).tobytes())
                    else:
                        one.append(None)
                        two.append(None)
                        sig.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "one", "two", "sig"])
        _WORDS.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, one long, two long, sig binary")


def _bands(reps: DataFrame) -> DataFrame:
    """(bucket, band, doc_id), a row a band."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        weights = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        number = mix(np.arange(1000, 1000 + BANDS, dtype=np.uint64))
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint32).reshape(b.num_rows, BANDS, ROWS).astype(np.uint64)
                key = mix((mix(sig + number[None, :, None]) * weights).sum(axis=2) + number)
                ids = np.repeat(b.column(0).to_numpy(), BANDS)
                bands = np.tile(np.arange(BANDS, dtype=np.int32), b.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)), pa.array(bands), pa.array(ids)], ["bucket", "band", "doc_id"])

    return reps.select("doc_id", "sig").mapInArrow(run, "bucket long, band int, doc_id long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 500):
                sets = _shingles(b.column(1).slice(i, 500).to_pylist(), width)
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 500), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "shingles"])
        _WORDS.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets meet 100 * intersection >= percent * union."""
    a = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(a, "u").join(b, "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared * 100 >= (F.size("a") + F.size("b") - shared) * percent).select("u", "v")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of one bucket in different components that their sets' 32-bit hashes don't rule out.

    members: bucket, band, doc_id, component, n (members of the bucket), sig, shingles.
    A pair is compared only in the bucket of the first band that both agree on.
    """
    need = int((percent / 100 - 0.17) * BANDS * ROWS)
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), tiles).cast("int")
    small = F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int"))
    dealt = members.withColumns({"mine": mine, "short": small}).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    dealt = dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).select("bucket", "i", "j", "band", "mine", "doc_id", "component", "sig", "short")

    def compare(table):
        import numpy as np
        import pyarrow as pa

        i, j, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
        mine = table.column("mine").to_numpy()
        ids, comp = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(len(ids), BANDS * ROWS)
        short = [np.sort(x.values.to_numpy(zero_copy_only=False)) for x in table.column("short")]
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        us, vs = [], []
        for x in left.tolist():
            y = right[(comp[right] != comp[x]) & (ids[right] > ids[x] if i == j else ids[right] != ids[x])]
            if not len(y):
                continue
            equal = sig[y] == sig[x]
            first = equal.reshape(len(y), BANDS, ROWS).all(axis=2).argmax(axis=1)
            for k in y[(equal.sum(axis=1) >= need) & (first == band)].tolist():
                a, b = short[x], short[k]
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                shared = int((b[at] == a).sum())  # never less than that of the full hashes
                if shared * 100 >= (len(a) + len(b) - shared) * percent:
                    us.append(max(int(ids[x]), int(ids[k])))
                    vs.append(min(int(ids[x]), int(ids[k])))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; a link is 100 * intersection >= percent * union."""
    rows = texts_of(docs)
    every = materialise(signatures(rows, shingle), "signatures")
    full = every.where("n_shingles > 0")
    classes = materialise(full.groupBy("one", "two").agg(F.min("doc_id").alias("rep")), "classes")
    # a document's node is its smallest class; the classes of a doc_id with several texts are linked through it
    nodes = materialise(full.select("doc_id", "one", "two").join(classes, ["one", "two"]).groupBy("doc_id").agg(F.min("rep").alias("node"), F.max("rep").alias("last")), "nodes")
    several = full.select("doc_id", "one", "two").join(nodes.where("node != last").select("doc_id"), "doc_id", "left_semi")
    shared = several.join(classes, ["one", "two"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u != v").distinct()
    picked = classes.select(F.col("rep").alias("doc_id"), "one", "two")
    reps = materialise(full.join(picked, ["doc_id", "one", "two"], "left_semi").dropDuplicates(["doc_id", "one", "two"]).select("doc_id", "sig"), "reps")
    bands = _bands(reps)
    pivots = bands.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    # merge joins of tables: adaptive execution splits a hot bucket there, but neither in a broadcast join after the
    # shuffle nor where one side is still to be aggregated
    members = materialise(bands.join(materialise(pivots, "pivots").hint("merge"), "bucket"), "buckets")
    sets = materialise(_sets(rows.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), shingle), "sets")
    star = members.where("doc_id != pivot").select(F.col("doc_id").alias("u"), F.col("pivot").alias("v")).distinct()
    star = star.join(reps.select(F.col("doc_id").alias("u"), F.col("sig").alias("a")), "u").join(reps.select(F.col("doc_id").alias("v"), F.col("sig").alias("b")), "v")
    possible = _agreeing(star, int((percent / 100 - 0.17) * BANDS * ROWS))
    links = materialise(confirm(possible, sets, percent).union(shared), "links")
    first = components(links)
    label = F.coalesce(F.col("component"), F.col("doc_id")).alias("component")
    named = members.where("n > 2").join(first.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "band", "doc_id", "n", label)
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    rest = _across(named.join(materialise(mixed, "mixed").hint("merge"), "bucket", "left_semi").join(reps, "doc_id").join(sets, "doc_id"), percent)
    final = components(links.union(confirm(rest, sets, percent)))
    joined = every.select("doc_id", "n_shingles").join(nodes.drop("last"), "doc_id", "left").join(final, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one document (the smallest doc_id) of each component.

    Rows that repeat a doc_id are one document: they stay or go together.  Rows without
    doc_id stay.  Only the doc_ids that go are joined with the documents.
    """
    (name,) = free_names(1, docs.columns)
    gone = near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def _agreeing(pairs: DataFrame, need: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(n).to_pylist()), dtype=np.uint32).reshape(b.num_rows, -1) for n in ("a", "b"))
                ok = pa.array((a == c).sum(axis=1) >= need)
                yield pa.RecordBatch.from_arrays([b.column("u").filter(ok), b.column("v").filter(ok)], ["u", "v"])

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")
