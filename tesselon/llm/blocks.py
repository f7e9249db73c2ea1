"""Exchange between document blocks and content-routed shards.

A block is a set of whole documents chosen by the hash of the doc_id, a few megabytes of
text.  Blocks send compact arrays of content keys to shards; a key always meets the same
shard; a shard answers each block with what the block needs to know.  A block sends each
key once, however many documents hold it, so a passage that a third of all documents
share costs one entry a block.  The numbers of blocks and shards follow the bytes of
text, so that either fits a task at any size of the input.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 16 << 20
LIGHT = 512


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES, carry: bool = False) -> tuple[DataFrame, int]:
    """(doc_id, text, block) and the bytes of all texts; with ``carry``, also all columns of docs, by position, as held_0, held_1 and so on."""
    rows = texts_of(docs)
    if carry:
        fields = [F.col(f"`{c}`").alias(f"held_{i}") for i, c in enumerate(docs.columns) if c != "text"]
        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *fields)
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(total / block_bytes))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int")), total


def shard_of(keys, shards: int):
    """The shard of each unsigned 64-bit key: shards are equal ranges of keys."""
    import numpy as np

    n = np.uint64(shards)
    high, low = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    return ((high * n + (low * n >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def shard_slices(keys, shards: int):
    """The shards that sorted keys go to, and where the keys of each begin (one more at the end); work follows the keys, not the shards."""
    import numpy as np

    to = shard_of(keys, shards)
    begin = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, np.int64)
    return to[begin], np.append(begin, len(to))


def contains(sorted_keys, keys):
    """Which keys occur in the sorted ones."""
    import numpy as np

    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


def in_order(table):
    """(doc_id, text) of a block; a stable order makes every pass see the same rows."""
    return zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist())


# ---------------------------------------------------------------- which keys occur in several documents


def shared_keys(texts: DataFrame, keys_of, shards: int, most: int | None = None) -> DataFrame:
    """(block, keys): for each block, its keys that also occur in another document (8 bytes a key).

    ``keys_of(table)`` gives two arrays for a block: 64-bit keys and document numbers.  With ``most``, it also
    gives the keys that bring LIGHT bytes or more from the block, sorted, and these bytes; then ``hot`` has those of
    the block's keys that bring over ``most`` bytes from all blocks, and ``bytes`` how many at most.
    """

    def send(table):
        import numpy as np
        import pyarrow as pa

        block = table.column("block")[0].as_py()
        keys, owner, *heavy = keys_of(table)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        uniq = keys[first]
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first) if len(first) else np.zeros(0, bool)
        used, cut = shard_slices(uniq, shards)
        parts = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        more = {}
        if most is not None:
            to = shard_of(heavy[0], shards)  # heavy keys are among the block's keys
            ends = list(zip(np.searchsorted(to, used).tolist(), np.searchsorted(to, used, "right").tolist()))
            more = {c: pa.array([x[a:b].tobytes() for a, b in ends], pa.binary()) for c, x in zip(("heavy", "weight"), heavy)}
        return pa.table(more | {"shard": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()), "keys": pa.array([uniq[a:b].tobytes() for a, b in parts], pa.binary()), "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in parts], pa.binary())})

    def answer(table):
        import numpy as np
        import pyarrow as pa

        lists = [np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(k)).astype(bool) for x, k in zip(table.column("several").to_pylist(), lists)]
        every = np.sort(np.concatenate(lists))
        again = np.unique(every[1:][every[1:] == every[:-1]])
        hot, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if most is not None:
            heavy, weight = (np.concatenate([np.frombuffer(x, dtype=t) for x in table.column(c).to_pylist()]) for c, t in (("heavy", np.uint64), ("weight", np.int64)))
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            uniq, total = every[first], np.diff(np.append(first, len(every))) * LIGHT
            np.add.at(total, np.searchsorted(uniq, heavy), weight)
            hot, total = uniq[total > most], total[total > most]
        blocks, out, hots, sizes = [], [], [], []
        for b, k, m in zip(table.column("block").to_pylist(), lists, several):
            got = k[m | contains(again, k)]
            if len(got):
                blocks.append(b)
                out.append(got.tobytes())
                mine = contains(got, hot)
                hots.append(hot[mine].tobytes())
                sizes.append(total[mine].tobytes())
        more = {"hot": pa.array(hots, pa.binary()), "bytes": pa.array(sizes, pa.binary())} if most is not None else {}
        return pa.table({"block": pa.array(blocks, pa.int32()), "keys": pa.array(out, pa.binary())} | more)

    sent = texts.groupBy("block").applyInArrow(send, ("" if most is None else "heavy binary, weight binary, ") + "shard int, block int, keys binary, several binary")
    return sent.groupBy("shard").applyInArrow(answer, "block int, keys binary" + ("" if most is None else ", hot binary, bytes binary"))


def joined_keys(table):
    import numpy as np

    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, dtype=np.uint64) for x in table.column("keys").to_pylist())]))
