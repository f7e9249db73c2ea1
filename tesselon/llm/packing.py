"""Shortest-pack-first packing over the length histogram.

Documents become token pieces of at most ``size`` ids (whole pieces of ``size`` and a
rest).  Only the histogram of piece lengths, at most ``size`` rows whatever the input,
goes to the driver, where pieces are placed longest first, each into the least filled
pack that still has room; a pack kind (pattern) and its count stand for all packs alike.
There are at most 2 * ``size`` patterns, as a length splits one pattern and opens two at
most.  Patterns are joined back to pieces by the rank of a piece among those of its length.

Nulls and empty texts give one piece of the end id alone.  Repeated rows and doc_ids are
packed once a row.  A text of any length is encoded whole, one at a time.  Rows without
doc_id are left out; other columns play no part, whatever their names.  Pieces of one
length are ranked by task and place.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import struct
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, texts_of
from .tokens import encoder


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) patterns that hold every length of the histogram exactly as often as it occurs."""
    groups: dict[int, list[list]] = {}
    heap: list[int] = []

    def put(room: int, count: int, lengths: list[int]) -> None:
        if room not in groups or not groups[room]:
            heapq.heappush(heap, -room)
        groups.setdefault(room, []).append([count, lengths])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            while heap and not groups.get(-heap[0]):
                heapq.heappop(heap)
            if not heap or -heap[0] < length:
                break
            room = -heap[0]
            count, lengths = groups[room].pop()
            used = min(n, count)
            if count > used:
                groups[room].append([count - used, lengths])
            put(room - length, used, [*lengths, length])
            n -= used
        if n:
            each = size // length
            if n // each:
                put(size - each * length, n // each, [length] * each)
            if n % each:
                put(size - n % each * length, 1, [length] * (n % each))
    return [(c, x) for room in sorted(groups) for c, x in groups[room]]


def token_pieces(docs: DataFrame, tokenizer: str, spaces: bool, end_id: int, size: int, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents, written to the shared folder, with their rank in (part, length)."""
    end = struct.pack("<I", end_id)

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer, spaces), [0] * (size + 1)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", *["ids"] * with_ids]
        for b in batches:
            ids = b.column(0).to_pylist()
            for i in range(0, len(ids), 500):
                cols: list[list] = [[] for _ in names]
                for doc, raw in zip(ids[i : i + 500], enc.encode_many(b.column(1).slice(i, 500).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    for at in range(0, n, size):
                        piece = raw[4 * at : 4 * (at + size)]
                        k = len(piece) // 4
                        row = (doc, at, k, zlib.crc32(piece), n, part, seen[k], piece)
                        seen[k] += 1
                        for c, x in zip(cols, row):
                            c.append(x)
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        enc.forget()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long" + ", ids binary" * with_ids
    rows = texts_of(docs)
    return materialise(rows.mapInArrow(cut, schema), "pieces")


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``token_pieces``."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    ranks = dict.fromkeys(histogram, 0)
    base = 0
    for count, lengths in pack_histogram(histogram, size):
        places: dict[int, list[int]] = {}
        at = 0
        for x in lengths:
            places.setdefault(x, []).append(at)
            at += x
        for x, offsets in places.items():
            slots.setdefault(x, []).append((ranks[x], base, len(offsets), offsets))
            ranks[x] += count * len(offsets)
        base += count
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")

    def place(batches):
        import bisect

        import pyarrow as pa

        firsts = {x: [s[0] for s in v] for x, v in slots.items()}
        for b in batches:
            seqs, offs = [], []
            for x, r in zip(b.column("length").to_pylist(), b.column("rank").to_pylist()):
                first, start, m, offsets = slots[x][bisect.bisect_right(firsts[x], r) - 1]
                q, k = divmod(r - first, m)
                seqs.append(start + q)
                offs.append(offsets[k])
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in keep] + [pa.array(seqs, pa.int64()), pa.array(offs, pa.int64())], [*keep, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, spaces: bool = True, end_id: int = 0, size: int = 1024, with_ids: bool = False) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, spaces, end_id, size, with_ids), size)
