"""Suffix-array deduplication of repeated byte strings.

A byte goes if it is covered by a string of ``span`` bytes that also starts in a document
with a smaller doc_id.  Windows of ``span`` bytes are routed by content: the key of a
window is the smallest hash of its ``GRAM``-byte substrings, so equal windows have equal
keys wherever they stand.  Successive windows with one key form a run.  Only runs whose
key also occurs in another document are sent, as text, to the key's shard, each distinct
text once a block.  A shard sorts the suffixes of its texts (see ``induced``); suffixes
next to each other whose common prefix reaches ``span`` bytes are equal windows, and each
such group learns the smallest doc_id that holds it.  A text that is alone with its key in
the shard has no window in common with another and is not sorted; neither is a text none of
whose windows has its hash a second time in the shard (equal windows have equal hashes).

A key may be hot: a frequent phrase has one key in all its contexts.  If the distinct
texts of a key pass ``HOT_TEXT`` bytes, its windows are sent one by one and dealt over
several shards by a second content key, the hash of the window, so that no shard grows
with the documents that hold a phrase.

The common prefix is taken by comparing neighbours in the sorted order, up to ``span``
bytes, rather than carried through the queues: only whether it reaches ``span`` counts.

Null and empty texts have no bytes; shorter texts than ``span`` keep all; documents with
one doc_id are no source for each other, repeated rows have a result each; texts of any
length are read whole; other columns play no part, whatever their names; rows without
doc_id are left out (``cut_repeats`` lets them stay); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import partial

from pyspark.sql import DataFrame

from .blocks import LIGHT, blocked, contains, in_order, joined_keys, shard_slices, shared_keys
from .common import tidy
from .induced import suffix_array
from .words import mix

GRAM = 18
CHUNK = 1 << 16
SHARD_TEXT = 2 << 20
HOT_TEXT = 1 << 20
HOT_WINDOWS = 200_000


def _key_minima(part: bytes, span: int):
    """Of each window of ``span`` bytes, the smallest hash of its grams."""
    import numpy as np

    u = np.ndarray((len(part) - 7,), dtype="<u8", buffer=part, strides=(1,))
    m = len(part) - GRAM + 1
    h = u[:m].copy()
    for k in [*range(8, GRAM - 7, 8), GRAM - 8]:
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += u[k : k + m]
    h = mix(h)
    width, have = span - GRAM + 1, 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    if have < width:
        h = np.minimum(h[: len(h) - (width - have)], h[width - have :])
    return h


def runs_of(raw: bytes, span: int):
    """(start, windows, key) of the runs of one byte string."""
    return runs_of_many([raw], span)[0]


def runs_of_many(raws: list[bytes], span: int) -> list[tuple]:
    """(start, windows, key) of the runs of each byte string; short ones are hashed together, long ones in pieces of CHUNK."""
    import numpy as np

    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out, group, held = [none] * len(raws), [], 0

    def several() -> None:
        size = np.array([len(raws[i]) for i in group])
        begin = np.concatenate(([0], np.cumsum(size)))
        h = _key_minima(b"".join([raws[i] for i in group]), span)
        valid = np.zeros(int(begin[-1]) + 1, dtype=np.int64)
        valid[begin[:-1]] += 1
        np.add.at(valid, begin[1:] - span + 1, -1)
        valid = np.cumsum(valid)[: len(h)] > 0
        first = np.ones(len(h), dtype=bool)
        first[1:] = h[1:] != h[:-1]
        first[begin[:-1]] = True
        at = np.flatnonzero(first & valid)
        before = np.concatenate(([0], np.cumsum(valid)))
        n = np.diff(np.append(before[at], before[-1]))
        key = mix(h[at] + np.uint64(1))  # minima are small numbers: spread them
        cut = np.searchsorted(at, begin)
        for k, i in enumerate(group):
            x, y = cut[k], cut[k + 1]
            out[i] = at[x:y] - begin[k], n[x:y], key[x:y]

    for i, raw in enumerate(raws):
        if len(raw) < span:
            continue
        if len(raw) > CHUNK:
            parts = []
            for at in range(0, len(raw) - span + 1, CHUNK):
                h = _key_minima(raw[at : at + CHUNK + span - 1], span)
                first = np.concatenate(([0], np.flatnonzero(h[1:] != h[:-1]) + 1))
                parts.append((first + at, np.diff(np.append(first, len(h))), mix(h[first] + np.uint64(1))))
            out[i] = tuple(np.concatenate(x) for x in zip(*parts))
            continue
        group.append(i)
        held += len(raw)
        if held > CHUNK // 2:
            several()
            group, held = [], 0
    if group:
        several()
    return out


def _with_twins(texts: list[bytes], span: int):
    """The numbers of texts that hold a window whose hash occurs a second time among all windows."""
    import numpy as np

    size = np.fromiter(map(len, texts), np.int64, len(texts))
    joined, count = b"".join(texts), size - span + 1
    m = len(joined) - span + 1
    u = np.ndarray((len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
    h = u[:m].copy()
    for k in [*range(8, span - 7, 8), span - 8]:
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += u[k : k + m]
    owner = np.repeat(np.arange(len(texts)), count)
    h = h[np.arange(len(owner)) + (owner * (span - 1))]  # windows within one text
    order = np.argsort(h)
    h = h[order]
    twin = np.zeros(len(h) + 1, dtype=bool)
    twin[1:-1] = h[1:] == h[:-1]
    return np.unique(owner[order[twin[1:] | twin[:-1]]])


def window_minima(texts: list[bytes], low, span: int, memory: int = 4_000_000):
    """For distinct texts and the smallest doc_id of each: (text number, first window, windows, smallest doc_id), run by run."""
    import numpy as np

    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    joined = b"\xff".join(texts) + b"\xff" * 8  # no UTF-8 text holds this byte
    text = np.frombuffer(joined, dtype=np.uint8)[: int(sizes.sum()) + len(texts)]
    order = suffix_array(text, 256, memory, depth=span)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    valid = np.arange(len(text)) - starts[owner] <= sizes[owner] - span
    order = order[valid[order]]
    u = np.ndarray((len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,))
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), dtype=bool)
    for k in [*range(0, span - 7, 8), span - 8]:
        same &= u[a + k] == u[b + k]
    first = np.concatenate(([0], np.flatnonzero(~same) + 1))
    least = np.minimum.reduceat(low[owner[order]], first)
    smallest = np.zeros(len(text), dtype=np.int64)
    smallest[order] = np.repeat(least, np.diff(np.append(first, len(order))))
    at = np.flatnonzero(valid)
    of, value = owner[at], smallest[at]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (value[1:] != value[:-1])))
    i = np.flatnonzero(new)
    return of[i], at[i] - starts[of[i]], np.diff(np.append(i, len(at))), value[i]


def dedup_suffixes(docs: DataFrame, span: int = 50, keep_text: bool = True, memory: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, text_crc32 (of the input's bytes) and, if asked for, kept.

    ``memory``: entries that a sort keeps in memory; beyond that, its queues and arrays are on disk.
    ``kept`` is text; a character of which a part is cut goes as a whole (kept_sha256 is of the exact bytes).
    """
    texts, total = blocked(docs)
    return _plan(texts, total, span, keep_text, None, memory)


def cut_repeats(docs: DataFrame, span: int = 50) -> DataFrame:
    """``docs`` with its columns, but texts without what ``dedup_suffixes`` removes.

    Columns of any other name come through as they are.  Rows without doc_id have no
    place in the order of documents: they stay as they are and are no source.
    """
    texts, total = blocked(docs, carry=True)
    whole = docs.where("doc_id is null")
    return _plan(texts, total, span, True, docs).unionByName(whole.withColumn("text", whole["text"].cast("string")))


def _plan(texts: DataFrame, total: int, span: int, keep_text: bool, like: DataFrame | None, memory: int | None = None) -> DataFrame:
    """The exchange; with ``like``, rows in its columns, else the digests."""
    shards = max(1, math.ceil(total / SHARD_TEXT))
    columns = like.columns if like is not None else []
    sort = window_minima if memory is None else partial(window_minima, memory=memory)

    def keys_of(table):
        import numpy as np

        keys, owner, runs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        raw = [(t or "").encode() for _, t in in_order(table)]
        for (i, doc), (start, n, k) in zip(enumerate(table.column("doc_id").to_pylist()), runs_of_many(raw, span)):
            runs.append((np.full(len(k), i), start, n + span - 1, k))
            k = np.unique(k)
            keys.append(k)
            owner.append(np.full(len(k), doc))
        return np.concatenate(keys), np.concatenate(owner), *heavy_of(raw, *(np.concatenate(x) for x in zip(*runs)))

    def heavy_of(raw, of, start, size, key):
        """The keys whose distinct texts in the block have LIGHT bytes or more, and these bytes."""
        import numpy as np

        uniq, at = np.unique(key, return_inverse=True)
        on = np.flatnonzero((np.bincount(at, weights=size, minlength=len(uniq)) >= LIGHT)[at])
        total, seen = np.zeros(len(uniq), np.int64), set()
        for k, d, s, n in zip(at[on].tolist(), of[on].tolist(), start[on].tolist(), size[on].tolist()):
            piece = raw[d][s : s + n]
            if piece not in seen:
                seen.add(piece)
                total[k] += n
        return uniq[total >= LIGHT], total[total >= LIGHT]

    def send(table, shared):
        import numpy as np
        import pyarrow as pa
        import xxhash
        import zstandard

        kinds = {"shard": pa.int64(), "block": pa.int32(), "hot": pa.bool_(), "key": pa.binary(), "name": pa.binary(), "low": pa.binary(), "several": pa.binary(), "size": pa.binary(), "text": pa.binary()}
        if not table.num_rows or not shared.num_rows:
            return pa.table({k: pa.array([], v) for k, v in kinds.items()})
        block, known, seen, zipper = table.column("block")[0].as_py(), joined_keys(shared), {}, zstandard.ZstdCompressor(level=3)
        hot = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in shared.column("hot").to_pylist()])
        parts = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in shared.column("bytes").to_pylist()])
        parts = dict(zip(hot.tolist(), (-(-parts * span // SHARD_TEXT)).tolist()))
        rows, windows = {c: [] for c in kinds}, {}

        def row(shard, is_hot, key, name, low, several, pieces):
            size = np.fromiter(map(len, pieces), np.uint32, len(pieces))
            packed = [zipper.compress(x.tobytes()) for x in ((key >> np.uint64(32)).astype(np.uint32), low, several, size)]
            for c, x in zip(kinds, (shard, block, is_hot, packed[0], name.tobytes(), *packed[1:], zipper.compress(b"".join(pieces)))):
                rows[c].append(x)

        def deal():
            """The windows of hot keys, by the hash of each."""
            dealt = {}
            for (x, w), (least, last) in windows.items():
                name = xxhash.xxh3_64_intdigest(w)
                dealt.setdefault((x, name % parts[x]), []).append((name, least, least < last, w))
            for (x, part), found in dealt.items():
                name, low, several, texts = zip(*found)
                to = shards + (xxhash.xxh3_64_intdigest(b"%d %d" % (x, part)) >> 2)
                row(to, True, np.full(len(found), x, np.uint64), np.array(name, np.uint64), np.array(low, np.int64), np.array(several, bool), texts)
            windows.clear()

        raws = [(t or "").encode() for _, t in in_order(table)]
        for doc, raw, (start, n, key) in zip(table.column("doc_id").to_pylist(), raws, runs_of_many(raws, span)):
            on = contains(known, key)
            for s, k, x in zip(start[on].tolist(), n[on].tolist(), key[on].tolist()):
                if x in parts:
                    for i in range(s, s + k):
                        old = windows.setdefault((x, raw[i : i + span]), [doc, doc])
                        old[:] = min(old[0], doc), max(old[1], doc)
                    if len(windows) > HOT_WINDOWS:
                        deal()
                    continue
                piece = raw[s : s + k + span - 1]
                old = seen.get(piece)
                if old is None:
                    seen[piece] = [x, doc, doc]
                elif doc < old[1]:
                    old[1] = doc
                elif doc > old[2]:
                    old[2] = doc
        pieces = list(seen)
        key = np.array([seen[p][0] for p in pieces], dtype=np.uint64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        pieces = [pieces[i] for i in order.tolist()]
        name = np.array([xxhash.xxh3_64_intdigest(p) for p in pieces], dtype=np.uint64)
        low = np.array([seen[p][1] for p in pieces], dtype=np.int64)
        several = low < np.array([seen[p][2] for p in pieces], dtype=np.int64)
        used, cut = shard_slices(key, shards)
        for i, a, b in zip(used.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            row(i, False, key[a:b], name[a:b], low[a:b], several[a:b], pieces[a:b])
        deal()
        return pa.table({c: pa.array(rows[c], k) for c, k in kinds.items()})

    def minima(distinct, low, key):
        """Of all texts of a shard what ``window_minima`` says; equal windows have equal keys, so a text alone with its key needs no sorting."""
        import numpy as np

        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        together = np.flatnonzero(count[at] > 1)
        if len(together):
            together = together[_with_twins([distinct[i] for i in together.tolist()], span)]
        alone = np.setdiff1d(np.arange(len(distinct)), together)
        size = np.fromiter((len(distinct[i]) for i in alone.tolist()), np.int64, len(alone))
        parts = [(alone, np.zeros(len(alone), np.int64), size - span + 1, low[alone])]
        if len(together):
            of, *rest = sort([distinct[i] for i in together.tolist()], low[together], span)
            parts.append((together[of], *rest))
        found = [np.concatenate(x) for x in zip(*parts)]
        order = np.argsort(found[0], kind="stable")
        return [x[order] for x in found]

    def answer(table):
        import numpy as np
        import pyarrow as pa
        import zstandard

        numbers, distinct, low_of, key_of, records, unzip, zipper = {}, [], [], [], [], zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        cols = [table.column(c).to_pylist() for c in ("block", "hot", "key", "name", "low", "several", "size", "text")]
        for block, hot, key, name, low, several, size, text in zip(*cols):
            low, raw, at, mine = np.frombuffer(unzip.decompress(low), dtype=np.int64), unzip.decompress(text), 0, []
            key = np.frombuffer(unzip.decompress(key), dtype=np.uint32)
            for x, n, short in zip(low.tolist(), np.frombuffer(unzip.decompress(size), dtype=np.uint32).tolist(), key.tolist()):
                piece = raw[at : at + n]
                at += n
                k = numbers.get(piece)
                if k is None:
                    k = numbers[piece] = len(distinct)
                    distinct.append(piece)
                    low_of.append(x)
                    key_of.append(short)
                elif x < low_of[k]:
                    low_of[k] = x
                mine.append(k)
            records.append((block, hot, key, np.frombuffer(name, dtype=np.uint64), low, np.frombuffer(unzip.decompress(several), dtype=bool), np.array(mine)))
        numbers.clear()
        of, first, n, value = minima(distinct, np.array(low_of, dtype=np.int64), np.array(key_of))
        begin = np.searchsorted(of, np.arange(len(distinct) + 1))
        out = {"block": [], "hot": [], "key": [], "name": [], "first": [], "n": [], "low": []}
        for block, hot, key, name, low, several, mine in records:
            count = begin[mine + 1] - begin[mine]
            row = np.repeat(np.arange(len(mine)), count)
            run = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[mine][row]
            ok = (value[run] < low[row]) | several[row]
            if ok.any():
                row, run = row[ok], run[ok]
                out["block"].append(block)
                out["hot"].append(hot)
                for c, x in (("key", key[row]), ("name", name[row]), ("first", first[run]), ("n", n[run]), ("low", value[run])):
                    out[c].append(zipper.compress(x.tobytes()))
        return pa.table({c: pa.array(x, {"block": pa.int32(), "hot": pa.bool_()}.get(c, pa.binary())) for c, x in out.items()})

    def remove(table, found):
        import numpy as np
        import pyarrow as pa
        import xxhash
        import zstandard

        known, hot, notes, unzip = np.zeros(0, np.uint32), set(), {}, zstandard.ZstdDecompressor()
        if found.num_rows:
            key, name, first, n, low = (np.concatenate([np.frombuffer(unzip.decompress(x), dtype=k) for x in found.column(c).to_pylist()]) for c, k in (("key", np.uint32), ("name", np.uint64), ("first", np.int64), ("n", np.int64), ("low", np.int64)))
            known = np.unique(key)
            hot = set(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(unzip.decompress(x), dtype=np.uint32) for x, h in zip(found.column("key").to_pylist(), found.column("hot").to_pylist()) if h)]).tolist())
            for x, *note in zip(name.tolist(), first.tolist(), n.tolist(), low.tolist()):
                notes.setdefault(x, []).append(note)
        rows, cut = [], []
        raws = [(t or "").encode() for _, t in in_order(table)]
        for (doc, t), raw, (start, n, key) in zip(in_order(table), raws, runs_of_many(raws, span) if len(known) else [(None, None, ())] * len(raws)):
            spans = []
            if len(key):
                on = contains(known, (key >> np.uint64(32)).astype(np.uint32))
                for s, k, x in zip(start[on].tolist(), n[on].tolist(), (key[on] >> np.uint64(32)).tolist()):
                    hits = [(s + first, m, low) for first, m, low in notes.get(xxhash.xxh3_64_intdigest(raw[s : s + k + span - 1]), ())]
                    if x in hot:
                        hits = sorted([*hits, *((i + first, m, low) for i in range(s, s + k) for first, m, low in notes.get(xxhash.xxh3_64_intdigest(raw[i : i + span]), ()))])
                    for first, m, low in hits:
                        if low < doc:
                            a, b = first, first + m + span - 1
                            if spans and a <= spans[-1][1]:
                                spans[-1][1] = max(spans[-1][1], b)
                            else:
                                spans.append([a, b])
            kept, at = [], 0
            for a, b in spans:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            if columns:
                cut.append(t if not spans else kept.decode(errors="ignore"))
                continue
            rows.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), zlib.crc32(raw), kept.decode(errors="ignore") if keep_text else None))
        del raws, notes
        tidy()
        if columns:
            return pa.table([pa.array(cut, pa.string()) if c == "text" else table.column(f"held_{i}") for i, c in enumerate(columns)], names=columns)
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text_crc32", *["kept"] * keep_text]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, t) for c, t, _ in zip(zip(*rows) if rows else [[]] * 7, kinds, names)], names=names)

    by_block = texts.groupBy("block")
    shared = shared_keys(texts, keys_of, shards, HOT_TEXT)
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(send, "shard long, block int, hot boolean, key binary, name binary, low binary, several binary, size binary, text binary")
    found = sent.groupBy("shard").applyInArrow(answer, "block int, hot boolean, key binary, name binary, first binary, n binary, low binary")
    if like is not None:
        return by_block.cogroup(found.groupBy("block")).applyInArrow(remove, like.withColumn("text", like["text"].cast("string")).schema)
    return by_block.cogroup(found.groupBy("block")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text_crc32 long" + ", kept string" * keep_text)
