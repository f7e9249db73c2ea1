"""Substring deduplication by difference-cover anchors.

A window is ``span`` consecutive words.  With the cover D = {1, 2, 4} modulo 7, any two
places i and j have a shift s < 7 for which i + s and j + s both lie on cover places, so
two equal windows of 13 words share an anchor of 7 words that starts on a cover place in
both.  Only anchors (3 of 7 places) are exchanged first; windows around an anchor that
another document has too are then extended to their full width, as 128-bit hashes, and
each learns the smallest doc_id that holds it.

A word goes if a window that covers it also starts in a document with a smaller doc_id.
Null and empty texts have no words; texts shorter than a window keep all; documents of
the same doc_id are no source for each other, repeated rows have a result each; texts of
any length are read whole; rows without doc_id are left out; other columns play no part,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame

from .blocks import SHARD_BYTES, blocked, contains, in_order, joined_keys, shard_slices, shared_keys
from .words import WordHashes, hash_words, split_words, windows, windows_at

PERIOD, COVER = 7, (1, 2, 4)
_WORDS = WordHashes()


def _inside(starts, width: int, n: int):
    """Places where a run of ``width`` words lies in one document, the document's number, and the place in it."""
    import numpy as np

    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(owner)) - starts[:-1][owner]
    ok = at + width <= sizes[owner]
    return ok[:n], owner[:n], at[:n]


def dedup_windows(docs: DataFrame, span: int = 13, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words joined by one space), kept_sha256."""
    anchor = span - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"a window needs at least {PERIOD} words")
    texts, total = blocked(docs)
    shards = max(1, math.ceil(total * 0.6 / shard_bytes))

    def read(table):
        docs = list(in_order(table))
        lists = [split_words(t) for _, t in docs]
        out = [d for d, _ in docs], lists, *hash_words(lists, _WORDS)
        _WORDS.forget()
        return out

    def anchors(ids, flat, starts):
        import numpy as np

        ok, owner, at = _inside(starts, anchor, max(len(flat) - anchor + 1, 0))
        on = np.flatnonzero(ok & np.isin(at % PERIOD, COVER))
        return windows_at(flat, on, anchor), owner[on], on

    def keys_of(table):
        import numpy as np

        ids, _, flat, starts = read(table)
        keys, owner, _ = anchors(ids, flat, starts)
        return keys, np.array(ids, dtype=np.int64)[owner]

    def send(table, shared):
        import numpy as np
        import pyarrow as pa
        import zstandard

        kinds = {"shard": pa.int32(), "block": pa.int32(), "one": pa.binary(), "two": pa.binary(), "low": pa.binary(), "several": pa.binary()}
        if not table.num_rows or not shared.num_rows:
            return pa.table({k: pa.array([], v) for k, v in kinds.items()})
        block = table.column("block")[0].as_py()
        ids, _, flat, starts = read(table)
        keys, _, place = anchors(ids, flat, starts)
        hit = np.zeros(len(flat) + 1, dtype=np.int64)
        hit[place[contains(joined_keys(shared), keys)]] = 1
        seen = np.concatenate(([0], np.cumsum(hit)))
        ok, owner, _ = _inside(starts, span, max(len(flat) - span + 1, 0))
        i = np.flatnonzero(ok)
        i = i[seen[i + span - anchor + 1] > seen[i]]  # an anchor that begins in the window's first places is shared
        one, two, doc = windows_at(flat, i, span, 0), windows_at(flat, i, span, 1), np.array(ids, dtype=np.int64)[owner[i]]
        order = np.lexsort((doc, two, one))
        one, two, doc = one[order], two[order], doc[order]
        new = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(one) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(one))[: len(first)] - 1
        several = doc[first] != doc[last]
        one, two, low = one[first], two[first], doc[first]
        used, cut = shard_slices(one, shards)
        ends = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
        part = lambda a: pa.array([a[x:y].tobytes() for x, y in ends], pa.binary())
        zipper = zstandard.ZstdCompressor(level=3)
        packed = lambda a: pa.array([zipper.compress(a[x:y].tobytes()) for x, y in ends], pa.binary())
        return pa.table({"shard": pa.array(used, pa.int32()), "block": pa.array([block] * len(used), pa.int32()), "one": part(one), "two": part(two), "low": packed(low), "several": packed(several)})

    def answer(table):
        import numpy as np
        import pyarrow as pa
        import zstandard

        unzip = zstandard.ZstdDecompressor()

        def arrays(name, kind):
            raw = table.column(name).to_pylist()
            return [np.frombuffer(x if name in ("one", "two") else unzip.decompress(x), dtype=kind) for x in raw]

        ones, twos, lows, sev = arrays("one", np.uint64), arrays("two", np.uint64), arrays("low", np.int64), arrays("several", bool)
        of = np.repeat(np.arange(len(ones)), [len(x) for x in ones])
        one, two, low, several = (np.concatenate(x) for x in (ones, twos, lows, sev))
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        least = np.repeat(np.minimum.reduceat(low[order], first), np.diff(np.append(first, len(a))))
        smallest = np.empty_like(low)
        smallest[order] = least
        keep = (smallest < low) | several
        blocks, out = [], {"one": [], "two": [], "low": []}
        for i, block in enumerate(table.column("block").to_pylist()):
            k = keep & (of == i)
            if k.any():
                blocks.append(block)
                for n, x in (("one", one), ("two", two), ("low", smallest)):
                    out[n].append(x[k].tobytes())
        return pa.table({"block": pa.array(blocks, pa.int32()), **{n: pa.array(x, pa.binary()) for n, x in out.items()}})

    def remove(table, found):
        import numpy as np
        import pyarrow as pa

        ids, lists, flat, starts = read(table)
        gone = np.zeros(len(flat) + 1, dtype=np.int64)
        if found.num_rows and len(flat):
            f_one, f_two, f_low = (np.concatenate([np.frombuffer(x, dtype=k) for x in found.column(n).to_pylist()]) for n, k in (("one", np.uint64), ("two", np.uint64), ("low", np.int64)))
            order = np.argsort(f_one, kind="stable")
            f_one, f_two, f_low = f_one[order], f_two[order], f_low[order]
            one = windows(flat, span, 0)
            ok, owner, _ = _inside(starts, span, len(one))
            i = np.flatnonzero(ok)
            i = i[contains(f_one, one[i])]
            two, doc = windows_at(flat, i, span, 1), np.array(ids, dtype=np.int64)[owner[i]]
            at = np.searchsorted(f_one, one[i])
            bad = np.zeros(len(i), dtype=bool)
            more = np.ones(len(i), dtype=bool)
            while more.any():  # one step, unless first halves of different hashes are equal
                bad |= more & (f_two[np.minimum(at, len(f_one) - 1)] == two) & (f_low[np.minimum(at, len(f_one) - 1)] < doc)
                at = at + 1
                more &= (at < len(f_one)) & (f_one[np.minimum(at, len(f_one) - 1)] == one[i])
            np.add.at(gone, i[bad], 1)
            np.add.at(gone, i[bad] + span, -1)
        mask = np.cumsum(gone)[:-1] > 0
        rows = []
        for k, (doc, w) in enumerate(zip(ids, lists)):
            m = mask[starts[k] : starts[k + 1]]
            n = int(m.sum())
            kept = b" ".join([x for x, g in zip(w, m.tolist()) if not g] if n else w)
            rows.append((doc, len(w), n, kept.decode(), hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    by_block = texts.groupBy("block")
    shared = shared_keys(texts, keys_of, shards)
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(send, "shard int, block int, one binary, two binary, low binary, several binary")
    found = sent.groupBy("shard").applyInArrow(answer, "block int, one binary, two binary, low binary")
    return by_block.cogroup(found.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
