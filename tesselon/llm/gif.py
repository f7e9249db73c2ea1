"""GIF columns: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms.

``decode_gif`` reads any GIF87a/89a and composes its frames; ``gif_frames`` applies it to a
column, a row a frame.  ``encode_samples`` stores bytes as an animation of 24 x 24 pixels:
each block of 576 bytes is what the red channel shows at one frame.  Frames take turns: a
whole one that stays; one whose unchanged pixels are transparent, after which the canvas
goes back; the part that differs, cleared afterwards; and a whole one with a palette of its
own.  ``text_media`` stores texts so and reads them back through the composed frames, with
time, disposal and histogram of each frame.

Streams are decoded and composed ``GROUP`` frames at a time, so a long text needs little
more memory than itself.  A null or unreadable GIF, one with a stream that is bad or ends early
in any frame, or one whose canvas has over ``most_pixels`` (a parameter), gives no frame row
and an ``error``; a null text is stored as an empty one.  Rows without doc_id are left out; equal rows give equal results, each its own;
other columns play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

SIDE = 24
FRAME = SIDE * SIDE
GROUP = 256
MOST_PIXELS = 1 << 26  # of a canvas, by default: a task holds four bytes a pixel
CHANNELS = ("hist_red", "hist_green", "hist_blue")
HELD = 8 << 20  # bytes of pixels that a batch of frames holds


# ---------------------------------------------------------------- LZW


def _widths(n: int, min_size: int):
    """Bit widths of the first n codes after a clear code, for a reader that adds an entry a code."""
    import numpy as np

    entries = (1 << min_size) + 1 + np.arange(n)  # entries in the table when code k is read
    return np.minimum(np.maximum(np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1, min_size + 1), 12)


def lzw_decode(data: bytes, min_size: int, limit: int) -> bytes:
    """Any LZW code stream, code by code; at most ``limit`` bytes."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, width, prev, out, size = list(base), min_size + 1, b"", [], 0
    bits = n = 0
    for byte in data:
        bits |= byte << n
        n += 8
        while n >= width:
            code = bits & ((1 << width) - 1)
            bits >>= width
            n -= width
            if code == clear:
                table, width, prev = list(base), min_size + 1, b""
                continue
            if code == end or size >= limit:
                return b"".join(out)[:limit]
            if code < len(table):
                entry = table[code]
            elif prev and code == len(table):
                entry = prev + prev[:1]
            else:
                raise ValueError("bad LZW code")
            out.append(entry)
            size += len(entry)
            if prev and len(table) < 4096:
                table.append(prev + entry[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            prev = entry
    return b"".join(out)[:limit]


def _decode_all(streams: list[bytes], size) -> list[bytes] | None:
    """Many 8-bit streams with one leading clear code each, by array steps; None if a stream isn't so.

    ``size``: the bytes of each stream.  A code that names entry j stands for the output of code j and one byte more, which
    lie in a row in the output.  Lengths follow by pointer doubling over codes, the bytes
    by pointer doubling over output places.
    """
    import numpy as np

    count = len(streams)
    lens = np.fromiter(map(len, streams), np.int64, count)
    raw = np.frombuffer(b"".join(streams) + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    first = np.concatenate(([0], np.cumsum(lens)[:-1]))
    most = int(lens.max()) * 8 // 9 + 1
    if most > 3838:  # the table may be full: widths stop growing
        return None
    width = _widths(most, 8)
    # code 0 is the clear code of width 9; code k >= 1 is read with k - 1 codes before it in the table's count
    width = np.concatenate(([9], width))[: most + 1]
    at = np.concatenate(([0], np.cumsum(width)))
    n = np.searchsorted(at, lens * 8, side="right") - 1
    rep = np.repeat(np.arange(count), n)
    start = np.concatenate(([0], np.cumsum(n)[:-1]))
    k = np.arange(int(n.sum())) - start[rep]
    bit = first[rep] * 8 + at[k]
    b = bit >> 3
    code = ((raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (bit & 7)) & ((1 << width[k]) - 1)
    if (code[start] != 256).any():
        return None
    inner = k > 0
    if (code[inner] == 256).any():
        return None
    ended = np.flatnonzero(code == 257)
    stop = np.full(count, -1)
    stop[rep[ended][::-1]] = k[ended][::-1]
    if (stop < 0).any():
        return None
    keep = inner & (k < stop[rep])
    code, rep = code[keep], rep[keep]
    own = np.bincount(rep, minlength=count)
    first_code = np.concatenate(([0], np.cumsum(own)[:-1]))
    here = np.arange(len(code))
    named = code >= 258
    up = np.where(named, first_code[rep] + code - 258, here)
    if (up[named] >= here[named]).any():
        return None
    length = named.astype(np.int64)
    jump = up.copy()
    while True:
        step = length[jump]
        if not step.any():
            break
        length += step
        jump = jump[jump]
    length += 1
    place = np.concatenate(([0], np.cumsum(length)))
    total = np.add.reduceat(length, first_code) if len(code) else np.zeros(count)
    if (own == 0).any() or (total != size).any():
        return None
    owner = np.repeat(here, length)
    out_at = np.arange(int(place[-1]))
    source = np.where(named[owner], place[up[owner]] + out_at - place[owner], out_at)
    while True:
        nxt = source[source]
        if (nxt == source).all():
            break
        source = nxt
    value = np.zeros(len(out_at), dtype=np.uint8)
    lit = ~named
    value[place[:-1][lit]] = code[lit]
    flat = value[source].tobytes()
    cut = np.concatenate(([0], np.cumsum(size))).tolist()
    return [flat[x:y] for x, y in zip(cut, cut[1:])]


def _lzw_codes(data: bytes) -> list[int]:
    """Greedy codes of up to 3838 bytes of 8-bit samples, between a clear and an end code."""
    table: dict[int, int] = {}
    get, out, free, now = table.get, [256], 258, data[0]
    for b in data[1:]:
        key = now << 8 | b
        code = get(key)
        if code is None:
            out.append(now)
            table[key] = free
            free += 1
            now = b
        else:
            now = code
    out += (now, 257)
    return out


def _pack_codes(codes: list[list[int]]) -> list[bytes]:
    import numpy as np

    count = len(codes)
    n = np.fromiter(map(len, codes), np.int64, count)
    flat = np.fromiter((c for x in codes for c in x), np.int64, int(n.sum()))
    width = np.concatenate(([9], _widths(int(n.max()), 8)))
    at = np.concatenate(([0], np.cumsum(width)))
    size = (at[n] + 7) >> 3
    first = np.concatenate(([0], np.cumsum(size)))
    rep = np.repeat(np.arange(count), n)
    k = np.arange(len(flat)) - np.concatenate(([0], np.cumsum(n)[:-1]))[rep]
    bit = first[rep] * 8 + at[k]
    v, b, m = flat << (bit & 7), bit >> 3, int(first[-1]) + 3
    raw = np.bincount(b, v & 255, m) + np.bincount(b + 1, (v >> 8) & 255, m) + np.bincount(b + 2, v >> 16, m)
    raw = raw.astype(np.uint8).tobytes()
    cut = first.tolist()
    return [raw[a:b] for a, b in zip(cut, cut[1:])]


# ---------------------------------------------------------------- container


#: Red counts up, green down, blue in steps of seven; the other palette has the same colours from its end.
_COLOURS = bytes(x for i in range(256) for x in (i, 255 - i, i * 7 & 255))
_TURNED = bytes(x for i in range(255, -1, -1) for x in (i, 255 - i, i * 7 & 255))
_TURN = bytes(range(255, -1, -1))


def _plan(payload: bytes) -> list[tuple[tuple[int, int, int, int], bytes, int, int | None, bool]]:
    """(box, indexes, disposal, transparent index, own palette) of each frame."""
    import numpy as np

    blocks = np.frombuffer(payload, dtype=np.uint8).reshape(-1, SIDE, SIDE)
    whole, out = (0, 0, SIDE, SIDE), []
    kept = blocks[0]  # what the canvas shows before the frame, in the first three turns
    for n, block in enumerate(blocks):
        turn = n % 4
        if turn == 0:
            out.append((whole, block.tobytes(), 1, None, False))
            kept = block
        elif turn == 3:
            out.append((whole, block.tobytes().translate(_TURN), 1, None, True))
        else:
            differs = block != kept
            if turn == 1:
                raw = block.tobytes()
                free = next((v for v in range(254, -2, -1) if v & 255 not in raw), None)
                if free is None:  # every value occurs: none can be transparent
                    out.append((whole, raw, 3, None, False))
                else:
                    out.append((whole, np.where(differs, block, np.uint8(free & 255)).tobytes(), 3, free & 255, False))
            else:
                ys, xs = np.flatnonzero(differs.any(axis=1)), np.flatnonzero(differs.any(axis=0))
                x, y, right, low = (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(ys) else (0, 0, 1, 1)
                out.append(((x, y, right - x, low - y), block[y:low, x:right].tobytes(), 2, None, False))
    return out


def encode_samples(payload: bytes, delay: int = 4) -> bytes:
    """An animation whose composed frames show the payload (a positive multiple of 576 bytes) in their red channel."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    out = [b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + _COLOURS]
    group = GROUP // 4 * 4
    for at in range(0, len(payload), group * FRAME):
        plan = _plan(payload[at : at + group * FRAME])
        for ((x, y, w, h), _, disposal, clear, own), s in zip(plan, _pack_codes([_lzw_codes(f[1]) for f in plan])):
            out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0) + b"\0\x2c" + struct.pack("<HHHHB", x, y, w, h, 0x87 if own else 0) + (_TURNED if own else b"") + b"\x08")
            out += [bytes([len(s[i : i + 255])]) + s[i : i + 255] for i in range(0, len(s), 255)]
            out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _parse(data: bytes) -> tuple[tuple[int, int], list[dict]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    w, h, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, at = data[at : at + n], at + n
    frames, control = [], (0, 0, None)
    while True:
        kind = data[at]
        if kind == 0x3B:
            return (w, h), frames
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                f, delay, clear = struct.unpack("<BHB", body[:4])
                control = ((f >> 2) & 7, delay, clear if f & 1 else None)
        elif kind == 0x2C:
            x, y, fw, fh, f = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            palette = shared
            if f & 0x80:
                n = 3 << ((f & 7) + 1)
                palette, at = data[at : at + n], at + n
            min_size = data[at]
            body, at = _blocks(data, at + 1)
            frames.append({"box": (x, y, fw, fh), "interlaced": bool(f & 0x40), "palette": palette, "min_size": min_size, "data": body, "disposal": control[0], "delay": control[1], "clear": control[2]})
            control = (0, 0, None)
        else:
            raise ValueError("bad GIF block")


def _samples(frames: list[dict]) -> Iterator[bytes]:
    """Palette indexes of each frame, a group of frames at a time."""
    for i in range(0, len(frames), GROUP):
        some = frames[i : i + GROUP]
        sizes = [f["box"][2] * f["box"][3] for f in some]
        fast = _decode_all([f["data"] for f in some], sizes) if all(f["min_size"] == 8 and n for f, n in zip(some, sizes)) else None
        yield from fast or (lzw_decode(f["data"], f["min_size"], n) for f, n in zip(some, sizes))


def check_streams(data: bytes) -> None:
    """Raises ValueError where any frame's code stream is bad or ends before its last sample."""
    _, frames = _parse(data)
    for f, raw in zip(frames, _samples(frames)):
        if len(raw) < f["box"][2] * f["box"][3]:
            raise ValueError("a code stream that ends early")


def _composed(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[tuple]:
    """(canvas as shown, indexes, frame, start in ms) of each frame."""
    import numpy as np

    (w, h), frames = _parse(data)
    if w * h > most_pixels:
        raise ValueError(f"a canvas of {w} x {h} pixels")
    palettes: dict[bytes, object] = {}
    canvas, clock = np.zeros((h, w), dtype="<u4"), 0  # a pixel: red, green, blue, alpha from the lowest byte up
    for f, raw in zip(frames, _samples(frames)):
        x, y, fw, fh = f["box"]
        if len(raw) < fw * fh:
            raise ValueError("a code stream that ends early")
        index = np.frombuffer(raw, dtype=np.uint8).reshape(fh, fw)
        if f["interlaced"]:
            order = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)]
            rows = np.empty_like(index)
            rows[order] = index
            index = rows
        colours = f["palette"] or bytes(768)
        colour = palettes.get(colours)
        if colour is None:
            rgba = np.full((256, 4), 255, dtype=np.uint8)
            own = np.frombuffer(colours, dtype=np.uint8).reshape(-1, 3)
            rgba[:, :3] = own[np.minimum(np.arange(256), len(own) - 1)]
            colour = palettes[colours] = rgba.view("<u4").ravel()
        before = canvas.copy() if f["disposal"] == 3 else None
        region = canvas[y : y + fh, x : x + fw]
        seen = index[: region.shape[0], : region.shape[1]]
        if f["clear"] is None:
            region[...] = colour[seen]
        else:
            np.copyto(region, colour[seen], where=seen != f["clear"])
        yield canvas.copy(), index, f, clock
        clock += f["delay"] * 10
        if f["disposal"] == 2:
            region[...] = 0
        elif f["disposal"] == 3:
            canvas = before


def decode_gif(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[dict]:
    """Composed frames: ``rgba`` (height, width, 4), ``indexes``, ``delay_ms``, ``start_ms``, ``disposal``, ``transparent``."""
    for canvas, index, f, clock in _composed(data, most_pixels):
        yield {"rgba": canvas.view("u1").reshape(*canvas.shape, 4), "indexes": index, "delay_ms": f["delay"] * 10, "start_ms": clock, "disposal": f["disposal"], "transparent": f["clear"]}


def read_frames(data: bytes) -> tuple[bytes, list[dict]]:
    """Payload (the red channel of all composed frames) and start_ms, delay_ms, disposal and histograms of 8 bins a channel of each frame."""
    import numpy as np

    parts, notes, shown = [], [], _composed(data)
    while some := list(islice(shown, GROUP)):
        shown_now = np.stack([x.ravel() for x, *_ in some]).view(np.uint8).reshape(len(some), -1, 4)
        turn = np.arange(len(some))[:, None] * 8
        bins = [np.bincount((turn + (shown_now[..., c] >> 5)).ravel(), minlength=8 * len(some)).reshape(-1, 8).tolist() for c in range(3)]
        parts.append(shown_now[..., 0].tobytes())
        notes += [{"start_ms": clock, "delay_ms": f["delay"] * 10, "disposal": f["disposal"], **dict(zip(CHANNELS, b))} for (_, _, f, clock), *b in zip(some, *bins)]
    return b"".join(parts), notes


def read_samples(data: bytes) -> tuple[bytes, list[int], int]:
    """Payload, 8-bin histogram of red over all frames, and duration in ms."""
    payload, notes = read_frames(data)
    return payload, [sum(x) for x in zip(*(n["hist_red"] for n in notes))], sum(n["delay_ms"] for n in notes)


# ---------------------------------------------------------------- DataFrames


def gif_frames(media: DataFrame, key: str, column: str, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A row a frame: key, frame, start_ms, delay_ms, disposal, width, height, rgba and histograms of 8 bins a channel.

    A file that is null or broken anywhere, a stream that ends early too, or whose canvas has more than ``most_pixels``,
    gives no frame row and one with its error.  Batches end when their pixels pass ``HELD`` bytes.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = [key, "frame", "start_ms", "delay_ms", "disposal", "width", "height", "rgba", *CHANNELS, "error"]
        hist = pa.list_(pa.int64())
        for b in batches:
            kinds = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), hist, hist, hist, pa.string()]
            told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)  # noqa: E731, B023
            rows, held = [], 0
            for k, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    data = data.as_py()
                    if data is None:
                        raise ValueError("null")
                    check_streams(data)
                    for i, f in enumerate(decode_gif(data, most_pixels)):
                        p = f["rgba"]
                        seen = p[..., 3] > 0
                        rows.append((k, i, f["start_ms"], f["delay_ms"], f["disposal"], p.shape[1], p.shape[0], p.tobytes(), *[np.bincount(p[..., c][seen] >> 5, minlength=8).tolist() for c in range(3)], None))
                        held += p.nbytes
                        if held > HELD:
                            yield told(rows)
                            rows, held = [], 0
                except (ValueError, IndexError, struct.error, MemoryError) as e:
                    rows.append((k, *[None] * 10, str(e)))
            if rows:
                yield told(rows)

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, F.col(column).cast("binary").alias(column)).mapInArrow(run, f"{key} {kind}, frame int, start_ms long, delay_ms long, disposal int, width int, height int, rgba binary, hist_red array<long>, hist_green array<long>, hist_blue array<long>, error string")


def text_media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Texts stored as GIF animations and read back: sizes, hashes of payload and media, features, and timed frames with histograms."""

    def run(batches):
        import pyarrow as pa

        frames = pa.list_(pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int32()), ("disposal", pa.int32()), *((c, pa.list_(pa.int32())) for c in CHANNELS)]))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "frames", *["media"] * keep_media]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), frames, pa.binary()]
        for b in batches:
            for i in range(0, b.num_rows, 200):
                rows = []
                for doc, text in zip(b.column(0).slice(i, 200).to_pylist(), b.column(1).slice(i, 200).to_pylist()):
                    raw = (text or "").encode()
                    media = encode_samples(raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME))
                    payload, notes = read_frames(media)
                    sums = [f"{c[5:]}={','.join(str(sum(x)) for x in zip(*(n[c] for n in notes)))}" for c in CHANNELS]
                    feature = ";".join([f"ms={sum(n['delay_ms'] for n in notes)}", *sums])
                    rows.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(notes), notes, media))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(zip(*rows), kinds, names)], names)

    rows = texts_of(docs)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, frames array<struct<start_ms:long,delay_ms:int,disposal:int,hist_red:array<int>,hist_green:array<int>,hist_blue:array<int>>>" + ", media binary" * keep_media)
