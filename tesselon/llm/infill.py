"""Fill-in-middle transformation: one numpy kernel for all rows of an Arrow batch.

The UTF-8 buffer of a batch is read once.  A lookup table gives each byte its class (line feed, space, continuation of a
character, other); a boundary mask over adjacent bytes marks where a unit begins (a line: the byte before is a line feed;
a word with the spaces after it: a space before, none here; a character: no continuation); its cumulative sum, reset at
each document's first byte, numbers the units; searchsorted in it finds the byte of every cut of every row at once.  Cuts
are then offsets into the same buffer, so prefix, middle and suffix are one Arrow array of three slices a row, and joining
them with the sentinels is one call.  ``restore`` undoes the transformation from output and form by built-in expressions.

Which units are cut, and in which form, follows from the sha256 of ``seed:doc_id`` alone: the same row gives the same
output whatever its partition or attempt.  Batches are worked in runs of ``SLICE_BYTES``, longer only for a single longer text.

A null text is empty; an empty text, or one that holds a sentinel, stays plain.  A null doc_id is hashed as an empty
string.  Repeated rows give equal rows, an empty table none.  ``transform`` keeps the columns of docs and puts its own
behind them; a column of docs with such a name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE_BYTES = 4 << 20
OTHER, FEED, SPACE, CONTINUATION = range(4)
UNITS = ("lines", "words", "characters")


def byte_classes():
    import numpy as np

    table = np.zeros(256, np.uint8)
    table[[9, 11, 12, 13, 32]] = SPACE
    table[10] = FEED
    table[0x80:0xC0] = CONTINUATION
    return table


def unit_starts(classes, first, unit: str):
    """Mask of the bytes where a unit begins; ``first`` are the first bytes of documents that aren't empty."""
    import numpy as np

    before, mask = classes[:-1], np.zeros(len(classes), bool)
    if unit == "lines":
        mask[1:] = before == FEED
    elif unit == "words":
        spaces = (classes == SPACE) | (classes == FEED)
        mask[1:] = spaces[:-1] & ~spaces[1:]
    else:
        mask[1:] = classes[1:] != CONTINUATION
    mask[first] = True
    return mask


def whole_texts(texts):
    """An Arrow string array without nulls, its bytes as numpy and where each text begins (one more at the end)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return texts, flat, edges - edges[0]


def slices(batch, column: int, most: int = SLICE_BYTES):
    """Runs of rows of a batch with at most so many bytes in the column; a longer text alone."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to


def cut_batch(texts, hashes, rate: int, spm: int, unit: str):
    """(units, form, prefix characters, middle characters, output) as Arrow arrays, for texts and four hash columns a row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts, flat, edges = whole_texts(texts)
    classes = byte_classes()[flat]
    size = np.diff(edges)
    full = np.flatnonzero(size > 0)
    number = np.concatenate(([0], np.cumsum(unit_starts(classes, edges[:-1][full], unit)))) if len(flat) else np.zeros(1, np.int64)
    begun = number[edges[:-1]]  # units of earlier documents
    units = number[edges[1:]] - begun
    a, b = hashes[0] % (units + 1), hashes[1] % (units + 1)
    cuts = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)
    # the byte that begins unit k (counted from 0) is the first with more than begun + k units up to it
    found = np.searchsorted(number[1:], begun[:, None] + cuts, side="right")
    found = np.where(cuts == units[:, None], edges[1:, None], found)
    chars = np.concatenate(([0], np.cumsum(classes != CONTINUATION)))
    at = np.concatenate([edges[:-1, None], found], axis=1)
    held = np.zeros(len(size), bool)
    for s in (PREFIX, SUFFIX, MIDDLE):
        held |= pc.match_substring(texts, s.encode()).to_numpy(zero_copy_only=False)
    plain = (size == 0) | held | (hashes[2] % 100 >= rate)
    form = np.where(plain, "plain", np.where(hashes[3] % 100 < spm, "spm", "psm"))
    pieces = pa.Array.from_buffers(pa.large_binary(), 3 * len(size), [None, pa.py_buffer(np.append(at.ravel(), edges[-1]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
    prefix, middle, suffix = (pieces.take(pa.array(np.arange(k, 3 * len(size), 3))) for k in range(3))
    p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in (PREFIX, SUFFIX, MIDDLE))
    end = pa.scalar(b"", pa.large_binary())
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, end)
    output = pc.if_else(pa.array(form == "psm"), psm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, end))
    output = pc.if_else(pa.array(plain), texts, output).cast(pa.large_string()).cast(pa.string())
    counted = [pa.array(chars[at[:, k + 1]] - chars[at[:, k]], pa.int64(), mask=plain) for k in range(2)]
    return pa.array(units, pa.int64()), pa.array(form, pa.string()), *counted, output


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "lines") -> DataFrame:
    """docs with n (units), form, prefix_chars, middle_chars and output; rate and spm are percentages."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    own = ("n", "form", "prefix_chars", "middle_chars", "output")
    kept = [c for c in docs.columns if c not in own]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    names = free_names(4, kept)
    hashed = docs.select(*[f"`{c}`" for c in kept], *[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(c) for i, c in enumerate(names)])
    text = kept.index("text")
    schema = hashed.drop(*names).schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for b in slices(whole, text):
                hashes = [c.to_numpy() for c in b.columns[len(kept) :]]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *cut_batch(b.column(text), hashes, rate, spm, unit)], schema.names)

    return hashed.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form; no sentinel occurs in a transformed text."""
    piece = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(piece[1], piece[3], piece[2])).when(form == "spm", F.concat(piece[2], piece[3], piece[1])).otherwise(output)
