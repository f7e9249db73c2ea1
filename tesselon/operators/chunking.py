"""Sliding word windows, section splits, greedy paragraph packing and neighbour flags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate, whitespace_words


def sliding_windows(docs: DataFrame, size: int, step: int, least_tokens: int = 0, keep_short: bool = False) -> DataFrame:
    """doc_id, chunk_index, chunk_id, n_words, text: overlapping windows of words; no shuffle but for the index.

    ``keep_short``: a text of at most ``size`` words stays as it is, white space included.
    """
    words = docs.select("doc_id", "text", whitespace_words(F.col("text")).alias("w"))
    n = F.size("w")
    whole = F.when(F.lit(keep_short) & (n <= size), F.col("text"))
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / step)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("w", i * step + 1, size))
    every = words.where(n > 0).select("doc_id", whole.alias("whole"), F.posexplode(parts).alias("k", "part"))
    text = F.coalesce("whole", F.array_join("part", " "))
    kept = every.select("doc_id", "k", F.size("part").alias("n_words"), text.alias("text")).where(token_estimate(text) >= least_tokens)
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy("k")) - 1).cast("int")
    return kept.withColumn("chunk_index", index).select("doc_id", "chunk_index", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "n_words", "text")


def overlap_flags(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumns({"overlap_prev": F.lag("chunk_index").over(w).isNotNull(), "overlap_next": F.lead("chunk_index").over(w).isNotNull()})


# ---------------------------------------------------------------- sections and paragraphs: one pass over a text, in Arrow batches
#
# A fold over array columns copies its result at each step, so texts with many headers or paragraphs would cost their square.

WHITE = " \t\n\x0b\f\r"
_LINE, _GAP, _WORD = re.compile(r"\r\n|[\n\r]"), re.compile(r"\n\s*\n", re.A), re.compile(rf"[^{WHITE}]+")


def _tokens(text: str) -> int:
    return max(1, len(text) // 4)


def split_sections(text: str, header: re.Pattern, keep_header: bool, default: str, loose: bool = True) -> list[tuple[int, str, int, str]]:
    """(number, section, char_start, text) of each section with a text; a header stands alone on its line, blanks around it if ``loose``.

    The number counts headers; ``char_start`` is where the section's first line begins, a line end counting as one.
    """
    out, number, name, start, at, body = [], 0, default, 0, 0, []

    def close():
        if told := "\n".join(body).strip(WHITE):
            out.append((number, name, start, told))

    for line in _LINE.split(text):
        if header.match(line.strip(WHITE) if loose else line):
            close()
            number, start, body = number + 1, at, [line] if keep_header else []
            name = (line.strip(WHITE).rstrip(":").strip(WHITE) if loose else line.rstrip(f":{WHITE}")).upper()
        else:
            body.append(line)
        at += len(line) + 1
    close()
    return out


def cut_words(text: str, size: int, step: int, keep_short: bool = True) -> list[str]:
    """Overlapping windows of words; with ``keep_short``, a text of up to ``size`` words stays as it is."""
    words = _WORD.findall(text)
    if keep_short and len(words) <= size:
        return [text]
    return [" ".join(words[i * step : i * step + size]) for i in range(max(0, -(-(len(words) - size) // step)) + 1)]


def pack(text: str, max_tokens: int, size: int, step: int, evaluation: bool) -> list[str]:
    """The chunks of ``pack_paragraphs``."""
    paragraphs = [p for p in (x.strip(WHITE) for x in _GAP.split(text)) if p]
    if len(paragraphs) == 1 and not evaluation:
        return cut_words(text.strip(WHITE), size, step)
    done, now, n = [], [], 0
    for p in paragraphs:
        tokens = _tokens(p)
        if tokens > max_tokens:
            done += ["\n\n".join(now)] * bool(now) + cut_words(p, size, step, not evaluation)
            now, n = [], 0
        elif now and n + tokens > max_tokens:
            done.append("\n\n".join(now))
            now = [now[-1], p]
            n = _tokens(now[0]) + tokens if evaluation else _tokens("\n\n".join(now))
        else:
            now.append(p)
            n += tokens
    return done + ["\n\n".join(now)] * bool(now)


def _header(headers: str) -> re.Pattern:
    return re.compile(rf"(?:{headers})[:\s]*\Z", re.I | re.A)


def sections(docs: DataFrame, headers: str, keep_header: bool = True, default: str = "PREAMBLE") -> DataFrame:
    """doc_id, section_no, section, text: a header stands alone on its line; no shuffle."""
    header = _header(headers)
    cut = F.udf(lambda x: [(n, name, told) for n, name, _, told in split_sections(x, header, keep_header, default, False)] if x else [], "array<struct<section_no:int,section:string,text:string>>", useArrow=True)
    return docs.select("doc_id", F.inline(cut(F.col("text").cast("string"))))


def section_list(text: Column, headers: str, keep_header: bool, default: str) -> Column:
    """array<struct(section, char_start, text)> of a text; the whole text as DOCUMENT if there is none, null for null."""
    header = _header(headers)

    def cut(x):
        return None if x is None else [s[1:] for s in split_sections(x, header, keep_header, default)] or [("DOCUMENT", 0, x)]

    return F.udf(cut, "array<struct<section:string,char_start:int,text:string>>", useArrow=True)(text)


def pack_paragraphs(text: Column, max_tokens: int, size: int = 1600, step: int = 1400, evaluation: bool = False) -> Column:
    """Paragraphs packed greedily up to max_tokens; a new chunk begins with the last paragraph of the one before.

    A paragraph over max_tokens goes in windows of ``size`` words, and so does a single one; the chunk after it has no
    overlap.  A chunk's size is the estimate of its joined text when it begins with an overlap.  The ``evaluation``
    variant has no rule for single paragraphs, cuts white space in windows always, and sums estimates.
    """
    return F.udf(lambda x: None if x is None else pack(x, max_tokens, size, step, evaluation), "array<string>", useArrow=True)(text)


#: Characters of text in one batch of chunks, as far as whole documents allow.
BATCH_CHARS = 1 << 20


def _chunked(docs: DataFrame, cut, columns: dict[str, str]) -> DataFrame:
    """doc_id, chunk_index, n and ``columns`` (Spark types by name, the text last): the rows that ``cut`` makes of a text, n of them; no shuffle.

    One text at a time is held as Python text, with up to BATCH_CHARS of chunks.
    """

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}

        def batch(keys, at, rows):
            cells = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), pa.int32(), *(kinds[k] for k in columns.values())])]
            return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *cells], ["doc_id", "chunk_index", "n", *columns])

        for b in batches:
            at, rows, size = [], [], 0
            for i, text in enumerate(b.column(1)):
                found = cut(text.as_py())
                at += [i] * len(found)
                rows += [(k, len(found), *x) for k, x in enumerate(found)]
                size += sum(len(x[-1]) for x in found)
                if size > BATCH_CHARS:
                    yield batch(b.column(0), at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield batch(b.column(0), at, rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join(f"{c} {k}" for c, k in columns.items())
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, chunk_index int, n int, {schema}")


def chunk_documents(docs: DataFrame, headers: str, max_tokens: int = 800, size: int = 1600, step: int = 1400, least_tokens: int = 20) -> DataFrame:
    """doc_id, chunk_index, section, n_tokens, text, overlap_prev, overlap_next: sections, packed paragraphs, windows, minimum size.

    Blank and null texts give no chunk.
    """
    header = _header(headers)

    def cut(x):
        if not x or not x.strip(WHITE):
            return []
        found = split_sections(x, header, True, "PREAMBLE") or [(0, "DOCUMENT", 0, x)]
        return [(name, _tokens(p), p) for _, name, _, told in found for p in pack(told, max_tokens, size, step, False) if _tokens(p) >= least_tokens]

    out = _chunked(docs, cut, {"section": "string", "n_tokens": "int", "text": "string"})
    return out.withColumns({"overlap_prev": F.col("chunk_index") > 0, "overlap_next": F.col("chunk_index") < F.col("n") - 1}).drop("n")


def chunk_for_evaluation(docs: DataFrame, headers: str, max_tokens: int = 600, size: int = 300, step: int = 250, least_tokens: int = 15, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index, section, char_start, n_tokens, text, overlap_prev: each piece after the last words of the one before in its section."""
    header = _header(headers)

    def cut(x):
        out = []
        for _, name, start, told in (split_sections(x, header, False, "HEADER") or [(0, "DOCUMENT", 0, x)]) if x is not None else ():
            before = None
            for p in pack(told, max_tokens, size, step, True):
                if _tokens(p) < least_tokens:
                    before = p
                    continue
                full = " ".join(_WORD.findall(before)[-overlap:]) + "\n" + p if before else p
                out.append((name, start, _tokens(full), before is not None, full.strip(WHITE)))
                before = full
        return out

    out = _chunked(docs, cut, {"section": "string", "char_start": "int", "n_tokens": "int", "overlap_prev": "boolean", "text": "string"})
    return out.select("doc_id", "chunk_index", "section", "char_start", "n_tokens", "text", "overlap_prev")


def whole_lists(lines: DataFrame, key: str, order: str, line: str, most: int) -> DataFrame:
    """key, chunk_index, entries, text: the lines of a key in one chunk if they have at most ``most`` characters, else cut every ``most`` between lines."""
    size = F.length(line) + 1
    before = F.sum(size).over(Window.partitionBy(key).orderBy(order)) - size
    placed = lines.withColumn("chunk_index", F.floor(before / most).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))), lambda x: x["l"]), "\n")
    return placed.groupBy(key, "chunk_index").agg(F.count("*").alias("entries"), text.alias("text"))
