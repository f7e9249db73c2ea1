"""Token ids in binary files: byte- or bit-plane shuffled blocks with a chunk index.

File format (all integers little-endian)::

    magic "TSPL1\\0\\0\\0"
    chunk*      planes of one block of ids, one zstandard frame a plane
    doc table   zstandard frame: int64 doc_id[n_docs], int64 n_tokens[n_docs]
    chunk index zstandard frame: int64 (offset, n_ids, plane byte length[n_planes])[n_chunks]
    footer      JSON (sizes and kinds), uint32 footer length, magic

A block of ``block`` ids (the last may be shorter) is transposed into planes: plane b
holds byte b (``planes="byte"``) or bit b (``planes="bit"``) of every id.  A plane of
zeros has length 0 and no frame.  Any range of ids needs only the chunks that it meets.

Nulls and empty texts give a document with the end id only; repeated doc_ids keep one
entry a row, ordered by (doc_id, hash of the text, text); a text of any length is encoded
whole and cut into blocks as it is written; columns other than doc_id and text play no
part, whatever their names; an empty table gives no file.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, open_output, replace_file, shared_dir, texts_of
from .tokens import encoder

MAGIC = b"TSPL1\0\0\0"
BLOCK = 65_536
FILE_IDS = 8_000_000


def _planes(ids, kind: str) -> list[bytes]:
    import numpy as np

    raw = np.ascontiguousarray(ids, dtype="<u4").view("u1").reshape(-1, 4)
    if kind == "byte":
        return [raw[:, b].tobytes() if raw[:, b].any() else b"" for b in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, b], bitorder="little").tobytes() if bits[:, b].any() else b"" for b in range(32)]


def _unplanes(planes: list[bytes], n: int, kind: str):
    import numpy as np

    if kind == "byte":
        raw = np.zeros((n, 4), dtype="u1")
        for b, p in enumerate(planes):
            if p:
                raw[:, b] = np.frombuffer(p, dtype="u1")
    else:
        bits = np.zeros((n, 32), dtype="u1")
        for b, p in enumerate(planes):
            if p:
                bits[:, b] = np.unpackbits(np.frombuffer(p, dtype="u1"), count=n, bitorder="little")
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


class PlaneWriter:
    """Writes one file; blocks leave memory as they fill."""

    def __init__(self, out, planes: str = "byte", block: int = BLOCK, level: int = 3):
        import zstandard

        self.out, self.kind, self.block = out, planes, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at = out.write(MAGIC) or len(MAGIC)
        self.at = len(MAGIC)
        self.index: list[int] = []
        self.docs: list[int] = []
        self.sizes: list[int] = []
        self.waiting: list[bytes] = []
        self.n_waiting = 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        import numpy as np

        ids = np.frombuffer(b"".join(self.waiting), dtype="<u4")
        stop = len(ids) if last else len(ids) // self.block * self.block
        for i in range(0, stop, self.block):
            part = ids[i : min(i + self.block, stop)]
            frames = [self.zip.compress(p) if p else b"" for p in _planes(part, self.kind)]
            self.index += [self.at, len(part), *map(len, frames)]
            for f in frames:
                self.out.write(f)
                self.at += len(f)
        self.waiting = [ids[stop:].tobytes()]
        self.n_waiting = len(ids) - stop

    def close(self) -> None:
        import numpy as np

        self._flush(True)
        table = self.zip.compress(np.array([self.docs, self.sizes], dtype="<i8").tobytes())
        index = self.zip.compress(np.array(self.index, dtype="<i8").tobytes())
        footer = json.dumps({"planes": self.kind, "block": self.block, "docs": len(self.docs), "doc_table": [self.at, len(table)], "chunk_index": [self.at + len(table), len(index)]}).encode()
        self.out.write(table + index + footer + struct.pack("<I", len(footer)) + MAGIC)


class PlaneReader:
    """Random access to one file: the footer first, then only the chunks asked for."""

    def __init__(self, source):
        import numpy as np
        import zstandard

        self.source, self.zip = source, zstandard.ZstdDecompressor()
        size = source.size()
        if self._read(0, 8) != MAGIC or self._read(size - 8, 8) != MAGIC:
            raise ValueError("not a plane file")
        (n,) = struct.unpack("<I", self._read(size - 12, 4))
        f = json.loads(self._read(size - 12 - n, n))
        self.kind = f["planes"]
        self.doc_ids, self.sizes = np.frombuffer(self.zip.decompress(self._read(*f["doc_table"])), dtype="<i8").reshape(2, -1)
        width = 2 + (4 if self.kind == "byte" else 32)
        self.index = np.frombuffer(self.zip.decompress(self._read(*f["chunk_index"])), dtype="<i8").reshape(-1, width)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int):
        at, n, *lengths = self.index[k].tolist()
        raw, planes = self._read(at, sum(lengths)), []
        for x in lengths:
            planes.append(self.zip.decompress(raw[:x]) if x else b"")
            raw = raw[x:]
        return _unplanes(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(doc_id, start in the file, n_tokens, ids as bytes), one chunk in memory beside the document."""
        start, k, held, at = 0, 0, b"", 0
        for doc, n in zip(self.doc_ids.tolist(), self.sizes.tolist()):
            parts, need = [held[at : at + 4 * n]], 4 * n - (len(held) - at)
            at += 4 * n
            while need > 0:
                held, k = self.chunk(k).tobytes(), k + 1
                parts.append(held[:need])
                at, need = need, need - len(held)
            yield doc, start, n, b"".join(parts)
            start += n


def write_token_files(docs: DataFrame, tokenizer: str, spaces: bool, end_id: int, out: str, planes: str = "byte", block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) into plane files below ``out``, in ascending doc_id order.

    Returns the manifest (part, seq, file, n_docs, n_tokens), ordered by (part, seq).
    A file is written under a temporary name and then renamed, so that a repeated task
    leaves one whole file of the same content.
    """
    end = struct.pack("<I", end_id)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer, spaces)
        attempt = TaskContext.get().taskAttemptId()
        store, folder = open_output(out)
        rows, now = [], None

        def finish():
            w, f, tmp, name = now
            w.close()
            f.close()
            replace_file(store, tmp, f"{folder}/{name}")
            rows.append((part, len(rows), name, len(w.docs), sum(w.sizes)))

        for b in batches:
            ids = b.column(0).to_pylist()
            for i in range(0, len(ids), 500):
                for doc, raw in zip(ids[i : i + 500], enc.encode_many(b.column(1).slice(i, 500).to_pylist())):
                    if now is None:
                        store.create_dir(folder, recursive=True)
                        name = f"tokens-{part:06d}-{len(rows):05d}.tspl"
                        tmp = f"{folder}/.{name}.{attempt}"
                        f = store.open_output_stream(tmp)
                        now, total = (PlaneWriter(f, planes, block), f, tmp, name), 0
                    now[0].add(doc, raw + end)
                    total += len(raw) // 4 + 1
                    if total >= file_ids:
                        finish()
                        now = None
        if now is not None:
            finish()
        enc.forget()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["part", "seq", "file", "n_docs", "n_tokens"])

    name = F.xxhash64("text")  # range bounds are sampled to the driver: no texts among them
    ordered = texts_of(docs).repartitionByRange("doc_id", name).sortWithinPartitions("doc_id", name, "text")
    return materialise(ordered.mapInArrow(write, "part int, seq int, file string, n_docs long, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame, out: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, file.

    Only the token total of each writing task goes to the driver (a row a task).
    """
    spark = manifest.sparkSession
    base, at, n_files = [], 0, 0
    for r in manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("files")).orderBy("part").collect():
        base.append((r["part"], at))
        at += r["n"]
        n_files += r["files"]
    bases = spark.createDataFrame(base, "part int, base long")
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.join(bases, "part").select("file", (F.col("base") + before).alias("base"))

    def read(batches):
        import pyarrow as pa

        store, folder = open_output(out)
        for b in batches:
            for name, base in zip(*(b.column(i).to_pylist() for i in range(2))):
                with store.open_input_file(f"{folder}/{name}") as f:
                    rows = []
                    for doc, start, n, raw in PlaneReader(f).documents():
                        rows.append((doc, base + start, n, zlib.crc32(raw), name))
                        if len(rows) == 10_000:
                            yield _rows(pa, rows)
                            rows = []
                    if rows:
                        yield _rows(pa, rows)

    def _rows(pa, rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])

    # a stated number of tasks: the manifest is too small for adaptive planning to keep it apart
    return files.repartition(max(1, n_files), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_files(docs: DataFrame, tokenizer: str, spaces: bool, end_id: int, out: str | None = None, **how) -> DataFrame:
    out = out or f"{shared_dir(docs.sparkSession)}-tokens"
    return read_token_files(write_token_files(docs, tokenizer, spaces, end_id, out, **how), out)
