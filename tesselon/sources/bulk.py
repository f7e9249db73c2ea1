"""A sink outside of Spark's own formats, in two phases: tasks stage their rows, the commit publishes all of a write or none.

``df.write.format("tesselon_bulk").option("path", folder).mode("append").save()`` loads rows as a vector or document store
takes them, one JSON object a line.  A task stages its rows under a name of its own, so a task that is run again, or twice at
the same time, changes nothing that counts; its message names the staged file, its rows and their crc32.  The commit moves
the named files into place and writes the list of them last; readers follow that list alone.  An abort removes what was
staged.  ``spark.read.format("tesselon_bulk")`` reads it back, a partition a file, and fails on a file that isn't as listed.

Folders are those that driver and executors share.  Values are JSON's; a null stays null, an empty write is a version without files.
"""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "tesselon_bulk"


def _store(uri: str):
    """(filesystem, path) of a shared folder; a Hadoop spelling of a local path is understood."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def _versions(store, root: str) -> list[str]:
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("version-") and f.base_name.endswith(".json"))


def published(uri: str) -> list[dict]:
    """Files, rows and checksums in force: those of the last version."""
    store, root = _store(uri)
    last = _versions(store, root)[-1:]
    return json.loads(store.open_input_stream(last[0]).read()) if last else []


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int
    crc32: int


class BulkWriter(DataSourceWriter):
    def __init__(self, uri: str, fields: list[str], overwrite: bool):
        self.uri, self.fields, self.overwrite, self.write_id = uri, fields, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        store, root = _store(self.uri)
        store.create_dir(f"{root}/staged-{self.write_id}", recursive=True)
        name, rows, crc = f"{uuid.uuid4().hex}.jsonl", 0, 0
        with store.open_output_stream(f"{root}/staged-{self.write_id}/{name}") as out:
            for row in iterator:
                line = json.dumps({f: row[f] for f in self.fields}, ensure_ascii=False).encode() + b"\n"
                out.write(line)
                rows, crc = rows + 1, zlib.crc32(line, crc)
        return Staged(name, rows, crc)

    def commit(self, messages) -> None:
        store, root = _store(self.uri)
        store.create_dir(root, recursive=True)
        before = _versions(store, root)
        held = [] if self.overwrite or not before else published(self.uri)
        for m in messages:
            if m is not None and m.rows:
                store.move(f"{root}/staged-{self.write_id}/{m.file}", f"{root}/{m.file}")
                held.append({"file": m.file, "rows": m.rows, "crc32": m.crc32})
        done = f"{root}/version-{len(before) + 1:08d}.json"
        with store.open_output_stream(f"{done}.new") as out:
            out.write(json.dumps(held).encode())
        store.move(f"{done}.new", done)
        self._clear(store, root)

    def abort(self, messages) -> None:
        self._clear(*_store(self.uri))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/staged-{self.write_id}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/staged-{self.write_id}")


class BulkReader(DataSourceReader):
    def __init__(self, uri: str, fields: list[str]):
        self.uri, self.fields = uri, fields

    def partitions(self):
        return [InputPartition(f) for f in published(self.uri)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        store, root = _store(self.uri)
        rows = crc = 0
        with store.open_input_stream(f"{root}/{partition.value['file']}") as src:
            rest = b""
            while block := src.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    rows, crc = rows + 1, zlib.crc32(line + b"\n", crc)
                    one = json.loads(line)
                    yield tuple(one.get(f) for f in self.fields)
        if (rows, crc) != (partition.value["rows"], partition.value["crc32"]):
            raise OSError(f"{partition.value['file']} isn't as it was published")


class BulkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give the schema of the rows with .schema()")

    def writer(self, schema, overwrite: bool) -> BulkWriter:
        return BulkWriter(self.options["path"], schema.fieldNames(), overwrite)

    def reader(self, schema) -> BulkReader:
        return BulkReader(self.options["path"], schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BulkSource)
