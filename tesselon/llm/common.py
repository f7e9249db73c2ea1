"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that the cluster names in ``spark.checkpoint.dir``; only on one machine a temporary one is set where there is none."""
    return shared_folder(spark)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that lost executors cost a reread, not a recomputation,
    and freezes row order and partition numbers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows that have a doc_id; other columns play no part."""
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def open_output(uri: str):
    """(filesystem, path) for a shared folder, usable on executors; Hadoop spellings of a scheme are understood."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon:
        uri = "file://" + os.path.abspath(uri)
    elif scheme == "file":
        uri = "file:///" + rest.lstrip("/")
    elif scheme in ("s3a", "s3n"):
        uri = "s3:" + rest
    return fs.FileSystem.from_uri(uri)


def replace_file(store, source: str, target: str) -> None:
    """Renames; some stores don't rename onto the file that an earlier attempt left."""
    try:
        store.move(source, target)
    except OSError:
        store.delete_file(target)
        store.move(source, target)


def free_names(wanted: int, taken: list[str], stem: str = "held") -> list[str]:
    """Column names that clash with none of ``taken`` in any case."""
    low = {t.lower() for t in taken}
    while any(f"{stem}_{i}" in low for i in range(wanted)):
        stem += "_"
    return [f"{stem}_{i}" for i in range(wanted)]


def tidy() -> None:
    """Gives memory that a task of this Python worker no longer uses back to the system; idle workers would keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
