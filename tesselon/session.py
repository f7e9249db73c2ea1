"""Session factory, shipping of this package to executors, and the folder that all of a cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ARROW_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: set[str] = set()
_HELD: set[str] = set()


def session(app: str = "tesselon", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; ``conf`` entries override."""
    b = SparkSession.builder.appName(app).master(f"local[{cpus}]")
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    return b.config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application.

    Rows hold whole documents: Arrow batches are kept at ARROW_ROWS rows where the session says nothing else; Spark also ends
    them at spark.sql.execution.arrow.maxBytesPerBatch (64 MB where it is unset).
    """
    sc = spark.sparkContext
    if sc.getConf().get(_BATCH) is None and spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(ARROW_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tesselon-"), "tesselon.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process, a temporary one is set.
    All that an application writes there lies in one folder, which goes when the driver's process ends or ``clear`` is called.
    """
    root, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tesselon-")
        spark.conf.set("spark.checkpoint.dir", root)
    held = f"{root.rstrip('/')}/tesselon-{sc.applicationId}"
    if held not in _HELD:
        _HELD.add(held)
        atexit.register(_forget, *_store(spark, held))
    return f"{held}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder; results that aren't read yet are lost with it."""
    mine = [h for h in _HELD if h.endswith(f"/tesselon-{spark.sparkContext.applicationId}")]
    for h in mine:
        remove(spark, h)


def _forget(store, place) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone before
        store.delete(place, True)


def _store(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store, if it is there."""
    store, place = _store(spark, path)
    store.delete(place, True)
