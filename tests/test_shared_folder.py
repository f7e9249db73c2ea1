"""What an application writes to the shared folder goes with it."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from tesselon import session

CODE = """
import sys
sys.path.insert(0, {root!r})
from tesselon.session import session, shared_folder
spark = session("ends", 1, **{{"spark.checkpoint.dir": "file://{shared}"}})
spark.range(3).write.parquet(shared_folder(spark) + "-a")
print("rows", spark.read.parquet(f"file://{shared}/*/*").count())
spark.stop()
"""


def test_the_folder_goes_when_the_driver_ends(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root, shared=tmp_path)], capture_output=True, text=True, timeout=240)
    assert "rows 3" in out.stdout, out.stderr[-2000:]
    assert not [x for x in os.listdir(tmp_path) if x.startswith("tesselon-")]  # Spark makes a folder of its own there


def test_only_one_process_gets_a_temporary_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        session.shared_folder(Session())
