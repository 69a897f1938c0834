"""The package on workers started elsewhere, scratch tables, and the checkpoint folder."""

import os
import subprocess
import sys
import time

import pytest

from quiver import session
from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", sys.argv[1]).getOrCreate())
spec = importlib.util.spec_from_file_location("entry_elsewhere", sys.argv[2])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
print("ROWS", entry.queries()["knn_exact"](spark, sys.argv[3]).count())
"""


def test_run_from_another_folder_leaves_nothing_behind(tmp_path):
    shared, elsewhere = tmp_path / "shared", tmp_path / "elsewhere"
    shared.mkdir()
    elsewhere.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB, str(shared), f"{ROOT}/__spark_entry__.py", SF_SMALL],
                          cwd=elsewhere, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 5000" in done.stdout, done.stderr[-2000:]
    for _ in range(60):                       # the JVM ends a little after the driver's Python
        if not list(shared.rglob("*.parquet")):
            break
        time.sleep(0.5)
    assert not list(shared.rglob("*.parquet"))


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.checkpoint_dir(Session())
