"""Workers find the package wherever the driver was started."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "4").getOrCreate()
import __spark_entry__ as entry
print("ROWS", entry.queries()["topk_chunks"](spark, "/root/testdata/sf0.001").count())
"""


def test_top_k_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=240)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
    assert int(done.stdout.split("ROWS")[1]) > 0
