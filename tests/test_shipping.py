"""A session whose workers can't import the package by themselves."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
for _ in range(2):
    print("rows", e.queries()["nearest_distance"](spark, sys.argv[3]).count())
spark.stop()
"""


def test_queries_run_from_another_folder(tmp_path, sf):
    script = tmp_path / "job.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, str(script), str(ROOT), str(tmp_path / "shared"), sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.stdout.count("rows") == 2, run.stderr[-2000:]
