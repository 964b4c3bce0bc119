"""Workers that don't have the package."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {folder!r}).getOrCreate()
from scorelens.cluster import ship
from scorelens.operators.hypothesis import t_test
if {shipped}:
    ship(spark)
rows = spark.createDataFrame([("a", 0.5), ("a", 0.3), ("a", 0.4)], "g string, delta double")
print("p", round(t_test(rows, ["g"]).first()["p_value"], 4))
"""


def run(tmp_path, shipped: bool) -> subprocess.CompletedProcess:
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    code = SCRIPT.format(root=root, folder=str(tmp_path / "shared"), shipped=shipped)
    return subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)


def test_p_values_on_workers_without_the_package(tmp_path):
    assert "No module named 'scorelens'" in run(tmp_path, False).stderr
    assert "p 0.0202" in run(tmp_path, True).stdout
