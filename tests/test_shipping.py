"""Workers import the package wherever the driver was started."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from eventlake.operators.ordered import ordered_fold
from eventlake.operators.radius import radius_clusters
df = spark.createDataFrame([(1, [0.1, 0.9]), (2, [0.1, 0.9]), (3, [0.9, 0.0])], "window_id long, vec array<double>")
print("found", sorted((r.window_id, r.cluster_id) for r in radius_clusters(df, 0.1).collect()))
"""


def test_driver_in_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "found [(1, 1), (2, 1), (3, 3)]" in out.stdout, out.stderr[-2000:]
