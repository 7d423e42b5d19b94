"""Queries whose tasks run Python, where workers can't import the package: another folder, and no PYTHONPATH."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from outbreak_spark.operators import explain, features, pooled, seir
from outbreak_spark.sources import tables
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
x = tables.from_events(spark, sys.argv[2]).where("region = 'r1'")
ships = tables.from_shipments(spark, sys.argv[2]).where("record_index < 100")
print("rows", seir.fit_seir(x).count())
print("rows", pooled.forecast(ships, trees=1, depth=1)[0].count())
print("rows", explain.shapley_values(features.lag_features(ships.where("region = 'ASIA'")), trees=1).count())
print("rows", entry.queries()["changepoint_runlength"](spark, sys.argv[2]).count())
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_workers_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", RUN, ROOT, DATA], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    counts = [int(line.split()[1]) for line in out.stdout.splitlines() if line.startswith("rows")]
    assert len(counts) == 4 and min(counts) > 0
