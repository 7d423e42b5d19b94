"""The queries where Python workers can't import the package: another folder, and no PYTHONPATH."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"
RUN = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config(map={"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
for name in sys.argv[3:]:
    print("rows", name, entry.queries()[name](spark, sys.argv[2]).count())
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_workers_need_no_package(tmp_path):
    names = ["op1_language_id", "op3_cover_tree_top_k", "op4_log_bilinear_lm", "op12_tag_path_ratios"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", RUN, ROOT, DATA, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    assert [line.split()[1] for line in out.stdout.splitlines() if line.startswith("rows")] == names
