"""Executors need no copy of the package: the queries run where Python workers can't import it."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys, tempfile
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from tarnlight.llm.queries import queries
spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.driver.memory", "3g").config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-")).getOrCreate()
)


def seen(_):
    try:
        import tarnlight
    except ImportError:
        return [0]
    return [1]


assert sum(spark.sparkContext.range(4, numSlices=4).mapPartitions(seen).collect()) == 0, "the workers see the package"
for name, query in queries().items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("ran", name)
"""


def test_all_queries_without_the_package_on_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", CODE.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-3000:]
    assert got.stdout.count("ran op") == 13
