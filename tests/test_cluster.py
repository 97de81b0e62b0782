"""Tasks run where only Spark and its Python packages are installed."""

import os
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from tickloom.operators import positions
from tickloom.plans import Series
from tickloom.sources import readers
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.conf.set("spark.tickloom.rowsPerBlock", "10")
df = spark.range(50).select(F.lit("a").alias("product"), F.col("id").alias("t"))
out = positions.clamped_position(df, Series.of("product", "t"), F.lit(1), F.lit(20))
assert [r.position for r in out.orderBy("t").collect()] == [min(i, 20) for i in range(1, 51)]
assert readers.scan_quotes(spark, {folder!r}).count() == 1
print("fine")
"""


def test_workers_do_not_import_the_package(tmp_path):
    (tmp_path / "q.csv").write_text("timestamp,symbol,side,price,quantity\n1,X,BID,1,1\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=str(ROOT), folder=str(tmp_path))
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in run.stdout, run.stderr[-2000:]
