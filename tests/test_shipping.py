"""The package reaches tasks that run where it is not installed."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from setloom.operators import gsea
from setloom.session import local_session, ship_code
spark = local_session("2", shuffle_partitions=2, app="elsewhere")
ship_code(spark)
sys.path.remove({root!r})
w = spark.range(60).select(F.lit("S").alias("study_id"), F.col("id").cast("string").alias("feature_id"), (F.col("id") - 30.5).alias("weight"))
s = spark.range(12).select(F.lit("S").alias("study_id"), F.lit("a").alias("set_name"), F.lit(1).alias("set_ord"), (F.col("id") * 5).cast("string").alias("member"))
print("ROWS", gsea.run_enrichment(w, s, 5, 100).count())
"""


def test_enrichment_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", JOB.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True,
                          text=True, timeout=300)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]
