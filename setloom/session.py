"""Session settings and lineage cuts."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Adaptive settings every job in this package relies on: runtime broadcast decisions,
# coalesced shuffles and skew-join splitting also where a further shuffle follows.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the adaptive settings to an existing session."""
    for key, value in ADAPTIVE.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "setloom") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for key, value in ADAPTIVE.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, for clusters where it is installed on the driver only.

    Spark's own file service distributes the archive; tasks then import it like an installed package.
    """
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` by a checkpoint in the folder named by ``spark.checkpoint.dir``.

    Only where the session names none (a local run) is a folder of our own made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def spread(jobs: DataFrame) -> DataFrame:
    """Deal rows that stand for long jobs over as many tasks as a shuffle has; adaptive merging goes by their few bytes."""
    return jobs.repartition(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
