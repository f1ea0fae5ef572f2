"""Session settings shared by the tests, the bench and ad-hoc use."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime re-planning does the size-dependent work: it splits skewed join partitions, merges
# small shuffle partitions and only broadcasts a side whose measured size is under the
# threshold. Nothing in the library forces a broadcast.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    # Recording the Python line behind every column expression doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "sellerlens") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the session it provides."""
    partitions = 8 if cores == "*" else max(int(cores), 1)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session without that setting may fall back to a temporary folder: there, driver
    and executors are one process.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sellerlens-"))
        return context.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
