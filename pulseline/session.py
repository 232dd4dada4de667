"""Session settings the operators rely on."""

import os
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    # Local-time expressions assume epoch seconds rendered in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings; cluster sizing stays with the caller."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", app: str = "pulseline", **conf: str) -> SparkSession:
    """A local session for tests and the bench; ``conf`` holds extra settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cores if cores.isdigit() else "8",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        "spark.sql.codegen.cache.maxEntries": "2000",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="pulseline-")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for written tables under the cluster's shared checkpoint folder.

    Only a local master may fall back to a temporary folder: on a cluster the
    executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or (
        spark.sparkContext.getCheckpointDir() or ""
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_root()
    return f"{root.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the work folder and read it back.

    For a result that is used more than once: the second use reads the small table instead of
    repeating the scan and shuffle, and a lost executor costs no recomputation.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
