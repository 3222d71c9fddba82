"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution re-plans joins from measured sizes: a side is broadcast
# only when Spark has checked it against spark.sql.autoBroadcastJoinThreshold.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot user's open sessions are merged inside each task before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "vigilframe") -> SparkSession:
    """Session for tests and the benchmark; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is used only when the setting is absent and the session
    is a single-machine one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="vigilframe-")


def new_table_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder for one written table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Set, Spark drops the shuffles of a statement when it ends; else they stay until the driver happens to collect garbage.
DROPS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle on disk: the written table stands in for it."""
    before = spark.conf.get(DROPS_SHUFFLES, None)
    spark.conf.set(DROPS_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROPS_SHUFFLES)
        else:
            spark.conf.set(DROPS_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once below the shared folder and read back.

    For results several parts of a query need; they outlive a lost executor.
    """
    path = new_table_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written_in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """As :func:`written`, in buckets of ``key``: joins and groupings by it read the rows without a shuffle.

    There are as many buckets as shuffle partitions, so that other rows meet them by one shuffle of their own.
    """
    spark = df.sparkSession
    path, n = new_table_path(spark, name), shuffle_partitions(spark)
    table = f"{name}_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.repartition(n, key).write.bucketBy(n, key).option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table)
