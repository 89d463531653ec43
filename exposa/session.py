"""Spark session and job settings.

Settings that matter at scale live here so every entry point (tests, bench, driver) gets the
same plan shape: AQE on (coalesces small shuffles, splits skewed join partitions), a UTC session
time zone, and a checkpoint folder taken from the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "exposa") -> SparkSession:
    """Create (or reuse) a session with the engine's defaults.

    On a cluster the master, resources and the number of shuffle partitions come from spark-submit;
    ``master`` is only used for local runs and tests, where 8 partitions are enough.
    """
    builder = SparkSession.builder.appName(app_name)
    local = bool(master and master.startswith("local"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions or local:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if local:
        builder = builder.config("spark.driver.memory", os.environ.get("EXPOSA_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_job_settings(spark)
    return spark


def apply_job_settings(spark: SparkSession) -> None:
    """Session settings every job relies on; safe to call on a session someone else built."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage and hold intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``. Where it is unset, a local master gets a fresh folder
    under the local temp area, registered on the context; a cluster raises, since executors would not
    see each other's machine-local files.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="exposa-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def _tables_dir(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/exposa-tables"


def drop_tables(spark: SparkSession) -> None:
    """Delete every intermediate table of this application. Results that were built from them must
    have been written before."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables_dir(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df):
    """Write ``df`` as a Parquet table under the checkpoint folder and continue from it.

    Used where a derived table is reused by several later steps and as a planning barrier: later
    filters are not inlined into the expressions that produced these columns, so plans stay small
    however many URL stages precede them. The table is computed once (an RDD checkpoint would run
    the plan a second time to write it), read back with column pruning, and lives on the shared
    checkpoint storage, so a lost executor costs at most the step after the last table.
    ``drop_tables`` deletes them.
    """
    return df.sparkSession.read.parquet(_written(df))


def _written(df, *by: str) -> str:
    path = f"{_tables_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    return path


#: Folders of a table by buckets.
BUCKETS = 32


def bucket_of(key):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class Buckets:
    """A table written in folders by bucket of a key, of which a reader takes those its keys are in."""

    def __init__(self, df, key: str):
        df = df.withColumn("bucket", bucket_of(key))
        # a bucket may be many files, a file holds few buckets; the folders are listed once
        path = _written(df.repartitionByRange("bucket", key), "bucket")
        self.table = df.sparkSession.read.schema(df.schema).parquet(path)

    def read(self, buckets: list[int] | None = None):
        """All rows, or those of some buckets."""
        df = self.table if buckets is None else self.table.where(F.col("bucket").isin(buckets))
        return df.drop("bucket")
