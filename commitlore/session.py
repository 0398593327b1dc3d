"""Session helpers: local sessions, shared scratch space, short-lived caching."""

import gc
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus="*", app="commitlore", shuffle_partitions="8") -> SparkSession:
    """A session for one machine. A cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Only a local session may fall back to its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="commitlore-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: a table in shared storage, which outlives any executor.

    Read back as files, it brings true sizes to the planner and none of the plan behind it.
    """
    path = fresh_path(df.sparkSession, "stage")
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads, such as those of a finished round; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_staged_at", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let go of finished steps: Spark's cleaner deletes the shuffle files of tables that nothing refers to, once the driver collects them."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def reused(df: DataFrame):
    """Cache a table that several passes of one fit read; lost blocks are recomputed."""
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield cached
    finally:
        cached.unpersist()
