"""Activity counts kept current."""

from pyspark.sql import DataFrame, SparkSession, functions as F


def windowed_activity(df: DataFrame, at: str, keys, window: str = "1 day") -> DataFrame:
    """Rows per key and time window; works on tables and on streams."""
    return df.groupBy(F.window(at, window).alias("w"), *keys).agg(F.count("*").alias("commits")).select(
        F.col("w.start").alias("window_start"), *keys, "commits"
    )


def stream_activity(
    stream: DataFrame, path: str, checkpoint: str, at: str, keys, window: str = "1 day", late: str = "7 days",
):
    """Write the counts that changed, batch by batch; `late` is how long a window stays open."""
    counts = windowed_activity(stream.withWatermark(at, late), at, keys, window)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_activity(spark: SparkSession, path: str, keys) -> DataFrame:
    """The latest count of each window."""
    return spark.read.parquet(path).groupBy("window_start", *keys).agg(
        F.max_by("commits", "batch_id").alias("commits")
    )
