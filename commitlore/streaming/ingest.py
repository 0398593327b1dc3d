"""Adding new commits to a table, in batches or as they arrive."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F, types as T

from commitlore.session import reused

SMALL_BATCH = 1_000_000


def new_commits(incoming: DataFrame, existing: DataFrame | None, small: int = SMALL_BATCH) -> DataFrame:
    """Incoming commits whose hash the table lacks, each once: of rows that differ the one whose contents hash least, whatever their order.

    A small batch is broadcast to find the hashes the table has, so the table is read
    in one column and not shuffled. A large one is an ordinary anti-join.
    """
    whole = F.struct(*incoming.columns)
    incoming = incoming.groupBy(F.col("hash").alias("_hash")).agg(F.min_by(whole, F.struct(F.xxhash64(whole), F.to_json(whole))).alias("_row")).select("_row.*")
    if existing is None:
        return incoming
    known = existing.select("hash")
    hashes = incoming.select("hash")
    if hashes.limit(small + 1).count() <= small:
        known = known.join(F.broadcast(hashes), "hash", "left_semi").distinct()
    return incoming.join(known, "hash", "left_anti")


def _table_or_none(spark, path, schema):
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ingest_new_commits(incoming: DataFrame, path: str) -> int:
    """Append what a Parquet table lacks; returns the number of rows added."""
    existing = _table_or_none(incoming.sparkSession, path, incoming.schema)
    with reused(new_commits(incoming, existing)) as fresh:
        added = fresh.count()
        if added:
            fresh.write.mode("append").parquet(path)
    return added


def stream_ingest_commits(stream: DataFrame, path: str, checkpoint: str):
    """Run the stream over what is there now and append the new commits.

    A batch writes its own partition and replaces it when it is run again after a
    failure; that partition is left out of the look-up, so a retry gives the same rows.
    """
    with_batch = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = _table_or_none(spark, path, with_batch)
        earlier = stored.filter(F.col("batch_id") != batch_id) if stored is not None else None
        with reused(batch) as rows:
            new_commits(rows, earlier).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_ingest_recent(stream: DataFrame, path: str, checkpoint: str, arrival: str, delay: str = "2 days"):
    """The same by the stream's own state, for sources that repeat a commit within `delay` only."""
    return (
        stream.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(["hash"])
        .writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
