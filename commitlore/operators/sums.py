"""Sums over all rows of what a function makes of a batch: tasks add up their rows, Spark adds up the tasks."""

from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from commitlore.session import discard, stage

#: Most rows and bytes of one block, blocks of one Arrow batch, and groups in which the sums of tasks are added before they meet.
#: A page of a Parquet file is a hundred blocks at least, and a reader holds it as a whole, so blocks are short.
BATCH_ROWS, BLOCK_BYTES, BATCH_BLOCKS, GROUPS = 4096, 1 << 17, 64, 16


def matrix(column) -> np.ndarray:
    return np.asarray(column.tolist(), float)


def block_rows(size: int) -> int:
    """Rows of a block, of so many bytes each."""
    return max(1, min(BATCH_ROWS, BLOCK_BYTES // max(size, 1)))


@contextmanager
def few_blocks(spark: SparkSession):
    """Arrow batches of BATCH_BLOCKS rows: a batch stands in a task's memory as a whole, and a block is hundreds of rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BLOCKS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def blocks(rows: DataFrame):
    """`rows` (x array<double>, maybe y double) as blocks of numbers, written once for the many scans of a fit and deleted after it.

    A block is one row that holds the bytes of BATCH_ROWS rows or BLOCK_BYTES at most: a scan takes them as they are and opens no lists.
    """
    names = [c for c in ("x", "y") if c in rows.columns]

    def made(frames):
        for pdf in frames:
            step = block_rows(8 * len(pdf["x"].iloc[0])) if len(pdf) else BATCH_ROWS
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i : i + step]
                x = matrix(part["x"])
                held = {"n": [len(x)], "x": [x.tobytes()]}
                if "y" in names:
                    held["y"] = [part["y"].to_numpy(float).tobytes()]
                yield pd.DataFrame(held)

    written = stage(rows.select(*names).mapInPandas(made, ", ".join(["n int", *(f"{c} binary" for c in names)])))
    try:
        yield written
    finally:
        discard(written)


def summed(held: DataFrame, length: int, made: Callable) -> np.ndarray:
    """The sum of `made(x, y)`, an array of this length, over all `blocks`, y being None where there is none; zeros for no rows.

    Rows that are no blocks yet are made so for this one scan.
    """
    if "n" not in held.columns:
        with blocks(held) as written:
            return summed(written, length, made)

    def opened(row) -> np.ndarray:
        return made(np.frombuffer(row.x).reshape(row.n, -1), np.frombuffer(row.y) if hasattr(row, "y") else None)

    return totals(held, length, opened)


def totals(held: DataFrame, length: int, made: Callable) -> np.ndarray:
    """The sum of `made(row)`, an array of this length, over all rows of a table of blocks; zeros for no rows.

    A task hands on one array. Where tasks are many their arrays are added in groups, then the groups, so the driver gets one array a scan.
    """
    def partial(frames):
        total, seen = np.zeros(length), False
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                total, seen = total + made(row), True
        if seen:
            yield pd.DataFrame({"total": [total.tobytes()]})

    def added(frames):
        total, seen = np.zeros(length), False
        for pdf in frames:
            for held in pdf["total"]:
                total, seen = total + np.frombuffer(held), True
        if seen:
            yield pd.DataFrame({"total": [total.tobytes()]})

    found = held.mapInPandas(partial, "total binary")
    parts = held.rdd.getNumPartitions()
    if parts > GROUPS:
        found = found.repartition(GROUPS).mapInPandas(added, "total binary")
    if parts > 1:  # GROUPS arrays at most meet in this task
        found = found.repartition(1).mapInPandas(added, "total binary")
    with few_blocks(held.sparkSession):
        return np.sum([np.zeros(length), *(np.frombuffer(r["total"]) for r in found.collect())], axis=0)
