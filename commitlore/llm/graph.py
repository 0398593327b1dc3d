"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlore.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of undirected `edges` (a, b); the component is its smallest node.

    Large stars and small stars in turn: each node hands its larger, then its smaller neighbours to the least of them, until
    nothing moves, in a number of rounds that grows with the logarithm of the longest path. Each round is written to
    the shared folder. Neighbours are never gathered: a hub costs one row per neighbour.
    """

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            both = df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("low"))
            joined = both.join(least, "a").withColumn("low", F.least("a", "low")).filter("b > a")
            return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # here a > b always: every neighbour of a and a itself go to the least
        least = df.groupBy("a").agg(F.min("b").alias("low"))
        joined = df.join(least, "a")
        return joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b"))).distinct()

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = digest(now)
    while before[0]:
        now = stage(star(star(now, True), False))
        after = digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
