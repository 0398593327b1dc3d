"""Mixing of sources to target weights, by DataFrame operations only.

Each document gets a hash-random key. Keys of a source are dealt to equal ranges of the key space, so that a source
of any size is split; word counts are summed by range, ranges get a running sum, and only inside a range are rows
sorted. A document's place in its source's order is thus known without bringing a source together.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlore.session import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the key that name its range: 4 096 ranges in each source.
RANGE_DIGITS = 3
#: Weights of sources in their order, repeated.
WEIGHTS = (3, 1, 2)


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Target words of each source, from rows of (source, size).

    Sources in code point order, the null source last, get `weights` in turn and share `share` times all words. A target
    stops at `most` times its source's words and the excess goes to the others by weight: every target is the lesser of
    its limit and one common level times its weight. With limits in ascending order of limit / weight the level
    follows from running sums. The table has one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy(F.lit(1))
    ordered = every.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    rising = every.orderBy("ratio", F.col("source").isNull(), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    return (
        by_source.withColumn("weight", weight.cast("double"))
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("words", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("limited", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("words") - F.col("limited")) / F.col("open_weight"))
        # the first source whose ratio reaches its level, and all after it, share that level; later levels are lower
        .withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every))
        .withColumn("target", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))))
        .select("source", "source_size", "target")
    )


def mix_plan(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """What the mix takes of each document: doc_id, tie, size, source_size, target, taken, one row per document.

    A source's budget is its target without the fraction. Whole epochs are taken while they fit; the last one is cut at
    the exact word, so at most one document of a source counts in part. `tie` is the md5 of the text: with doc_id it
    names a row, and rows equal in both are interchangeable.
    Null or empty texts have no words and take nothing. Null sources are one source. A null doc_id hashes as the
    empty text. An empty table gives no rows. Other columns are ignored. Equal keys go by md5 of the text.
    """
    keyed = stage(docs.select(
        "doc_id", "source", word_count("text").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
        F.md5(F.coalesce("text", F.lit(""))).alias("tie"),
    )).withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(keyed.groupBy("source").agg(F.sum("size").alias("size")), weights, share, most)
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("start"))
    bounds = (
        ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select(F.col("r.source").alias("of"), F.col("range").alias("in"), "start", "source_size", "target")
    )
    within = Window.partitionBy("source", "range").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(bounds, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
        .withColumn("budget", F.floor("target"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
        .withColumn("cut", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("partial", F.least("size", F.greatest(F.lit(0), F.col("cut") - F.col("start") - F.col("inside"))))
        .select("doc_id", "source", "tie", "size", "source_size", "target",
                (F.col("epochs") * F.col("size") + F.col("partial")).cast("long").alias("taken"))
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself, with the columns of `docs`: one row per taken copy; a copy taken in part ends at its last taken word.

    `n_chars`, if there, follows the text. Of rows equal in doc_id, source and text one stands for all, with their words.
    """
    plan = mix_plan(docs, **settings).groupBy("doc_id", "source", "tie").agg(
        F.first("size").alias("size"), F.sum("taken").alias("taken")).filter("taken > 0")
    plan = plan.select(F.struct("doc_id", "source", "tie", "size", "taken").alias("_mix_plan"))
    own = docs.withColumn("_mix_tie", F.md5(F.coalesce("text", F.lit(""))))
    same = (
        own["doc_id"].eqNullSafe(F.col("_mix_plan.doc_id")) & own["source"].eqNullSafe(F.col("_mix_plan.source"))
        & (F.col("_mix_tie") == F.col("_mix_plan.tie"))
    )
    copies = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_mix_plan.taken") / F.col("_mix_plan.size")))
    out = own.join(plan, same).dropDuplicates(["doc_id", "source", "_mix_tie"]).withColumn("_mix_copy", F.explode(copies))
    words = F.col("_mix_plan.taken") - (F.col("_mix_copy") - 1) * F.col("_mix_plan.size")
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    text = F.when(words < F.col("_mix_plan.size"), cut).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)
