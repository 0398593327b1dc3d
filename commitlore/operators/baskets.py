"""Commits as baskets of files: co-change pairs, frequent sets and association rules."""

from pyspark.sql import DataFrame, Window as W, functions as F

from commitlore.functions.text import visible_name
from commitlore.session import discard, stage

# Default thresholds of the mining and sizes of its reports.
MIN_FILE_COUNT = 2
MAX_FILES = 100
MIN_SUPPORT = 0.01
FALLBACK_SUPPORT = 0.005
MIN_LIFT = 1.0
TOP_RULES = 50
STRONG_RULES = 10
TOP_PAIRS = 20
COOCCURRENCE_FILES = 20
COOCCURRENCE_PARTNERS = 5

# Orders rules whose lifts differ only by rounding noise by name.
LIFT_DIGITS = 9


def visible_files(file_changes: DataFrame, column: str = "path") -> DataFrame:
    """(hash, pos, file) with base names, hidden and blank files left out."""
    named = file_changes.select("hash", "pos", visible_name(column).alias("file"))
    return named.filter(F.col("file").isNotNull())


def distinct_files(file_changes: DataFrame, column: str = "path") -> DataFrame:
    return visible_files(file_changes, column).select("file").distinct()


def min_frequency_files(files: DataFrame, min_count: int = MIN_FILE_COUNT, weight: str | None = None) -> DataFrame:
    """(file, mentions) of files named often enough; nothing if fewer than two are.

    A file named twice in one commit counts twice, by its two rows or in column `weight`.
    """
    mentions = F.sum(weight) if weight else F.count("*")
    kept = files.groupBy("file").agg(mentions.alias("mentions")).filter(F.col("mentions") >= min_count)
    return kept.filter(kept.agg(F.count("*")).scalar() >= 2)


def top_files_cap(frequent: DataFrame, max_files: int | None = MAX_FILES) -> DataFrame:
    """The most mentioned files; a tie goes to the smaller name."""
    if max_files is None:
        return frequent
    return frequent.orderBy(F.desc("mentions"), "file").limit(max_files)


def basket_membership(files: DataFrame, kept: DataFrame) -> DataFrame:
    """(hash, file) of the kept files, once per commit."""
    return _of_files(files, kept).select("hash", "file").distinct()


def _of_files(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """Mentions of the given files. Their list is written first: with its true size known,
    the planner broadcasts a short one and a file named in every commit stays spread out."""
    return mentions.join(stage(files.select("file")), "file", "left_semi")


def file_memberships(
    file_changes: DataFrame, min_count: int = MIN_FILE_COUNT, max_files: int | None = MAX_FILES, column: str = "path",
) -> DataFrame:
    """(hash, file) after cleaning, the frequency threshold and the cap."""
    named = visible_files(file_changes, column).groupBy("hash", "file").agg(F.count("*").alias("n"))
    listed = stage(named)  # read for the frequencies and for the baskets
    kept = top_files_cap(min_frequency_files(listed, min_count, "n"), max_files)
    return _of_files(listed, kept).select("hash", "file")


def _counted_sets(memberships: DataFrame, min_support: float, total: int) -> DataFrame:
    """(items, n): baskets of the files whose own support reaches the threshold, equal ones as one.

    No larger set can hold another file. Their number is at most the mean basket size
    over the threshold, whatever the number of commits, so a basket is bounded too.
    """
    counts = memberships.groupBy("file").agg(F.count("*").alias("n"))
    held = _of_files(memberships, counts.filter(F.col("n") >= F.lit(min_support) * total))
    lists = held.groupBy("hash").agg(F.sort_array(F.collect_list("file")).alias("items"))
    return lists.groupBy("items").agg(F.count("*").alias("n"))


def file_baskets(
    file_changes: DataFrame, min_count: int = MIN_FILE_COUNT, max_files: int | None = MAX_FILES, column: str = "path",
) -> DataFrame:
    """(hash, files): the kept files of each commit that has any. At most `max_files` per basket."""
    members = file_memberships(file_changes, min_count, max_files, column)
    return members.groupBy("hash").agg(F.sort_array(F.collect_list("file")).alias("files"))


def numeric_cells_as_items(commits: DataFrame, column: str = "modified_files") -> DataFrame:
    """File mentions of exports that hold the number of files in place of the list."""
    return commits.filter(F.col(column).rlike(r"^\d+$")).select(
        "hash", F.lit(0).cast("long").alias("pos"), F.col(column).alias("path")
    )


# --- frequent sets -------------------------------------------------------------


def frequent_itemsets(
    memberships: DataFrame, min_support: float = MIN_SUPPORT, fallback_support: float | None = FALLBACK_SUPPORT,
) -> DataFrame:
    """(items, size, freq, support) of all file sets with enough support.

    `items` is sorted. When no set reaches `min_support`, `fallback_support` is tried.
    """
    thresholds = [t for t in (min_support, fallback_support) if t is not None]
    total = memberships.select("hash").distinct().count()
    if total and thresholds:
        sets = stage(_counted_sets(memberships, min(thresholds), total))
        for threshold in thresholds:
            found = _grown(sets, total, threshold)
            if found is not None:
                return found
    return memberships.sparkSession.createDataFrame([], "items array<string>, size int, freq long, support double")


def _grown(sets: DataFrame, total: int, min_support: float) -> DataFrame | None:
    """Pattern growth over counted sets (items, n). Support is counted over all `total` commits, also those without a set; None if no set has enough.

    Each frequent set carries the counted rests of the baskets that hold it: their files after its last one. Counting a file in
    these rests gives the sets with one file more. Equal rests of a set are one row, so rows depend on how many kinds of baskets there
    are, not on the commits.
    """
    # a little below, so that rounding of the product cannot raise the needed count
    needed = max(min_support * total - 1e-6, 1.0)
    rests, levels = sets.select(F.array().cast("array<string>").alias("held"), F.col("items").alias("rest"), "n"), []
    while True:
        opened = rests.select("held", "rest", "n", F.posexplode("rest").alias("at", "file"))
        kept = stage(opened.groupBy("held", "file").agg(F.sum("n").alias("freq")).filter(F.col("freq") >= needed))
        if kept.isEmpty():
            break
        longer = F.concat("held", F.array("file"))
        levels.append(kept.select(longer.alias("items"), "freq"))
        further = opened.join(kept.select("held", "file"), ["held", "file"]).select(
            longer.alias("held"), F.slice("rest", F.col("at") + 2, F.greatest(F.size("rest"), F.lit(1))).alias("rest"), "n")
        following = stage(further.filter(F.size("rest") > 0).groupBy("held", "rest").agg(F.sum("n").alias("n")))
        if len(levels) > 1:
            discard(rests)
        rests = following
    if not levels:
        return None
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.select("items", F.size("items").alias("size"), "freq", (F.col("freq") / F.lit(total)).alias("support"))


def itemset_statistics(itemsets: DataFrame) -> DataFrame:
    return itemsets.agg(
        F.count("*").alias("total_itemsets"), F.avg("support").alias("avg_support"), F.max("support").alias("max_support")
    )


def itemset_sizes(itemsets: DataFrame) -> DataFrame:
    return itemsets.groupBy("size").agg(F.count("*").alias("itemsets"))


# --- rules ---------------------------------------------------------------------


def _key(items):
    return F.concat_ws("\x01", items)


#: Splits of a set that are made from one row: two to the power of this.
MASK_BITS = 12


def rule_support_lookup(itemsets: DataFrame) -> DataFrame:
    """Every split of every set into two parts, with the support of the set and of both parts. A set holds 62 items at most."""
    supports = itemsets.select(_key("items").alias("_key"), F.col("support").alias("_support"))
    # blocks of masks are dealt over tasks before they are opened: a long set is many blocks, and no array is longer than theirs
    blocks = itemsets.filter("size >= 2").select(
        "items", "support", "size", F.expr(f"explode(sequence(0L, shiftleft(1L, greatest(size - {MASK_BITS}, 0)) - 1L)) AS high")
    )
    splits = blocks.repartition("items", "high").select(
        "items", "support", "size", "high", F.expr(f"explode(sequence(0L, shiftleft(1L, least(size, {MASK_BITS})) - 1L)) AS low")
    ).withColumn("mask", F.col("low") + F.shiftleft("high", MASK_BITS)).filter("mask > 0 and mask < shiftleft(1L, size) - 1L")
    # bit i of the mask puts item i among the antecedents
    sides = splits.select(
        "support",
        F.expr("filter(items, (x, i) -> shiftright(mask, i) % 2 = 1)").alias("antecedents"),
        F.expr("filter(items, (x, i) -> shiftright(mask, i) % 2 = 0)").alias("consequents"),
    )
    for side in ["antecedent", "consequent"]:
        found = supports.select(F.col("_key").alias(f"_{side}"), F.col("_support").alias(f"{side}_support"))
        sides = sides.join(found, _key(f"{side}s") == F.col(f"_{side}")).drop(f"_{side}")
    return sides


def association_rules(itemsets: DataFrame, min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules with support, confidence, lift, leverage and conviction."""
    both, a, c = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    confidence = both / a
    return rule_support_lookup(itemsets).select(
        "antecedents", "consequents", "antecedent_support", "consequent_support", "support",
        confidence.alias("confidence"),
        (confidence / c).alias("lift"),
        (both - a * c).alias("leverage"),
        F.when(confidence < 1, (1 - c) / (1 - confidence)).otherwise(F.lit(float("inf"))).alias("conviction"),
    ).filter(F.round("lift", LIFT_DIGITS) >= min_lift)


def top_rules(rules: DataFrame, limit: int = TOP_RULES) -> DataFrame:
    return rules.orderBy(
        F.desc(F.round("lift", LIFT_DIGITS)), _key("antecedents"), _key("consequents")
    ).limit(limit)


def strong_rules(rules: DataFrame) -> DataFrame:
    return top_rules(rules, STRONG_RULES)


def rule_statistics(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count("*").alias("total_rules"), F.avg("confidence").alias("avg_confidence"), F.avg("lift").alias("avg_lift"),
        F.avg("support").alias("avg_support"), F.max("lift").alias("max_lift"), F.min("lift").alias("min_lift"),
    )


# --- file statistics -----------------------------------------------------------


def file_frequencies(memberships: DataFrame, limit: int | None = None) -> DataFrame:
    """(file, commits, rate) of each kept file."""
    total = memberships.agg(F.count_distinct("hash")).scalar()
    found = memberships.groupBy("file").agg(F.count("*").alias("commits")).select(
        "file", "commits", (F.col("commits") / total).alias("rate")
    )
    return found.orderBy(F.desc("commits"), "file").limit(limit) if limit else found


def basket_totals(memberships: DataFrame) -> DataFrame:
    return memberships.agg(
        F.count_distinct("file").alias("total_files"), F.count_distinct("hash").alias("total_commits")
    )


def cooccurrence_with_top(
    baskets: DataFrame, files: int = COOCCURRENCE_FILES, partners: int = COOCCURRENCE_PARTNERS,
) -> DataFrame:
    """For the most frequent files the partners most often in the same commit.

    Works on capped baskets, so a basket gives at most files x cap rows, which are
    summed before they are shuffled.
    """
    kinds = baskets.groupBy("files").agg(F.count("*").alias("n"))
    frequent = (
        kinds.select(F.explode("files").alias("file"), "n").groupBy("file").agg(F.sum("n").alias("modifications"))
        .filter("modifications > 1").orderBy(F.desc("modifications"), "file").limit(files)
    )
    total = baskets.agg(F.count("*")).scalar()
    with_top = kinds.select("files", "n", F.explode("files").alias("file")).join(F.broadcast(frequent), "file")
    pairs = (
        with_top.select("file", "modifications", "n", F.explode("files").alias("partner"))
        .filter(F.col("file") != F.col("partner"))
        .groupBy("file", "modifications", "partner").agg(F.sum("n").alias("commits"))
    )
    w = W.partitionBy("file").orderBy(F.desc("commits"), "partner")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= partners).select(
        "file", "modifications", (F.col("modifications") / total).alias("rate"), "partner", "commits", "rank"
    )


# --- co-change pairs -----------------------------------------------------------

# Files in a block of a commit: two blocks, or one with itself, make their pairs in one row.
BLOCK_FILES = 256


def _counted_baskets(mentions: DataFrame) -> DataFrame:
    """(kind, n, files, block, blocks): equal lists of (hash, pos, file) reduced to one, `kind`, with their number n, in blocks.

    Lists are equal if their files and places have equal sums of two hashes of 64 bits, so no list is gathered to
    compare it; the one of the smallest hash stands for all. A block is a sorted array of BLOCK_FILES names at most.
    """
    placed = mentions.withColumn("place", F.row_number().over(W.partitionBy("hash").orderBy("pos", "file")) - 1)
    digest = [F.sum(F.xxhash64("place", "file", F.lit(i)).cast("decimal(20,0)")).alias(f"digest{i}") for i in (1, 2)]
    lists = placed.groupBy("hash").agg(F.count("*").alias("size"), *digest)
    kinds = lists.groupBy("size", "digest1", "digest2").agg(F.min("hash").alias("hash"), F.count("*").alias("n"))
    blocks = F.ceil(F.col("size") / BLOCK_FILES).cast("int")
    held = placed.join(kinds.filter("size > 1").select("hash", "n", blocks.alias("blocks")), "hash")
    return held.groupBy(F.col("hash").alias("kind"), "n", "blocks", F.floor(F.col("place") / BLOCK_FILES).cast("int").alias("block")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "file"))), lambda x: x["file"]).alias("files"))


def _pairs_of(kinds: DataFrame, ordered: bool) -> DataFrame:
    """Pair counts of baskets in blocks: the earlier file first, or the smaller name first.

    A short basket makes its pairs where it stands. Of a longer one every two blocks make a row of their own, and these are
    dealt over tasks before any pair is made, so one commit of many files is many tasks' work.
    """
    short = kinds.filter("blocks = 1").select("n", F.col("files").alias("heads"), F.col("files").alias("tails"), F.lit(True).alias("same"))
    long = stage(kinds.filter("blocks > 1"))
    left = long.select("kind", "n", F.col("block").alias("i"), F.col("files").alias("heads"))
    right = long.select(F.col("kind").alias("_kind"), F.col("block").alias("j"), F.col("files").alias("tails"))
    met = left.join(right, (F.col("kind") == F.col("_kind")) & (F.col("i") <= F.col("j"))).repartition("kind", "i", "j")
    blocks = short.unionByName(met.select("n", "heads", "tails", (F.col("i") == F.col("j")).alias("same")))
    inside = F.expr(
        f"flatten(transform(heads, (a, k) -> transform(if(same, slice(tails, k + 2, {BLOCK_FILES}), tails), b -> struct(a, b))))"
    )
    pairs = blocks.select("n", F.explode(inside).alias("p")).select(
        "n", F.col("p.a").alias("file_a"), F.col("p.b").alias("file_b")
    )
    if not ordered:
        pairs = pairs.select("n", F.least("file_a", "file_b").alias("file_a"), F.greatest("file_a", "file_b").alias("file_b"))
    return pairs.groupBy("file_a", "file_b").agg(F.sum("n").alias("commits"))


def _first_mentions(files: DataFrame) -> DataFrame:
    return files.groupBy("hash", "file").agg(F.min("pos").alias("pos"))


def co_change_pairs(files: DataFrame, min_support: float | None = None, ordered: bool = True) -> DataFrame:
    """(file_a, file_b, commits) of all pairs changed together, or of those in enough commits.

    `file_a` is named first in the commit. Equal lists are counted before their pairs are made. With `min_support`,
    commits are first cut down to files that reach it alone, as a pair cannot be more frequent than its files; that
    bounds a commit's list by the mean list length over `min_support`.
    """
    if min_support is None:
        return _pairs_of(stage(_counted_baskets(stage(_first_mentions(files)))), ordered)
    mentions = stage(_first_mentions(files))
    total = mentions.agg(F.count_distinct("hash")).scalar()
    needed = F.lit(min_support) * total
    frequent = mentions.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") >= needed)
    kinds = stage(_counted_baskets(_of_files(mentions, frequent)))
    return _pairs_of(kinds, ordered).filter(F.col("commits") >= needed)


def leading_kinds(files: DataFrame, limit: int = TOP_PAIRS, ordered: bool = True, seeds: int = 64) -> DataFrame:
    """Counted lists of the files that can be in one of the `limit` pairs changed together most often.

    Pairs among the few most frequent files come first. The count of the last one
    reported is a lower bound, and only files with that many commits can be in a pair
    that beats it; all others are left out before any pair is made. If all of these are among the first few, their lists
    are there already. What serves ordered pairs serves unordered ones, whose counts are no smaller.
    """
    mentions = stage(_first_mentions(files))
    counts = stage(mentions.groupBy("file").agg(F.count("*").alias("n")))
    for tried in (seeds, 16 * seeds):
        best = counts.orderBy(F.desc("n"), "file").limit(tried).select("file")
        kinds = stage(_counted_baskets(mentions.join(F.broadcast(best), "file", "left_semi")))
        leading = _pairs_of(kinds, ordered).orderBy(F.desc("commits")).limit(limit)
        row = leading.agg(F.min("commits").alias("c"), F.count("*").alias("k")).first()
        bound = row["c"] if row["k"] == limit else 1
        if counts.filter(F.col("n") >= bound).count() <= tried:
            return kinds
        if bound > 1:
            break
    return stage(_counted_baskets(_of_files(mentions, counts.filter(F.col("n") >= bound))))


def top_pairs_of(kinds: DataFrame, limit: int = TOP_PAIRS, ordered: bool = True) -> DataFrame:
    """The pairs changed together most often, of `leading_kinds`."""
    return _pairs_of(kinds, ordered).orderBy(F.desc("commits"), "file_a", "file_b").limit(limit)


def top_pairs(files: DataFrame, limit: int = TOP_PAIRS, ordered: bool = True, seeds: int = 64) -> DataFrame:
    """The pairs changed together most often."""
    return top_pairs_of(leading_kinds(files, limit, ordered, seeds), limit, ordered)
