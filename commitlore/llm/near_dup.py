"""Near-duplicate texts: DartMinHash signatures of five-word shingles, banded, then exact similarities.

Each shingle owns a strip as wide as its weight. Darts fall on strips as a Poisson process in hashed order, the same for
every text that has the shingle; a text keeps, for each of its coordinates, the earliest dart inside its strips. Texts
agree in a coordinate with the probability of their weighted Jaccard similarity. Work is in proportion to shingles plus darts.
"""

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlore.llm.common import buffered, encoded, mix64, ragged, small_batches, word_hashes
from commitlore.llm.graph import components
from commitlore.session import stage

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 7
#: Characters of text that a task holds at a time.
MOST_CHARS = 4_000_000
#: Bits of a shingle's hash inside a text.
BITS = 40
#: Words of 64 bits that mark the shingles of a text; pivots of a bucket in the first round, and in any round.
BIT_WORDS, LEAST_PIVOTS, MOST_PIVOTS = 8, 8, 2048


def shingles(raw: list[bytes], size: int = SHINGLE):
    """Distinct shingles of each text, sorted, laid end to end: hash, count, owner; and a key of each whole word sequence.

    Words part at ASCII white space, A-Z count as lower case. A text of fewer words is one shingle, one without words has none.
    """
    words: list[bytes] = []
    lengths = np.zeros(len(raw), np.int64)
    for i, text in enumerate(raw):
        found = text.lower().split()
        words += found
        lengths[i] = len(found)
    h = word_hashes(words)
    owner, place = ragged(lengths)
    # the whole sequence: a sum over places, which does not hang on the other texts
    salt = mix64(place.astype(np.uint64) + np.uint64(1))
    keys = np.zeros(len(raw), np.uint64)
    full = lengths > 0
    starts = (np.cumsum(lengths) - lengths)[full]
    if len(starts):
        keys[full] = np.add.reduceat(mix64(h ^ salt), starts)
    keys = mix64(keys + lengths.astype(np.uint64))
    acc = np.zeros(len(h), np.uint64)
    for j in range(size):
        ahead = np.zeros(len(h), np.uint64)
        ahead[: max(0, len(h) - j)] = h[j:]
        inside = place + j < lengths[owner]
        acc = np.where(inside, mix64(acc * np.uint64(3) + ahead), acc)
    first = (place + size <= lengths[owner]) | ((place == 0) & (lengths[owner] < size))
    code = (owner[first].astype(np.uint64) << np.uint64(BITS)) | (acc[first] >> np.uint64(64 - BITS))
    distinct, count = np.unique(code, return_counts=True)
    return distinct & np.uint64((1 << BITS) - 1), count, (distinct >> np.uint64(BITS)).astype(np.int64), keys


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, texts: int, k: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (texts, k) of weighted sets given as (element hash, weight, owner); rows of empty sets are 0.

    A strip of width w is ceil(w) cells of width 1; a cell's darts come in order of rank as a Poisson process of rate 1, each
    at a place across the cell, and those beyond the strip's edge miss. About k ln k + 2 k darts hit a text's strips
    before the first limit of rank; a text with a coordinate left empty gets twice the limit.
    """
    out = np.zeros((texts, k), np.uint64)
    total = np.bincount(owner, weight, texts)
    limit = (k * math.log(k) + 2 * k) / np.maximum(total, 1e-12)
    open_texts = total > 0
    cells = np.ceil(weight).astype(np.int64)
    of, level = ragged(cells)
    base = mix64(element[of] * np.uint64(0x9E3779B97F4A7C15) + level.astype(np.uint64) + np.uint64(1))
    edge, holder = weight[of] - level, owner[of]
    while open_texts.any():
        live = np.flatnonzero(open_texts[holder])
        rank = np.zeros(len(live))
        best = np.full(texts * k, np.inf)
        throws = []
        seed = base[live]
        while len(live):
            seed = mix64(seed + np.uint64(0x632BE59BD9B4E019))
            rank = rank - np.log(_uniform(seed))
            near = rank < limit[holder[live]]
            live, rank, seed = live[near], rank[near], seed[near]
            dart = mix64(seed ^ np.uint64(0xA0761D6478BD642F))
            inside = _uniform(dart) < edge[live]
            at = holder[live] * k + (mix64(dart) % np.uint64(k)).astype(np.int64)
            at, hit, name = at[inside], rank[inside], dart[inside]
            np.minimum.at(best, at, hit)
            throws.append((at, hit, name))
        flat = out.reshape(-1)
        for at, hit, name in throws:
            won = hit == best[at]
            flat[at[won]] = name[won]
        empty = np.isinf(best.reshape(texts, k)).any(1)
        open_texts = open_texts & empty
        limit = np.where(open_texts, 2 * limit, limit)
        out[open_texts] = 0
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signatures.reshape(len(signatures), bands, -1)
    key = np.zeros(rows.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for r in range(rows.shape[2]):
        key = mix64(key * np.uint64(3) + rows[:, :, r])
    return key


def _deltas(sorted_values: np.ndarray) -> bytes:
    import zstandard

    steps = np.diff(sorted_values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8]
    return zstandard.ZstdCompressor(level=1).compress(steps.T.tobytes())


def _values(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(BITS // 8, -1)
    wide = np.zeros((raw.shape[1], 8), np.uint8)
    wide[:, : BITS // 8] = raw.T
    return np.cumsum(wide.view("<u8").reshape(-1), dtype=np.uint64)


SIGNED = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("tie", T.LongType()), T.StructField("row", T.LongType()), T.StructField("node", T.LongType()),
                       T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, tie and row (hashes of the text, of doc_id and text), node (a hash of the whole word sequence), band keys and number of shingles of each text."""

    def sign(frames):
        import pandas as pd

        for frame in buffered(frames, MOST_CHARS):
            element, _, owner, keys = shingles(encoded(frame["text"]))
            n = len(frame)
            # each distinct shingle once, as links count them: repeats inside a text must not part it from a like one
            bands = band_keys(dart_signatures(element, np.ones(len(element)), owner, n)).astype(np.int64)
            sizes = np.bincount(owner, minlength=n)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "tie": frame["tie"], "row": frame["row"], "node": keys.astype(np.int64),
                "bands": [b if size else None for b, size in zip(bands, sizes, strict=True)], "size": sizes,
            })

    # ids pass as text: a frame with a null would hold numbers as floats
    rows = docs.select(F.col("doc_id").cast("long").cast("string"), _tie().alias("tie"), _row().alias("row"), "text")
    return small_batches(rows).mapInPandas(sign, SIGNED).withColumn("doc_id", F.col("doc_id").cast("long"))


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, size and packed distinct shingles of the texts in `chosen` (node, row), one row a node."""

    def pack(frames):
        import pandas as pd

        for frame in buffered(frames, MOST_CHARS):
            element, _, owner, _ = shingles(encoded(frame["text"]))
            ends = np.cumsum(np.bincount(owner, minlength=len(frame)))
            parts = np.split(element, ends[:-1]) if len(frame) else []
            yield pd.DataFrame({"node": frame["node"], "size": [len(p) for p in parts], "shingles": [_deltas(p) for p in parts]})

    rows = docs.select(_row().alias("row"), "text").join(chosen, "row").select("node", "text")
    return small_batches(rows).mapInPandas(pack, "node long, size long, shingles binary").dropDuplicates(["node"])


def _tie():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _row():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b), those whose exact Jaccard similarity of distinct shingles is at least `least`."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))

    def compare(frames):
        for frame in frames:
            kept = []
            for x, y in zip(frame["of_a"], frame["of_b"], strict=True):
                x, y = _values(x), _values(y)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                kept.append(common >= least * (len(both) - common) - 1e-9)
            yield frame.loc[kept, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").mapInPandas(compare, "a long, b long")


def _divided(live: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (bucket, node) with their component, of buckets that hold more than one."""
    named = live.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return named.join(ends.filter("low < high").select("bucket"), "bucket")


def _by_rare_shingles(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Rows (bucket, node, size, shared, bits) of `nodes`, where texts of the least similarity or more share a bucket: an exact filter.

    Such a pair shares `least` of the shingles of each. In any one order of all shingles, the first 1 - `least` of both
    therefore have one in common, which is the bucket; with the rarest first, buckets are small. Shingles of one text
    alone come first and make no bucket; `shared` counts the others, and `bits` marks the places their hashes fall on. Linear in shingles.
    """

    def spread(frames):
        import pandas as pd

        for frame in frames:
            parts = [_values(x) for x in frame["shingles"]]
            lengths = [len(p) for p in parts]
            owners = np.repeat(frame["node"].to_numpy(np.int64), lengths)
            yield pd.DataFrame({"node": owners, "size": np.repeat(lengths, lengths), "bucket": np.concatenate(parts).astype(np.int64) if parts else owners})

    held = small_batches(sets.join(nodes, "node", "left_semi").select("node", "shingles"))
    single = held.mapInPandas(spread, "node long, size long, bucket long")
    counts = single.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    own = Window.partitionBy("node")
    ranked = single.join(counts, "bucket").withColumn("place", F.row_number().over(own.orderBy("n", "bucket"))).withColumn("shared", F.count("*").over(own))
    at, word = F.pmod("bucket", F.lit(64)).cast("int"), F.pmod(F.shiftright("bucket", 6), F.lit(BIT_WORDS))
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), at)
    ranked = ranked.withColumn("bits", F.array(*(F.bit_or(F.when(word == i, mark).otherwise(F.lit(0).cast("long"))).over(own) for i in range(BIT_WORDS))))
    first = F.col("size") - F.ceil(F.col("size") * F.lit(least) - F.lit(1e-6)) + 1
    return ranked.filter(F.col("place") + F.col("size") - F.col("shared") <= first).select("bucket", "node", "size", "shared", "bits")


def _can_link(x: str, y: str, least: float):
    """Whether rows `x` and `y` can be of the least similarity: an exact bound on what they share, from sizes and bits.

    Each place that only one of them marks holds a shingle of it that the other lacks.
    """
    needed = (F.col(f"{x}.size") + F.col(f"{y}.size")) * F.lit(least / (1 + least)) - F.lit(1e-6)

    def most(a, b):
        lacking = (F.bit_count(F.col(f"{a}.bits")[i].bitwiseAND(F.bitwise_not(F.col(f"{b}.bits")[i]))) for i in range(BIT_WORDS))
        return F.col(f"{a}.shared") - sum(lacking, F.lit(0))

    return (F.least(f"{x}.size", f"{y}.size") >= needed) & (most(x, y) >= needed) & (most(y, x) >= needed)


def links(docs: DataFrame, signatures: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between different word sequences that join near-duplicates, and their components.

    Members of a bucket are not compared with each other but with pivots: first each text with the smallest pivot of a fitting size it meets.
    Texts in buckets that still hold several components are dealt anew, by their rare shingles, into buckets that lose no
    pair. There, members outside a bucket's largest component become pivots in turn and leave the bucket once compared. A bucket
    is done when it lies in one component: every pair of it has then been compared, excluded, or joined through others.
    """
    single = signatures.filter("bands is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.first("size").alias("size"), F.min("row").alias("row"))
    banded = single.select("node", "size", "row", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("pivot")).filter("n > 1")
    met = stage(banded.join(shared, "bucket").select("bucket", "node", "size", "row", F.col("pivot.node").alias("pivot"), F.col("pivot.size").alias("pivot_size")))
    sets = stage(_sets(docs, met.select("node", "row").distinct()))
    fitting = F.least("size", "pivot_size") >= F.greatest("size", "pivot_size") * F.lit(least) - F.lit(1e-6)
    pairs = met.filter("node <> pivot").filter(fitting).groupBy(F.col("node").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b")
    found = stage(_similar(pairs, sets, least))
    labels = stage(components(found))
    open_nodes = _divided(met.select("bucket", "node"), labels).select("node").distinct()
    live, parts = stage(_by_rare_shingles(open_nodes, sets, least)), LEAST_PIVOTS
    while True:
        live = stage(_divided(live.select("bucket", "node", "size", "shared", "bits"), labels))
        if live.isEmpty():
            return found, labels
        sizes = live.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
        others = live.join(largest, "bucket").filter("component <> largest")
        row = F.struct("component", "size", "shared", "bits")
        pivots = stage(others.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part")).agg(F.min("node").alias("pivot"), F.min_by(row, "node").alias("of")))
        parts = min(16 * parts, MOST_PIVOTS)
        x, y = live.alias("x"), pivots.select(F.col("bucket").alias("in"), "pivot", "of")
        differ = (F.col("x.bucket") == F.col("in")) & (F.col("x.component") != F.col("of.component"))
        near = x.join(y, differ & _can_link("x", "of", least)).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        new = stage(_similar(near.distinct(), sets, least))
        if not new.isEmpty():
            found = found.unionByName(new)
            labels = stage(components(found))
        live = live.join(pivots.select("bucket", F.col("pivot").alias("node")), ["bucket", "node"], "left_anti")


def _classed(docs: DataFrame, least: float) -> DataFrame:
    own = stage(signed(docs))
    found, labels = links(docs, own, least)
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    nodes = labels.join(degree, "node", "left")
    placed = own.select("doc_id", "tie", "node").join(nodes, "node", "left")
    return placed.withColumn("component", F.coalesce("component", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id (smallest doc_id of its class), class_size, n_links of its word sequence.

    Texts of equal word sequence are one class, texts without words too; classes are joined by links of exact Jaccard
    similarity >= `least` over distinct five-word shingles. Null texts are empty. Repeated rows are copies. Other
    columns are ignored. A class whose doc_ids are all null has a null class_id. Candidates come from DartMinHash
    bands, which hold a pair of similarity 0.8 with probability 0.9998 and a more alike one with more; copies cost one row
    each, not pairs.
    """
    placed = _classed(docs, least)
    classes = placed.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(classes, "component").select("doc_id", "class_id", "class_size", "n_links")


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class, with the columns of `docs`: the smallest doc_id (null last), then the smallest hash of the text."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    keep = _classed(docs, least).groupBy("component").agg(best.alias("_nd_row")).select("_nd_row")
    own = docs.withColumn("_nd_tie", _tie())
    same = (F.col("_nd_tie") == F.col("_nd_row.tie")) & own["doc_id"].cast("long").eqNullSafe(F.col("_nd_row.doc_id"))
    return own.join(keep, same).dropDuplicates(["doc_id", "_nd_tie"]).select(*docs.columns)
