"""Similarity digests of texts: improbable byte windows in chained Bloom filters.

Every window of 64 bytes has an entropy. How often each entropy occurs in the whole corpus gives its rank, the rarest
first. A window that is the rarest among its neighbours often enough is a feature; features go into a chain of filters, each
of a bounded number of features, and two texts are compared by the bits their filters share beyond chance.
"""

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlore.llm.common import buffered, encoded, mix64, shielded, shuffle_partitions, small_batches
from commitlore.session import stage

WINDOW = 64
#: Entropy in thousandths of the most a window can have.
LEVELS = 1001
#: Entropies below this one are those of filling and repeats; they make no feature.
LEAST_LEVEL = 200
#: Times a window must be the rarest of the windows around it.
POPULAR = 16
FILTER_BITS, FEATURE_BITS, MOST_FEATURES = 2048, 5, 160
#: Bytes handled at a time: they stay in the processor's cache.
STRIP = 1 << 15
MOST_CHARS = 2_000_000
#: Bytes of texts whose features are sought at once.
GROUP = 1 << 18
#: c log2 c in fixed point, for counts in a window, and what one more byte of a kind adds to it.
_GAIN = np.array([0, *(int(round(c * np.log2(c) * 65536)) for c in range(1, WINDOW + 1))], np.int32)
_MORE = np.diff(_GAIN)
_MOST = 65536 * WINDOW * int(np.log2(WINDOW))


def window_levels(flat: np.ndarray) -> np.ndarray:
    """The entropy level of the window that starts at each byte; the last 63 bytes have none.

    A window and the next differ by one byte that goes and one that comes, so the sum of c log2 c follows from how often
    each byte occurs among the 63 before it and the 63 after it.
    """
    n = len(flat)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    ahead, behind = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    same = np.empty(STRIP, bool)
    for start in range(0, n, STRIP):
        part = flat[start : start + STRIP + WINDOW - 1]
        size = min(STRIP, n - start)
        for d in range(1, WINDOW):
            m = min(size, len(part) - d)
            if m <= 0:
                break
            eq = np.equal(part[:m], part[d : d + m], out=same[:m]).view(np.uint8)
            ahead[start : start + m] += eq
            behind[start + d : start + d + m] += eq
    steps = np.empty(n - WINDOW + 1, np.int32)
    steps[0] = _GAIN[np.bincount(flat[:WINDOW], minlength=256)].sum()
    np.subtract(_MORE[behind[WINDOW:]], _MORE[ahead[: n - WINDOW]], out=steps[1:])
    total = np.cumsum(steps, dtype=np.int32)
    return ((_MOST - total) * ((LEVELS - 1) / _MOST)).astype(np.int16)


def _groups(raw: list[bytes]):
    """Slices of `raw` of about GROUP bytes, or one longer text."""
    start = size = 0
    for i, text in enumerate(raw):
        if size and size + len(text) > GROUP:
            yield raw[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(raw):
        yield raw[start:]


def _joined(raw: list[bytes]):
    """Texts end to end, where each starts, and for every window whether it lies inside one text."""
    flat = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.array([len(t) for t in raw], np.int64)
    starts = np.cumsum(sizes) - sizes
    inside = np.zeros(max(0, len(flat) - WINDOW + 1), bool)
    for a, n in zip(starts, sizes, strict=True):
        if n >= WINDOW:
            inside[a : a + n - WINDOW + 1] = True
    return flat, starts, sizes, inside


def level_histogram(raw: list[bytes]) -> np.ndarray:
    total = np.zeros(LEVELS, np.int64)
    for part in _groups(raw):
        flat, _, _, inside = _joined(part)
        total += np.bincount(window_levels(flat)[inside], minlength=LEVELS)
    return total


def level_ranks(histogram: np.ndarray) -> np.ndarray:
    """Rank of each entropy level, 1 the rarest in the corpus; levels of equal count go by level, low ones have rank 0."""
    levels = np.arange(LEAST_LEVEL, LEVELS)
    ranks = np.zeros(LEVELS, np.int32)
    ranks[levels[np.lexsort((levels, histogram[LEAST_LEVEL:]))]] = np.arange(1, len(levels) + 1)
    return ranks


def _features(raw: list[bytes], ranks: np.ndarray):
    """Hashes of the features of each text in the order of their places: hash, text. A text under 64 bytes is one feature."""
    flat, starts, sizes, inside = _joined(raw)
    hashes, owners = [], []
    if inside.any():
        n = len(inside)
        rank = np.where(inside, ranks[window_levels(flat)], 0)
        # neighbouring windows of one text only: between two texts there are 63 windows that belong to neither
        # rank above, place below: a group has at most 2^21 windows, a longer text alone takes wider numbers
        kind = np.dtype(np.uint32) if n <= 1 << 21 else np.dtype(np.uint64)
        low = 21 if n <= 1 << 21 else 48
        key = (np.where(rank > 0, rank, LEVELS + 1).astype(kind) << kind.type(low)) | np.arange(n, dtype=kind)
        # the first text, too, stands behind 63 windows of no text, as all others do
        edge = np.full(WINDOW - 1, np.iinfo(kind).max, kind)
        padded = np.concatenate([edge, key, edge])
        width = 1
        while width < WINDOW:
            padded = np.minimum(padded[:-width], padded[width:])
            width *= 2
        popular = np.bincount((padded & kind.type((1 << low) - 1)).astype(np.int64), minlength=n)
        chosen = np.flatnonzero((popular >= POPULAR) & (rank > 0))
        words = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[chosen]
        words = np.ascontiguousarray(words).view("<u8")
        h = np.zeros(len(chosen), np.uint64)
        for j in range(words.shape[1]):
            h = mix64(h * np.uint64(3) + words[:, j])
        hashes.append(h)
        owners.append(np.searchsorted(starts + sizes, chosen, side="right"))
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    if len(short):
        block = np.frombuffer(b"".join(raw[i].ljust(WINDOW, b"\0") for i in short), "<u8").reshape(len(short), -1)
        h = np.full(len(short), 7, np.uint64)
        for j in range(block.shape[1]):
            h = mix64(h * np.uint64(3) + block[:, j])
        hashes.append(h)
        owners.append(short)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return h[order], o[order]


def digests(raw: list[bytes], ranks: np.ndarray) -> list[str]:
    """The fingerprint of each text: base 64 of its filters, one after another; that of an empty text is empty."""
    return [d for part in _groups(raw) for d in _digests(part, ranks)]


def _digests(raw: list[bytes], ranks: np.ndarray) -> list[str]:
    h, owner = _features(raw, ranks)
    counts = np.bincount(owner, minlength=len(raw))
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    filters = -(-counts // MOST_FEATURES)
    first = np.cumsum(filters) - filters
    bits = np.zeros((int(filters.sum()), FILTER_BITS), bool)
    at = first[owner] + place // MOST_FEATURES
    for j in range(FEATURE_BITS):
        bits[at, (h >> np.uint64(11 * j)).astype(np.int64) % FILTER_BITS] = True
    data = np.packbits(bits, axis=1)
    return [base64.b64encode(data[a : a + n].tobytes()).decode() for a, n in zip(first, filters, strict=True)]


def _likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x, y = (np.unpackbits(np.frombuffer(base64.b64decode(t), np.uint8)).reshape(-1, FILTER_BITS).astype(np.float32) for t in (a, b))
    if len(x) > len(y):
        x, y = y, x
    nx, ny = x.sum(1), y.sum(1)
    common, least = x @ y.T, np.minimum(nx[:, None], ny[None, :])
    chance = nx[:, None] * ny[None, :] / FILTER_BITS
    score = np.clip((common - chance) / np.maximum(least - chance, 1e-9), 0, 1)
    # each filter of the shorter chain counts with its best counterpart, by the bits it has
    return float((score.max(1) * nx).sum() / nx.sum())


def likeness(a, b) -> list[float]:
    """Likeness of fingerprints, 0 to 1: bits in common beyond chance, over the most there could be; equal ones have 1.

    Whole chains are compared filter by filter. An empty fingerprint is like no other.
    """
    return [_likeness(x, y) for x, y in zip(a, b, strict=True)]


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of entropy levels by how rare they are in all texts: LEVELS numbers come to the driver."""

    def count(frames):
        import pandas as pd

        total = np.zeros(LEVELS, np.int64)
        for frame in buffered(frames, MOST_CHARS):
            total += level_histogram(encoded(frame["text"]))
        yield pd.DataFrame({"level": np.arange(LEVELS), "n": total})

    found = small_batches(docs.select("text")).mapInPandas(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    histogram = np.zeros(LEVELS, np.int64)
    for r in found.collect():
        histogram[r.level] = r.n
    return level_ranks(histogram)


def fingerprints(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """`docs` with fingerprint, made of the whole text. Without given `ranks` they are measured on `docs`.

    Null and empty texts have an empty fingerprint, texts under 64 bytes are one feature, equal texts have equal
    fingerprints. A column of that name is replaced, others stay; rows are neither merged nor dropped.
    """
    ranks = corpus_ranks(docs) if ranks is None else ranks
    kept = docs.drop("fingerprint")
    outside = list(kept.columns)

    def digest(frames):
        for frame in buffered(frames, MOST_CHARS):
            out = frame[outside]
            out["fingerprint"] = digests(encoded(frame["text"]), ranks)
            yield out

    return shielded(kept, digest, fingerprint="string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (range, place, doc_id, text, tail) in which each range of doc_id holds its texts and, as its tail, the text after it.

    Ranges follow quantiles of doc_id, four to each shuffle partition, so each text is shuffled once; the order is that of descending
    doc_id, null last, then of a hash of the text, and after the last comes the first. `tail` marks rows that belong to the range after.
    """
    wanted = min(2000, 4 * shuffle_partitions(docs.sparkSession))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = F.array(*(F.lit(i / wanted) for i in range(1, wanted)))
    bounds = own.agg(F.percentile_approx("doc_id", shares, 20000)).first()[0] or []
    bounds = sorted(set(bounds), reverse=True)  # `wanted` numbers at most

    def number(ids):
        # ranges of descending ids: how many bounds are above the id; a null comes last of all
        import pandas as pd

        known = np.array([0 if i is None else int(i) for i in ids], np.int64)
        at = np.searchsorted(np.array(bounds[::-1], np.int64), known, side="right")
        return pd.Series(np.where(ids.isna(), len(bounds) + 1, len(bounds) - at))

    number.__annotations__ = {}
    ranged = own.withColumn("range", F.pandas_udf(number, "int")(F.col("doc_id").cast("string"))).withColumn("h", F.xxhash64("text"))
    heads = stage(
        ranged.groupBy("range").agg(F.max(F.struct("doc_id", F.col("h"))).alias("head")).select("range", "head.doc_id", "head.h")
    )  # one row a range
    order = [r["range"] for r in heads.select("range").orderBy("range").collect()]
    before = {r: order[i - 1] for i, r in enumerate(order)}
    if not order:
        return ranged.select("range", "doc_id", "text", "h", F.lit(False).alias("tail"))
    previous = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    marks = F.broadcast(heads.select(F.struct("range", "doc_id", "h").alias("head")))
    same = (F.col("range") == F.col("head.range")) & F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h"))
    tails = ranged.join(marks, same).dropDuplicates(["range"])
    tails = tails.select(previous[F.col("range")].alias("range"), "doc_id", "text", "h", F.lit(True).alias("tail"))
    return ranged.select("range", "doc_id", "text", "h", F.lit(False).alias("tail")).unionByName(tails)


def neighbours(docs: DataFrame, ranks: np.ndarray | None = None, share: int = 3) -> DataFrame:
    """Fingerprints of texts, of their edited forms, and how like they are to the edited form and to the next text.

    The edited form of a text has its last floor(n / `share`) characters replaced by as many first ones of the next text (all, if it
    has fewer), in the order of `with_next`. Rows equal in doc_id and text follow each other in any order, each the other's next. With
    one row alone the next is the row itself. Null texts are empty. Other columns are ignored.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    ranks = corpus_ranks(docs) if ranks is None else ranks
    rows = with_next(docs)
    parts = shuffle_partitions(docs.sparkSession)
    sorted_rows = rows.repartition(parts, "range").sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    sorted_rows = sorted_rows.withColumn("doc_id", F.col("doc_id").cast("string"))  # a frame with a null would hold numbers as floats
    columns = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(frames):
        import pandas as pd

        rest = None
        for frame in buffered(frames, MOST_CHARS):
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            rest = frame.iloc[-1:]
            text, tail = frame["text"].tolist(), frame["tail"].tolist()
            mine = [i for i in range(len(text) - 1) if not tail[i]]
            if not mine:
                continue
            edited = []
            for i in mine:
                n, cut = len(text[i]), len(text[i]) // share
                edited.append(text[i][: n - cut] + text[i + 1][:cut])
            raw = encoded(edited)
            prints = digests(encoded(text), ranks)
            changed = digests(raw, ranks)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].iloc[mine].to_numpy(), "n_chars": [len(text[i]) for i in mine],
                "edited_sha256": [hashlib.sha256(t).hexdigest() for t in raw], "fingerprint": [prints[i] for i in mine],
                "edited_fingerprint": changed, "near_edited": likeness([prints[i] for i in mine], changed),
                "near_next": likeness([prints[i] for i in mine], [prints[i + 1] for i in mine]),
            })

    return small_batches(sorted_rows).mapInPandas(compare, columns).withColumn("doc_id", F.col("doc_id").cast("long"))
