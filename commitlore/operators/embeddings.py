"""Word vectors from a factorisation of the table of words that stand near each other.

The table of co-occurrences stays distributed; the driver holds square matrices of the number of components only. Words are never
gathered, hashed into buckets or left out, so one form serves any vocabulary.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from commitlore.functions.text import tokenize_message
from commitlore.session import discard, stage

#: Components beyond the wanted ones, and multiplications by the table.
OVERSAMPLE, ROUNDS = 10, 6
#: Most word vectors that go to every task.
SMALL_VOCABULARY = 50_000


def _one_way(df: DataFrame, column: str, window: int) -> DataFrame:
    """(a, b, n): how often two words, a <= b, stand at most `window` words apart; two equal words count from both ends."""
    tokens = df.select(tokenize_message(column).alias("t")).filter(F.size("t") > 1)
    apart = tokens.select("t", F.explode(F.sequence(F.lit(1), F.least(F.lit(window), F.size("t") - 1))).alias("d"))
    pairs = apart.select(F.explode(F.arrays_zip(F.expr("slice(t, 1, size(t) - d)").alias("a"), F.expr("slice(t, d + 1, size(t) - d)").alias("b"))).alias("p"))
    met = pairs.groupBy(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).agg(F.count("*").alias("n"))
    return met.select("a", "b", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")).alias("n"))


def _both_ways(half: DataFrame, *columns: str) -> DataFrame:
    """(word, context, ...) of a symmetric table (a, b, ...) with a <= b: each row and its mirror image; no shuffle."""
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("context")), F.struct(F.col("b").alias("word"), F.col("a").alias("context")))
    ways = F.when(F.col("a") == F.col("b"), F.slice(ways, 1, 1)).otherwise(ways)
    return half.select(F.explode(ways).alias("p"), *columns).select("p.*", *columns)


def cooccurrences(df: DataFrame, column: str, window: int) -> DataFrame:
    """(word, context, n): how often two words stand at most `window` words apart, both ways round. Null texts have no words.

    Each pair is counted in one direction and mirrored where it stands, so it is shuffled once."""
    return _both_ways(_one_way(df, column, window), "n")


def _information(n, total, context_total, whole):
    return F.log(n.cast("double") * float(whole) / (total.cast("double") * context_total))


def information_weights(counts: DataFrame) -> DataFrame:
    """(word, context, value): positive pointwise mutual information; pairs no more frequent than by chance have no row."""
    sums = stage(counts.groupBy("word").agg(F.sum("n").alias("total")))
    whole = sums.agg(F.sum("total")).first()[0] or 0
    of_context = sums.select(F.col("word").alias("context"), F.col("total").alias("context_total"))
    value = _information(F.col("n"), F.col("total"), F.col("context_total"), whole)
    return counts.join(sums, "word").join(of_context, "context").select("word", "context", value.alias("value")).filter("value > 0")


def weighted_cooccurrences(df: DataFrame, column: str, window: int) -> DataFrame:
    """(word, context, n, value): `cooccurrences` with their `information_weights`, null where these have no row.

    Each pair of words goes through the joins in one direction only; totals of words are summed on the map side first."""
    half = stage(_one_way(df, column, window))
    sums = stage(_both_ways(half, "n").groupBy("word").agg(F.sum("n").alias("total")))
    whole = sums.agg(F.sum("total")).first()[0] or 0
    first, second = (sums.select(F.col("word").alias(c), F.col("total").alias(f"total_{c}")) for c in ("a", "b"))
    value = _information(F.col("n"), F.col("total_a"), F.col("total_b"), whole)
    told = half.join(first, "a").join(second, "b").select("a", "b", "n", F.when(value > 0, value).alias("value"))
    return _both_ways(told, "n", "value")


def _products(df: DataFrame, left: str, right: str, size: int) -> np.ndarray:
    """Sum over all rows of the outer product of two array columns: summed in each task, then over tasks; size² numbers come back."""

    def summed(frames):
        import pandas as pd

        total = np.zeros((size, size))
        for frame in frames:
            if len(frame):
                total += np.stack(frame["l"].to_numpy()).T @ np.stack(frame["r"].to_numpy())
        yield pd.DataFrame({"k": np.arange(size * size), "v": total.ravel()})

    parts = df.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInPandas(summed, "k long, v double")
    out = np.zeros(size * size)
    for k, v in parts.groupBy("k").agg(F.sum("v")).collect():
        out[k] = v
    return out.reshape(size, size)


def _mapped(df: DataFrame, matrix: np.ndarray, **columns: str) -> DataFrame:
    """`word` and, for each new=old, the old array column times the matrix."""

    def times(frames):
        import pandas as pd

        for frame in frames:
            made = {new: list(np.stack(frame[old].to_numpy()) @ matrix) if len(frame) else [] for new, old in columns.items()}
            yield pd.DataFrame({"word": frame["word"], **made})

    return df.mapInPandas(times, ", ".join(["word string", *(f"{new} array<double>" for new in columns)]))


def _multiplied(weights: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """(word, y): the table times the vectors. Sums are made on the map side first, so a frequent word is no hot key."""
    joined = weights.join(vectors.select(F.col("word").alias("context"), "q"), "context")
    sums = [F.sum(F.col("value") * F.get("q", F.lit(i))).alias(f"s{i}") for i in range(size)]
    return joined.groupBy("word").agg(*sums).select("word", F.array(*(f"s{i}" for i in range(size))).alias("y"))


def _whitening(gram: np.ndarray) -> np.ndarray:
    """The map that makes vectors of this Gram matrix orthonormal; directions without length are left out."""
    lengths, axes = np.linalg.eigh(gram)
    used = lengths > max(lengths.max(initial=0.0), 0.0) * 1e-13
    return axes[:, used] / np.sqrt(lengths[used])


def factorised(weights: DataFrame, size: int, seed: int = 42, rounds: int = ROUNDS, oversample: int = OVERSAMPLE):
    """(vectors, spectrum) of a symmetric table (word, context, value).

    vectors: (word, vec), `size` numbers a word: the components of largest absolute eigenvalue, times the root of it, zeros beyond the rank.
    spectrum: [(eigenvalue, residual)], residual the length of Mv - λv for the unit vector v of the component. Starts are random signs
    from the word's hash and the seed, so reruns agree up to rounding.
    """
    weights = stage(weights)
    k = size + oversample
    signs = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.xxhash64("word", F.lit(seed), i).bitwiseAND(F.lit(1)).cast("double") * 2 - 1)
    basis = stage(weights.select("word").distinct().select("word", signs.alias("q")))
    if basis.isEmpty():
        return basis.select("word", F.col("q").alias("vec")), []
    image = stage(_multiplied(weights, basis, k))
    for _ in range(rounds - 1):
        straight = _whitening(_products(image, "y", "y", k))
        k = straight.shape[1]
        further = stage(_multiplied(weights, _mapped(image, straight, q="y"), k))
        discard(image)
        image = further
    for _ in range(2):  # the second time mends what rounding left
        straight = _whitening(_products(image, "y", "y", k))
        k = straight.shape[1]
        image = stage(_mapped(image, straight, y="y"))
    basis = image.withColumnRenamed("y", "q")
    image = stage(_multiplied(weights, basis, k))
    both = stage(basis.join(image, "word"))
    inner = _products(both, "q", "y", k)
    values, axes = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:size]
    values, axes = values[order], axes[:, order]
    lengths = np.diag(axes.T @ _products(image, "y", "y", k) @ axes)  # |Mv|², and v'Mv is the eigenvalue
    spectrum = [(float(v), float(np.sqrt(max(n - v * v, 0.0)))) for v, n in zip(values, lengths)]
    scaled = np.zeros((k, size))
    scaled[:, : len(order)] = axes * np.sqrt(np.abs(values))
    return stage(_mapped(both, scaled, vec="q")), spectrum


def mean_vectors(df: DataFrame, column: str, vectors: DataFrame, size: int) -> DataFrame:
    """`df` with `embedding`, the mean of the vectors of a text's words, words without a vector counting as zeros; zeros without words.

    A counted, small number of vectors goes to every task, which takes a few texts at a time; more of them meet blocks of texts by ranges of
    words. So no task holds more than a batch, a block or a range, however many texts there are.
    """
    from commitlore.operators import contexts

    found = vectors.select(F.xxhash64("word").alias("h"), "vec").limit(SMALL_VOCABULARY + 1).toPandas()
    if len(found) > SMALL_VOCABULARY:
        rows = stage(df.withColumn("_row", F.monotonically_increasing_id()))
        blocks = contexts.token_blocks(rows, column)
        means = stage(contexts.text_means(blocks, contexts.vector_state(vectors, contexts.range_bits(blocks), size), size))
        return rows.join(means, "_row").drop("_row")
    order = np.argsort(found["h"].to_numpy(np.int64))
    known = found["h"].to_numpy(np.int64)[order]
    # a last row of zeros for words without a vector
    table = np.concatenate([np.stack(found["vec"].to_numpy()).reshape(-1, size)[order] if len(found) else np.zeros((0, size)), np.zeros((1, size))])

    @F.pandas_udf("array<double>")
    def mean(texts: pd.Series) -> pd.Series:
        lengths = np.array([0 if t is None else len(t) for t in texts], np.int64)
        out = np.zeros((len(lengths), size))
        if lengths.sum():
            tokens = np.concatenate([t for t in texts if t is not None and len(t)]).astype(np.int64)
            at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
            at = np.where(known[at] == tokens, at, len(known)) if len(known) else np.zeros(len(tokens), np.int64)
            some = np.flatnonzero(lengths)
            starts, at_word = (np.cumsum(lengths) - lengths)[some], 0
            # some texts at a time: a place takes as many numbers as a vector
            while at_word < len(some):
                to = max(at_word + 1, int(np.searchsorted(starts, starts[at_word] + contexts.STEP_TOKENS, side="right")) - 1)
                begin, end = starts[at_word], starts[to] if to < len(some) else len(tokens)
                out[some[at_word:to]] = np.add.reduceat(table[at[begin:end]], starts[at_word:to] - begin, axis=0)
                at_word = to
        return pd.Series(list(out / np.maximum(lengths, 1)[:, None]))

    return df.withColumn("embedding", mean(F.transform(tokenize_message(column), lambda w: F.xxhash64(w))))
