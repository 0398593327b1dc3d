"""Word vectors from the contexts of words, and means of word vectors, for any number of different words.

The vectors are factors of the table of words that stand near each other, scaled by their totals, but the table is never made: a product
with it is a sum over the places of the texts. Texts are gathered into blocks; a block asks ranges of word hashes for the vectors of its
distinct words, one message a range, and sends them what its places add. A frequent word is thus one entry a block, a block and a range
are of bounded size, and the driver holds square matrices of the number of components.
"""

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from commitlore.functions.text import tokenize_message
from commitlore.operators.embeddings import OVERSAMPLE, ROUNDS, _whitening
from commitlore.session import discard, stage

#: Tokens of a block (one text may be longer), of all texts for each range of hashes, and of a block that are worked on at a time.
BLOCK_TOKENS, RANGE_TOKENS, STEP_TOKENS = 500_000, 125_000, 1 << 15

_BLOCK = "block string, rows binary, lengths binary, words binary, codes binary"
_MESSAGE = "block string, range int, words binary, part binary"
_STATE = "range int, words binary, sums binary, gram binary"


def token_blocks(df: DataFrame, column: str) -> DataFrame:
    """One row for some texts: their `_row`, their numbers of words, the hashes of the distinct words, and each place's word among these."""
    hashed = df.select("_row", F.transform(tokenize_message(column), lambda w: F.xxhash64(w)).alias("t"))

    def gather(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def made():
            rows, lengths, tokens = (np.concatenate(v) for v in zip(*held, strict=True))
            words, codes = np.unique(tokens.view(np.uint64), return_inverse=True)
            values = [f"{task}-{count}", rows.tobytes(), lengths.tobytes(), words.tobytes(), codes.astype(np.int32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            lists = batch.column("t")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, tokens = batch.column("_row").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(lengths), 0
            while at < len(rows):
                before = ends[at] - lengths[at]
                to = max(at + 1, int(np.searchsorted(ends, before + BLOCK_TOKENS - size, side="right")))
                held.append((rows[at:to], lengths[at:to], tokens[before : ends[to - 1]]))
                size += int(ends[to - 1] - before)
                at = to
                if at < len(rows) or size >= BLOCK_TOKENS:
                    yield made()
                    held, size, count = [], 0, count + 1
        if held:
            yield made()

    return stage(hashed.mapInArrow(gather, _BLOCK))


def range_bits(blocks: DataFrame) -> int:
    tokens = (blocks.agg(F.sum(F.octet_length("codes"))).first()[0] or 0) / 4
    return max(0, math.ceil(math.log2(tokens / RANGE_TOKENS))) if tokens > RANGE_TOKENS else 0


def _edges(words: np.ndarray, bits: int) -> np.ndarray:
    """Where each range's words begin among words in order."""
    return np.searchsorted(words >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, len(words)])


def _messages(block: str, words: np.ndarray, parts: np.ndarray | None, bits: int) -> list[tuple]:
    edges = _edges(words, bits)
    return [(block, int(r), words[a:b].tobytes(), None if parts is None else parts[a:b].astype("<f4").tobytes())
            for r, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]


def _block(row):
    words, codes = np.frombuffer(row.words, "<u8"), np.frombuffer(row.codes, "<i4")
    return words, codes, np.frombuffer(row.lengths, "<i8")


def _reach(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and place behind the last that each place of texts laid end to end has as its context, itself among them."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(ends))
    return np.maximum(place - window, ends - np.repeat(lengths, lengths)), np.minimum(place + window + 1, ends)


def _by_code(codes: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """Adds the rows of values to those of `out` that their codes name."""
    order = np.argsort(codes, kind="stable")
    kinds, starts = np.unique(codes[order], return_index=True)
    out[kinds] += np.add.reduceat(values[order], starts, axis=0)


def _products(codes: np.ndarray, lengths: np.ndarray, vectors: np.ndarray, window: int) -> np.ndarray:
    """For each word the sum, over its places, of the vectors of the words around."""
    low, high = _reach(lengths, window)
    out = np.zeros(vectors.shape)
    for a in range(0, len(codes), STEP_TOKENS):
        b = min(a + STEP_TOKENS, len(codes))
        first, last = int(low[a]), int(high[b - 1])
        near = vectors[codes[first:last]].astype(float)
        along = np.concatenate([np.zeros((1, near.shape[1])), np.cumsum(near, axis=0)])
        _by_code(codes[a:b], along[high[a:b] - first] - along[low[a:b] - first] - near[a - first : b - first], out)
    return out


def _signs(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Random signs from the word's hash and the seed."""
    factors = np.random.default_rng(seed).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (words ^ (words >> np.uint64(29)))[:, None] * factors[None, :]
    return (mixed >> np.uint64(63)).astype("<f4") * 2 - 1


def _gathered(messages: DataFrame, width: int) -> DataFrame:
    """Sums of the messages of all blocks, one row a range, with the sum of the outer products of its words' rows."""

    def add(frame):
        import pandas as pd

        frame = frame.sort_values("block")  # the same sums, in whatever order messages come
        words = np.concatenate([np.frombuffer(w, "<u8") for w in frame["words"]])
        kinds, codes = np.unique(words, return_inverse=True)
        total, at = np.zeros((len(kinds), width)), 0
        for part in frame["part"]:
            part = np.frombuffer(part, "<f4").reshape(-1, width)
            total[codes[at : at + len(part)]] += part  # a word is once in a message
            at += len(part)
        return pd.DataFrame([(int(frame["range"].iloc[0]), kinds.tobytes(), total.astype("<f4").tobytes(), (total.T @ total).tobytes())], columns=["range", "words", "sums", "gram"])

    return messages.groupBy("range").applyInPandas(add, _STATE)


def _gram(state: DataFrame) -> np.ndarray:
    """Sum of the ranges' outer products: square matrices of the number of components, added in 16 groups before the driver adds these."""

    def added(frames):
        import pandas as pd

        total = None
        for pdf in frames:
            for g in pdf["gram"]:
                total = np.frombuffer(g) if total is None else total + np.frombuffer(g)
        if total is not None:
            yield pd.DataFrame({"gram": [total.tobytes()]})

    found = state.select("gram").mapInPandas(added, "gram binary").repartition(16).mapInPandas(added, "gram binary").collect()
    total = np.sum([np.frombuffer(r["gram"]) for r in found], axis=0)
    size = math.isqrt(np.size(total))
    return np.reshape(total, (size, size))


def _turned(state: DataFrame, matrix: np.ndarray) -> DataFrame:
    def turn(frames):
        for pdf in frames:
            made = [np.frombuffer(s, "<f4").reshape(-1, len(matrix)) @ matrix for s in pdf["sums"]]
            yield pdf.assign(sums=[m.astype("<f4").tobytes() for m in made], gram=[(m.T @ m).tobytes() for m in made])

    return stage(state.mapInPandas(turn, _STATE))


def _asks(blocks: DataFrame, bits: int) -> DataFrame:
    def ask(frames):
        import pandas as pd

        for pdf in frames:
            for row in pdf.itertuples():
                yield pd.DataFrame([m[:3] for m in _messages(row.block, np.frombuffer(row.words, "<u8"), None, bits)], columns=["block", "range", "words"])

    return stage(blocks.select("block", "words").mapInPandas(ask, "block string, range int, words binary"))


def _answers(state: DataFrame, asks: DataFrame, width: int) -> DataFrame:
    """For each block and range the rows of the block's words there; zeros for words that the range does not have."""

    def answer(states, asked):
        import pandas as pd

        known, sums = np.zeros(0, "<u8"), np.zeros((0, width), "<f4")
        if len(states):
            known = np.frombuffer(states["words"].iloc[0], "<u8")
            sums = np.frombuffer(states["sums"].iloc[0], "<f4").reshape(-1, width)
        out = []
        for row in asked.itertuples():
            words = np.frombuffer(row.words, "<u8")
            at = np.searchsorted(known, words)
            has = at < len(known)
            has[has] = known[at[has]] == words[has]
            part = np.zeros((len(words), width), "<f4")
            part[has] = sums[at[has]]
            out.append((row.block, int(row.range), None, part.tobytes()))
        return pd.DataFrame(out, columns=["block", "range", "words", "part"])

    return state.select("range", "words", "sums").groupBy("range").cogroup(asks.groupBy("range")).applyInPandas(answer, _MESSAGE)


def _answered(answers, width: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, width), "<f4"), *(np.frombuffer(p, "<f4").reshape(-1, width) for p in answers.sort_values("range")["part"])])


def context_vectors(blocks: DataFrame, size: int, window: int, seed: int = 42, rounds: int = ROUNDS, oversample: int = OVERSAMPLE):
    """(state, spectrum): for each range the words of `token_blocks` in order of hash and `size` numbers a word, and the eigenvalues.

    The table's entry for two words is how often they stand at most `window` words apart, over the roots of both their totals, each
    with the mean total added, which holds back words seen a few times. A word's vector is the mean of what its eigenvectors, scaled
    back, say of its contexts: the components of largest absolute eigenvalue, zeros beyond the rank. Starts are random signs
    from the word's hash, so reruns agree up to rounding.
    """
    bits, k = range_bits(blocks), size + oversample
    asks = _asks(blocks, bits)

    def total(frames):
        import pandas as pd

        for pdf in frames:
            for row in pdf.itertuples():
                words, codes, lengths = _block(row)
                low, high = _reach(lengths, window)
                totals = np.bincount(codes, weights=high - low - 1, minlength=len(words))
                yield pd.DataFrame(_messages(row.block, words, totals[:, None], bits), columns=["block", "range", "words", "part"])

    totals = stage(_gathered(blocks.mapInPandas(total, _MESSAGE), 1))

    def counted(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"words": [len(w) // 8 for w in pdf["words"]], "total": [float(np.frombuffer(s, "<f4").sum(dtype=float)) for s in pdf["sums"]]})

    n, whole = totals.select("words", "sums").mapInPandas(counted, "words long, total double").agg(F.sum("words"), F.sum("total")).first()
    if not whole:
        return totals.filter("false"), []
    added = whole / n

    def scaled(frame, answers):
        return frame.assign(scale=[(1 / np.sqrt(_answered(answers, 1)[:, 0].astype(float) + added)).astype("<f4").tobytes()])

    held = stage(blocks.drop("rows").groupBy("block").cogroup(_answers(totals, asks, 1).groupBy("block")).applyInPandas(
        scaled, "block string, lengths binary, words binary, codes binary, scale binary"))
    discard(totals)

    def multiplied(row, vectors: np.ndarray) -> list[tuple]:
        words, codes, lengths = _block(row)
        scale = np.frombuffer(row.scale, "<f4")[:, None]
        return _messages(row.block, words, scale * _products(codes, lengths, scale * vectors, window), bits)

    def begun(frames):
        import pandas as pd

        for pdf in frames:
            for row in pdf.itertuples():
                yield pd.DataFrame(multiplied(row, _signs(np.frombuffer(row.words, "<u8"), k, seed)), columns=["block", "range", "words", "part"])

    def times(state: DataFrame, width: int) -> DataFrame:
        def met(frame, answers):
            import pandas as pd

            return pd.DataFrame(multiplied(next(frame.itertuples()), _answered(answers, width)), columns=["block", "range", "words", "part"])

        return stage(_gathered(held.groupBy("block").cogroup(_answers(state, asks, width).groupBy("block")).applyInPandas(met, _MESSAGE), width))

    def straightened(state: DataFrame) -> tuple[DataFrame, int]:
        matrix = _whitening(_gram(state))
        turned = _turned(state, matrix)
        discard(state)
        return turned, matrix.shape[1]

    image = stage(_gathered(held.mapInPandas(begun, _MESSAGE), k))
    for _ in range(rounds - 1):
        basis, k = straightened(image)
        image = times(basis, k)
        discard(basis)
    for _ in range(2):  # the second time mends what rounding left
        image, k = straightened(image)
    basis, image = image, times(image, k)

    def inner(a, b):
        import pandas as pd

        q, y = (np.frombuffer(t["sums"].iloc[0], "<f4").reshape(-1, k).astype(float) for t in (a, b))
        return pd.DataFrame({"gram": [(q.T @ y).tobytes()]})

    found = _gram(basis.groupBy("range").cogroup(image.groupBy("range")).applyInPandas(inner, "gram binary"))
    values, axes = np.linalg.eigh((found + found.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:size]
    turn = np.zeros((k, size))
    turn[:, : len(order)] = axes[:, order] * np.sqrt(np.abs(values[order]) * whole)
    # scaled back by the totals, in each block, as all else is
    turned = _turned(basis, turn)

    def unscaled(frame, answers):
        import pandas as pd

        row = next(frame.itertuples())
        vectors = np.frombuffer(row.scale, "<f4")[:, None] * _answered(answers, size)
        return pd.DataFrame(_messages(row.block, np.frombuffer(row.words, "<u8"), vectors, bits), columns=["block", "range", "words", "part"])

    parts = held.groupBy("block").cogroup(_answers(turned, asks, size).groupBy("block")).applyInPandas(unscaled, _MESSAGE)

    def once(frame):
        import pandas as pd

        words = np.concatenate([np.frombuffer(w, "<u8") for w in frame["words"]])
        kinds, first = np.unique(words, return_index=True)
        vectors = np.concatenate([np.frombuffer(p, "<f4") for p in frame["part"]]).reshape(-1, size)[first]
        return pd.DataFrame([(int(frame["range"].iloc[0]), kinds.tobytes(), vectors.tobytes(), b"")], columns=["range", "words", "sums", "gram"])

    state = stage(parts.groupBy("range").applyInPandas(once, _STATE))
    discard(held, basis, image, turned, asks)
    return state, [float(v) for v in values[order]]


def vector_state(vectors: DataFrame, bits: int, size: int) -> DataFrame:
    """The ranges of a table (word, vec)."""
    hashed = vectors.select(F.xxhash64("word").alias("h"), "vec")
    ranges = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)

    def add(frame):
        import pandas as pd

        words = frame["h"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(words)
        sums = np.stack(frame["vec"].to_numpy())[order].astype("<f4")
        return pd.DataFrame([(int(frame["range"].iloc[0]), words[order].tobytes(), sums.tobytes(), b"")], columns=["range", "words", "sums", "gram"])

    return stage(hashed.withColumn("range", ranges).groupBy("range").applyInPandas(add, _STATE))


def text_means(blocks: DataFrame, state: DataFrame, size: int) -> DataFrame:
    """(_row, embedding): the mean of the vectors of a text's words; zeros without words."""
    bits = range_bits(blocks)

    def mean(frame, answers):
        import pandas as pd

        row = next(frame.itertuples())
        _, codes, lengths = _block(row)
        vectors, ends = _answered(answers, size), np.cumsum(lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        out = np.zeros((len(lengths), size))
        for a in range(0, len(codes), STEP_TOKENS):
            _by_code(owner[a : a + STEP_TOKENS], vectors[codes[a : a + STEP_TOKENS]].astype(float), out)
        return pd.DataFrame({"_row": np.frombuffer(row.rows, "<i8"), "embedding": list(out / np.maximum(lengths, 1)[:, None])})

    return blocks.groupBy("block").cogroup(_answers(state, _asks(blocks, bits), size).groupBy("block")).applyInPandas(mean, "_row long, embedding array<double>")
