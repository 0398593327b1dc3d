"""Language-model scores by deleted interpolation: bigram, unigram and uniform estimates, mixed by context frequency.

Counts never meet in one place. Texts are gathered into blocks; a block asks for the counts of its distinct n-grams, one
message to each range of n-gram hashes, and brings its own training counts along. Each range adds up what all blocks
have and answers every block in the order it asked. A frequent n-gram is thus one entry per block, however
often it stands there. Mixture weights come from expectation-maximisation over all tokens of held-out training
documents, gathered as a histogram of bounded size.
"""

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlore.llm.common import buffered, encoded, mix64, small_batches, word_hashes
from commitlore.session import stage

#: Characters of text in a block, and of all text for each range of hashes.
BLOCK_CHARS = 4_000_000
RANGE_CHARS = 12_000_000
#: Roles of documents: counted, counted and used to learn the mixture, only scored.
MAIN, MIXTURE, SCORED = 0, 1, 2
#: Buckets of context frequency: never seen, then by power of two.
BUCKETS = 24
#: Steps of log10 probability in the histogram that the mixture is learned from.
STEP = 0.05
START, END = b"\t", b"\n"
#: Stands for a missing doc_id inside blocks.
_NO_ID = -(2**63) + 1
KINDS = ("uni", "bi")


def packed(x: np.ndarray) -> bytes:
    """Integers as bytes: all lowest bytes, then all second ones, and so on, compressed."""
    x = np.ascontiguousarray(x.astype("<u8"))
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").reshape(-1)


def text_tokens(raw: list[bytes]):
    """Hashes of all tokens and of the token before each, laid end to end; tokens of each text. A-Z count as lower case."""
    words: list[bytes] = []
    lengths = np.zeros(len(raw), np.int64)
    for i, text in enumerate(raw):
        found = text.lower().split()
        words += found
        words.append(END)
        lengths[i] = len(found) + 1
    tokens = word_hashes(words)
    before = np.concatenate([[0], tokens[:-1]]).astype(np.uint64) if len(tokens) else tokens
    start = np.cumsum(lengths) - lengths
    before[start] = word_hashes([START])[0]
    return tokens, before, lengths


def ngrams(tokens, before) -> dict:
    # pairs keep 56 bits, which do for estimates; single tokens, whose counts are reported, keep all
    return {"uni": tokens, "bi": mix64(mix64(before) + tokens) >> np.uint64(8) << np.uint64(8)}


BLOCK = T.StructType([T.StructField("block", T.StringType()), T.StructField("ids", T.BinaryType()), T.StructField("roles", T.BinaryType()),
                      T.StructField("lengths", T.BinaryType()), T.StructField("texts", T.BinaryType())])
ASK = T.StructType([T.StructField("block", T.StringType()), T.StructField("range", T.IntegerType()), T.StructField("kind", T.StringType()),
                    T.StructField("keys", T.BinaryType()), T.StructField("main", T.BinaryType()), T.StructField("mixture", T.BinaryType())])
ANSWER = T.StructType([T.StructField("block", T.StringType()), T.StructField("range", T.IntegerType()), T.StructField("kind", T.StringType()),
                       T.StructField("main", T.BinaryType()), T.StructField("mixture", T.BinaryType()), T.StructField("totals", T.ArrayType(T.LongType()))])
_COUNTS = [f"{kind}_{part}" for kind in KINDS for part in ("main", "mixture")]
COUNTED = T.StructType([*BLOCK.fields, *(T.StructField(c, T.BinaryType()) for c in _COUNTS), T.StructField("totals", T.ArrayType(T.LongType()))])


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of whole texts from rows of doc_id, text, role. Written once, so block names hold however tasks run later."""

    def gather(frames):
        import pandas as pd
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, frame in enumerate(buffered(frames, BLOCK_CHARS)):
            raw = encoded(frame["text"])
            yield pd.DataFrame({
                "block": [f"{task}-{k}"], "ids": [frame["doc_id"].to_numpy("<i8").tobytes()], "roles": [frame["role"].to_numpy(np.uint8).tobytes()],
                "lengths": [packed(np.array([len(t) for t in raw], np.uint64))], "texts": [zstandard.ZstdCompressor(level=6).compress(b"".join(raw))],
            })

    return stage(small_batches(docs).mapInPandas(gather, BLOCK))


def _texts(row) -> tuple[list[bytes], np.ndarray]:
    lengths = unpacked(row.lengths).astype(np.int64)
    data = zstandard.ZstdDecompressor().decompress(row.texts)
    ends = np.cumsum(lengths)
    return [data[b - n : b] for b, n in zip(ends, lengths, strict=True)], np.frombuffer(row.roles, np.uint8)


def _ask(bits: int):
    def ask(frames):
        import pandas as pd

        for frame in frames:
            for row in frame.itertuples():
                raw, roles = _texts(row)
                tokens, before, lengths = text_tokens(raw)
                role = np.repeat(roles, lengths)
                out = []
                for kind, keys in ngrams(tokens, before).items():
                    distinct, at = np.unique(keys, return_inverse=True)
                    counts = [np.bincount(at[role == r], minlength=len(distinct)) for r in (MAIN, MIXTURE)]
                    edges = np.searchsorted(distinct >> np.uint64(64 - bits), np.arange((1 << bits) + 1)) if bits else np.array([0, len(distinct)])
                    for r in np.flatnonzero(np.diff(edges)):
                        part = slice(edges[r], edges[r + 1])
                        steps = np.diff(distinct[part], prepend=np.uint64(0))
                        out.append((row.block, int(r), kind, packed(steps), *(packed(c[part]) for c in counts)))
                yield pd.DataFrame(out, columns=ASK.names)

    return ask


def _answer(frame):
    """Add up one range of hashes and answer every block; a row without block holds the range's totals."""
    import pandas as pd

    out, r = [], int(frame["range"].iloc[0])
    totals = [0, 0, 0, 0]
    for kind in KINDS:
        rows = list(frame[frame["kind"] == kind].itertuples())
        if not rows:
            continue
        keys = [np.cumsum(unpacked(x.keys), dtype=np.uint64) for x in rows]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([unpacked(getattr(x, c)) for x in rows]).astype(float), len(distinct)).astype(np.uint64) for c in ("main", "mixture")]
        if kind == "uni":
            both = sums[0] + sums[1]
            totals = [int(both.sum()), int((both > 0).sum()), int(sums[0].sum()), int((sums[0] > 0).sum())]
        ends = np.cumsum([len(k) for k in keys])
        for x, k, end in zip(rows, keys, ends, strict=True):
            mine = at[end - len(k) : end]
            out.append((x.block, r, kind, packed(sums[0][mine]), packed(sums[1][mine]), None))
    out.append(("", r, "", None, None, totals))
    return pd.DataFrame(out, columns=ANSWER.names)


def _join(blocks, answers):
    """A block with the counts of its n-grams in the order of their hashes; for the nameless block, the totals."""
    import pandas as pd

    if not len(blocks):
        totals = np.sum([t for t in answers["totals"] if t is not None], axis=0).tolist()
        return pd.DataFrame([["", *[None] * 8, totals]], columns=COUNTED.names)
    answers = answers.sort_values("range")
    counts = {}
    for kind in KINDS:
        rows = answers[answers["kind"] == kind]
        for part in ("main", "mixture"):
            counts[f"{kind}_{part}"] = [packed(np.concatenate([unpacked(x) for x in rows[part]]))] if len(rows) else [packed(np.zeros(0))]
    return blocks.assign(**counts, totals=None)[COUNTED.names]


def _events(row, only=None, with_mixture: bool = True):
    """For all tokens of the chosen texts of a block: counts of token, context and pair; tokens of each text; which texts."""
    raw, roles = _texts(row)
    tokens, before, lengths = text_tokens(raw)
    found = {}
    for kind, keys in ngrams(tokens, before).items():
        at = np.unique(keys, return_inverse=True)[1]
        counts = unpacked(getattr(row, f"{kind}_main")).astype(float)
        if with_mixture:
            counts += unpacked(getattr(row, f"{kind}_mixture")).astype(float)
        found[kind] = counts[at]
    c, pair = found["uni"], found["bi"]
    context = np.concatenate([[0.0], c[:-1]])
    ends = np.cumsum(lengths)
    # every text starts after the start sign, which stands before as many texts as the end sign ends
    context[ends - lengths] = c[ends - 1]
    keep = np.ones(len(c), bool) if only is None else np.repeat(roles == only, lengths)
    return c[keep], context[keep], pair[keep], lengths, roles


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(context, 1)))), 0).astype(np.int64)


def learn_mixture(histogram: dict, uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, [pair, word, uniform]) by expectation-maximisation over {(bucket, log f2, log f1): tokens}.

    A bucket without tokens takes the weights learned over all of them; one token spread evenly keeps weights above 0.
    """
    if not histogram:
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
    keys = np.array(list(histogram), dtype=np.int64)
    n = np.array(list(histogram.values()), dtype=float)
    value = lambda q: np.where(q < 0, 10.0 ** (q * STEP), 0.0) + (q == 0)
    p = np.stack([np.where(keys[:, 1] == 1, 0.0, value(keys[:, 1])), np.where(keys[:, 2] == 1, 0.0, value(keys[:, 2])), np.full(len(n), uniform)])

    def em(rows):
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            part = w[:, None] * p[:, rows]
            part = part / part.sum(0) * n[rows]
            w = (part.sum(1) + 1 / 3) / (n[rows].sum() + 1)
        return w

    overall = em(np.arange(len(n)))
    out = np.tile(overall, (BUCKETS, 1))
    for b in np.unique(keys[:, 0]):
        out[b] = em(np.flatnonzero(keys[:, 0] == b))
    return out


def _quantised(x: np.ndarray) -> np.ndarray:
    """log10 in steps; 1 stands for a probability of 0."""
    return np.where(x > 0, np.minimum(0, np.round(np.log10(np.where(x > 0, x, 1)) / STEP)), 1).astype(np.int64)


def model_scores(docs: DataFrame) -> DataFrame:
    """Scores of all whole texts from rows of doc_id, text and role (MAIN, MIXTURE or SCORED).

    Returns doc_id, role, n_tokens, n_known, train_tokens, base_score, score. Null texts are empty: their one token is
    the end. Repeated rows count and score as often as they stand there. Without training rows N and V are 0, nothing is known,
    and all weight is on the uniform estimate. Other columns are ignored; an empty table gives no rows; a null doc_id stays null.
    """
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id")
    rows = docs.select(own_id, "text", F.col("role").cast("int"))
    blocks = _blocks(rows)
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, chars) / RANGE_CHARS)))) if chars > RANGE_CHARS else 0
    answers = blocks.mapInPandas(_ask(bits), ASK).groupBy("range").applyInPandas(_answer, ANSWER)
    counted = stage(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_join, COUNTED))
    totals = counted.filter("block = ''").select("totals").first()
    n, v, n_main, v_main = totals["totals"] if totals and totals["totals"] else (0, 0, 0, 0)
    named = counted.filter("block <> ''").drop("totals")

    def histogram(frames):
        import pandas as pd

        for frame in frames:
            for row in frame.itertuples():
                c, context, pair, _, _ = _events(row, MIXTURE, with_mixture=False)
                key = np.stack([_bucket(context), _quantised(pair / np.maximum(context, 1)), _quantised(c / max(1, n_main))])
                distinct, counts = np.unique(key, axis=1, return_counts=True)
                yield pd.DataFrame({"b": distinct[0], "q2": distinct[1], "q1": distinct[2], "n": counts})

    cells = named.mapInPandas(histogram, "b long, q2 long, q1 long, n long").groupBy("b", "q2", "q1").agg(F.sum("n").alias("n"))
    # at most BUCKETS x 340 x 340 cells, whatever the size of the corpus
    weights = learn_mixture({(r.b, r.q2, r.q1): r.n for r in cells.collect()}, 1 / (v_main + 1))

    def score(frames):
        import pandas as pd

        for frame in frames:
            for row in frame.itertuples():
                c, context, pair, lengths, roles = _events(row)
                w = weights[_bucket(context)]
                p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * c / max(1, n) + w[:, 2] / (v + 1)
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                starts = np.cumsum(lengths) - lengths
                yield pd.DataFrame({
                    "doc_id": np.frombuffer(row.ids, "<i8"), "role": roles.astype(np.int32), "n_tokens": lengths,
                    "n_known": np.add.reduceat((c > 0).astype(np.int64), starts), "train_tokens": n,
                    "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts),
                })

    scored = named.mapInPandas(score, "doc_id long, role int, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
