"""Toxic spans: a linear-chain conditional random field with two states, and document scores from its marginals.

Labels come by document. In a bounded sample on the driver, words and word stems are chosen that stand in toxic documents too often
and in too many places for chance; their occurrences are the labelled tokens on which the field is trained. Inference runs forward-backward over the tokens of whole texts, many texts at a time.
"""

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlore.llm.common import buffered, encoded, plain_words, ragged, sampled_texts, shielded

#: Tokens of a training segment.
STEPS = 24
#: Characters of text that a task holds at a time.
MOST_CHARS = 12_000_000
#: Lengths of word beginnings, in bytes, that are features.
STEMS = (4, 5, 6, 7)
#: Words whose scores a task remembers.
MEMORY = 300_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def features(word: bytes) -> list[bytes]:
    """What speaks for a word: itself, and its first 4 to 7 bytes where it is longer, so that forms of one stem count together."""
    return [word, *(b"^" + word[:n] for n in STEMS if n < len(word))]


def token_lexicon(words: list[list[bytes]], toxic: list[int], precision: float = 0.97, chance: float = 0.01) -> set[bytes]:
    """Features that label tokens: those in toxic texts too often, and in too many places, for chance.

    A feature's support is the number of different (word before, word after) in which it stands, so that a passage copied
    from text to text counts once. At least `precision` of it must be in toxic texts, and so much that some feature had as
    much with a probability below `chance` if toxic texts were like all others.
    """
    tokens = [sum(len(t) for t, k in zip(words, toxic, strict=True) if k == label) for label in (0, 1)]
    if not tokens[1] or not tokens[0]:
        return set()
    texts: tuple[dict, dict] = ({}, {})
    for text, label in zip(words, toxic, strict=True):
        for f in {f for w in set(text) for f in features(w)}:
            texts[label][f] = texts[label].get(f, 0) + 1
    share = tokens[1] / sum(tokens)
    needed = max(2, (np.log(len(texts[0].keys() | texts[1].keys())) - np.log(chance)) / -np.log(share))
    likely = {f for f, n in texts[1].items() if n >= 2 and n >= 0.9 * (n + texts[0].get(f, 0))}
    places: dict = {f: (set(), set()) for f in likely}
    for text, label in zip(words, toxic, strict=True):
        for before, w, after in zip([b"", *text], text, [*text[1:], b""]):
            for f in features(w):
                if f in likely:
                    places[f][label].add(hash((before, after)))
    return {f for f, (clean, found) in places.items() if len(found) >= needed and len(found) >= precision * (len(found) + len(clean))}


def messages(odds: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages at every token, for sequences laid end to end.

    `odds`: emission odds of state 1 by token; `transition`: 2 x 2 potentials. Forward and backward messages are kept as
    ratios of state 1 to state 0, so nothing under- or overflows on long texts.
    """
    if not len(odds):
        return np.zeros(0), np.zeros(0)
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    first = np.concatenate([[0], np.cumsum(alive)])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    owner, place = ragged(lengths)
    at = first[place] + rank[owner]
    e = np.empty(len(odds))
    e[at] = odds
    (t00, t01), (t10, t11) = transition
    forward, r = np.empty(len(odds)), np.ones(0)
    for t in range(len(alive)):
        part = slice(first[t], first[t + 1])
        if t:
            r = r[: alive[t]]
            r = (t01 + r * t11) / (t00 + r * t10) * e[part]
        else:
            r = e[part].copy()
        forward[part] = r
    backward, q = np.empty(len(odds)), np.ones(0)
    for t in range(len(alive) - 1, -1, -1):
        part = slice(first[t], first[t + 1])
        q = np.concatenate([q, np.ones(alive[t] - len(q))])
        backward[part] = q
        x = e[part] * q
        q = (t10 + t11 * x) / (t00 + t01 * x)
    return forward[at], backward[at]


def marginals(odds: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Probability of state 1 at every token."""
    forward, backward = messages(odds, lengths, transition)
    return 1 - 1 / (1 + forward * backward)


def fit_field(words: list[list[bytes]], labels: list[list[int]], rounds: int = 60, rate: float = 0.4, ridge: float = 1e-3) -> dict:
    """Train emission weights by feature and the transition potentials by gradient ascent on the likelihood of the tags."""
    distinct = sorted({w for text in words for w in text})
    number = {w: i for i, w in enumerate(distinct)}
    vocabulary = {f: i + 1 for i, f in enumerate(sorted({f for w in distinct for f in features(w)}))}
    ids = np.array([number[w] for text in words for w in text], np.int64)
    y = np.array([t for tags in labels for t in tags], np.int64)
    lengths = np.array([len(t) for t in words], np.int64)
    # which features each different word has
    word_of, feature_of = (np.array(v, np.int64) for v in zip(*((number[w], vocabulary[f]) for w in distinct for f in features(w)))) if distinct else (ids, ids)
    # index 0 is the bias, which every token has and which alone speaks for words without a known feature
    n = len(vocabulary) + 1
    weight, potential = np.zeros(n), np.zeros((2, 2))
    g_w, g_t = np.full(n, 1e-6), np.full((2, 2), 1e-6)
    owner, place = ragged(lengths)
    inner = np.flatnonzero(place > 0)
    share = np.bincount(feature_of, np.bincount(ids, minlength=len(distinct))[word_of], n)
    for _ in range(rounds if len(ids) else 0):
        by_word = np.bincount(word_of, weight[feature_of], len(distinct))
        odds = np.exp(np.clip(weight[0] + by_word[ids], -30, 30))
        t = np.exp(potential)
        forward, backward = messages(odds, lengths, t)
        gap = y - (1 - 1 / (1 + forward * backward))
        d_w = np.bincount(feature_of, np.bincount(ids, gap, len(distinct))[word_of], n) - ridge * weight * np.maximum(1, share)
        d_w[0] = gap.sum()
        left, right = forward[inner - 1], odds[inner] * backward[inner]
        pairs = np.array([[np.full(len(inner), t[0, 0]), t[0, 1] * right], [t[1, 0] * left, t[1, 1] * left * right]])
        hoped = (pairs / pairs.sum((0, 1))).sum(-1)
        seen = np.bincount(2 * y[inner - 1] + y[inner], minlength=4).reshape(2, 2)
        d_t = seen - hoped
        scale = max(1, len(ids))
        d_w, d_t = d_w / scale, d_t / scale
        g_w += d_w * d_w
        g_t += d_t * d_t
        weight += rate * d_w / np.sqrt(g_w)
        potential += 0.1 * rate * d_t / np.sqrt(g_t)
    return {"features": {f: float(weight[i]) for f, i in vocabulary.items()}, "bias": float(weight[0]), "transition": np.exp(potential)}


def token_marginals(raw: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Probability of the toxic state for every token of each text, laid end to end; tokens of each text."""
    weight, known = model["features"], model.setdefault("known", {})
    scores, lengths = [], np.zeros(len(raw), np.int64)
    for i, text in enumerate(raw):
        found = []
        for w in plain_words(text):
            score = known.get(w)
            if score is None:
                score = sum(weight.get(f, 0.0) for f in features(w))
                if len(known) < MEMORY:
                    known[w] = score
            found.append(score)
        lengths[i] = len(found)
        scores.append(np.array(found, np.float64))
    flat = np.concatenate(scores) if scores else np.zeros(0)
    odds = np.exp(np.clip(flat + model["bias"], -30, 30))
    return marginals(odds, lengths, model["transition"]), lengths


def _strongest(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log odds of the likeliest token of each text; a text without tokens has the lowest value there is."""
    out = np.full(len(lengths), -12.0)
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        top = np.clip(np.maximum.reduceat(p, starts), 1e-9, 1 - 1e-9)
        out[full] = np.clip(np.log(top / (1 - top)), -12, 12)
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, where=None, max_rows: int = 2400, seed: int = 5) -> dict:
    """Fit on at most `max_rows` labelled rows, half of them toxic where there are enough, by smallest hash of text.

    `labels` has doc_id and toxic; null labels are left out. Of several labels of a document the highest counts. With no
    toxic row the model scores every text by the share of toxic rows, which is then 0.
    """
    own = docs if where is None else docs.filter(where)
    marked = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("is_toxic"))
    toxic, clean = (
        [plain_words(t) for t in encoded(t for t, _ in sampled_texts(own, "is_toxic", max_rows // 2, marked.filter(F.col("is_toxic") == k)))] for k in (1, 0)
    )
    words, target = toxic + clean, [1] * len(toxic) + [0] * len(clean)
    lexicon = token_lexicon(words, target)
    rng = np.random.default_rng(seed)
    pieces = [text[i : i + STEPS] for text in words for i in range(0, len(text), STEPS)]
    tagged = [i for i, p in enumerate(pieces) if any(not lexicon.isdisjoint(features(w)) for w in p)]
    plain = sorted(set(range(len(pieces))) - set(tagged))
    plain = [plain[i] for i in sorted(rng.permutation(len(plain))[: 4 * len(tagged) + 500])]
    chosen = [pieces[i] for i in tagged + plain]
    model = fit_field(chosen, [[int(not lexicon.isdisjoint(features(w))) for w in p] for p in chosen])
    # features that hardly matter need no entry
    model["features"] = {f: v for f, v in model["features"].items() if abs(v) > 1e-2}
    raw = [b" ".join(t) for t in words]
    x, y = _strongest(*token_marginals(raw, model)), np.array(target, float)
    slope, offset = 1.0, 0.0
    weight = np.where(y == 1, 1.0, len(toxic) / max(1, len(clean))) if toxic else np.ones(len(y))
    for _ in range(400 if toxic else 0):
        gap = weight * (y - 1 / (1 + np.exp(-(slope * x + offset))))
        slope += 0.05 * ((gap * x).sum() / len(y) - 1e-3 * slope)
        offset += 0.05 * gap.sum() / len(y) * 10
    model.pop("known", None)
    return model | {"slope": float(slope), "offset": float(offset) if toxic else -20.0, "lexicon": sorted(lexicon)}


def toxic_scores(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """`docs` with score (0 to 1) and toxic_spans, (start, end, score) in characters, of tokens of probability >= `threshold`.

    Neighbouring toxic tokens are one span. Null and empty texts have no token: no spans, and the score of a text in
    which nothing was found. Columns of those two names are replaced; others stay as they are.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    kept = docs.drop("score", "toxic_spans")
    outside = list(kept.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        fitted = dict(shared.value)
        for frame in buffered(batches, MOST_CHARS):
            texts = frame["text"].tolist()
            p, lengths = token_marginals(encoded(texts), fitted)
            x = fitted["slope"] * _strongest(p, lengths) + fitted["offset"]
            starts = np.cumsum(lengths) - lengths
            spans: list[list] = [[] for _ in texts]
            hits = np.flatnonzero(p >= threshold)
            for i in np.unique(np.searchsorted(starts + lengths, hits, side="right")):
                mine = p[starts[i] : starts[i] + lengths[i]]
                last = -2
                for k, word in enumerate(_WORD.finditer(texts[i])):
                    if mine[k] < threshold:
                        continue
                    if k == last + 1:
                        spans[i][-1]["end"] = word.end()
                        spans[i][-1]["score"] = max(spans[i][-1]["score"], float(mine[k]))
                    else:
                        spans[i].append({"start": word.start(), "end": word.end(), "score": float(mine[k])})
                    last = k
            out = frame[outside]
            out["score"] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            out["toxic_spans"] = spans
            yield out

    return shielded(kept, score, score="double", toxic_spans=span)
