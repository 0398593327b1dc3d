"""Language of texts: a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent layers read each segment of a text forwards and backwards; a softmax over both states labels
every byte, and the label probabilities of all bytes of a text are averaged. Weights are fitted by backpropagation
through time on the driver, on a bounded sample of labelled rows; they are a few thousand numbers.
"""

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlore.llm.common import encoded, ragged, sampled_texts, shielded

#: Bytes of a segment; states start anew at each, so that long texts are many short chains.
SEGMENT = 48
#: Bytes scored at a time, and segments: what a task holds beside its batch.
BLOCK = 2048
UNKNOWN = "und"
_LETTER = r"\p{L}"


def _gate(x):
    """The hard sigmoid."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _run(x, p, keep=None):
    """States of one direction: x (steps, n) bytes -> (steps, n, hidden). With `keep` a list, it gets what training needs."""
    table, u_zr, u_c = p
    hidden = u_c.shape[0]
    h = np.zeros((x.shape[1], hidden), np.float32)
    out = np.empty((*x.shape, hidden), np.float32)
    for t in range(x.shape[0]):
        e = table[x[t]]
        zr = h @ u_zr
        zr += e[:, : 2 * hidden]
        zr *= 0.25
        zr += 0.5
        np.clip(zr, 0, 1, out=zr)
        z, r = zr[:, :hidden], zr[:, hidden:]
        c = (r * h) @ u_c
        c += e[:, 2 * hidden :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((h, zr, c))
        h = c + z * (h - c)
        out[t] = h
    return out


def _back(x, p, kept, d_out):
    """Gradients of one direction's weights by backpropagation through time."""
    table, u_zr, u_c = p
    hidden = u_c.shape[0]
    g_table, g_zr, g_c = np.zeros_like(table), np.zeros_like(u_zr), np.zeros_like(u_c)
    dh = np.zeros_like(d_out[0])
    for t in range(x.shape[0] - 1, -1, -1):
        h, zr, c = kept[t]
        z, r = zr[:, :hidden], zr[:, hidden:]
        dh = dh + d_out[t]
        da_c = dh * (1 - z) * (1 - c * c)
        d_rh = da_c @ u_c.T
        d_zr = np.concatenate([dh * (h - c), d_rh * h], 1) * (0.25 * ((zr > 0) & (zr < 1)))
        g_c += (r * h).T @ da_c
        g_zr += h.T @ d_zr
        d_e = np.concatenate([d_zr, da_c], 1)
        order = np.argsort(x[t], kind="stable")
        seen, first = np.unique(x[t][order], return_index=True)
        g_table[seen] += np.add.reduceat(d_e[order], first)
        dh = dh * z + d_rh * r + d_zr @ u_zr.T
    return [g_table, g_zr, g_c]


def _label(states, w, b):
    logits = states @ w
    logits += b
    logits -= logits.max(-1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(-1, keepdims=True)
    return logits


def _scan(x: np.ndarray, p, readout: np.ndarray, logits: np.ndarray, backwards: bool) -> None:
    """Run one direction over x (steps, n) and add its share of the label scores to `logits` (steps, labels, n).

    The same arithmetic as `_run`, laid out with one row per hidden unit, which is what numpy does fastest.
    """
    table, u_zr, u_c = p
    hidden = u_c.shape[0]
    table, u_zr, u_c = np.ascontiguousarray(table.T), np.ascontiguousarray(u_zr.T * 0.25), np.ascontiguousarray(u_c.T)
    table[: 2 * hidden] = table[: 2 * hidden] * 0.25 + 0.5
    h = np.zeros((hidden, x.shape[1]), np.float32)
    e = np.empty((3 * hidden, x.shape[1]), np.float32)
    zr, c = np.empty_like(e[: 2 * hidden]), np.empty_like(h)
    for t in range(x.shape[0] - 1, -1, -1) if backwards else range(x.shape[0]):
        np.take(table, x[t], axis=1, out=e, mode="clip")
        np.matmul(u_zr, h, out=zr)
        zr += e[: 2 * hidden]
        np.maximum(zr, 0, out=zr)
        np.minimum(zr, 1, out=zr)
        zr[hidden:] *= h
        np.matmul(u_c, zr[hidden:], out=c)
        c += e[2 * hidden :]
        np.tanh(c, out=c)
        h -= c
        h *= zr[:hidden]
        h += c
        logits[t] += readout.T @ h


def position_probabilities(x: np.ndarray, model: dict) -> np.ndarray:
    """Label probabilities of every byte: x (steps, n) -> (steps, labels, n)."""
    w = model["weights"]
    hidden = w[2].shape[0]
    logits = np.empty((x.shape[0], len(w[7]), x.shape[1]), np.float32)
    logits[:] = w[7][:, None]
    _scan(x, w[0:3], w[6][:hidden], logits, False)
    _scan(x, w[3:6], w[6][hidden:], logits, True)
    for step in logits:
        step -= step.max(0)
        np.exp(step, out=step)
        step /= step.sum(0)
    return logits


def segments(raw: list[bytes], length: int = SEGMENT):
    """Cut texts into segments of `length` bytes, the last of a text filled with zeros: bytes (n, length), owner, real bytes."""
    sizes = np.array([len(x) for x in raw], np.int64)
    counts = -(-sizes // length)
    owner, place = ragged(counts)
    used = np.minimum(length, sizes[owner] - place * length)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    out = np.zeros((len(owner), length), np.uint8)
    out[np.arange(length) < used[:, None]] = flat
    return out, owner, used


def fit(texts: list, labels: list, hidden: int = 6, epochs: int = 6, batch: int = 192, rate: float = 0.01, seed: int = 7, most_segments: int = 8, least_steps: int = 300) -> dict:
    """Train the network on labelled texts; of each text up to `most_segments` segments, spread evenly, are used.

    All segments are gone through `epochs` times, and again until at least `least_steps` steps are taken.
    """
    classes = sorted(set(labels))
    rng = np.random.default_rng(seed)
    x, owner, used = segments(encoded(texts))
    place = ragged(np.bincount(owner, minlength=len(texts)))[1] if len(owner) else owner
    total = np.bincount(owner, minlength=len(texts))
    step = -(-total // most_segments)
    x, owner, used = (a[(place % step[owner]) == 0] for a in (x, owner, used)) if len(owner) else (x, owner, used)
    y = np.array([classes.index(labels[i]) for i in owner], np.int64)
    k = max(1, len(classes))
    normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    weights = [normal(256, 3 * hidden), normal(hidden, 2 * hidden), normal(hidden, hidden),
               normal(256, 3 * hidden), normal(hidden, 2 * hidden), normal(hidden, hidden), normal(2 * hidden, k), np.zeros(k, np.float32)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    share = np.bincount(y, minlength=k) if len(y) else np.ones(k)
    balance = (len(y) / k / np.maximum(share, 1)) ** 0.5
    epochs = max(epochs, -(-least_steps // max(1, len(y) // batch))) if len(y) else 0
    n_steps = max(1, epochs * max(1, len(y) // batch))
    step_no = 0
    for _ in range(epochs if k > 1 else 0):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            step_no += 1
            xb, yb = np.ascontiguousarray(x[rows].T), y[rows]
            kept_f, kept_b = [], []
            states = np.concatenate([_run(xb, weights[0:3], kept_f), _run(xb[::-1], weights[3:6], kept_b)[::-1]], -1)
            d = _label(states, weights[6], weights[7])
            d[:, np.arange(len(rows)), yb] -= 1
            d *= ((np.arange(SEGMENT)[:, None] < used[rows]) * balance[yb])[:, :, None]
            d = (d / max(1, used[rows].sum())).astype(np.float32)
            flat = states.reshape(-1, states.shape[-1])
            d_states = d @ weights[6].T
            grads = _back(xb, weights[0:3], kept_f, d_states[:, :, :hidden]) + _back(xb[::-1], weights[3:6], kept_b, d_states[::-1, :, hidden:])
            grads += [flat.T @ d.reshape(-1, k), d.sum((0, 1))]
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            lr = rate * min(1.0, 2 * (1 - step_no / (n_steps + 1)))
            for i, g in enumerate(grads):
                g = g * min(1.0, 1 / (norm + 1e-12))
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                weights[i] -= (lr * (first[i] / (1 - 0.9**step_no)) / (np.sqrt(second[i] / (1 - 0.99**step_no)) + 1e-8)).astype(np.float32)
    return {"classes": classes, "weights": weights}


def document_probabilities(raw: list[bytes], model: dict) -> np.ndarray:
    """Mean label probabilities over all bytes of each text."""
    total = np.zeros((len(raw), max(1, len(model["classes"]))))
    x, owner, used = segments(raw)
    for start in range(0, len(owner), BLOCK):
        part = slice(start, start + BLOCK)
        p = position_probabilities(np.ascontiguousarray(x[part].T), model)
        for step in np.flatnonzero(np.arange(SEGMENT) >= used[part].min()):
            p[step] *= step < used[part]
        np.add.at(total, owner[part], p.sum(0).T)
    return total / np.maximum(1, [len(b) for b in raw])[:, None]


def fit_languages(docs: DataFrame, where=None, max_rows: int = 1500, **settings) -> dict:
    """Fit on at most `max_rows` rows with a language, those of the smallest hash of text, so that reruns agree.

    Rows without text, language or letter are left out. With no row at all the model knows no language.
    """
    rows = docs.filter(F.col("text").rlike(_LETTER))
    rows = sampled_texts(rows if where is None else rows.filter(where), "lang", max_rows)
    return fit([text for text, _ in rows], [lang for _, lang in rows], **settings)


def languages(docs: DataFrame, model: dict) -> DataFrame:
    """`docs` with lang_pred and score, the mean probability of that language over all bytes of the whole text.

    A null text or one without a letter is `und` with score 0; so is every text if the model knows no language. Of equal
    probabilities the first language by name wins. Columns of those two names are replaced; others stay as they are.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")

    def predict(batches):
        import regex

        fitted, letter = weights.value, regex.compile(_LETTER).search
        for frame in batches:
            texts = frame["text"].tolist()
            p = document_probabilities(encoded(texts), fitted)
            known = np.array([bool(fitted["classes"]) and isinstance(t, str) and bool(letter(t)) for t in texts], bool)
            best = p.argmax(1) if len(frame) else np.zeros(0, int)
            out = frame[outside]
            out["lang_pred"] = [fitted["classes"][b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            out["score"] = np.where(known, np.clip(p.max(1, initial=0), 0, 1), 0.0)
            yield out

    outside = list(kept.columns)
    return shielded(kept, predict, lang_pred="string", score="double")
