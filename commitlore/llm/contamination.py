"""Benchmark passages in texts: one Aho-Corasick automaton over all windows of the benchmark, and one scan of each text.

A window is 13 consecutive words of an item, or a whole shorter item. Texts are scanned in a plain form (words parted by
one space); hits are mapped back to words and to characters of the original.
"""

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlore.llm.common import encoded, plain_words, shielded, worker_cache

WINDOW = 13
#: Characters of benchmark text up to which one automaton stands in each Python worker (about 100 bytes of memory each).
AUTOMATON_CHARS = 1_500_000


def item_windows(words: list[bytes], window: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def _automaton(items: list[tuple[str | None, str]], window: int):
    import ahocorasick

    by_window: dict[bytes, set] = {}
    for item, text in items:
        for w in item_windows(plain_words(text.encode("utf-8", "surrogatepass")), window):
            by_window.setdefault(w, set()).update([] if item is None else [item])
    machine = ahocorasick.Automaton()
    for w, found in by_window.items():
        machine.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, sorted(found)))
    if by_window:
        machine.make_automaton()
    return machine if by_window else None


def scan(words: list[bytes], machine) -> tuple[np.ndarray, set]:
    """Which words are inside an occurrence of a window, and the items whose windows occur."""
    hit, items = np.zeros(len(words), bool), set()
    if machine is None or not words:
        return hit, items
    found = list(machine.iter(f" {b' '.join(words).decode('latin-1')} "))
    if found:
        ends = np.cumsum([len(w) + 1 for w in words])  # the space after each word, in the padded text
        last = np.searchsorted(ends, [end for end, _ in found])
        for k, (_, (n, names)) in zip(last, found, strict=True):
            hit[k - n + 1 : k + 1] = True
            items.update(names)
    return hit, items


def _blocks(benchmark: DataFrame, most_chars: int) -> list[list[tuple[str | None, str]]]:
    """The items in blocks of at most `most_chars` characters, or one longer item: one block unless the benchmark is large."""
    blocks, size = [[]], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("text is not null").toLocalIterator():
        if blocks[-1] and size + len(r["text"]) > most_chars:
            blocks.append([])
            size = 0
        blocks[-1].append((r["item"], r["text"]))
        size += len(r["text"])
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """`docs` with n_words, hit_words (places of hit words), items (sorted as strings), hit_spans (start, end in bytes of the text).

    Both tables' words: letters, digits and characters beyond ASCII, A-Z in lower case. Null texts have no words and no hits; items
    without text or words have no window, and windows of items without id hit words but name no item; several items may share a window or an id. An empty benchmark hits nothing. A benchmark beyond
    `most_chars` is held in blocks, one automaton after another passing over each batch, so a worker holds one at a time.
    Columns of these four names are replaced, others stay.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    added = {"n_words": "long", "hit_words": "array<int>", "items": "array<string>", "hit_spans": span}
    kept = docs.drop(*added)
    outside = list(kept.columns)
    context = docs.sparkSession.sparkContext
    call = uuid.uuid4().hex
    shared = [context.broadcast(b) for b in _blocks(benchmark, most_chars)]

    def machine(k):
        # one automaton a worker: that of an earlier call, or of another block, goes before the next is built
        cache, key = worker_cache(), (call, k)
        if cache.get("automaton", (None,))[0] != key:
            cache.pop("automaton", None)
            cache["automaton"] = (key, _automaton(shared[k].value, window))
        return cache["automaton"][1]

    def find(batches):
        for frame in batches:
            words = [plain_words(t) for t in encoded(frame["text"])]
            hits = [(np.zeros(len(w), bool), set()) for w in words]
            for k in range(len(shared)):
                own = machine(k)
                for (hit, items), w in zip(hits, words, strict=True):
                    more, names = scan(w, own)
                    hit |= more
                    items |= names
            out = frame[outside]
            out["n_words"] = [len(w) for w in words]
            out["hit_words"] = [np.flatnonzero(hit).astype("int32") for hit, _ in hits]
            out["items"] = [sorted(items) for _, items in hits]
            out["hit_spans"] = [_spans(t, hit) if hit.any() else [] for t, (hit, _) in zip(frame["text"], hits, strict=True)]
            yield out

    return shielded(kept, find, **added)


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words as byte ranges of the original text."""
    places = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.encode("utf-8", "surrogatepass"))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in edges.reshape(-1, 2)]


def contaminated(n_hit, n_words):
    """The rule: some word is hit, and hit words are a twentieth of all words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents that the rule leaves, with their columns."""
    found = contamination(docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c != "text"}), benchmark, **settings)
    clean = found.filter(~contaminated(F.size("hit_words"), F.col("n_words")))
    return clean.select(*(F.col("text") if c == "text" else F.col(f"_own_{c}").alias(c) for c in docs.columns))
