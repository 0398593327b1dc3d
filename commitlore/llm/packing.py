"""Token ids packed into rows of one length: best-fit decreasing, with a segment tree over room left.

Each task tokenizes the texts it reads, collects pieces up to a fixed number of tokens and packs them; nothing is
shuffled. Texts longer than a row are cut into pieces without loss. A packed row holds its ids as little-endian
bytes, the cumulative lengths of its segments, and the position with which each segment starts.
"""

import base64
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlore.llm.common import small_batches

#: Byte-level pairs of 50 256 tokens; the free id after them ends each text.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts part into pieces before pairs are merged, as this vocabulary was made (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ROW_TOKENS = 2048
#: Tokens that a task packs at a time.
BUFFER_TOKENS = 4_000_000
#: Words whose ids a task remembers, those it meets first.
MEMORY = 500_000
_STOPS = frozenset(".,;:!?")
#: A space with white space on both sides: only there do ids depend on more than a space and the word after it.
_RUN = re.compile(r"\s \s")

PACKED = T.StructType([
    T.StructField("row_id", T.StringType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("position_starts", T.ArrayType(T.IntegerType())),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("parts", T.ArrayType(T.IntegerType())),
])


class Tokens:
    """Ids of texts as arrays, by a byte-pair vocabulary given as the content of its file."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.codec = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)
        self.kind = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}

    def _ids(self, piece: str) -> bytes:
        known = self.known
        if piece[1:].isalpha():
            ids = self.codec._encode_single_piece(piece)
        elif piece[-1:] in _STOPS and piece[1:-1].isalpha():
            # letters, then one sign: two pieces, the first often known
            out = (known.get(piece[:-1]) or self._ids(piece[:-1])) + (known.get(piece[-1]) or self._ids(piece[-1]))
            if len(known) < MEMORY:
                known[piece] = out
            return out
        else:
            ids = self.codec.encode_ordinary(piece)
        out = array(self.kind.char, ids).tobytes()
        if len(known) < MEMORY:
            known[piece] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of the text, then the end.

        No piece of the pattern reaches over a space but at its start, unless white space stands on both sides of
        it; so texts are encoded word by word, each with its space before it, and a word's ids are remembered.
        """
        if _RUN.search(text):
            return np.array([*self.codec.encode_ordinary(text), self.end], self.kind)
        get, make = self.known.get, self._ids
        first, *rest = text.split(" ")
        blocks = [make(first)]
        blocks += [get(piece) or make(piece) for piece in map(" ".__add__, rest)]
        blocks.append(self.end.to_bytes(self.kind.itemsize, "little"))
        return np.frombuffer(b"".join(blocks), self.kind)

    def decode(self, ids) -> str:
        return self.codec.decode([int(i) for i in ids if i != self.end])


def best_fit(lengths: list[int], room: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the open bin with the least room that holds it.

    A segment tree over amounts of room counts the open bins below each node; the search for the smallest
    sufficient amount goes up from its leaf until a right neighbour has bins, then down.
    """
    leaves = 1 << max(1, room).bit_length()
    count = [0] * (2 * leaves)
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    bins: list[list[int]] = []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[piece]
        node = leaves + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node > 1:
                node += 1
                while node < leaves:
                    node = 2 * node if count[2 * node] else 2 * node + 1
        if node > 1:
            left = node - leaves
            chosen = by_room[left].pop()
            while node:
                count[node] -= 1
                node >>= 1
        else:
            left, chosen = room, len(bins)
            bins.append([])
        bins[chosen].append(piece)
        left -= need
        by_room[left].append(chosen)
        node = leaves + left
        while node:
            count[node] += 1
            node >>= 1
    return bins


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, row_tokens: int = ROW_TOKENS, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """Packed rows of all whole texts: row_id, n_tokens, ids, cu_seqlens, position_starts, doc_ids, parts.

    Every text ends with the end id; null and empty texts are that id alone. `ids` has `row_tokens` ids of 2 or 4
    bytes, filled up with the end id; of these `n_tokens` count. Segment k of a row has the ids from cu_seqlens[k] to cu_seqlens[k+1]
    and is piece parts[k] of document doc_ids[k]. Positions start anew with every segment, at position_starts[k]: 0 for
    whole texts and first pieces, for later pieces the number of ids before them in their text. Pieces of one text
    have consecutive numbers, so texts can be put together again. Repeated rows are packed as often as
    they stand there, a null doc_id stays null, an empty table gives no rows, other columns are ignored.
    """
    with open(vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file: under a megabyte

    def rows(batches):
        import pandas as pd
        from pyspark import TaskContext

        tokens = Tokens(content.value)
        end = np.full(row_tokens, tokens.end, tokens.kind)
        task, made = TaskContext.get().partitionId(), 0

        def packed(pieces):
            nonlocal made
            out = []
            for chosen in best_fit([len(p[2]) for p in pieces], row_tokens):
                part = [pieces[i] for i in chosen]
                bounds = np.cumsum([0, *(len(p[2]) for p in part)])
                ids = np.concatenate([*(p[2] for p in part), end[: row_tokens - bounds[-1]]])
                out.append((f"{task}-{made}", int(bounds[-1]), ids.tobytes(), bounds.tolist(), [p[1] * row_tokens for p in part],
                            [p[0] for p in part], [p[1] for p in part]))
                made += 1
            return pd.DataFrame(out, columns=PACKED.names)

        held, size = [], 0
        for frame in batches:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = tokens.encode(text if isinstance(text, str) else "")
                doc_id = None if doc_id is None else int(doc_id)
                held.extend((doc_id, k, ids[i : i + row_tokens]) for k, i in enumerate(range(0, len(ids), row_tokens)))
                size += len(ids)
                if size >= buffer_tokens:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    # ids pass as text: a frame with a null would hold numbers as floats
    return small_batches(docs.select(F.col("doc_id").cast("string"), "text")).mapInPandas(rows, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows: each Parquet part holds a matrix of ids, one row a line, with its lengths and positions."""
    packed.write.parquet(path)


def matrices(rows: list, row_tokens: int = ROW_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Id matrix and position matrix of collected packed rows, as a trainer takes them; positions of filling are 0."""
    kind = np.dtype("<u2") if rows and len(rows[0]["ids"]) == 2 * row_tokens else np.dtype("<u4")
    ids = np.array([np.frombuffer(r["ids"], kind) for r in rows]).reshape(len(rows), row_tokens)
    positions = np.zeros((len(rows), row_tokens), np.int64)
    for i, r in enumerate(rows):
        for a, b, start in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["position_starts"]):
            positions[i, a:b] = np.arange(start, start + b - a)
    return ids, positions
