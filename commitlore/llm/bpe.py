"""Byte-level pair encoding of a whole corpus, each distinct word encoded once, and decoding by the token-byte table.

Texts are split into pre-tokens in blocks of a bounded number of characters. A block sends each of its distinct words, once,
to the partition of that word; there every word of the corpus is encoded once, however many blocks hold it, and its ids go
back to the blocks that asked. A block's positions travel beside them, as the places of its words in text order, and
the ids are laid out by them. So no word makes more than one row a block, and no text is shuffled.
"""

import base64
import heapq
import itertools
import re
from array import array
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text in one block, a block holds whole texts: one text alone may be longer.
BLOCK_CHARS = 32_000_000
#: Pre-tokens laid out, and ids decoded, at a time; a text is not divided.
PIECES_AT_ONCE = DECODED_IDS = 500_000
#: A word's place in its block takes so many bits of a long, and a block's number the others.
_PLACE_BITS = 28
_MOST_WORDS, _MOST_BLOCKS = (1 << _PLACE_BITS) - 1, (1 << 12) - 1
#: The classes that a splitting pattern names; two regular expression libraries need not know the same Unicode version.
_CLASSES = (r"\p{L}", r"\p{N}", r"\s")
#: Signs that are a pre-token of their own after letters, at the end of a cutting.
_STOPS = frozenset(".,;:!?")


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a vocabulary file, one base64 token and one rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.read().splitlines())}


def split_pattern(pattern: str) -> str:
    """`pattern` for the `regex` module, with the letters, digits and spaces that the tiktoken library knows.

    Characters of younger Unicode versions count as letters in one library and not in the other. The library is asked
    once, on the driver, for the members of each class among all characters; where the two differ, the class is
    corrected by the ranges that differ.
    """
    import regex
    import tiktoken

    every = "".join(map(chr, itertools.chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    flags = ""
    for name in _CLASSES:
        probe = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = set(bytes(probe.encode_ordinary(every)).decode("utf-8"))
        ours = set(regex.findall(name, every))
        more, less = _ranges(theirs - ours), _ranges(ours - theirs)
        if not more and not less:
            continue
        flags = "(?V1)"
        inner = name + more
        right = f"[[{inner}]--[{less}]]" if less else f"[{inner}]"
        pattern = pattern.replace(name, right)
        if name == r"\s":
            pattern = pattern.replace(r"\S", f"[^{right}]")
    return flags + pattern


def _ranges(characters: set) -> str:
    """Members of a character class, as escaped ranges."""
    codes = sorted(map(ord, characters))
    out = []
    for _, run in itertools.groupby(enumerate(codes), lambda x: x[1] - x[0]):
        run = [c for _, c in run]
        out.append(rf"\U{run[0]:08X}-\U{run[-1]:08X}")
    return "".join(out)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: neighbours are merged, the pair of the least rank first, the leftmost of equals, until no pair is a token.

    Pairs wait in a heap; a merge leaves stale entries behind, known by their length. The work grows as n log n.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the next piece starts, where the one before does
    heap = []

    def offer(i):
        j = after[i]
        if j < n:
            rank = ranks.get(word[i : after[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, after[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or after[j] != end:
            continue
        alive[j], after[i] = False, end
        if end < n:
            before[end] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


def _split(batches, pattern: str, most_chars: int):
    """Blocks of whole texts: (number, check, doc_ids, pre-tokens of each text, words in order of appearance, each pre-token's word).

    No pre-token reaches over a space but at its start, unless white space stands on both sides of it or a space ends the text
    after white space. So texts are cut at spaces, and the pattern runs once over each distinct cutting of a block;
    texts with such runs of white space go through the pattern whole. Cuttings are keyed by the text after their space,
    those without a space before them as a tuple.
    """
    import pyarrow as pa
    import regex
    import xxhash
    from pyspark import TaskContext

    find, run = regex.compile(pattern).findall, re.compile(r" (?<=\s )(?=\s|\Z)").search
    task, made = TaskContext.get().partitionId(), 0

    def pieces(cutting) -> Sequence[str]:
        text = cutting[0] if isinstance(cutting, tuple) else " " + cutting
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            return (text,)
        if word[-1:] in _STOPS and word[:-1].isalpha():
            return text[:-1], word[-1]
        return find(text)

    def block():
        places: dict[str, int] = defaultdict(itertools.count().__next__)
        flat, each = array("I"), array("I")
        for cutting in cuttings:
            parts = pieces(cutting)
            each.append(len(parts))
            flat.extend(map(places.__getitem__, parts))
        cuttings.clear()
        flat, each = np.array(flat, np.uint32), np.array(each, np.int64)
        starts = np.cumsum(each) - each
        counts, laid = [], []
        for k, c in enumerate(codes):
            n = each[c]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(c) else 0
            laid.append(flat[np.repeat(starts[c] - (ends - n), n) + np.arange(total)])
            counts.append(total)
            codes[k] = None
        words, positions = list(places), np.concatenate(laid)
        check = xxhash.xxh64(positions.tobytes())
        check.update("\n".join(words).encode())
        if made > _MOST_BLOCKS or len(words) > _MOST_WORDS:
            raise ValueError("too many blocks in a task, or words in a block")
        return task * (_MOST_BLOCKS + 1) + made, check.intdigest() & _MOST_WORDS, pa.chunked_array(ids).combine_chunks(), counts, words, positions

    ids, codes, cuttings, size = [], [], defaultdict(itertools.count().__next__), 0
    for batch in batches:
        done = 0
        for row, text in enumerate(t for k in range(0, len(batch), 1000) for t in _texts(batch.column("text").slice(k, 1000))):
            first, *rest = text.split(" ")
            keys = [(first,), *rest] if not run(text) else [(p,) for p in find(text)]
            codes.append(np.fromiter(map(cuttings.__getitem__, keys), np.uint32, len(keys)))
            size += len(text)
            if size >= most_chars:
                ids.append(batch.column("doc_id").slice(done, row + 1 - done))
                yield block()
                ids, codes, cuttings, size = [], [], defaultdict(itertools.count().__next__), 0
                done, made = row + 1, made + 1
        if done < len(batch):
            ids.append(batch.column("doc_id").slice(done))
    if codes:
        yield block()


def _texts(column) -> list[str]:
    """The texts of an Arrow column; a null is empty, bytes that are no UTF-8 are replaced."""
    import pyarrow as pa

    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        return [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]


def block_words(docs: DataFrame, pattern: str, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """(at, word): every distinct pre-token of a block, once. `at` is the block's number and the word's place in the block.

    One more row a block, whose word is null, has the block's check in place of a place.
    """

    def rows(batches):
        import pyarrow as pa

        for number, check, _, _, words, _ in _split(batches, pattern, most_chars):
            base = number << _PLACE_BITS
            yield pa.RecordBatch.from_arrays([pa.array([base | check]), pa.array([None], pa.binary())], names=["at", "word"])
            for i in range(0, len(words), 50_000):
                part = [w.encode() for w in words[i : i + 50_000]]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(base + i, base + i + len(part))), pa.array(part, pa.binary())], names=["at", "word"])

    return docs.select("doc_id", "text").mapInArrow(rows, "at long, word binary")


def block_positions(docs: DataFrame, pattern: str, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row a block: its number and check, its doc_ids, the number of pre-tokens of each text, the number of words, and positions.

    Positions are each pre-token's place among the block's words, one byte of all places after the other, compressed.
    """
    doc_id = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("check", T.LongType()), T.StructField("doc_ids", T.ArrayType(doc_id)),
        T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("n_words", T.IntegerType()), T.StructField("positions", T.ArrayType(T.BinaryType())),
    ])

    def rows(batches):
        import pyarrow as pa

        for number, check, ids, counts, words, positions in _split(batches, pattern, most_chars):
            planes = np.ascontiguousarray(positions.astype("<u4").view(np.uint8).reshape(-1, 4).T)
            packed = [pa.compress(plane.tobytes(), codec="zstd", asbytes=True) for plane in planes] if len(positions) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([check]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                 pa.array([counts], pa.list_(pa.int32())), pa.array([len(words)], pa.int32()), pa.array([packed], pa.list_(pa.binary()))],
                names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def word_ids(words: DataFrame, vocabulary: str) -> DataFrame:
    """(block, ids) of (at, word): words meet in one global shuffle, and each distinct one is encoded once.

    `ids` is the word's place in 4 bytes, then its ids, of 2 bytes each where the vocabulary allows it, else of 4.
    """
    ranks = load_ranks(vocabulary)
    kind = id_kind(len(ranks))
    shared = words.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: some tens of thousands of tokens

    def rows(batches):
        import pyarrow as pa

        table, last, ids = shared.value, None, b""
        for batch in batches:
            out = []
            at = batch.column("at").to_numpy()
            places = (at & _MOST_WORDS).astype("<u4").tobytes()
            for i, word in enumerate(batch.column("word").to_pylist()):
                if word != last:
                    last, ids = word, b"" if word is None else np.array(merged(word, table), kind).tobytes()
                out.append(places[4 * i : 4 * i + 4] + ids)
            yield pa.RecordBatch.from_arrays([pa.array(at >> _PLACE_BITS), pa.array(out, pa.binary())], names=["block", "ids"])

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(rows, "block long, ids binary")


def id_kind(tokens: int) -> np.dtype:
    return np.dtype("<u2") if tokens <= 1 << 16 else np.dtype("<u4")


def encode(docs: DataFrame, vocabulary: str, pattern: str, most_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) of every whole text, as the tiktoken library would give them without special tokens.

    A null text is empty and has no ids; repeated rows and null doc_ids come back as often as they stand there; an
    empty table gives no rows; other columns are ignored. A text may be of any length that a row can hold. `docs` is read
    twice, so its rows must come in the same order again: files do, other tables should be written first. A block whose
    second reading differs is an error, not a wrong result.
    """
    right = split_pattern(pattern)
    with_ids = word_ids(block_words(docs, right, most_chars), vocabulary)
    blocks = block_positions(docs, right, most_chars)
    kind = id_kind(len(load_ranks(vocabulary)))
    doc_id = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("doc_id", doc_id.dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def laid_out(block, words):
        import pyarrow as pa

        rows = sorted(words.column("ids").to_pylist(), key=len)  # the check is among those without ids, and no word is
        if len(block) != 1 or len(rows) != block.column("n_words")[0].as_py() + 1 or rows[0] != block.column("check")[0].as_py().to_bytes(4, "little"):
            raise ValueError("the documents were read twice and differ: write them to a table first")
        rows = rows[1:]
        places = np.frombuffer(b"".join([r[:4] for r in rows]), "<u4")
        order = np.argsort(places)
        lengths = (np.fromiter(map(len, rows), np.int64, len(rows))[order] - 4) // kind.itemsize
        ids = np.frombuffer(b"".join([rows[i][4:] for i in order.tolist()]), kind)
        starts = np.cumsum(lengths) - lengths
        counts = np.array(block.column("counts")[0].as_py(), np.int64)
        total = int(counts.sum())
        planes = [np.frombuffer(pa.decompress(p, total, codec="zstd", asbytes=True), np.uint8) for p in block.column("positions")[0].as_py()]
        owners = block.column("doc_ids").combine_chunks().flatten()
        tables, done = [], 0
        cuts = np.flatnonzero(np.diff(np.cumsum(counts) // PIECES_AT_ONCE, prepend=0)) + 1
        text_ends = np.cumsum(counts)
        for end in sorted({*cuts.tolist(), len(counts)}):
            a, b = int(text_ends[done - 1]) if done else 0, int(text_ends[end - 1])
            codes = np.ascontiguousarray(np.stack([p[a:b] for p in planes], axis=1)).view("<u4").ravel() if b > a else np.zeros(0, np.uint32)
            each = lengths[codes]
            ends = np.cumsum(each)
            values = ids[np.repeat(starts[codes] - (ends - each), each) + np.arange(int(each.sum()))]
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts[done:end])])]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int32)))
            tables.append(pa.Table.from_arrays([owners.slice(done, end - done), lists], names=schema.names))
            done = end
        return pa.concat_tables(tables)

    return blocks.groupBy("block").cogroup(with_ids.groupBy("block")).applyInArrow(laid_out, schema)


def token_bytes(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes laid end to end by id, and where each one starts."""
    ranks = load_ranks(vocabulary)
    size = max(ranks.values()) + 1
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def decode(encoded: DataFrame, vocabulary: str, output: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of its `ids` in a new binary column.

    The token-byte table is joined on the map side: it has a row a token, under a megabyte, and goes to every task; ids
    take their bytes from it in the order they stand. Null ids give null bytes, no ids the empty ones; an id without a
    token is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))
    schema = T.StructType([*encoded.schema.fields, T.StructField(output, T.BinaryType())])

    def joined(ids: np.ndarray, table: np.ndarray, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(starts) - 1):
            raise ValueError("an id has no token")
        each = starts[ids + 1] - starts[ids]
        ends = np.cumsum(each)
        where = np.repeat(starts[ids] - (ends - each), each) + np.arange(int(each.sum()))
        return table[where].tobytes(), np.concatenate([[0], ends])

    def rows(batches):
        import pyarrow as pa

        table, starts = shared.value
        for batch in batches:
            lists, done = batch.column("ids"), 0
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // DECODED_IDS, prepend=0))
            for end in [*cuts.tolist(), len(batch)]:
                if end == done and end < len(batch):
                    continue
                part = batch.slice(done, end - done)
                column = part.column("ids")
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                text, at = joined(flat, table, starts)
                bounds = at[np.concatenate([[0], np.cumsum(sizes[done:end])]).astype(np.int64)].tolist()
                out = [None if null else text[a:b] for a, b, null in zip(bounds, bounds[1:], column.is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=schema.names)
                done = end

    return encoded.mapInArrow(rows, schema)
