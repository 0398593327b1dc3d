"""Helpers of the text operators."""

import sys
import types

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch: texts may be long, and a batch stands in a task's memory as a whole.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Arrow batches hold at most BATCH_ROWS rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def fold(column, parts: int):
    """crc32 of the column as text, modulo `parts`; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % parts


def extended(df: DataFrame, **columns) -> T.StructType:
    """The schema of `df` with more columns, given as name=type."""
    kind = lambda t: T.StructType.fromDDL(f"x {t}")[0].dataType if isinstance(t, str) else t
    return T.StructType([*df.schema.fields, *(T.StructField(c, kind(t)) for c, t in columns.items())])


def shielded(df: DataFrame, function, **added) -> DataFrame:
    """`df.mapInPandas(function)`, which adds the columns given as name=type; numbers pass the workers as text and come back whole.

    In a frame with a null whole numbers would be floats, and large ids would change.
    """
    numbers = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    texts = df.select(*(F.col(f"`{c}`").cast("string").alias(c) if c in numbers else F.col(f"`{c}`") for c in df.columns))
    out = small_batches(texts).mapInPandas(function, extended(texts, **added))
    return out.select(*(F.col(f"`{c}`").cast(df.schema[c].dataType).alias(c) if c in numbers else F.col(f"`{c}`") for c in out.columns))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def encoded(texts) -> list[bytes]:
    """UTF-8 bytes of each text; a missing one is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of these lengths laid end to end: the piece of each element, and its place in the piece."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return owner, np.arange(int(lengths.sum())) - np.repeat(starts, lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers: multiply and shift, with odd constants."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(words: list) -> np.ndarray:
    """A 64-bit hash of each word; each different word is hashed once."""
    import pandas as pd

    if not words:
        return np.zeros(0, np.uint64)
    codes, distinct = pd.factorize(np.array(words, dtype=object))
    return pd.util.hash_array(distinct, categorize=False)[codes]


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for tables that each task would build again."""
    module = sys.modules.setdefault("_commitlore_worker", types.ModuleType("_commitlore_worker"))
    return module.__dict__.setdefault("cache", {})



#: Bytes of plain words: ASCII letters in lower case and digits; every byte beyond ASCII stays; all others part words.
_PLAIN = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(256)).lower())


def plain_words(raw: bytes) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return raw.translate(_PLAIN).split()


def buffered(frames, most_chars: int, column: str = "text"):
    """Join batches until they hold `most_chars` characters; one batch alone may hold more."""
    import pandas as pd

    held, size = [], 0
    for frame in frames:
        held.append(frame)
        size += int(frame[column].str.len().fillna(0).sum())
        if size >= most_chars:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


#: Characters of text that a sample brings to the driver, whatever its number of rows.
SAMPLE_CHARS = 12_000_000


def sampled_texts(docs: DataFrame, label: str, max_rows: int, labels: DataFrame | None = None, most_chars: int = SAMPLE_CHARS) -> list:
    """(text, label) of at most `max_rows` different texts and `most_chars` characters, those of the smallest hash of text.

    A text of more than a twentieth of the characters comes after all others, and only if it still fits; if none
    fits, the beginning of the shortest is the sample. So no long text keeps others out.
    The label is a column of `docs`, or of `labels` by doc_id. Hashes alone are sorted; the chosen rows then come by a join
    with their list, which is bounded. Of rows with one text the smallest doc_id speaks; null doc_ids and texts do not.
    """
    keyed = docs.filter("doc_id is not null and text is not null").withColumn("_h", F.xxhash64("text")).withColumn("_n", F.char_length("text"))
    narrow = keyed.select("doc_id", "_h", "_n", *([] if labels is not None else [label]))
    narrow = narrow if labels is None else narrow.join(labels.select("doc_id", label), "doc_id")
    first = F.min(F.struct("doc_id", label, "_n")).alias("row")
    rows = narrow.filter(F.col(label).isNotNull()).groupBy("_h").agg(first).orderBy("_h").limit(max_rows).select("_h", "row.*").collect()
    if not rows:
        return []
    chosen, left = set(), most_chars
    for k, r in sorted(enumerate(rows), key=lambda x: (20 * x[1]["_n"] > most_chars, x[0])):
        if r["_n"] <= left:
            chosen.add(k)
            left -= r["_n"]
    rows = [r for k, r in enumerate(rows) if k in chosen] or [min(rows, key=lambda r: r["_n"])]
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"], r["_h"]) for r in rows], "doc_id long, _h long"))
    found = {r["_h"]: r["text"] for r in keyed.join(wanted, ["doc_id", "_h"]).dropDuplicates(["_h"]).select("_h", F.substring("text", 1, most_chars).alias("text")).collect()}
    return [(found[r["_h"]], r[label]) for r in rows]
