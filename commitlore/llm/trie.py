"""The prefix trie of conversations: what they share from their first turn on, with totals of every subtree.

Texts become digests where they are read; nothing but digests and numbers is shuffled. A prefix is known by the digest of its
turns in order, so equal prefixes meet by a grouping. Totals go up the trie by time-forward processing: nodes are
sorted by reverse level order, each node takes the messages of its children from a priority queue and sends its own
totals to its parent, later in the order. Subtrees of a bounded number of turns are shards, processed side by side; what
their roots send goes on to the few nodes above them, processed last.
"""

import hashlib
import heapq
import pickle
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlore.llm.common import shuffle_partitions
from commitlore.session import stage

#: Messages that a queue holds before it writes them to a file.
HELD_MESSAGES = 200_000
#: Shards hold at least so many turns, and about a fourth of a partition's share: there are a few shards a partition.
LEAST_SHARD, SHARDS_A_PARTITION = 64, 4
#: Ids in one piece of a list of members.
PIECE_IDS = 50_000
#: The root's digest; every other prefix has a digest of its parent's and its last turn's.
ROOT = bytes(16)
WORD = r"[^\x20\x09-\x0D]+"


def turn_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, nth, digest, words) of conversation rows: turns by number from 1, ordered by turn, nulls first, then role and digest.

    A null role or text is empty. The digest is of both, `words` the number of words of the text. Rows without a
    conv_id belong to no conversation and go.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    narrow = rows.filter("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.substring(F.unhex(F.sha2(told, 256)), 1, 16).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return narrow.select("conv_id", F.row_number().over(by_turn).alias("nth"), "digest", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, nth, digest, words): each conversation c begins with the first h turns of c - c % 20, h = crc32(c) % 4, then goes on with its own after its first h.

    Every conversation has one more row, of nth 0 and no digest, so that one without turns is not lost. `turns` is read
    three times.
    """
    borrowed = F.crc32(F.col("conv_id").cast("string")) % 4
    ids = turns.filter("nth = 1").select("conv_id", borrowed.alias("h"))
    first = turns.filter("conv_id % 20 = 0 and nth <= 3").withColumnRenamed("conv_id", "base")
    taken = ids.filter("h > 0").withColumn("base", F.expr("conv_id - conv_id % 20")).join(first, "base").filter("nth <= h")
    own = turns.filter(F.col("nth") > borrowed)
    roots = ids.select("conv_id", F.lit(0).alias("nth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return roots.unionByName(taken.select(*roots.columns)).unionByName(own.select(*roots.columns))


PREFIXES = T.StructType([
    T.StructField("node", T.BinaryType()), T.StructField("parent", T.BinaryType()), T.StructField("conv_id", T.LongType()),
    T.StructField("depth", T.LongType()), T.StructField("words", T.LongType()), T.StructField("below", T.LongType()),
])


def prefixes(turns: DataFrame) -> DataFrame:
    """One row for every prefix of every conversation: its digest and its parent's, the turns below it in this conversation.

    `turns` has a row of nth 0 for each conversation, whose prefix is the root. A task streams over conversations, by nth.
    """
    dealt = turns.repartition("conv_id").withColumn("n", F.count("*").over(Window.partitionBy("conv_id")))

    def rows(frames):
        import pandas as pd

        now, node, depth = None, ROOT, 0
        for frame in frames:
            nodes, parents, depths = [], [], []
            for conv, digest in zip(frame["conv_id"].tolist(), frame["digest"].tolist()):
                if conv != now:
                    now, node, depth, parent = conv, ROOT, 0, None
                else:
                    parent, depth = node, depth + 1
                    node = hashlib.blake2b(node + bytes(digest), digest_size=16).digest()
                nodes.append(node)
                parents.append(parent)
                depths.append(depth)
            yield pd.DataFrame({"node": nodes, "parent": parents, "conv_id": frame["conv_id"], "depth": depths, "words": frame["words"],
                                "below": frame["n"] - 1 - depths})

    return dealt.sortWithinPartitions("conv_id", "nth").mapInPandas(rows, PREFIXES)


class SpillingQueue:
    """A priority queue of tuples in bounded memory: when it holds too many, they go to a file as one sorted run."""

    def __init__(self, most: int = HELD_MESSAGES):
        self.most, self.heap, self.heads, self.runs = most, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.most:
            run = self._run(sorted(self.heap))
            self.heap = []
            heapq.heappush(self.heads, (next(run), self.runs, run))  # of equal items the older run's comes first
            self.runs += 1

    @staticmethod
    def _run(items: list):
        file = tempfile.TemporaryFile()
        for i in range(0, len(items), 1000):
            pickle.dump(items[i : i + 1000], file, pickle.HIGHEST_PROTOCOL)
        size = len(items)
        del items
        file.seek(0)
        yield from (item for _ in range(0, size, 1000) for item in pickle.load(file))
        file.close()

    def least(self) -> tuple | None:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            return self.heads[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        item = self.least()
        if self.heap and item is self.heap[0]:
            return heapq.heappop(self.heap)
        _, number, run = self.heads[0]
        following = next(run, None)
        if following is None:
            heapq.heappop(self.heads)
        else:
            heapq.heapreplace(self.heads, (following, number, run))
        return item


TOTALS = T.StructType([
    T.StructField("node", T.BinaryType()), T.StructField("parent", T.BinaryType()), T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()),
    T.StructField("n_convs", T.LongType()), T.StructField("top", T.BooleanType()),
    T.StructField("n_children", T.LongType()), T.StructField("n_leaves", T.LongType()), T.StructField("saved_tokens", T.LongType()),
])


def time_forward(nodes: DataFrame, held: int = HELD_MESSAGES) -> DataFrame:
    """TOTALS of `nodes`, shard by shard, in reverse level order: each partition has its shards whole, sorted by (shard, depth descending, node).

    `nodes` has the columns of TOTALS, where the totals are what children outside the shard have sent, and `words`
    and `shard`. A `top` node sends nothing on: its parent, if it has one, is outside.
    """

    def rows(frames):
        import pandas as pd

        queue, shard = SpillingQueue(held), None
        for frame in frames:
            out = []
            columns = ["shard", *TOTALS.names, "words"]
            for key, node, parent, conv, depth, n_convs, top, children, leaves, saved, words in zip(*(frame[c].tolist() for c in columns)):
                if key != shard:
                    if queue.least() is not None:
                        raise ValueError("a message found no node")
                    shard = key
                at = (-depth, bytes(node))
                while (least := queue.least()) is not None and least[:2] == at:
                    _, _, _, more, tokens = queue.pop()
                    children, leaves, saved = children + 1, leaves + more, saved + tokens
                leaves += not children
                saved += (n_convs - 1) * words
                if not top:
                    queue.push((1 - depth, bytes(parent), at[1], leaves, saved))
                out.append((node, parent, conv, depth, n_convs, top, children, leaves, saved))
            yield pd.DataFrame(out, columns=TOTALS.names)
        if queue.least() is not None:
            raise ValueError("a message found no node")

    return nodes.mapInPandas(rows, TOTALS)


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the hash of each node's conv_ids, ascending, joined by commas.

    Ids are dealt by ranges of (node, conv_id), so a node that a third of all conversations end in is many tasks' work; the
    pieces of its list, texts of some hundred kilobytes, are hashed in order as they come.
    """

    def pieces(frames):
        import pandas as pd

        for frame in frames:
            out, start = [], 0
            nodes, ids = frame["node"].tolist(), frame["conv_id"].tolist()
            for i in range(1, len(nodes) + 1):
                if i == len(nodes) or nodes[i] != nodes[start] or i - start == PIECE_IDS:
                    out.append((nodes[start], ids[start], ",".join(map(str, ids[start:i]))))
                    start = i
            yield pd.DataFrame(out, columns=["node", "first", "ids"])

    def hashed(frames):
        import pandas as pd

        now = digest = None
        for frame in frames:
            out = []
            for node, ids in zip(frame["node"].tolist(), frame["ids"].tolist()):
                if node != now:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if digest is not None:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["node", "ends_sha256"])

    listed = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInPandas(pieces, "node binary, first long, ids string")
    return listed.repartition("node").sortWithinPartitions("node", "first").mapInPandas(hashed, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard_turns: int | None = None, held: int = HELD_MESSAGES) -> DataFrame:
    """Nodes of the trie of `turns` (conv_id, nth, digest, words; nth 0 for each conversation's root), one row a node.

    conv_id (the least member) and depth name a node; parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (childless nodes of its subtree), saved_tokens (over its subtree, members but one times words of the last turn),
    ends_sha256 (members that end there). A conversation without turns is a member of the root; an empty table gives no
    rows, not even a root; repeated turns are turns.

    A node is light if no more than `shard_turns` turns of its members lie below it. The light nodes nearest to the root are
    the roots of shards; the heavy ones above are at most all turns / shard_turns on each level. A conversation's
    digests are made by one task, as a stream of small rows.
    """
    spark = turns.sparkSession
    rows = stage(prefixes(turns))
    nodes = stage(rows.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("words").alias("words"),
        F.count("*").alias("n_convs"), F.sum("below").alias("below")))
    if shard_turns is None:
        total = nodes.filter("depth = 0").select(F.coalesce(F.sum("below"), F.lit(0))).first()[0]
        shard_turns = max(LEAST_SHARD, total // (SHARDS_A_PARTITION * shuffle_partitions(spark)))
    sent = [F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    heavy = stage(nodes.filter(F.col("below") > shard_turns))
    light_rows = rows.join(heavy.select("node"), "node", "left_anti")
    shards = light_rows.groupBy("conv_id").agg(F.min_by("node", "depth").alias("shard"), F.min("depth").alias("top_depth"))
    light = nodes.filter(F.col("below") <= shard_turns).join(shards, "conv_id").withColumn("top", F.col("depth") == F.col("top_depth"))
    order = ["shard", F.col("depth").desc(), "node"]
    below = stage(time_forward(light.select("*", *sent).repartition("shard").sortWithinPartitions(*order), held))

    messages = below.filter("top").groupBy("parent").agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    got = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    above = heavy.join(messages.withColumnRenamed("parent", "node"), "node", "left").select(*heavy.columns, *got)
    above = above.withColumn("shard", F.lit(ROOT)).withColumn("top", F.col("depth") == 0)
    above = time_forward(above.coalesce(1).sortWithinPartitions(*order), held)

    owner = [F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")]
    inside = below.filter("not top").join(nodes.filter(F.col("below") <= shard_turns).select(*owner), "parent")
    over = below.filter("top").unionByName(above).join(heavy.select(*owner), "parent", "left")
    found = inside.unionByName(over).join(end_digests(rows.filter("below = 0").select("node", "conv_id")), "node", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
