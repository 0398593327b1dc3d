"""Structure of conversations: faults found, and the cheapest edits that make the roles alternate.

Rows are dealt by conversation and sorted by turn, the last turn first. One task streams over its conversations and carries, from
Arrow batch to Arrow batch, the least cost of mending the rest of a conversation from each state of the grammar. A row
leaves one byte behind, two bits for the best edit in each state. At the first turn the edits are read off from
there to the end. A conversation is held in memory up to a number of characters; beyond, its rows and their bytes
go to the task's own temporary file, so a conversation of any length passes through bounded memory.
"""

import hashlib
import pickle
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of one conversation that a task holds before it writes its rows to a file.
HELD_CHARS = 8_000_000
#: Rows or characters of a frame of results.
OUT_ROWS, OUT_CHARS = 5000, 8_000_000

#: White space that ends a text, and signs that close a sentence (fixed values).
_SPACE = " \t\n\x0b\f\r"
_CLOSED = (".", "!", "?")
#: Edits by their initials, in ASCII order, and what each costs.
_EDITS = "DIKR"
_DELETE, _INSERT, _KEEP, _REROLE = range(4)
_COSTS = (2, 5, 0, 1)
_TRUNCATED_COST = 5
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. An expected role leads on to the next state.
_EXPECTED = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
#: States that a kept row of initial s, u, a may follow, and where it leads.
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
_INITIALS = ("s", "u", "a", "")
_NEVER = 1 << 40
#: At the end: nothing more from the first and the last state, else what is missing is put in.
_END = (0, 2 * _COSTS[_INSERT], _COSTS[_INSERT], 0)

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
_FAULTS = (None, BLANK, DUPLICATE, TRUNCATED)

_NUMBERS = ("place", "cost")
REPAIRED = T.StructType([
    T.StructField(c, T.IntegerType() if c in _NUMBERS else T.StringType())
    for c in ("conversation", "turn", "place", "role", "text", "role_before", "fault", "edit", "cost")
])


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with damage by crc32 of `conv_id:turn` modulo 20, nulls being one space.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats it, 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, seen, fault) of rows, dealt by conversation; a row has its first fault, or none.

    blank: nothing but white space; duplicate: role and text stood earlier in the conversation, by turn, nulls first;
    truncated: the last sign that is no white space does not close a sentence. Null roles and texts are one space. `seen` is
    how often role and text have stood before.
    """
    filled = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    dealt = filled.repartition("conv_id").withColumn("seen", F.row_number().over(earlier) - 1)
    end = F.rtrim("text", F.lit(_SPACE))
    fault = F.when(end == "", BLANK).when(F.col("seen") > 0, DUPLICATE).when(~F.right(end, F.lit(1)).isin(*_CLOSED), TRUNCATED)
    return dealt.withColumn("fault", fault)


def step(after: tuple, initial: str, fault: str | None) -> tuple[tuple, int]:
    """Least costs from each state before a row, given those after it, less their least; and the best edits, two bits a state.

    Of edits that cost the same the one with the least initial is best, so the edits read off are the ASCII-least ones: in a
    state an initial says all of an edit.
    """
    extra = _TRUNCATED_COST if fault == TRUNCATED else 0
    best = []
    for state in range(4):
        ways = [(after[state] + _COSTS[_DELETE], _DELETE)]
        if fault not in (BLANK, DUPLICATE):
            if state in _KEPT[initial]:
                ways.append((after[_KEPT[initial][state]] + _COSTS[_KEEP] + extra, _KEEP))
            ways.append((after[_NEXT[state]] + _COSTS[_REROLE] + extra, _REROLE))
        best.append(min(ways))
    for state in (3, 2, 3, 0, 1):  # what is put in before the row: at most one from the last two states, two from the others
        best[state] = min(best[state], (best[_NEXT[state]][0] + _COSTS[_INSERT], _INSERT))
    least = min(cost for cost, _ in best)
    return tuple(min(cost - least, _NEVER) for cost, _ in best), sum(edit << 2 * state for state, (_, edit) in enumerate(best))


class _Spool:
    """Pieces of a conversation in the order they came, given back in reverse; all but the last ones may be in a file."""

    def __init__(self, most_chars: int):
        self.most, self.held, self.chars, self.file, self.places = most_chars, [], 0, None, []

    def add(self, piece: list, chars: int) -> None:
        self.held.append(piece)
        self.chars += chars
        if self.chars > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            for one in self.held:
                self.places.append(self.file.tell())
                pickle.dump(one, self.file, pickle.HIGHEST_PROTOCOL)
            self.held, self.chars = [], 0

    def reversed(self):
        while self.held:
            yield self.held.pop()
        for place in reversed(self.places):
            self.file.seek(place)
            yield pickle.load(self.file)
        if self.file:
            self.file.close()


def _mended(pieces, conversation):
    """Rows of REPAIRED from the pieces of one conversation, first turn first."""
    state = place = 0

    def put_in():
        nonlocal state, place
        row = (conversation, None, place, _EXPECTED[state], "", None, None, "I", _COSTS[_INSERT])
        state, place = _NEXT[state], place + 1
        return row

    for turns, roles, texts, kinds, edits in pieces:
        for i in range(len(edits) - 1, -1, -1):
            edit = edits[i] >> 2 * state & 3
            while edit == _INSERT:
                yield put_in()
                edit = edits[i] >> 2 * state & 3
            initial, fault = _INITIALS[kinds[i] & 3], _FAULTS[kinds[i] >> 2]
            extra = _TRUNCATED_COST if fault == TRUNCATED and edit != _DELETE else 0
            at, role = (None, None) if edit == _DELETE else (place, roles[i] if edit == _KEEP else _EXPECTED[state])
            yield conversation, turns[i], at, role, texts[i], roles[i], fault, _EDITS[edit], _COSTS[edit] + extra
            if edit != _DELETE:
                state, place = _KEPT[initial][state] if edit == _KEEP else _NEXT[state], place + 1
    while state in (1, 2):
        yield put_in()


def _frames(rows):
    """Frames of bounded size from rows of REPAIRED."""
    import pandas as pd

    def frame():
        return pd.DataFrame(held, columns=REPAIRED.names).astype({c: "Int32" for c in _NUMBERS})

    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[4])
        if len(held) >= OUT_ROWS or chars >= OUT_CHARS:
            yield frame()
            held, chars = [], 0
    if held:
        yield frame()


def repaired(rows: DataFrame, held_chars: int = HELD_CHARS) -> DataFrame:
    """Every row of (conv_id, turn, role, text) and every row put in, with its edit, in the order of turns within partitions.

    Columns: `conversation` and `turn` as text, `place` in the mended conversation, `role` and `text` as they stand there (a deleted
    row has no place and no role), `role_before`, `fault`, `edit` (K kept, R other role, D deleted, I put in) and `cost`. The mended
    conversation's role initials give (s?(ua)+)? at the least cost, the ASCII-least edits of these.

    A null conv_id is one conversation; null roles and texts are one space; of rows of one turn the least role, then text,
    comes first; repeated rows are duplicates; an empty table gives no rows; other columns are ignored. A conversation is one task's work, in bounded memory.
    """
    kind = F.coalesce(*(F.when(F.left("role", F.lit(1)) == c, i) for i, c in enumerate(_INITIALS[:3])), F.lit(3))
    code = kind + 4 * F.coalesce(*(F.when(F.col("fault") == f, i) for i, f in enumerate(_FAULTS) if f), F.lit(0))
    order = [F.col("conv_id"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc(), F.col("seen").desc()]
    sorted_rows = faults(rows).sortWithinPartitions(*order).select(
        F.col("conv_id").cast("string").alias("conversation"), F.col("turn").cast("string").alias("turn"), "role", "text", code.alias("kind"))

    def conversations(frames):
        memo: dict = {}
        now, spool, costs = False, _Spool(held_chars), _END
        for frame in frames:
            names = frame["conversation"].where(frame["conversation"].notna(), None).tolist()
            columns = [frame[c].where(frame[c].notna(), None).tolist() for c in ("turn", "role", "text")] + [frame["kind"].tolist()]
            start = 0
            while start < len(names):
                if now is False or names[start] != now:
                    if now is not False:
                        yield from _mended(spool.reversed(), now)
                    now, spool, costs = names[start], _Spool(held_chars), _END
                end = start
                edits = bytearray()
                while end < len(names) and names[end] == now:
                    key = costs, columns[3][end]
                    if key not in memo:
                        memo[key] = step(costs, _INITIALS[key[1] & 3], _FAULTS[key[1] >> 2])
                    costs, edit = memo[key]
                    edits.append(edit)
                    end += 1
                piece = [c[start:end] for c in columns] + [bytes(edits)]
                spool.add(piece, sum(map(len, piece[2])))
                start = end
        if now is not False:
            yield from _mended(spool.reversed(), now)

    return sorted_rows.mapInPandas(lambda frames: _frames(conversations(frames)), REPAIRED)


_COUNTS = ("gaps", BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")
AUDIT = T.StructType([
    T.StructField(c, T.LongType() if c in _COUNTS else T.StringType()) for c in ("conversation", *_COUNTS, "audit", "repaired_sha256")
])


def audits(mended: DataFrame) -> DataFrame:
    """One row for each conversation of `repaired`'s result: counts of faults, the edits' initials and a hash of the mended rows.

    gaps: turns missing between the least and the greatest, nulls left out; illegal: neighbours, before the edits,
    whose role initials are not su, ua or au. Rows are read as `repaired` leaves them, in one pass, and hashed as they come.
    """

    def rows(frames):
        import pandas as pd

        state = None

        def result():
            gaps = state["last"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
            return (state["name"], gaps, state[BLANK], state[DUPLICATE], state[TRUNCATED], state["illegal"], state["cost"],
                    "".join(state["audit"]), state["hash"].hexdigest())

        for frame in frames:
            out = []
            frame = frame.astype(object).where(frame.notna(), None)
            for name, turn, place, role, text, before, fault, edit, cost in frame.itertuples(index=False, name=None):
                if state is None or name != state["name"]:
                    if state is not None:
                        out.append(result())
                    state = {"name": name, "first": 0, "last": None, "turns": 0, BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, "illegal": 0, "cost": 0,
                             "audit": [], "hash": hashlib.sha256(), "initial": None, "rows": 0}
                state["cost"] += int(cost)
                state["audit"].append(edit)
                if edit != "I":
                    if fault:
                        state[fault] += 1
                    if turn is not None and (not state["turns"] or int(turn) != state["last"]):
                        state["first"] = state["first"] if state["turns"] else int(turn)
                        state["last"] = int(turn)
                        state["turns"] += 1
                    if state["initial"] is not None and state["initial"] + before[:1] not in ("su", "ua", "au"):
                        state["illegal"] += 1
                    state["initial"] = before[:1]
                if edit != "D":
                    state["hash"].update((("\n" if state["rows"] else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                    state["rows"] += 1
            if out:
                yield pd.DataFrame(out, columns=AUDIT.names)
        if state is not None:
            yield pd.DataFrame([result()], columns=AUDIT.names)

    return mended.mapInPandas(rows, AUDIT)


def conversation_audits(rows: DataFrame, of: DataFrame) -> DataFrame:
    """`audits` of `rows` for every conv_id of `of`: one without rows has zeros, no edits and the hash of the empty text."""
    found = audits(repaired(rows)).withColumn("_id", F.col("conversation").cast(of.schema["conv_id"].dataType))
    every = of.select("conv_id").distinct()
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in _COUNTS]
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
