"""Chat records of many layouts as canonical turns, formatted with a loss mask; DataFrame operations only.

A record's nested field paths, without types, are hashed; the hash selects a declarative mapping that says where the
turns are. Turns are written into a template whose marks are escaped inside texts, so they can be read back exactly.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
#: Marks of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Control strings that texts may hold, as common chat templates have them (fixed values).
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Layout:
    """Where the turns of a layout are: a list at `path` with `role` and `text` fields, or single `fields` as (path, role)."""

    name: str
    paths: tuple[str, ...]
    path: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()


#: A list of paths names a layout; `[]` is an element of a list.
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), "messages", "role", "content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("turns", ("turns[].role", "turns[].text"), "turns", "role", "text"),
    Layout("dialog", ("data.dialog[].content", "data.dialog[].speaker"), "data.dialog", "speaker", "content"),
    Layout("prompt_response", ("prompt", "response"), fields=(("prompt", "user"), ("response", "assistant"))),
    Layout("prompt_completion", ("completion", "prompt"), fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), fields=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Layout("instruction", ("instruction", "output"), fields=(("instruction", "user"), ("output", "assistant"))),
    Layout("instruction_input", ("input", "instruction", "output"), fields=(("instruction+input", "user"), ("output", "assistant"))),
    Layout("question", ("answer", "question"), fields=(("question", "user"), ("answer", "assistant"))),
)
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Characters from which on the engine's parser may refuse well-formed JSON.
PARSED_CHARS = 20_000_000


def _nested(paths) -> str:
    """Paths as the engine writes the schema of a value, with the types taken out and names in order."""
    tree: dict = {}
    for path in paths:
        node = tree
        for step in path.replace("[]", ".[]").split("."):
            node = node.setdefault(step, {})

    def write(node: dict) -> str:
        if "[]" in node:
            return f"ARRAY<{write(node['[]'])}>"
        return f"OBJECT<{', '.join(name + (': ' + write(below) if below else '') for name, below in sorted(node.items()))}>"

    return write(tree)


def field_paths(value) -> Column:
    """The nested field names of a variant, in order of name, without types."""
    shape = F.schema_of_variant(value)
    leaf = r":?\s*(VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,\s*-?[0-9]+\)|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID|VARIANT)(?=[,>]|$)"
    return F.regexp_replace(shape, leaf, "")


def fingerprint(paths) -> Column:
    return F.sha2(paths, 256)


def _turn(role, text) -> Column:
    renamed = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.struct(F.coalesce(renamed[role], role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(value, layout: Layout) -> Column:
    if layout.path:
        items = F.try_variant_get(value, f"$.{layout.path}", f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
        return F.transform(items, lambda t: _turn(t[layout.role], t[layout.text]))

    def said(path: str) -> Column:
        parts = [F.try_variant_get(value, f"$.{p}", "string") for p in path.split("+")]
        whole = F.concat_ws("\n", *(F.when(p != "", p) for p in parts)) if len(parts) > 1 else F.coalesce(parts[0], F.lit(""))
        return whole

    return F.array(*(F.struct(F.lit(role).alias("role"), said(path).alias("text")) for path, role in layout.fields))


def canonical(records: DataFrame, column: str = "record") -> DataFrame:
    """`records` with layout and turns, from JSON text in `column`; further fields beside a layout's own do not matter.

    The fingerprint of all field paths selects the layout; a record with more fields, or whose list is empty or has null
    entries only, is matched by the fields it has at the top instead. Null, malformed and unknown records have a null layout and no turns.
    Null roles and texts are empty. A record that cannot be read and is so long that the parser's limits may be why is an error.
    """
    value, paths = F.try_parse_json(F.col(column)), field_paths(F.col("_chat_value"))
    known = records.withColumn("_chat_value", value).withColumn("_chat_print", fingerprint(paths))
    by_print = F.create_map(*(F.lit(x) for p in LAYOUTS for x in (_sha(_nested(p.paths)), p.name)))
    top = F.coalesce(F.json_object_keys(F.col(column)), F.array().cast("array<string>"))
    by_fields = F.coalesce(*(
        F.when(F.size(F.array_except(F.array(*map(F.lit, sorted({x.split("[")[0].split(".")[0] for x in p.paths}))), top)) == 0, F.lit(p.name))
        for p in sorted(LAYOUTS, key=lambda p: -len(p.paths))
    ))
    refused = F.col("_chat_value").isNull() & (F.char_length(F.col(column)) >= PARSED_CHARS)
    error = F.raise_error(F.lit("a chat record is malformed or too long for the JSON parser")).cast("string")
    layout = F.when(refused, error).when(F.col("_chat_value").isNotNull(), F.coalesce(by_print[F.col("_chat_print")], by_fields))
    named = known.withColumn("layout", layout)
    turns = F.coalesce(*(F.when(F.col("layout") == p.name, _turns(F.col("_chat_value"), p)) for p in LAYOUTS), F.array().cast(TURNS))
    return named.withColumn("turns", turns.cast(TURNS)).drop("_chat_value", "_chat_print")


def _sha(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def escaped(text) -> Column:
    """Backslashes doubled, then one put behind the first character of every control string."""
    signs = "|".join("".join(f"\\{c}" if not c.isalnum() and c != "_" else c for c in mark[1:]) for mark in CONTROLS)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={signs})", r"$1\\")


def unescaped(text) -> Column:
    """Every character behind a backslash, without that backslash."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


#: Turns whose running lengths are summed together.
BLOCK_TURNS = 256


def formatted(chats: DataFrame) -> DataFrame:
    """`chats` (with turns) with formatted text and loss_spans, (start, length) in characters, one for each assistant text.

    A turn is its mark, its role, a line break, its text and the end mark. A role is written URL-encoded, so it has neither
    marks nor line breaks. The spans cover the escaped text of assistant turns only. No turns give an empty text.
    """
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    out = chats.withColumn("_chat_parts", parts)
    pieces = F.transform("_chat_parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n")))
    # running lengths within blocks of turns, then over the blocks: an array that grows is copied at each step, so it stays short
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint,loss:boolean>>").alias("spans"))

    def step(state, p):
        begin, n = state["at"] + F.char_length(p["head"]), F.char_length(p["body"]).cast("long")
        span = F.struct(begin.alias("start"), n.alias("length"), p["loss"].alias("loss"))
        return F.struct((begin + n + len(CLOSE) + 1).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def placed(blocks):
        first = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("begins"))
        begins = F.aggregate(blocks, first, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["begins"], F.array(s["at"])).alias("begins")))["begins"]
        moved = lambda b, o: F.transform(b["spans"], lambda s: F.struct((s["start"] + o).alias("start"), s["length"].alias("length"), s["loss"].alias("loss")))
        return F.flatten(F.zip_with(blocks, begins, moved))

    numbers = F.sequence(F.lit(0), F.floor((F.size("_chat_parts") - 1) / BLOCK_TURNS).cast("int"))
    numbers = F.when(F.size("_chat_parts") > 0, numbers).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(numbers, lambda i: F.aggregate(F.slice("_chat_parts", i * BLOCK_TURNS + 1, BLOCK_TURNS), start, step))
    spans = F.filter(F.get(F.transform(F.array(blocks), placed), F.lit(0)), lambda s: s["loss"])
    loss = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return out.withColumn("formatted", F.array_join(pieces, "")).withColumn("loss_spans", loss).drop("_chat_parts")


def read_back(chats: DataFrame) -> DataFrame:
    """`chats` with read_turns and loss_texts, both from `formatted` and `loss_spans` alone: the exact reverse of `formatted`."""
    end = "".join(f"\\{c}" if c in "|<>" else c for c in CLOSE) + "\n"
    pieces = F.filter(F.split("formatted", end), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        F.url_decode(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
        unescaped(F.substr(p, F.locate("\n", p) + F.lit(1))).alias("text")))
    # four bytes a character: a span is cut at its place, without counting characters from the start for each
    wide = F.transform(F.array(F.encode("formatted", "UTF-32")), lambda w: F.transform(
        "loss_spans", lambda s: unescaped(F.decode(F.substr(w, (s["start"] * 4 - 3).cast("int"), (s["length"] * 4).cast("int")), "UTF-32"))))
    said = F.get(wide, F.lit(0))
    return chats.withColumn("read_turns", turns).withColumn("loss_texts", said)


def schema_paths(kind: T.DataType) -> str:
    """The nested field names of a column's type, written as `field_paths` writes those of a JSON record."""
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{schema_paths(kind.elementType)}>"
    if not isinstance(kind, T.StructType):
        return ""
    inner = {f.name: schema_paths(f.dataType) for f in kind}
    return f"OBJECT<{', '.join(name + (': ' + below if below else '') for name, below in sorted(inner.items()))}>"


def canonical_structs(records: DataFrame, column: str = "record") -> DataFrame:
    """`records` with layout and turns, from a nested column in place of JSON text.

    The fingerprint of the column's field paths selects the layout, as `canonical` does for JSON; a column whose paths are those of no
    layout has a null layout and no turns, and so has a null record. Null roles and texts are empty.
    """
    paths, value = schema_paths(records.schema[column].dataType), F.col(column)
    by_print = F.create_map(*(F.lit(x) for p in LAYOUTS for x in (_sha(_nested(p.paths)), p.name)))
    named = records.withColumn("layout", F.when(value.isNotNull(), by_print[fingerprint(F.lit(paths))]))

    def turns(layout: Layout) -> Column:
        if layout.path:
            return F.transform(reduce(lambda v, step: v[step], layout.path.split("."), value), lambda t: _turn(t[layout.role], t[layout.text]))
        said = lambda path: F.concat_ws("\n", *(F.when(value[f] != "", value[f]) for f in path.split("+")))
        return F.array(*(F.struct(F.lit(role).alias("role"), said(path).alias("text")) for path, role in layout.fields))

    fitting = [p for p in LAYOUTS if _nested(p.paths) == paths]  # only their fields are in the column
    made = [F.when(F.col("layout") == p.name, turns(p)).cast(TURNS) for p in fitting]
    return named.withColumn("turns", F.coalesce(*made, F.array().cast(TURNS)))


def rows_to_chats(rows: DataFrame) -> DataFrame:
    """conv_id, layout and turns, as `canonical` gives them for `rows_to_records`, without a way through JSON and its parser's limits.

    Rows of a conversation become one nested record, whose fingerprint selects the layout. A null conv_id is one conversation, an
    empty table gives no rows, other columns are ignored.
    """
    messages = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    records = rows.groupBy("conv_id").agg(_ordered().alias("all")).select("conv_id", F.struct(messages.alias("messages")).alias("record"))
    return canonical_structs(records).select("conv_id", "layout", "turns")


def _ordered() -> Column:
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    return F.sort_array(F.collect_list(one))


def rows_to_records(rows: DataFrame) -> DataFrame:
    """conv_id and record, a JSON text of the layout "messages", from rows of (conv_id, turn, role, text).

    Rows go by turn, a null turn first, then by role and text. A conversation is one record and one row; its turns stand
    together because its text does.
    """
    grouped = rows.groupBy("conv_id").agg(_ordered().alias("all"))
    messages = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return grouped.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))
