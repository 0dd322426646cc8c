"""Chat formatting: schema fingerprints select declarative mappings to canonical turns, which a reversible template writes out.

A layout is known by the hash of its nested field paths. Typed tables are fingerprinted from their schema when the plan is
made; JSON records of mixed layouts are fingerprinted row by row from the shape of the parsed variant.
"""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Turn marks of the template, and other control strings that texts must not contain unescaped.
OPEN, CLOSE = "<s>", "</s>"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
ESCAPE = "~"


def escape(text: Column, breaks: bool = False) -> Column:
    """Part every control string after its first character; the escape character is escaped first. breaks: line ends too."""
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for c in CONTROLS:
        text = F.replace(text, F.lit(c), F.lit(c[0] + ESCAPE + "1" + c[1:]))
    return F.replace(text, F.lit("\n"), F.lit(ESCAPE + "2")) if breaks else text


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE + "2"), F.lit("\n"))
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit("")), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> int:
    """Hash of the sorted nested field paths."""
    return zlib.crc32("\n".join(sorted(set(paths))).encode())


@dataclass(frozen=True)
class Layout:
    """How a layout becomes turns: parts of (role, path) in order, or a list at `turns` whose items hold role and text, or,
    with `order`, a row for each turn that holds role and text and its place in the conversation."""

    paths: tuple[str, ...]
    parts: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    order: str = ""

    @property
    def key(self) -> int:
        return fingerprint(list(self.paths))


#: Names of roles in public layouts.
NAMED = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Layout(("turn", "role", "text"), order="turn", role="role", text="text"),
    Layout(("turn", "role", "content"), order="turn", role="role", text="content"),
    Layout(("messages[].role", "messages[].content"), turns="messages", role="role", text="content"),
    Layout(("conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value", roles=NAMED),
    Layout(("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Layout(("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout(("question", "answer"), (("user", "question"), ("assistant", "answer"))),
    Layout(("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout(("instruction", "input", "output"), (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout(("system", "prompt", "response"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)
TURN = "array<struct<role:string,text:string>>"


def variant_paths(shape: Column) -> Column:
    """Nested field paths, as in field_paths() and joined by line ends, from the printed shape of a variant."""
    # OBJECT<a: ARRAY<OBJECT<b: STRING, c: BIGINT>>, d: VOID>: tokens are names, `[]` for ARRAY<, `>` and plain types.
    marks = F.regexp_extract_all(F.lower(shape), F.lit(r"(`[^`]*`|[\w-]+): |array<|object<|>|[a-z]+(?:\([0-9,]+\))?"), 0)
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, m: Column) -> Column:
        stack, paths = acc["stack"], acc["paths"]
        pop = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        whole = F.regexp_replace(F.array_join(stack, ""), r"^\.", "")
        # After a container closes, the name that introduced it is done too.
        return (
            F.when(m.endswith(": "), F.struct(F.concat(stack, F.array(F.concat(F.lit("."), F.regexp_replace(m, "`|: $", "")))).alias("stack"), paths.alias("paths")))
            .when(m == "array<", F.struct(F.concat(stack, F.array(F.lit("[]"), F.lit(""))).alias("stack"), paths.alias("paths")))
            .when(m == "object<", F.struct(F.concat(stack, F.array(F.lit(""))).alias("stack"), paths.alias("paths")))
            .when(m == ">", F.struct(_close(pop).alias("stack"), paths.alias("paths")))
            .otherwise(F.struct(_close_name(stack).alias("stack"), F.concat(paths, F.array(whole)).alias("paths")))
        )

    return F.array_join(F.array_sort(F.array_distinct(F.aggregate(marks, start, step)["paths"])), "\n")


def _close_name(stack: Column) -> Column:
    """Drop a name from the top of the stack."""
    return F.when(F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("")).startswith("."), F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack)


def _close(stack: Column) -> Column:
    """After the mark of an object or array is gone, drop its `[]` and then its name."""
    inner = F.when(F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit("")) == "[]", F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack)
    return F.when(F.coalesce(F.try_element_at(inner, F.lit(-1)), F.lit("")).startswith("."), F.slice(inner, 1, F.size(inner) - 1)).otherwise(inner)


def canonical_turns(records: DataFrame, json_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The columns of records, fingerprint (null for malformed or null JSON) and turns (null for an unknown layout).

    A missing or null text is an empty one; an empty optional `input` part makes no turn; order is that of the record.
    """
    body = F.try_parse_json(F.col(json_col))
    key = F.crc32(variant_paths(F.schema_of_variant(body)).cast("binary"))
    turns = F.lit(None).cast(TURN)
    get = lambda path, kind: F.try_variant_get(body, f"$.{path}", kind)
    for layout in layouts:
        if layout.order:  # one turn of a conversation makes no conversation
            continue
        if layout.turns:
            items = get(layout.turns, f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
            own = F.transform(items, _turn_reader(layout.role, layout.text, dict(layout.roles)))
        else:
            own = _parts(layout, lambda path: get(path, "string"))
        turns = F.when(key == layout.key, own.cast(TURN)).otherwise(turns)
    return records.withColumns({"fingerprint": key, "turns": turns})


def _parts(layout: Layout, get) -> Column:
    """The turns of a layout of parts; an empty optional `input` makes none."""
    own = F.array(*(F.struct(F.lit(r).alias("role"), F.coalesce(get(p), F.lit("")).alias("text"), F.lit(p == "input").alias("o")) for r, p in layout.parts))
    return F.transform(F.filter(own, lambda x: ~(x["o"] & (x["text"] == ""))), lambda x: F.struct(x["role"], x["text"]))


def _turn_reader(role_field: str, text_field: str, names: dict[str, str]):
    def turn(x: Column) -> Column:
        role = x[role_field]
        for a, b in names.items():
            role = F.when(x[role_field] == a, b).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(x[text_field], F.lit("")).alias("text"))

    return turn


def layout_of(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout whose fingerprint a typed table has; of a table with further columns, that of the most of its field paths."""
    paths, by_key = field_paths(schema), {x.key: x for x in layouts}
    if fingerprint(paths) in by_key:
        return by_key[fingerprint(paths)]
    for layout in sorted(layouts, key=lambda x: -len(x.paths)):
        if by_key.get(fingerprint([p for p in paths if p in layout.paths])) is layout:
            return layout
    raise ValueError(f"no known layout has the field paths {paths}")


def turns_of(table: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text of a typed table of conversations, by the mapping that the fingerprint of its schema selects."""
    layout = layout_of(T.StructType([f for f in table.schema.fields if f.name != id_col]), layouts)
    key = F.col(id_col).cast("long").alias("conv_id")
    if layout.order:
        read = _turn_reader(layout.role, layout.text, dict(layout.roles))
        return table.select(key, F.col(layout.order).cast("long").alias("turn"), read(F.struct(layout.role, layout.text)).alias("x")).select("conv_id", "turn", "x.role", "x.text")
    turns = F.transform(F.col(layout.turns), _turn_reader(layout.role, layout.text, dict(layout.roles))) if layout.turns else _parts(layout, F.col)
    return table.select(key, F.posexplode(turns).alias("turn", "x")).select("conv_id", F.col("turn").cast("long").alias("turn"), "x.role", "x.text")


def format_turns(*tables: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start from 1 and length, in characters, of each assistant text as written).

    The tables may have different layouts; each is read by the mapping of its fingerprint, other columns are not read. Rows
    are ordered by turn, then role and text, so ties and repeated rows have a fixed order; null roles and texts are empty, a
    null turn is first, rows without a conv_id are together one conversation with a null id. An empty table gives no rows. A
    conversation is one output row, so it must fit one.
    """
    rows = functools.reduce(DataFrame.unionByName, map(turns_of, tables)).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role"), breaks=True), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(order), F.lit(0))
    count = F.count("*").over(order)
    rows = rows.select("conv_id", count.alias("i"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("role") == "assistant", F.struct((before + F.length("head") + 1).cast("int").alias("start"), F.length("body").alias("length"))).alias("span"))
    whole = F.array_sort(F.collect_list(F.struct("i", "piece", "span")))
    out = rows.groupBy("conv_id").agg(whole.alias("w"))
    return out.select("conv_id", F.array_join(F.col("w.piece"), "").alias("formatted"), F.filter(F.col("w.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")
