"""Chat formatting by schema fingerprints, in DataFrame functions alone.

A record is a JSON object. Its nested field paths, without types and values, are hashed; the hash selects one of the
declared layouts, whose paths say where the turns' roles and texts are. A record with further fields (an id, a name) has another hash; it is
hashed again by those of its paths that some layout declares. Turns are rendered with turn marks; control strings
and backslashes inside texts are escaped so that reading back restores them exactly.

Defined cases: a record that is null, no JSON or of an undeclared layout, or with the fields of two layouts, is returned with a null layout, no turns and an
empty output; null roles and texts are empty; null ids are a conversation of their own; turns with the same number are
ordered by role, then text; repeated rows stay repeated turns; an empty table gives an empty result; the caller names the
columns that are read, others are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """Where a kind of record has its turns. ``sample`` is a record with just the fields that the kind has.

    ``turns``: path of an array whose items have ``role`` and ``text`` paths; or none of these, and ``parts`` lists the role and the
    path of each turn; ``order`` marks a record that is one turn of a conversation and names the path of its number.
    """

    name: str
    sample: str
    turns: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    parts: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
LAYOUTS = (
    Layout("turn_rows", '{"role":"","text":"","turn":0}', role="$.role", text="$.text", order="$.turn"),
    Layout("messages", '{"messages":[{"content":"","role":""}]}', "$.messages", "$.role", "$.content"),
    Layout("messages_text", '{"messages":[{"role":"","text":""}]}', "$.messages", "$.role", "$.text"),
    Layout("speakers", '{"conversations":[{"from":"","value":""}]}', "$.conversations", "$.from", "$.value", roles=_SPEAKERS),
    Layout("instruction", '{"instruction":"","output":""}', parts=(("user", "$.instruction"), ("assistant", "$.output"))),
    Layout("instruction_input", '{"input":"","instruction":"","output":""}', parts=(("user", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Layout("prompt_completion", '{"completion":"","prompt":""}', parts=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Layout("prompt_response", '{"prompt":"","response":""}', parts=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("system_prompt_response", '{"prompt":"","response":"","system":""}', parts=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("question_answer", '{"answer":"","question":""}', parts=(("user", "$.question"), ("assistant", "$.answer"))),
)


def field_paths(variant: Column) -> Column:
    """The record's nested field names, sorted at each level, without types and values."""
    types = r"(?<=: |ARRAY<)(?:STRING|VOID|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>])"
    return F.regexp_replace(F.schema_of_variant(variant), types, "_")


def fingerprint(variant: Column) -> Column:
    return F.xxhash64(field_paths(variant))


def layout_table(spark: SparkSession, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``(fingerprint, declared, layout)``, a row for each declared layout; two of one hash, which would tell a record twice, are an error."""
    named = F.array(*[F.struct(F.lit(x.name).alias("layout"), F.lit(x.sample).alias("sample")) for x in layouts])
    rows = spark.range(1).select(F.inline(named)).withColumn("v", F.try_parse_json("sample"))
    table = rows.select(fingerprint(F.col("v")).alias("fingerprint"), declared_fingerprint(F.col("v"), layouts).alias("declared"), "layout")
    for column in ("fingerprint", "declared"):
        if shared := table.where(F.col(column).isNotNull()).groupBy(column).agg(F.array_sort(F.collect_list("layout")).alias("names")).where("size(names) > 1").first():
            raise ValueError(f"layouts share a fingerprint: {', '.join(shared.names)}")
    return table


def declared_fingerprint(variant: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the paths that the record has of all that the layouts declare; null without any."""
    has = lambda v, path: F.try_variant_get(v, path, "variant").isNotNull()
    item_has = lambda path: lambda item: has(item, path)
    found = {}
    for x in layouts:
        for path in ([x.role, x.text] if x.turns else [path for _, path in x.parts] or [x.role, x.text, x.order]):
            if x.turns:
                found[f"{x.turns}[*]{path}"] = F.exists(_got(variant, x.turns, "array<variant>"), item_has(path))
            else:
                found[path] = has(variant, path)
    held = F.array_compact(F.array(*[F.when(found[path], F.lit(path)) for path in sorted(found)]))
    return F.when(F.size(held) > 0, F.xxhash64(held))


def _got(variant: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(variant, path, kind)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _named(role: Column, roles: dict[str, str]) -> Column:
    if not roles:
        return role
    return F.coalesce(F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])[role], role)


def _turns(variant: Column, layout: Layout) -> Column:
    if layout.turns:
        return F.transform(F.coalesce(_got(variant, layout.turns, "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda x: _turn(_named(_got(x, layout.role), layout.roles), _got(x, layout.text)))
    if layout.parts:
        every = F.array(*[_turn(F.lit(role), _got(variant, path)) for role, path in layout.parts])
        return every if len({r for r, _ in layout.parts}) == len(layout.parts) else F.filter(every, lambda t: (t["text"] != "") | (t["role"] != "user"))
    return F.array(_turn(_named(_got(variant, layout.role), layout.roles), _got(variant, layout.text)))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def canonical_turns(records: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``(id, layout, turns array<struct<role,text>>)``: one row for each record, or for all records of an id that are single turns."""
    spark = records.sparkSession
    read = records.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(record_col).cast("string")).alias("v"))
    table = layout_table(spark, layouts)
    exact = read.withColumn("fingerprint", fingerprint(F.col("v"))).join(F.broadcast(table.drop("declared")), "fingerprint", "left")
    wider = exact.withColumn("declared", F.when(F.col("layout").isNull(), declared_fingerprint(F.col("v"), layouts)))
    near = table.select("declared", F.col("layout").alias("near"))
    known = wider.join(F.broadcast(near), "declared", "left").withColumn("layout", F.coalesce("layout", "near"))
    chosen = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    number = F.lit(None).cast("long")
    for x in layouts:
        chosen = F.when(F.col("layout") == x.name, _turns(F.col("v"), x)).otherwise(chosen)
        if x.order:
            number = F.when(F.col("layout") == x.name, _got(F.col("v"), x.order, "bigint")).otherwise(number)
    single = [x.name for x in layouts if x.order]
    taken = known.select("id", "layout", chosen.alias("turns"), number.alias("number"))
    is_single = F.coalesce(F.col("layout").isin(single), F.lit(False)) if single else F.lit(False)
    whole = taken.where(~is_single).select("id", "layout", "turns")
    rows = taken.where(is_single).select("id", "layout", "number", F.inline("turns"))
    order = F.sort_array(F.collect_list(F.struct("number", "role", "text")))
    grouped = rows.groupBy("id", "layout").agg(order.alias("turns"))
    return whole.unionByName(grouped.select("id", "layout", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))


def format_chat(records: DataFrame, id_col: str, record_col: str, layouts: tuple[Layout, ...] = LAYOUTS, loss_role: str = "assistant") -> DataFrame:
    """``(id_col, layout, formatted, segments array<struct<text,loss>>)``: the segments make up the output in order; ``loss`` marks what is learned."""

    def segments(t: Column) -> Column:
        seg: Callable[[Column, Column], Column] = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            seg(F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")), F.lit(False)),
            seg(escape(t["text"]), t["role"] == loss_role),
            seg(F.lit(f"{END}\n"), F.lit(False)),
        )

    turns = canonical_turns(records, id_col, record_col, layouts)
    cut = turns.select(F.col("id").alias(id_col), "layout", F.flatten(F.transform("turns", segments)).alias("segments"))
    return cut.select(id_col, "layout", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """``array<struct<role,text>>`` of an output of :func:`format_chat`."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substr(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    parts = F.split(formatted, F.lit("<\\|im_start\\|>"))
    return F.transform(F.filter(parts, lambda p: p != ""), turn)
