"""Chat formatting: tool calls linked to their results, in canonical JSON.

Messages are rows (conv_id, turn, role, text). An assistant's text that is a JSON object may hold
`tool_calls` (id, name, arguments); a `tool` message's text is a JSON object with `tool_call_id`.
Calls and results are hash-joined by conversation and identifier. The order is topological: a
message keeps its turn unless it is the result of a call made later (or in the same turn), in which
case it moves behind that call; of several calls with one identifier the first by turn counts. Sorting
by (order_turn, order_step, turn) gives the order; results moved behind one call keep theirs.

Arguments are validated against schemas, which are data: a JSON Schema for each tool (type, properties,
required, additionalProperties, enum, items, minimum, maximum, minLength, maxLength, pattern), nested to
any depth and compiled to expressions. Texts are parsed to variants, so values keep their JSON types:
they are checked and written back as what they are, with names in order, the shortest escapes and numbers
in their shortest form (`3.0` as `3`). A call
without an identifier is a call like others, with a problem of its own and `"id":null`; it links to
nothing. One row comes back per message, so no conversation is ever gathered in one task.

Defined results: null roles and texts are written as empty strings; a text that is not such an object
(or names a member twice) is plain content; repeated rows all stay; a null conv_id or turn links to
nothing. A null argument counts as missing. Extra columns are ignored. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The schemas taken without others: tool and JSON Schema of its arguments.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "weather": {"type": "object", "properties": {"city": {"type": "string", "minLength": 1}, "celsius": {"type": "boolean"}}, "required": ["city"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"], "additionalProperties": False},
}
#: Control characters without a short escape whose code has a letter in hexadecimal.
_LETTERED = [f"{c:04x}" for c in range(32) if c not in (8, 9, 10, 12, 13) and f"{c:04x}".upper() != f"{c:04x}"]


def _json(text: Column) -> Column:
    """A string as canonical JSON: the shortest escapes, nothing else escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code, short in ((8, "b"), (9, "t"), (10, "n"), (12, "f"), (13, "r")):
        out = F.replace(out, F.lit(chr(code)), F.lit("\\" + short))
    for code in (*range(8), 11, *range(14, 32)):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def _canonical(value: Column) -> Column:
    """A variant as canonical JSON: it keeps names in order, escapes are the shortest but for capital digits."""
    out = F.to_json(value)
    low = out
    for code in _LETTERED:
        low = F.regexp_replace(low, f"(?<!\\\\)((?:\\\\\\\\)*)\\\\u{code.upper()}", f"$1\\\\u{code}")
    return F.when(F.contains(out, F.lit("\\u00")), low).otherwise(out)


def _object(*members: tuple[str, Column]) -> Column:
    """An object of (name, JSON text) with its names in order; members that are null are left out."""
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in sorted(members, key=lambda m: m[0])]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _kind(value: Column) -> Column:
    """The JSON type of a variant: string, number, boolean, array, object or null."""
    kind = F.schema_of_variant(value)
    named = F.when(value.isNull() | (kind == "VOID"), "null").when(kind.isin("STRING", "BOOLEAN"), F.lower(kind)).when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    return named.otherwise("number")


def _member(value: Column, name: str) -> Column:
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return F.try_variant_get(value, path, "variant")


def conforms(value: Column, raw: Column, schema: Mapping) -> Column:
    """Whether a variant, whose text is raw, conforms to a JSON Schema of the supported words; never null.

    An integer is a number that is written without fraction and exponent.
    """
    unknown = set(schema) - {"type", "properties", "required", "additionalProperties", "enum", "items", "minimum", "maximum", "minLength", "maxLength", "pattern", "description", "title", "default"}
    if unknown:
        raise ValueError(f"schema words not supported: {sorted(unknown)}")
    kind, good = _kind(value), [F.lit(True)]
    if "type" in schema:
        kinds = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        whole = (kind == "number") & F.coalesce(raw.rlike("^-?[0-9]+$"), F.lit(False)) if "integer" in kinds else F.lit(False)
        good.append(kind.isin(*kinds) | whole)
    if "enum" in schema:
        good.append(_canonical(value).isin(*[_text(v) for v in schema["enum"]]))
    as_text, as_number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_text, is_number = kind == "string", kind == "number"
    for word, found, which in (
        ("minLength", lambda n: F.char_length(as_text) >= n, is_text), ("maxLength", lambda n: F.char_length(as_text) <= n, is_text), ("pattern", lambda p: as_text.rlike(p), is_text),
        ("minimum", lambda n: as_number >= n, is_number), ("maximum", lambda n: as_number <= n, is_number),
    ):
        if word in schema:
            good.append(~which | F.coalesce(found(schema[word]), F.lit(False)))
    if "items" in schema:
        both = F.arrays_zip(F.try_variant_get(value, "$", "array<variant>").alias("v"), F.from_json(raw, "array<string>").alias("r"))
        good.append((kind != "array") | F.coalesce(F.forall(both, lambda b: conforms(b["v"], b["r"], schema["items"])), F.lit(False)))
    names, texts = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), F.from_json(raw, "map<string,string>")
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
        good.append((kind != "object") | F.coalesce(F.size(F.array_except(names, known)) == 0, F.lit(False)))
    for name in schema.get("required", ()):
        good.append((kind != "object") | (_kind(_member(value, name)) != "null"))
    for name, own in schema.get("properties", {}).items():
        absent = ~F.coalesce(F.array_contains(names, name), F.lit(False))
        good.append((kind != "object") | absent | conforms(_member(value, name), F.try_element_at(texts, F.lit(name)), own))
    out = good[0]
    for g in good[1:]:
        out = out & g
    return F.coalesce(out, F.lit(False))


def _text(value) -> str:
    import json

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fault(name: Column, given: Column, raw: Column, schemas: Mapping) -> Column:
    """What is wrong with a call of these arguments (a variant, and its text), or null."""
    out = F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit(""))))
    for tool, schema in schemas.items():
        lacks = F.lit(False)
        for field in schema.get("required", ()):
            lacks = lacks | (_kind(_member(given, field)) == "null")
        out = out.when((name == tool) & (_kind(given) == "object") & lacks, F.lit(f"missing argument of {tool}"))
        out = out.when((name == tool) & ~conforms(given, raw, schema), F.lit(f"wrong argument of {tool}"))
    return out


def link(messages: DataFrame, schemas: Mapping = SCHEMAS) -> DataFrame:
    """conv_id, turn, order_turn, order_step, role, n_calls, call_turn, valid, problem and message."""
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    looks = F.col("role").isin("assistant", "tool") & F.col("text").rlike("^\\s*\\{")
    rows = rows.withColumn("said", F.when(looks, F.try_parse_json("text")))
    text_of = lambda v, path: F.try_variant_get(v, path, "string")
    is_array = F.schema_of_variant(F.try_variant_get("said", "$.tool_calls", "variant")).startswith("ARRAY")
    raw = F.when((F.col("role") == "assistant") & is_array, F.try_variant_get("said", "$.tool_calls", "array<variant>"))
    texts = F.transform(F.from_json("text", "struct<tool_calls:array<struct<arguments:string>>>")["tool_calls"], lambda c: c["arguments"])
    calls = F.transform(F.arrays_zip(raw.alias("v"), F.when(raw.isNotNull(), texts).alias("r")), lambda c: F.struct(
        text_of(c["v"], "$.id").alias("id"), text_of(c["v"], "$.name").alias("name"), _given(F.try_variant_get(c["v"], "$.arguments", "variant")).alias("arguments"), c["r"].alias("raw"),
    ))
    rows = rows.withColumn("calls", F.coalesce(calls, F.array().cast("array<struct<id:string,name:string,arguments:variant,raw:string>>")))
    rows = rows.withColumn("call_id", F.when(F.col("role") == "tool", text_of(F.col("said"), "$.tool_call_id")))

    # only rows that bear an identifier can meet a call; the others get a key of their own, so that none piles up
    made = rows.where(F.size("calls") > 0).select("conv_id", "turn", F.explode("calls.id").alias("id")).where("id is not null and conv_id is not null")
    first = made.groupBy(F.col("conv_id").alias("c"), F.col("id").alias("i")).agg(F.min("turn").alias("call_turn")).withColumn("k", F.xxhash64("c", "i"))
    link_key = F.when(F.col("call_id").isNotNull(), F.xxhash64("conv_id", "call_id")).otherwise(F.xxhash64("turn", "text", "conv_id", F.lit("plain")))
    both = rows.withColumn("link", link_key).join(first, (F.col("link") == F.col("k")) & (F.col("conv_id") == F.col("c")) & (F.col("call_id") == F.col("i")), "left")

    call_json = lambda c: _object(("id", F.coalesce(_json(c["id"]), F.lit("null"))), ("name", _json(F.coalesce(c["name"], F.lit("")))), ("arguments", _canonical(c["arguments"])))
    faults = F.flatten(F.transform("calls", lambda c: F.array(F.when(c["id"].isNull(), F.lit("call without an id")), fault(c["name"], c["arguments"], c["raw"], schemas))))
    problems = F.array_join(F.array_sort(F.array_distinct(F.filter(faults, lambda f: f.isNotNull()))), "; ")
    has_calls, is_result = F.size("calls") > 0, F.col("call_id").isNotNull()
    content = F.when(has_calls | is_result, F.coalesce(text_of(F.col("said"), "$.content"), F.lit(""))).otherwise(F.col("text"))
    message = _object(
        ("role", _json(F.col("role"))), ("content", _json(content)),
        ("tool_calls", F.when(has_calls, F.concat(F.lit("["), F.array_join(F.transform("calls", call_json), ","), F.lit("]")))),
        ("tool_call_id", F.when(is_result, _json(F.col("call_id")))),
    )
    problem = F.when(is_result & F.col("call_turn").isNull(), F.lit("result without a call")).when(has_calls, problems).otherwise("")
    moved = F.coalesce(F.col("call_turn") >= F.col("turn"), F.lit(False))
    return both.select(
        "conv_id", "turn", F.when(moved, F.col("call_turn")).otherwise(F.col("turn")).alias("order_turn"), F.when(moved, 1).otherwise(0).alias("order_step"),
        "role", F.size("calls").alias("n_calls"), "call_turn", (problem == "").alias("valid"), problem.alias("problem"), message.alias("message"),
    )


def _given(arguments: Column) -> Column:
    """Arguments; none are an empty object, and so is null."""
    return F.when(_kind(arguments) == "null", F.parse_json(F.lit("{}"))).otherwise(arguments)
