"""Operator 3 [native]: tool calls linked to results, ordered, validated, serialised.

Calls and results meet in a hash join on their identifier. Each call may name the call whose result
it uses; levels along these links are found by pointer doubling, so a chain of n calls takes log2(n)
joins, and a cycle is noticed when a round settles nothing. Positions inside a conversation come from
key ranges, so a conversation of any length is spread over tasks. Arguments are read as variants,
checked against schemas, and written with sorted keys and without white space.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etholith.llm.common import query, stored, table
from etholith.operators.ordered import row_index

#: Types of a JSON value by what `schema_of_variant` says of it.
TYPES = {
    "string": "^STRING$",
    "integer": r"^BIGINT$|^DECIMAL\(\d+,0\)$",
    "number": r"^BIGINT$|^DECIMAL|^DOUBLE$|^FLOAT$",
    "boolean": "^BOOLEAN$",
    "object": "^OBJECT",
    "array": "^ARRAY",
    "null": "^VOID$",
}
KEY = ["conv_id", "call_id"]

#: Schemas of the calls that plain turns stand for.
TURNS = {
    "configure": {"properties": {"instructions": {"type": "string", "minLength": 1}, "turn": {"type": "integer"}}, "required": ["instructions", "turn"]},
    "respond": {"properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"]},
}


def _field(node: Column, name: str) -> Column:
    """A property of an object as a variant; null where it is missing (JSON null is a value)."""
    if re.fullmatch(r"[^'\"\\\[\]]+", name):
        return F.try_variant_get(node, f"$['{name}']", "variant")
    return F.try_element_at(F.try_variant_get(node, "$", "map<string,variant>"), F.lit(name))


def _is(kind: Column, types: str | list[str]) -> Column:
    """Whether what `schema_of_variant` says is one of the types."""
    return kind.rlike("|".join(TYPES[t] for t in ([types] if isinstance(types, str) else types)))


def _among(node: Column, kind: Column, values: list) -> Column:
    """Whether a value equals one of the listed ones, of any type; numbers by their value."""
    numbers = [float(v) for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
    others = [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in values if isinstance(v, bool) or not isinstance(v, (int, float))]
    numeric = _is(kind, "number")
    return F.when(numeric, F.try_variant_get(node, "$", "double").isin(numbers) if numbers else F.lit(False)).otherwise(
        F.to_json(node).isin(others) if others else F.lit(False)
    )


def _problems(node: Column, schema: dict, path: str) -> Column:
    """Array of what is wrong with a variant by a schema, nested properties and items included.

    A missing ``type`` allows any, a list of types each of them. Parts of a value are named by their
    path (``a.b``, ``list[]``). Objects with listed properties take no others unless the schema says so.
    """
    kind = F.schema_of_variant(node)
    number, text = F.try_variant_get(node, "$", "double"), F.try_variant_get(node, "$", "string")
    told = lambda what, where=path: F.lit(f"{what} {where}".strip())
    tests = []
    if "type" in schema:
        tests.append(F.when(~_is(kind, schema["type"]), told("type")))
    for word, size, what in (("minLength", F.length(text), "short"), ("maxLength", -F.length(text), "long")):
        if word in schema:
            limit = schema[word] if word == "minLength" else -schema[word]
            tests.append(F.when(_is(kind, "string") & (size < limit), told(what)))
    for word, wrong, what in (
        ("minimum", lambda v: number < v, "small"), ("exclusiveMinimum", lambda v: number <= v, "small"),
        ("maximum", lambda v: number > v, "large"), ("exclusiveMaximum", lambda v: number >= v, "large"),
    ):
        if word in schema:
            tests.append(F.when(_is(kind, "number") & wrong(float(schema[word])), told(what)))
    if "enum" in schema:
        tests.append(F.when(~F.coalesce(_among(node, kind, schema["enum"]), F.lit(False)), told("value")))
    below = lambda name: f"{path}.{name}" if path else name
    parts, none = [], F.array().cast("array<string>")
    is_object = _is(kind, "object")
    for name in schema.get("required", []):
        tests.append(F.when(is_object & _field(node, name).isNull(), told("missing", below(name))))
    for name, inner in sorted(schema.get("properties", {}).items()):
        child = _field(node, name)
        parts.append(F.when(is_object & child.isNotNull(), _problems(child, inner, below(name))).otherwise(none))
    if "properties" in schema and not schema.get("additionalProperties", False):
        others = F.array_except(F.json_object_keys(F.to_json(node)), F.array(*map(F.lit, schema["properties"])).cast("array<string>"))
        parts.append(F.when(is_object, F.transform(others, lambda k: F.concat(F.lit("unexpected " + (path + "." if path else "")), k))).otherwise(none))
    if "items" in schema:
        each = F.transform(F.try_variant_get(node, "$", "array<variant>"), lambda v: _problems(v, schema["items"], f"{path}[]"))
        parts.append(F.when(_is(kind, "array"), F.array_distinct(F.flatten(each))).otherwise(none))
    return F.concat(F.array_compact(F.array(*[t.cast("string") for t in tests], F.lit(None).cast("string"))), *parts)


def _faults(schemas: dict) -> Column:
    """Sorted names of what is wrong with the arguments; empty if nothing is."""
    per_tool = F.lit(None).cast("array<string>")
    for tool, schema in sorted(schemas.items()):
        whole = {"properties": {}, **schema}
        per_tool = F.when(F.col("name") == tool, F.array_sort(_problems(F.col("_args"), whole, ""))).otherwise(per_tool)
    shape = F.schema_of_variant("_args")
    return (
        F.when(F.col("name").isNull(), F.array().cast("array<string>"))
        .when(~F.coalesce(F.col("name").isin(list(schemas)), F.lit(False)), F.array(F.lit("unknown tool")))
        .when(F.col("_args").isNull(), F.array(F.lit("invalid json")))
        .when(~shape.startswith("OBJECT"), F.array(F.lit("not an object")))
        .otherwise(per_tool)
    )


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): links above a call; null on and below a cycle.

    ``calls`` has one row per (conv_id, call_id) and ``after``; a link to no call is none.
    """
    known = calls.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_k"))
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    state = calls.join(known, same & (F.col("after") == F.col("_k")), "left").select(
        *KEY, F.col("_k").alias("up"), F.when(F.col("_k").isNull(), 0).otherwise(1).cast("long").alias("level")
    )
    state = stored(state)
    open_rows = state.filter("up IS NOT NULL").count()
    while open_rows:
        above = state.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_k"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        moved = (
            state.filter("up IS NOT NULL")
            .join(above, same & (F.col("up") == F.col("_k")))
            .select(*KEY, F.col("_up").alias("up"), (F.col("level") + F.col("_level")).alias("level"))
        )
        state = stored(state.filter("up IS NULL").union(moved))
        left = state.filter("up IS NOT NULL").count()
        if left == open_rows:
            break
        open_rows = left
    return state.select(*KEY, F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per identifier: conv_id, call_id, turn, name, status, level, position, valid, errors, record.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), after; ``results``: conv_id, turn,
    call_id, content; further columns are left out. Of repeated identifiers the row of the least turn
    counts (then the least content). ``status`` is linked, unanswered (no result), orphan (a result
    without a call), or early (a result before its call). Rows without an identifier are left out.
    ``position`` orders a conversation's calls by (level, turn, identifier), cycles and orphans last.
    ``record`` is canonical JSON: keys sorted at every depth, no white space; arguments that are no
    JSON are null there.
    """
    one_call = (
        calls.filter(F.col("call_id").isNotNull())
        .groupBy(*KEY)
        .agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
        .select(*KEY, F.col("c.turn").alias("turn"), F.coalesce("c.name", F.lit("")).alias("name"), "c.arguments", "c.after")
    )
    one_call = stored(one_call)
    one_result = (
        results.filter(F.col("call_id").isNotNull())
        .groupBy(*KEY)
        .agg(F.min(F.struct("turn", "content")).alias("r"))
        .select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_k"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"), F.lit(True).alias("_got"))
    )
    ranked = levels(one_call.select(*KEY, "after")).select(F.col("conv_id").alias("_lc"), F.col("call_id").alias("_lk"), "level")
    leveled = one_call.join(ranked, F.col("conv_id").eqNullSafe(F.col("_lc")) & (F.col("call_id") == F.col("_lk"))).drop("_lc", "_lk")
    joined = leveled.join(one_result.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_k")), "full")
    status = (
        F.when(F.col("name").isNull(), "orphan")
        .when(F.col("_got").isNull(), "unanswered")
        .when(F.col("result_turn") < F.col("turn"), "early")
        .otherwise("linked")
    )
    rows = joined.select(
        F.when(F.col("call_id").isNull(), F.col("_c")).otherwise(F.col("conv_id")).alias("conv_id"),
        F.coalesce("call_id", "_k").alias("call_id"),
        F.coalesce("turn", "result_turn").alias("turn"),
        "name",
        "arguments",
        "result",
        "level",
        status.alias("status"),
        F.try_parse_json("arguments").alias("_args"),
    )
    checked = rows.withColumn("errors", _faults(schemas))
    record = F.to_json(
        F.struct(
            F.col("_args").alias("arguments"), "call_id", "conv_id", F.col("errors"), "level", F.col("name"), F.col("result"), F.col("status"), "turn"
        ),
        {"ignoreNullFields": "false"},
    )
    done = checked.select(
        *KEY, "turn", "name", "status", "level", (F.col("name").isNotNull() & (F.size("errors") == 0)).alias("valid"), "errors", record.alias("record")
    )
    done = stored(done.withColumn("_last", F.col("level").isNull()))
    placed = row_index(done.select(*KEY, "_last", "level", "turn"), ["conv_id"], ["_last", "level", "turn", "call_id"], "position")
    placed = placed.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_k"), F.col("position").cast("long").alias("position"))
    return done.drop("_last").join(placed, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_k"))).drop("_c", "_k")


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in chat messages (conv_id, turn, role, text) that carry them as JSON.

    Assistant texts ``{"tool_calls": [{"id", "name", "arguments", "after"}]}`` are calls, texts of
    role ``tool`` ``{"tool_call_id", "content"}`` results. Other messages give nothing.
    """
    shape = "tool_calls array<struct<id string, name string, arguments string, after string>>"
    calls = (
        messages.filter(F.col("role") == "assistant")
        .select("conv_id", "turn", F.explode(F.from_json("text", shape)["tool_calls"]).alias("c"))
        .select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.after")
    )
    got = F.from_json("text", "tool_call_id string, content string")
    results = messages.filter(F.col("role") == "tool").select("conv_id", "turn", got["tool_call_id"].alias("call_id"), got["content"].alias("content"))
    return calls, results


def turn_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls: a user turn asks for a response, a system turn configures.

    The identifier is ``conv_id:turn``. An assistant turn is the result of the turn before it. A
    user turn uses the result of the user turn two before, the second turn that of the first.
    """
    number = F.col("turn").cast("string")
    name = F.when(F.col("role") == "system", "configure").otherwise("respond")
    system = F.col("role") == "system"
    arguments = F.when(system, F.to_json(F.struct(F.col("text").alias("instructions"), "turn"))).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"), "turn")))
    conv = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"))
    calls = messages.filter(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", F.concat(conv, number).alias("call_id"), name.alias("name"), arguments.alias("arguments"),
        F.when(F.col("turn") >= 1, F.concat(conv, F.greatest(F.col("turn") - 2, F.lit(0)).cast("string"))).alias("after"),
    )
    results = messages.filter(F.col("role") == "assistant").select("conv_id", "turn", F.concat(conv, (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


SQL = """WITH RECURSIVE src AS (SELECT conv_id, turn, role, text, coalesce(CAST(conv_id AS VARCHAR), 'null') || ':' AS c FROM conversations),
calls AS (SELECT conv_id, c || CAST(turn AS VARCHAR) AS call_id, turn, CASE WHEN role = 'system' THEN 'configure' ELSE 'respond' END AS name, text,
  CASE WHEN turn >= 1 THEN c || CAST(greatest(turn - 2, 0) AS VARCHAR) END AS after FROM src WHERE role IN ('user', 'system') AND turn IS NOT NULL),
results AS (SELECT conv_id, c || CAST(turn - 1 AS VARCHAR) AS call_id, turn AS result_turn, text AS result FROM src WHERE role = 'assistant' AND turn IS NOT NULL),
walk AS (SELECT a.conv_id, a.call_id, 0::BIGINT AS level FROM calls a WHERE NOT EXISTS (SELECT 1 FROM calls b WHERE b.call_id = a.after)
  UNION ALL SELECT a.conv_id, a.call_id, w.level + 1 FROM calls a JOIN walk w ON a.after = w.call_id),
linked AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.result_turn) AS turn,
  c.name, w.level, result, CASE WHEN c.name IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  CASE WHEN c.name IS NULL THEN '' WHEN c.text IS NULL THEN 'missing ' || key WHEN c.text = '' THEN 'short ' || key ELSE '' END AS errors,
  CASE WHEN c.name IS NULL THEN NULL WHEN c.text IS NULL THEN json_object('turn', c.turn) WHEN c.name = 'configure' THEN json_object('instructions', c.text, 'turn', c.turn)
  ELSE json_object('prompt', c.text, 'turn', c.turn) END AS arguments
  FROM (SELECT *, CASE WHEN name = 'configure' THEN 'instructions' ELSE 'prompt' END AS key FROM calls) c
  LEFT JOIN walk w ON w.call_id = c.call_id FULL JOIN results r ON c.call_id = r.call_id)
SELECT conv_id, call_id, turn, name, status, level, name IS NOT NULL AND errors = '' AS valid, errors,
  CAST(json_object('arguments', arguments, 'call_id', call_id, 'conv_id', conv_id,
    'errors', CASE WHEN errors = '' THEN json('[]') ELSE json_array(errors) END,
    'level', level, 'name', name, 'result', result, 'status', status, 'turn', turn) AS VARCHAR) AS record,
  row_number() OVER (PARTITION BY conv_id ORDER BY level IS NULL, level, turn, call_id) - 1 AS position FROM linked"""


@query("op3_tool_calls", SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turn_calls(table(spark, sf_dir, "conversations"))
    return link_calls(calls, results, TURNS).withColumn("errors", F.concat_ws(";", "errors"))
