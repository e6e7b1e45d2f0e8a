"""Chat formatting: tool calls linked with their results, ordered, validated and serialised, with DataFrame functions only.

Calls (``conv_id, call_id, turn, name, arguments, depends_on``) and results (``conv_id, call_id, turn, content``) are hash-joined by conversation and
identifier. Calls are ordered topologically: depth 0 depends on no call of its conversation, and each next depth only on lesser ones; a call in or
behind a cycle has no depth. Arguments are JSON objects, checked against the schema of the named tool: ``type``, ``enum``, ``properties`` and ``required`` of
objects at any depth, ``items`` of arrays; fields that no schema names are faults unless it has ``additionalProperties``. Fields are looked up by key,
never by path. Each row is serialised as canonical JSON: sorted keys, no spaces, one form for each number (plain digits without
trailing zeros up to 20 digits before and 18 after the point, beyond that the shortest form of the nearest double).

A row is a call or a result, never a whole conversation, and sorts by (conv_id, depth, turn, call_id); a conversation that holds a third of all rows is
therefore no group of its own. The first call and result of an identifier are minima with partial sums; only these firsts are joined, so that an
identifier that a third of the rows repeat, or rows without one, meet in no task. Each round of the ordering joins only the calls that became ready in
the last one, and is written to the shared folder; there are as many rounds as the longest chain of dependencies has links.

Edge cases: of several calls or results with one identifier the first (turn, then name and text, then dependencies) is linked and the others are ``repeated``; results without
a call are ``orphan``; calls without a result are ``open``; rows without conv_id or call_id link with nothing (calls open, results orphan); null or unparsable arguments, and
objects that repeat a key, are not valid; very long arguments are one row as any other; dependencies on calls that do not exist are ignored; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.store import written

# JSON Schema type names and the variant types that they admit.
_KINDS = {"string": ["STRING"], "integer": ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"], "number": ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"], "null": ["VOID"]}
_NO_FAULT = "array<string>"
_COMPACT_EVERY = 8


def canonical(text: Column) -> Column:
    """JSON as Spark writes it, with one form for each number."""
    # marks for escaped backslashes and quotes, which can't occur raw: then a string ends at the next quote
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    tokens = F.regexp_extract_all(marked, F.lit('"[^"]*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++'), F.lit(0))
    plain = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), _number(t)).otherwise(t)), "")
    back = F.replace(F.replace(plain, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(text.rlike("[0-9][.eE][0-9+-]"), back).otherwise(text)


def _number(t: Column) -> Column:
    d = t.try_cast("decimal(38,18)")
    digits = F.regexp_replace(F.format_string("%s", F.regexp_replace(d.cast("string"), "^-?0E-18$", "0.0")), "\\.?0+$", "")
    return F.when(t.rlike("^-?[0-9]+$"), t).when(d.isNotNull() & (d.cast("double") == t.try_cast("double")), F.when(d == 0, F.lit("0")).otherwise(digits)).otherwise(t)


def _schema(of: dict | str) -> dict:
    return {"type": of} if isinstance(of, str) else of


def _fails(schema: dict | str, value: Column, at: Column) -> Column:
    """What of a JSON value (variant) breaks a schema, as strings that begin with the place ``at`` (empty: the arguments themselves)."""
    schema = _schema(schema)
    named = lambda what: F.concat(F.when(at == "", F.lit("arguments")).otherwise(at), F.lit(f": {what}"))
    inner = lambda key: F.concat(F.when(at == "", F.lit("")).otherwise(F.concat(at, F.lit("."))), key)
    kind = schema.get("type")
    held = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    none = F.array().cast(_NO_FAULT)
    parts = []
    if "enum" in schema:
        allowed = [canonical(F.to_json(F.parse_json(F.lit(json.dumps(x))))) for x in schema["enum"]]
        parts.append(F.when(~canonical(F.to_json(value)).isin(*allowed), F.array(named("not one of the values"))).otherwise(none))
    if kind in (None, "object") and ("properties" in schema or "required" in schema or kind == "object"):
        fields = F.from_json(F.to_json(value), "map<string,variant>")
        properties = schema.get("properties", {})
        own = [F.when(~F.map_contains_key(fields, F.lit(k)), F.array(F.concat(inner(F.lit(k)), F.lit(": missing")))).otherwise(none) for k in schema.get("required", [])]
        own += [F.when(F.map_contains_key(fields, F.lit(k)), _fails(of, F.try_element_at(fields, F.lit(k)), inner(F.lit(k)))).otherwise(none) for k, of in properties.items()]
        if not schema.get("additionalProperties", False):
            known = F.array(*[F.lit(k) for k in properties]).cast(_NO_FAULT)
            own.append(F.transform(F.array_except(F.map_keys(fields), known), lambda k: F.concat(inner(k), F.lit(": unknown"))))
        parts.append(F.when(held == "OBJECT", F.concat(*own) if own else none).otherwise(none))
    if "items" in schema:
        every = F.transform(F.from_json(F.to_json(value), "array<variant>"), lambda x, i: _fails(schema["items"], x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        parts.append(F.when(held == "ARRAY", F.flatten(every)).otherwise(none))
    faults = F.concat(*parts) if parts else none
    if kind is None:
        return faults
    right = held.isin(*_KINDS[kind])
    if kind == "integer":
        number = F.try_variant_get(value, "$", "double")
        right = right & ((held == "BIGINT") | F.coalesce(number == F.floor(number), F.lit(False)))
    return F.when(~right, F.array(named(f"not {kind}"))).otherwise(faults)


def validated(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Adds ``faults`` (an array of strings, empty if the arguments are valid) and ``parsed`` (variant) to calls."""
    parsed = calls.withColumn("parsed", F.try_parse_json("arguments"))
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    faults = F.when(~is_object, F.array(F.lit("arguments: not an object")))
    for name, schema in schemas.items():
        faults = faults.when(F.col("name") == name, F.array_sort(_fails({"type": "object"} | schema, F.col("parsed"), F.lit(""))))
    return parsed.withColumn("faults", faults.otherwise(F.array(F.lit("name: no such tool"))))


def depths(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, depth`` of the calls that can be ordered, from distinct ``conv_id, call_id, depends_on``."""
    own = calls.select("conv_id", "call_id")
    asked = calls.select("conv_id", "call_id", F.explode("depends_on").alias("on")).where("on IS NOT NULL").distinct()
    needs = written(asked.join(own.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi"), "chat-needs")
    ready = written(own.join(needs, ["conv_id", "call_id"], "left_anti").withColumn("depth", F.lit(0)), "chat-ready")
    done, depth = ready, 0
    waiting = written(needs.groupBy("conv_id", "call_id").agg(F.count("*").alias("missing")), "chat-waiting")
    while waiting.head(1) and ready.head(1):
        depth += 1
        met = needs.join(ready.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"], "left_semi").groupBy("conv_id", "call_id").agg(F.count("*").alias("met"))
        left = written(waiting.join(met, ["conv_id", "call_id"], "left").select("conv_id", "call_id", (F.col("missing") - F.coalesce("met", F.lit(0))).alias("missing")), "chat-left")
        ready = left.where("missing = 0").select("conv_id", "call_id", F.lit(depth).alias("depth"))
        waiting = left.where("missing > 0")
        done = done.unionByName(ready)
        if depth % _COMPACT_EVERY == 0:
            done = written(done, "chat-done")
    return done


def _firsts(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each identifier, and all other rows (``repeated``: whether they have an identifier)."""
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), f"chat-{name}")
    keyed = rows.where("conv_id IS NOT NULL AND call_id IS NOT NULL")
    least = keyed.groupBy("conv_id", "call_id").agg(F.min(F.struct(*order, "uid")).alias("one"))
    first = written(least.select("conv_id", "call_id", "one.*"), f"chat-{name}-first")
    other = rows.join(first.select("uid"), "uid", "left_anti").withColumn("repeated", F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    return first.drop("uid"), other.drop("uid")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``conv_id, call_id, depth, turn, kind, name, status, valid, faults, json``: one row per call, and per result that is linked with none."""
    call, more_calls = _firsts(calls.select("conv_id", "call_id", F.col("turn").alias("call_turn"), "name", "arguments", "depends_on"), ["call_turn", "name", "arguments", "depends_on"], "calls")
    result, more_results = _firsts(results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content"), ["result_turn", "content"], "results")
    first = call.withColumn("is_call", F.lit(True)).join(result.withColumn("has_result", F.lit(True)).hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer")
    first = first.withColumn("is_call", F.coalesce("is_call", F.lit(False))).withColumn("has_result", F.coalesce("has_result", F.lit(False))).withColumn("repeated", F.lit(False))
    first = first.join(depths(call), ["conv_id", "call_id"], "left").drop("depends_on")
    others = more_calls.drop("depends_on").withColumn("is_call", F.lit(True)).withColumn("has_result", F.lit(False))
    others = others.unionByName(more_results.withColumn("is_call", F.lit(False)).withColumn("has_result", F.lit(True)), allowMissingColumns=True)
    rows = validated(first.unionByName(others, allowMissingColumns=True), schemas)
    call_side = F.col("is_call")
    status = F.when(F.col("repeated"), F.lit("repeated")).when(call_side & F.col("has_result"), F.lit("linked")).when(call_side, F.lit("open")).otherwise(F.lit("orphan"))
    rows = rows.withColumn("kind", F.when(call_side, F.lit("call")).otherwise(F.lit("result"))).withColumn("status", status)
    rows = rows.withColumn("turn", F.when(call_side, F.col("call_turn")).otherwise(F.col("result_turn"))).withColumn("faults", F.when(call_side, F.col("faults")))
    body = F.to_json(F.struct("call_id", "content", "conv_id", "depth", "kind", "name", "status", "turn"), {"ignoreNullFields": "true"})
    arguments = F.when(call_side & F.col("parsed").isNotNull(), F.concat(F.lit('"arguments":'), canonical(F.to_json("parsed")), F.lit(",")))
    text = F.concat(F.lit("{"), F.coalesce(arguments, F.lit("")), F.substr(body, F.lit(2)))
    return rows.select("conv_id", "call_id", "depth", "turn", "kind", "name", "status", (F.size("faults") == 0).alias("valid"), F.array_join("faults", "; ").alias("faults"), text.alias("json"))


# The exchange of roles in plain conversations, read as tool use: what the system and users say are calls, and an assistant's turn answers the turn before it.
CHAT_SCHEMAS = {
    "configure": {"properties": {"text": "string"}, "required": ["text"]},
    "ask": {"properties": {"text": "string", "turn": "integer"}, "required": ["text", "turn"]},
}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``conversations`` (``conv_id, turn, role, text``); users' calls depend on the system's, which is turn 0."""
    call_id = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    calls = conversations.where("role IN ('system', 'user')").select(
        "conv_id", call_id(F.col("turn")).alias("call_id"), "turn", F.when(F.col("role") == "system", F.lit("configure")).otherwise(F.lit("ask")).alias("name"),
        F.when(F.col("role") == "system", F.to_json(F.struct("text"))).otherwise(F.to_json(F.struct("turn", "text"))).alias("arguments"),
        F.when((F.col("role") == "user") & (F.col("turn") > 0), F.array(F.lit("t0"))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = conversations.where("role NOT IN ('system', 'user') OR role IS NULL").select("conv_id", call_id(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
