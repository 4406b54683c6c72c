"""Chat formatting: tool-call linking, with DataFrame and SQL functions only.

Method. Results are hash-joined to calls by identifier. Calls are ordered topologically: each may name one call that it
comes ``after``; depths come from pointer doubling, so a chain of n calls takes log2(n) rounds of equi-joins, and a result
comes directly behind its call. Arguments are parsed once and validated against the call's schema (required, type, unknown
fields). Every call is serialised as canonical JSON: keys in order at every level, no white space, nulls left out.

Input. calls (conv_id, call_id, after, turn, name, arguments), results (conv_id, call_id, turn, content), schemas (name,
field, type, required); types are string, integer, number, boolean, array, object. Turns that are neither call nor result may be
given as others (conv_id, turn, role, content), so that a conversation is written whole.

Results. One row per call, per result that has no place in a call, and per other turn: conv_id, call_id, depth, order_key, status,
errors, record. ``order_key`` sorts a conversation in topological order, other turns by turn before all calls. status: unlinked (such a
turn; its record has the role as name and the text as result), ok, no_result, duplicate_call (the identifier was
taken by an earlier call), repeated_result, orphan_result, cycle (no order exists), no_id. errors: comma-joined
``field:missing``, ``field:type``, ``field:unknown``, ``json`` (not a JSON object), ``schema`` (no schema of that name).

Scale. All joins are on identifiers; no conversation is gathered in one task, so a conversation or a tool with a third of
all rows is spread like any other. Schemas are one row per tool name; Spark broadcasts them when their size allows.

Edge cases. Rows equal in all columns count once. Of several calls (results) of one identifier, the first by turn, then by a
hash of its content, holds it. A null identifier cannot be linked. A null turn sorts last; null arguments are no JSON. ``after`` that
names no call, or null, makes a root. Field names are compared as they are. Empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faceoff.llm.scratch import Scratch

CALLS, RESULTS = ("conv_id", "call_id", "after", "turn", "name", "arguments"), ("conv_id", "call_id", "turn", "content")
OTHERS = ("conv_id", "turn", "role", "content")
LATE = 2**62


def _first(rows: DataFrame, *body: str) -> DataFrame:
    """``rows`` with whether each holds its identifier."""
    place = F.struct(F.coalesce("turn", F.lit(LATE)).alias("turn"), F.xxhash64(*body).alias("hash"))
    held = rows.where("call_id is not null").groupBy("call_id").agg(F.min(place).alias("held"))
    return rows.join(held, "call_id", "left").withColumn("holds", F.coalesce(F.col("held") == place, F.lit(False))).drop("held")


def _depths(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(call_id, depth): calls before it in its chain; null on a cycle."""
    nodes = calls.where("holds").select("call_id", "after")
    known = nodes.select(F.col("call_id").alias("after"), F.lit(True).alias("is"))
    state = scratch.keep(nodes.join(known, "after", "left").select(
        "call_id", F.when(F.col("is"), F.col("after")).alias("on"), F.when(F.col("is"), 1).otherwise(0).cast("long").alias("depth")))
    left, before = state.where("on is not null").count(), -1
    while left and left != before:
        step = state.select(F.col("call_id").alias("on"), F.col("on").alias("next"), F.col("depth").alias("more"))
        moving = state.where("on is not null").join(step, "on").select("call_id", F.col("next").alias("on"), (F.col("depth") + F.col("more")).alias("depth"))
        new = scratch.keep(moving.union(state.where("on is null")))
        scratch.drop(state)
        state, before = new, left
        left = state.where("on is not null").count()
    return state.select("call_id", F.when(F.col("on").isNull(), F.col("depth")).alias("depth"))


def _fits(kind, wanted):
    """Whether a value's kind, as ``schema_of_variant`` names it, fits a schema type."""
    number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")
    return (F.when(wanted == "string", kind == "STRING").when(wanted == "integer", kind == "BIGINT").when(wanted == "number", number)
            .when(wanted == "boolean", kind == "BOOLEAN").when(wanted == "array", kind.startswith("ARRAY"))
            .when(wanted == "object", kind.startswith("OBJECT")).otherwise(False))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Calls with their results, in order, validated and serialised; other turns as they are."""
    scratch = Scratch(calls.sparkSession, "chat")
    calls = _first(calls.select(*CALLS).distinct(), "arguments", "name", "after", "conv_id")
    results = _first(results.select(*RESULTS).distinct(), "content", "conv_id")
    depths = _depths(calls.select("call_id", "after", "holds"), scratch)
    fields = schemas.select("name", "field", "type", "required").where("name is not null and field is not null").distinct().groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct("field", "type", "required"))).alias("schema"))
    parsed = F.try_parse_json("arguments")
    whole = calls.withColumn("value", F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)).withColumn(
        "given", F.col("value").cast("map<string,variant>")).join(fields, "name", "left")
    has = lambda s: F.map_contains_key("given", s.field)
    error = lambda cells, what: F.transform(cells, lambda x: F.concat(x, F.lit(f":{what}")))
    name = lambda cells: F.transform(cells, lambda s: s.field)
    missing = error(name(F.filter("schema", lambda s: F.coalesce(s.required, F.lit(False)) & ~has(s))), "missing")
    wrong = error(name(F.filter("schema", lambda s: has(s) & ~_fits(F.schema_of_variant(F.element_at("given", s.field)), s.type))), "type")
    unknown = error(F.filter(F.map_keys("given"), lambda k: ~F.exists("schema", lambda s: s.field == k)), "unknown")
    errors = F.when(F.col("given").isNull(), "json").when(F.col("schema").isNull(), "schema").otherwise(
        F.array_join(F.array_sort(F.concat(missing, wrong, unknown)), ","))
    answer = results.where("holds").select("call_id", F.lit(True).alias("answered"), F.col("content").alias("result"), F.lit(True).alias("holds"))
    joined = whole.withColumn("errors", errors).join(answer, ["call_id", "holds"], "left").join(
        depths.withColumn("holds", F.lit(True)), ["call_id", "holds"], "left")
    status = (F.when(F.col("call_id").isNull(), "no_id").when(~F.col("holds"), "duplicate_call").when(F.col("depth").isNull(), "cycle")
              .when(F.col("answered"), "ok").otherwise("no_result"))
    first = joined.select("conv_id", "call_id", "depth", status.alias("status"), "errors",
                          F.to_json("value").alias("canonical"), "name", "result")
    taken = calls.where("holds").select("call_id", F.lit(True).alias("called"))
    rest = results.join(taken, "call_id", "left").where(~F.col("holds") | F.col("called").isNull()).select(
        "conv_id", "call_id", F.lit(None).cast("long").alias("depth"),
        F.when(F.col("call_id").isNull(), "no_id").when(F.col("called").isNull(), "orphan_result").otherwise("repeated_result").alias("status"),
        F.lit("").alias("errors"), F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("string").alias("name"), F.col("content").alias("result"))
    late = lambda c: F.lpad(F.coalesce(c, F.lit(9_999_999_999)).cast("string"), 10, "0")
    order = F.concat_ws(":", late("depth"), F.coalesce("call_id", F.lit("")))
    every = first.unionByName(rest).withColumn("order_key", order)
    if others is not None:
        apart = others.select(*OTHERS).distinct()
        every = every.unionByName(apart.select(
            "conv_id", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("depth"), F.lit("unlinked").alias("status"),
            F.lit("").alias("errors"), F.lit(None).cast("string").alias("canonical"), F.col("role").alias("name"), F.col("content").alias("result"),
            F.concat(F.lit("-"), late("turn")).alias("order_key")))
    # one key after the other, in alphabetical order; the parsed arguments print their keys in order
    part = lambda key, value, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{key}":'), value))
    string = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).cast("string").alias("v"))), r"(?s)\A\{\"v\":|\}\z", "")
    record = F.concat(F.lit("{"), F.concat_ws(
        ",", part("arguments", F.col("canonical"), "canonical"), part("call_id", string("call_id"), "call_id"), part("conv_id", string("conv_id"), "conv_id"),
        part("depth", F.col("depth").cast("string"), "depth"), part("errors", string("errors"), "errors"), part("name", string("name"), "name"),
        part("result", string("result"), "result"), part("status", string("status"), "status")), F.lit("}"))
    return every.select("conv_id", "call_id", "depth", "order_key", "status", "errors", record.alias("record"))
