"""Tool-call linking for chat data.

Calls and results are joined by call identifier.  A call may depend on other
calls; calls get a topological order: a call whose dependencies all stand before
it in its conversation is placed by its turn, and only conversations with a
dependency that points ahead go through rounds of peeling (Kahn), each round a
join.  Calls on a cycle get no place.  Arguments are parsed and validated against
the tool's JSON schema, and every linked exchange is serialised as canonical JSON
(sorted keys, no blanks, no escapes beyond the required ones).

One row per call is made, never one per conversation, so a conversation with a
large share of all rows is spread like any other rows.

Defined results: a null or unknown identifier links nothing; of several results
of a call the first by (turn, content) is linked, the others are rows of their own (kind
"extra", with the call's place and name), and all are counted; results that repeat the
linked one in turn and content are that result; repeated
calls each get their row and the same result; null or empty arguments are an
empty object; arguments that are not a JSON object are invalid and kept as text;
a tool without a schema makes its calls invalid; results without a call are
orphans, in rows of their own; other columns are not read; empty tables give an
empty result.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import field, stage

_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int,
}


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What of a JSON schema (type, enum, bounds, pattern, required, properties,
    additionalProperties, items) a value violates, in a fixed order."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{path}: type"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: enum")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    size = len(value) if isinstance(value, (str, list)) else None
    ends = "Length" if isinstance(value, str) else "Items"
    if number and value < schema.get("minimum", value):
        out.append(f"{path}: minimum")
    if number and value > schema.get("maximum", value):
        out.append(f"{path}: maximum")
    if size is not None and size < schema.get(f"min{ends}", 0):
        out.append(f"{path}: min{ends}")
    if size is not None and size > schema.get(f"max{ends}", size):
        out.append(f"{path}: max{ends}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{path}: pattern")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: required" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: additional")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{path}[{i}]")
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _parsed(text: str | None):
    """(arguments, whether they are a JSON object)."""
    if text is None or not text.strip():
        return {}, True
    try:
        value = json.loads(text, parse_constant=lambda x: x)
    except ValueError:
        return text, False
    return (value, True) if isinstance(value, dict) else (text, False)


def _serialise(schemas: dict[str, dict]):
    def run(batches):
        for pdf in batches:
            valid, errors, out = [], [], []
            for r in pdf.itertuples(index=False):
                call = None if r.call_id is None or pd.isna(r.call_id) else str(r.call_id)
                result = None if r.content is None or pd.isna(r.content) else str(r.content)
                if r.kind != "call":
                    valid.append(r.kind == "extra")
                    errors.append("" if r.kind == "extra" else "no call")
                    out.append(canonical({"call_id": call, "result": result}))
                    continue
                name = None if r.name is None or pd.isna(r.name) else str(r.name)
                args, ok = _parsed(None if r.arguments is None or pd.isna(r.arguments) else r.arguments)
                bad = ["$: not an object"] if not ok else ["unknown tool"] if name not in schemas else violations(args, schemas[name])
                valid.append(not bad)
                errors.append("; ".join(bad))
                needs = [] if r.needs is None else sorted(str(x) for x in r.needs if x is not None)
                out.append(canonical({"arguments": args, "call_id": call, "depends_on": needs, "name": name, "result": result}))
            yield pdf[["conv", "turn", "call_id", "kind", "name", "place", "n_results", "missing"]].assign(
                valid=valid, errors=errors, json=out)
    return run


def _places(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv) where some dependency does not point back, and places
    (call_id, place) in them by rounds of peeling; a call on or behind a cycle has
    no row."""
    ids = calls.where("call_id IS NOT NULL")
    at = ids.groupBy("call_id").agg(F.min("turn").alias("dep_turn"))
    edges = (ids.select("conv", "call_id", "turn", F.explode(F.array_distinct("needs")).alias("dep"))
             .join(at.withColumnRenamed("call_id", "dep"), "dep"))
    ahead = stage(edges.where("dep_turn >= turn").select(F.col("conv").alias("ahead")).distinct(), "calls-ahead")
    some = stage(ids.join(ahead, F.col("conv").eqNullSafe(F.col("ahead")), "left_semi").select("call_id", "needs"), "calls-moved")
    rest = stage(some.select("call_id").distinct(), "call-rest")
    open_ = stage(some.select("call_id", F.explode(F.array_distinct("needs")).alias("dep"))
                  .join(rest.withColumnRenamed("call_id", "dep"), "dep").select("call_id", "dep").distinct(), "call-edges")
    done, level = None, 0
    while True:
        free = stage(rest.join(open_.select("call_id"), "call_id", "left_anti").withColumn("place", F.lit(level).cast("long")),
                     "call-level")
        if free.isEmpty():
            return ahead, free if done is None else done
        done = free if done is None else done.unionByName(free)
        rest = stage(rest.join(free.select("call_id"), "call_id", "left_anti"), "call-rest")
        open_ = stage(open_.join(free.select(F.col("call_id").alias("dep")), "dep", "left_anti"), "call-edges")
        level += 1


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls``: conv, turn, call_id, name, arguments (JSON text), needs (array of
    call ids); ``results``: conv, turn, call_id, content.  One row per call, per further
    result of a call and per orphan result: conv, turn, call_id, kind, name, place,
    n_results, missing (dependencies without a call), valid, errors, json."""
    calls = calls.select("conv", "turn", "call_id", "name", F.col("arguments").cast("string").alias("arguments"),
                         F.coalesce("needs", F.array().cast(field(calls, "needs"))).alias("needs"))
    results = results.select("conv", "turn", "call_id", "content")
    first = stage(results.where("call_id IS NOT NULL").groupBy("call_id").agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")), "call-results")
    known = calls.where("call_id IS NOT NULL").select("call_id").distinct()
    lost = (calls.select(F.explode(F.array_distinct("needs")).alias("dep")).distinct()
            .join(known.select(F.col("call_id").alias("dep")), "dep", "left_anti"))
    missing = (calls.where("call_id IS NOT NULL").select("call_id", F.explode("needs").alias("dep")).distinct()
               .join(lost, "dep").groupBy("call_id").agg(F.count(F.lit(1)).alias("missing")))
    ahead, moved = _places(calls)
    ahead = ahead.withColumn("moved", F.lit(True))
    out = (calls.join(first, "call_id", "left").join(missing, "call_id", "left").join(moved, "call_id", "left")
           .join(ahead, F.col("conv").eqNullSafe(F.col("ahead")), "left"))
    place = F.when(F.col("moved").isNull(), F.col("turn").cast("long")).otherwise(F.col("place"))
    linked = out.select("conv", "turn", "call_id", F.lit("call").alias("kind"), "name", "arguments", "needs",
                        F.col("r.content").alias("content"), place.alias("place"),
                        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
                        F.coalesce("missing", F.lit(0)).cast("long").alias("missing"))
    orphans = (results.join(known, "call_id", "left_anti")
               .select("conv", "turn", "call_id", F.lit("orphan").alias("kind"), F.lit(None).cast("string").alias("name"),
                       F.lit(None).cast("string").alias("arguments"), F.array().cast(field(calls, "needs")).alias("needs"), "content",
                       F.lit(None).cast("long").alias("place"), F.lit(0).cast("long").alias("n_results"),
                       F.lit(0).cast("long").alias("missing")))
    # results beyond the linked one, with what is known of their call (of repeated calls, the first)
    many = first.where("n_results > 1").select("call_id", F.col("r").alias("linked"), F.col("n_results").alias("n"))
    of_call = stage(linked.where("call_id IS NOT NULL AND n_results > 1").groupBy("call_id").agg(F.min(F.struct("turn", "name", "place")).alias("c")),
                    "calls-with-more")
    extra = (results.join(many, "call_id").where(~F.struct("turn", "content").eqNullSafe(F.col("linked"))).join(of_call, "call_id")
             .select("conv", "turn", "call_id", F.lit("extra").alias("kind"), F.col("c.name").alias("name"),
                     F.lit(None).cast("string").alias("arguments"), F.array().cast(field(calls, "needs")).alias("needs"), "content",
                     F.col("c.place").alias("place"), F.col("n").cast("long").alias("n_results"), F.lit(0).cast("long").alias("missing")))
    rows = linked.unionByName(orphans).unionByName(extra)
    keep = ["conv", "turn", "call_id", "kind", "name", "place", "n_results", "missing"]
    schema = T.StructType([*(T.StructField(n, field(rows, n)) for n in keep), T.StructField("valid", T.BooleanType()),
                           T.StructField("errors", T.StringType()), T.StructField("json", T.StringType())])
    return rows.mapInPandas(_serialise(schemas), schema)
