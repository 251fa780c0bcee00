"""Tool-call linking: calls meet results by identifier, in topological order, with arguments checked and canonical JSON."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.storage import discard, stored
from corpusflow.session import shared_folder

#: Arguments name the result of another call as {"$ref": "<call id>"}.
REFERENCE = r'"\$ref"\s*:\s*"((?:[^"\\]|\\.)*)"'
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
# Words of JSON Schema that say nothing about a value, and those that are checked.
_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "format"}
_WORDS = {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "required",
          "properties", "additionalProperties", "items", "minItems", "maxItems", "anyOf", "allOf"}
_BOUNDS = [("minimum", "below minimum", lambda v, limit: v < limit), ("maximum", "above maximum", lambda v, limit: v > limit),
           ("exclusiveMinimum", "below minimum", lambda v, limit: v <= limit), ("exclusiveMaximum", "above maximum", lambda v, limit: v >= limit)]
_SIZES = [("minLength", str, "too short", lambda n, limit: n < limit), ("maxLength", str, "too long", lambda n, limit: n > limit),
          ("minItems", list, "too few items", lambda n, limit: n < limit), ("maxItems", list, "too many items", lambda n, limit: n > limit)]


class SchemaError(ValueError):
    """A schema that cannot be used; its text is the fault."""


def canonical(value: object) -> str:
    """JSON with sorted keys, no spaces and no escapes that need not be."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is_type(value: object, name: str) -> bool:
    if name in ("integer", "number"):
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer() or name == "number" and isinstance(value, float)
        return whole and not isinstance(value, bool)
    if name not in _TYPES:
        raise SchemaError(f"unknown type {name}")
    return isinstance(value, _TYPES[name])


def _same(a: object, b: object) -> bool:
    """Equal as JSON: 1 is 1.0 but not true."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return a == b


def errors_of(value: object, schema: object, at: str = "$") -> list[str]:
    """Where a value breaks a schema: the words in ``_WORDS``, or true (all values) and false (none).

    A reference stands for a value that is not known yet, so it is taken wherever a value may stand. A schema that is no
    object, or has words that are not known, raises SchemaError.
    """
    if schema is True:
        return []
    if schema is False:
        return [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        raise SchemaError("no object")
    if unknown := sorted(set(schema) - _WORDS - _NOTES):
        raise SchemaError(f"unknown word {unknown[0]}")
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any([_is_type(value, k) for k in kinds]):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(_same(value, v) for v in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{at}: not the constant")
    if _is_type(value, "number"):
        out += [f"{at}: {fault}" for word, fault, breaks in _BOUNDS if word in schema and breaks(value, schema[word])]
    out += [f"{at}: {fault}" for word, kind, fault, breaks in _SIZES if word in schema and isinstance(value, kind) and breaks(len(value), schema[word])]
    if "pattern" in schema and isinstance(value, str) and not re.search(schema["pattern"], value):
        out.append(f"{at}: no match of pattern")
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            out += errors_of(value[k], known[k] if k in known else more, f"{at}.{k}")
    if isinstance(value, list):
        for i, item in enumerate(value):
            out += errors_of(item, schema.get("items", True), f"{at}[{i}]")
    for part in schema.get("allOf", []):
        out += errors_of(value, part, at)
    if "anyOf" in schema and all([errors_of(value, part, at) for part in schema["anyOf"]]):
        out.append(f"{at}: fits none of anyOf")
    return out


@lru_cache(maxsize=1024)
def _schema(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        raise SchemaError("not JSON") from None


def _no_constant(name: str) -> object:
    raise ValueError(name)


def _finite(digits: str) -> float:
    number = float(digits)
    if number in (float("inf"), float("-inf")):
        raise ValueError(digits)
    return number


def _checked(name: str | None, arguments: str | None, schema: str | None) -> tuple[list[str], str | None]:
    """(faults, canonical arguments). Whatever a row holds has an outcome; none ends the job.

    ``$: not JSON`` and no arguments for a text that is no JSON or has numbers or characters that JSON cannot carry on
    (1e999, NaN, lone surrogates) or is nested too deeply; ``$: repeated key k`` where an object has a key twice (the last value counts); ``schema: ...``
    for a schema that is no JSON or not usable.
    """
    repeated: list[str] = []

    def object_of(pairs: list[tuple[str, object]]) -> dict:
        found = dict(pairs)
        if len(found) < len(pairs):
            names = [k for k, _ in pairs]
            repeated.extend(sorted(k for k in found if names.count(k) > 1))
        return found

    try:
        value = json.loads(arguments or "", parse_constant=_no_constant, parse_float=_finite, object_pairs_hook=object_of)
        line = canonical(value)
        line.encode()
    except (ValueError, RecursionError):
        return ["$: not JSON"], None
    found = [f"$: repeated key {k}" for k in repeated]
    if schema is None:
        return [*found, "$: unknown tool"], line
    try:
        return found + errors_of(value, _schema(schema)), line
    except SchemaError as fault:
        return [*found, f"schema: {fault}"], line
    except (TypeError, ValueError, AttributeError, LookupError, RecursionError, re.error):
        return [*found, "schema: not usable"], line


def checked(name: Column, arguments: Column, schema: Column) -> Column:
    """struct<errors array<string>, arguments string>: faults, and the arguments as canonical JSON (null if not JSON)."""

    @F.pandas_udf("errors array<string>, arguments string")
    def check(names: pd.Series, arguments: pd.Series, schemas: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_checked(*row) for row in zip(names, arguments, schemas)], columns=["errors", "arguments"])

    return check(name, arguments, schema)


def topological(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, ready, depth, cyclic of (conv_id, call_id, seq, refs array<string>), call ids unique in a conversation.

    ``ORDER BY ready, depth, seq`` puts every call behind those that it refers to. A call is ready at its own place or at that of
    its latest reference, and at equal places the depth counts on. So calls that refer back settle at once and only
    chains of forward references take rounds; no conversation is gathered in a task. In round r a call still moves only
    if r calls of its conversation have moved, unless references run in a circle: those calls are set ``cyclic`` and lead
    no further. References to calls that do not exist, and of a call to itself, are left out here.
    """
    edges = calls.select("conv_id", F.col("call_id").alias("child"), F.explode(F.array_distinct("refs")).alias("call_id")) \
        .where("child <> call_id")
    state = stored(calls.selectExpr("conv_id", "call_id", "seq AS ready", "0L AS depth", "false AS moved", "false AS active", "false AS cyclic"), "order")
    edges = stored(edges.join(state.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi"), "edges")
    done = shared_folder(calls.sparkSession, "settled")
    columns = ["conv_id", "call_id", "ready", "depth", "cyclic"]
    turn = 0
    while True:
        turn += 1
        need = edges.join(state.where("NOT cyclic"), ["conv_id", "call_id"]).groupBy("conv_id", F.col("child").alias("call_id")) \
            .agg(F.max(F.struct(F.col("ready"), (F.col("depth") + 1).alias("depth"))).alias("need"))
        later = F.coalesce(F.col("need") > F.struct("ready", "depth"), F.lit(False)) & ~F.col("cyclic")
        moved = state.join(need, ["conv_id", "call_id"], "left").select(
            "conv_id", "call_id", F.when(later, F.col("need.ready")).otherwise(F.col("ready")).alias("ready"),
            F.when(later, F.col("need.depth")).otherwise(F.col("depth")).alias("depth"),
            (F.col("moved") | later).alias("moved"), later.alias("active"), "cyclic")
        circles = moved.groupBy("conv_id").agg(F.count_if("moved").alias("n_moved"), F.count_if("active").alias("n_active")) \
            .where((F.col("n_active") > 0) & (F.col("n_moved") < turn)).select("conv_id", F.lit(True).alias("circle"))
        new = stored(moved.join(circles, "conv_id", "left").withColumn("cyclic", F.col("cyclic") | F.col("active") & F.coalesce("circle", F.lit(False)))
                     .drop("circle"), "order")
        # conversations in which nothing moves any more are done; only the others go on
        going = stored(new.where("active AND NOT cyclic").select("conv_id").distinct(), "going")
        new.join(going, "conv_id", "left_anti").select(*columns).write.mode("append").parquet(done)
        discard(state)
        if going.isEmpty():
            return calls.sparkSession.read.schema(new.select(*columns).schema).parquet(done)
        state = stored(new.join(going, "conv_id", "left_semi"), "order")
        edges = stored(edges.join(going, "conv_id", "left_semi"), "edges") if turn == 1 else edges
        discard(new)


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """A row for each identifier of a conversation that has a call or a result.

    calls: conv_id, call_id, seq, name, arguments (JSON); results: conv_id, call_id, seq, content; schemas: name, schema (JSON).
    Columns: conv_id, call_id, name, seq, status (``linked``, ``no_result``, ``no_call``), n_calls, n_results, ready, depth, cyclic,
    valid, errors (joined by ``; ``), canonical.

    Of repeated identifiers the first by seq counts (ties: least name, arguments or content); n_calls and n_results tell
    of the others. Rows without conv_id or call_id link with nothing and are left out. ``valid`` needs a known tool,
    JSON arguments that fit its schema, no reference to a missing call or to itself, and no circle; it is false for
    ``no_call``. A null seq counts as -1. ``canonical`` is one JSON object with sorted keys: arguments (null if not JSON), id,
    name, result (null without one). Empty tables give no rows; other columns are left out.
    """
    place = F.coalesce(F.col("seq").cast("long"), F.lit(-1))
    keyed = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    first = calls.where(keyed).groupBy("conv_id", "call_id").agg(
        F.min(F.struct(place.alias("seq"), "name", "arguments")).alias("c"), F.count("*").alias("n_calls"))
    answers = results.where(keyed).groupBy("conv_id", "call_id").agg(
        F.min(F.struct(place.alias("seq"), "content")).alias("r"), F.count("*").alias("n_results"))
    # the hash join of calls and results
    both = first.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer")
    # of several schemas of a name the least counts
    known = schemas.where("name IS NOT NULL").groupBy(F.col("name").alias("tool")).agg(F.min("schema").alias("schema"))
    rows = stored(both.join(known, F.col("c.name") == F.col("tool"), "left").withColumn(
        "refs", F.coalesce(F.expr(f"regexp_extract_all(c.arguments, r'{REFERENCE}', 1)"), F.array().cast("array<string>"))), "calls")
    order = topological(rows.where("c IS NOT NULL").select("conv_id", "call_id", "c.seq", "refs"))
    there = rows.where("c IS NOT NULL").select("conv_id", F.col("call_id").alias("ref"))
    refs = rows.select("conv_id", "call_id", F.explode(F.array_distinct("refs")).alias("ref"))
    broken = refs.join(there, ["conv_id", "ref"], "left_anti").withColumn("why", F.lit("missing")).union(
        refs.where("ref = call_id").select("conv_id", "ref", "call_id").withColumn("why", F.lit("of itself")))
    faults = broken.groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_list(F.concat(F.lit("$ref "), "ref", F.lit(": "), "why"))).alias("faults"))
    full = rows.join(order, ["conv_id", "call_id"], "left").join(faults, ["conv_id", "call_id"], "left") \
        .withColumn("checked", checked(F.col("c.name"), F.col("c.arguments"), F.col("schema")))
    problems = F.when(F.col("c").isNull(), F.array(F.lit("no call"))).otherwise(F.concat(
        "checked.errors", F.coalesce("faults", F.array().cast("array<string>")),
        F.when(F.col("cyclic"), F.array(F.lit("circle"))).otherwise(F.array().cast("array<string>"))))
    line = F.concat(F.lit('{"arguments":'), F.coalesce("checked.arguments", F.lit("null")), F.lit(',"id":'), as_json("call_id"),
                    F.lit(',"name":'), F.coalesce(as_json("c.name"), F.lit("null")), F.lit(',"result":'), F.coalesce(as_json("r.content"), F.lit("null")), F.lit("}"))
    status = F.when(F.col("c").isNull(), "no_call").when(F.col("r").isNull(), "no_result").otherwise("linked")
    return full.select("conv_id", "call_id", "c.name", "c.seq", status.alias("status"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
                       F.coalesce("n_results", F.lit(0)).alias("n_results"), "ready", "depth", "cyclic", (F.size(problems) == 0).alias("valid"),
                       F.array_join(problems, "; ").alias("errors"), line.alias("canonical"))


def as_json(column: str) -> Column:
    """A string column as JSON strings; null stays null."""

    @F.pandas_udf("string")
    def quoted(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else canonical(v))

    return quoted(column)
