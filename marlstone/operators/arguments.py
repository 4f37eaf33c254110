"""Arguments of tool calls, checked and coerced by schemas that are compiled into expressions.

A schema is gone through once, on the driver, and becomes one expression over
the arguments as Variants. Rows meet no interpreter: a call's tool chooses among
the compiled expressions.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsons import quoted

#: Names of arguments that stand for others.
ALIASES = {"table_indices": "table_index", "_precision": "precision"}

#: A schema's type and how Spark writes the types of its values.
KINDS = {
    "string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL.*|DOUBLE|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID",
}


def _types(spec: Any) -> list[str] | None:
    if not isinstance(spec, Mapping) or "type" not in spec:
        return None
    kinds = spec["type"] if isinstance(spec["type"], list) else [spec["type"]]
    return ["null" if k is None else k for k in kinds]


def _fits(v: Column, kinds: list[str]) -> Column:
    known = [KINDS[k] for k in kinds if k in KINDS]
    return F.schema_of_variant(v).rlike(f"^(?:{'|'.join(known)})$") if known else F.lit(False)


def _coerced(v: Column, kinds: list[str]) -> Column:
    """JSON text of a value of one of the types; null where it cannot be had."""
    text = F.when(F.schema_of_variant(v) == "STRING", F.trim(F.try_variant_get(v, "$", "string")))
    inner = F.try_parse_json(text)
    shape = F.schema_of_variant(inner)
    ways = [F.when(_fits(v, kinds), F.to_json(v))]
    if "integer" in kinds:
        single = F.when(shape == "ARRAY<BIGINT>", F.regexp_extract(F.to_json(inner), r"^\[(-?\d+)\]$", 1))
        digits = F.regexp_extract(text, r"(-?\d+)", 1)
        whole = F.when(F.schema_of_variant(v).rlike("^(?:DECIMAL.*|DOUBLE)$"), F.regexp_extract(F.to_json(v), r"^(-?\d+)(?:\.0+)?$", 1))
        ways += [F.when(x != "", x) for x in (single, digits, whole)]
    if "number" in kinds:
        ways.append(F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), F.to_json(F.try_parse_json(text.try_cast("double").cast("string")))))
    if "array" in kinds:
        ways.append(F.when(shape.startswith("ARRAY"), F.to_json(inner)))
    if "object" in kinds:
        ways.append(F.when(shape.startswith("OBJECT"), F.to_json(inner)))
    return F.coalesce(*ways)


def _renamed(m: Column, old: str, new: str) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != old), F.create_map(F.lit(new), F.element_at(m, old)))


def _compiled(name: str, parameters: Mapping[str, Any], m: Column, keys: Column) -> Column:
    """struct(status, arguments, notes) of a call of one tool whose arguments are the map m, named in the order of keys."""
    properties = parameters.get("properties") or {}
    required = parameters.get("required") or []
    closed = parameters.get("additionalProperties") is False
    note = lambda kind, what: F.concat(F.lit(f"{kind}:{name}."), what)
    notes: list[Column] = []
    for old, new in ALIASES.items():
        if old not in properties and new in properties:
            swap = F.array_contains(keys, old) & ~F.array_contains(keys, new)
            notes.append(F.when(swap, F.array(F.lit(f"argument_alias:{name}.{old}->{new}"))))
            m = F.when(swap, _renamed(m, old, new)).otherwise(m)
            keys = F.when(swap, F.array_append(F.array_remove(keys, old), F.lit(new))).otherwise(keys)
    known = F.array(*map(F.lit, properties)) if properties else F.expr("cast(array() as array<string>)")
    if closed:
        extra = F.array_sort(F.array_except(keys, known))
        notes.append(F.transform(extra, lambda k: note("removed_extra_argument", k)))
        keys = F.array_intersect(keys, known)
    typed = {p: kinds for p, spec in properties.items() if (kinds := _types(spec)) is not None}
    value = {p: _coerced(F.element_at(m, p), kinds) for p, kinds in typed.items()}
    bad = F.filter(keys, lambda k: reduce(lambda a, p: a | ((k == p) & value[p].isNull()), typed, F.lit(False)))
    missing = [F.when(~F.array_contains(keys, p), F.lit(p)) for p in required]
    lacking = F.concat_ws(",", *missing) if missing else F.lit("")
    same = {p: _fits(F.element_at(m, p), kinds) | (value[p] == F.to_json(F.element_at(m, p))) for p, kinds in typed.items()}
    changed = F.filter(keys, lambda k: reduce(lambda a, p: a | ((k == p) & value[p].isNotNull() & ~same[p]), typed, F.lit(False)))
    notes.append(F.transform(changed, lambda k: note("coerced_argument", k)))

    def shown(k: Column) -> Column:
        text = F.to_json(F.element_at(m, k))
        for p in typed:
            text = F.when(k == p, value[p]).otherwise(text)
        return F.concat(quoted(k), F.lit(":"), text)

    status = F.when(F.size(bad) > 0, note("dropped_call_bad_type", F.element_at(bad, 1))).when(lacking != "", note("dropped_call_missing_required", lacking)).otherwise("ok")
    arguments = F.concat(F.lit("{"), F.array_join(F.transform(keys, shown), ","), F.lit("}"))
    every = F.flatten(F.array(*(F.coalesce(n, F.expr("cast(array() as array<string>)")) for n in notes)))
    return F.struct(status.alias("status"), F.when(status == "ok", arguments).alias("arguments"), every.alias("notes"))


def coerced(calls: DataFrame, tool: str, arguments: str, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """calls with status, coerced (JSON text) and notes.

    schemas: a tool's name and its parameters (properties, required,
    additionalProperties). Aliases are renamed where the schema knows only the
    other name, unknown arguments of a closed schema go, and values are brought
    to their type: whole numbers out of texts (or a list of one, as text) and
    out of decimals without a fraction, numbers, lists and objects out of texts.
    status is ok, or why the call is dropped, as the first argument (in the
    order of the text) that does not fit, or else those that are required and
    missing; notes say what was changed. Arguments that are null or no object
    count as none; a null tool is not in the schema. Numbers beyond 64 bits are
    no integers.
    """
    keys = F.coalesce(F.json_object_keys(F.when(F.try_variant_get(F.try_parse_json(F.col(arguments)), "$", "map<string,variant>").isNotNull(), F.col(arguments))), F.expr("cast(array() as array<string>)"))
    opened = calls.withColumns({"_m": F.coalesce(F.try_variant_get(F.try_parse_json(F.col(arguments)), "$", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)")), "_keys": keys})
    unknown = F.struct(
        F.concat(F.lit("dropped_call_tool_not_in_schema:"), F.coalesce(F.col(tool), F.lit(""))).alias("status"), F.lit(None).cast("string").alias("arguments"),
        F.expr("cast(array() as array<string>)").alias("notes"),
    )
    found = unknown
    for name, parameters in schemas.items():
        found = F.when(F.col(tool) == name, _compiled(name, parameters, F.col("_m"), F.col("_keys"))).otherwise(found)
    out = opened.withColumn("_found", found)
    return out.select(*calls.columns, "_found.status", F.col("_found.arguments").alias("coerced"), "_found.notes")
