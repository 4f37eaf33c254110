"""Nested JSON values as rows, and what can then be done by aggregation: deep merges, keyed lists, flat texts.

A value is opened level by level, LEVELS of them in one job, until nothing is
left to open. A node is told by its path from the root; partial aggregates by
(key, path) are combined on the map side, so no task holds a whole state, and
no order of updates has to be gone through one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from json import dumps, loads

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsons import quoted
from ..shared import staged
from . import ranks

#: Levels of nesting that one job opens.
LEVELS = 8

#: A list item is the same as another if the first of KEYS that it has is equal, else if all of PARTS are.
KEYS = ("slot_id", "slot", "coverage_id", "id", "key", "evidence_id", "call_id", "calc_id")
PARTS = ("entity", "period", "date", "metric", "requested_metric", "subfield", "required_basis", "source_field", "source")
EMPTY = ("null", '""', "[]", "{}")

#: The texts of an element, in order, and then its children.
TEXTS = ("title", "text", "label", "heading", "html")
CHILDREN = ("children", "items", "nodes")

CONTROL = re.compile(r"[\x00-\x1f]")
MAP, LIST = "map<string,variant>", "array<variant>"


def _opened(rows: DataFrame, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Applies step to the rows that are not done until all are; each round's rows are written once."""
    finished, level = [], rows
    while True:
        for _ in range(LEVELS):
            level = step(level)
        level = staged(level, name)
        finished.append(level.where("done"))
        level = level.where("not done")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, finished).drop("done")


def nodes(df: DataFrame, keys: list[str], json: str, lists: bool = False) -> DataFrame:
    """One row per node of each value: keys, path, places, kind and leaf (a leaf's JSON text).

    path: the names from the root, places: where each stands among its siblings
    (names of an object in their order as text; with `lists` the items of a
    list, whose names are their numbers). kind: object, list or leaf; without
    `lists` a list is a leaf. The root has an empty path. What is no JSON has no
    rows; numbers are written as Spark's Variant does (1.0 as 1). Any depth.
    """
    start = df.select(*keys, F.try_parse_json(F.col(json)).alias("v")).where("v is not null")
    start = start.selectExpr(*keys, "cast(array() as array<string>) AS path", "cast(array() as array<int>) AS places", "cast(null as string) AS kind", "v", "false AS done")
    below = "named_struct('path', concat(path, array({0})), 'places', concat(places, array(i)), 'kind', cast(null as string), 'v', {1}, 'done', false)"
    items = f"transform(l, (x, i) -> {below.format('cast(i as string)', 'x')})" if lists else "null"

    def step(rows: DataFrame) -> DataFrame:
        seen = rows.selectExpr("*", f"CASE WHEN NOT done THEN try_variant_get(v, '$', '{MAP}') END AS m", (f"CASE WHEN NOT done THEN try_variant_get(v, '$', '{LIST}') END" if lists else f"cast(null as {LIST})") + " AS l")
        kind = "CASE WHEN done THEN kind WHEN m IS NOT NULL THEN 'object' WHEN l IS NOT NULL THEN 'list' ELSE 'leaf' END"
        own = f"named_struct('path', path, 'places', places, 'kind', {kind}, 'v', CASE WHEN m IS NULL AND l IS NULL THEN v END, 'done', true)"
        kids = f"coalesce(transform(map_entries(m), (e, i) -> {below.format('e.key', 'e.value')}), {items}, array())"
        return seen.selectExpr(*keys, f"inline(concat(array({own}), {kids}))")

    found = _opened(start, step, "nodes")
    return found.selectExpr(*keys, "path", "places", "kind", "CASE WHEN kind = 'leaf' THEN to_json(v) END AS leaf")


def deep_merged(updates: DataFrame, key: str, order: list[str], json: str) -> DataFrame:
    """(key, path, leaf): the leaves of each key's updates merged in order, maps into maps, anything else replaced.

    An object meets an object: their names are merged; else the later value
    stands. A list is one value. An object without names is the leaf {}.
    Updates that are no objects change nothing; of updates that tie in the whole
    order, that with the greater text comes later. Null keys are a key.

    A leaf stands if nothing was written later at its path, above it (but
    objects) or below it; an empty object stands if nothing below it does.
    Only leaves and empty objects are kept of an update: they say when the
    objects above them were written.
    """
    # Of updates that tie, the place among their texts stands for the text, which need not go along with each leaf.
    tie = F.dense_rank().over(Window.partitionBy(key, *order).orderBy(json))
    rows = updates.select(F.col(key).alias("_key"), *order, F.col(json).alias("_json"), tie.alias("_tie"))
    ends = _ends(rows.select("_key", F.struct(*order, "_tie").alias("_at"), "_json"), ["_key", "_at"], "_json")
    return _merged_ends(ends).withColumnRenamed("_key", key)


def _ends(df: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, path, leaf): the leaves of each value and its objects without names, whose leaf is {}; those of nodes(), without what is above them."""
    start = df.select(*keys, F.try_parse_json(F.col(json)).alias("v")).where("v is not null").selectExpr(*keys, "cast(array() as array<string>) AS path", "v", "false AS done")
    kids = "transform(map_entries(m), e -> named_struct('path', concat(path, array(e.key)), 'v', e.value, 'done', false))"

    def step(rows: DataFrame) -> DataFrame:
        seen = rows.selectExpr("*", f"CASE WHEN NOT done THEN try_variant_get(v, '$', '{MAP}') END AS m")
        return seen.selectExpr(*keys, f"inline(CASE WHEN size(m) > 0 THEN {kids} ELSE array(named_struct('path', path, 'v', v, 'done', true)) END)")

    return _opened(start, step, "ends").select(*keys, "path", F.to_json("v").alias("leaf"))


def _merged_ends(ends: DataFrame) -> DataFrame:
    empty = F.col("leaf") == "{}"
    leaf_at = F.when(~empty, F.col("_at"))
    last = ends.where("size(path) > 0").groupBy("_key", "path").agg(F.max(leaf_at).alias("leaf_at"), F.max_by("leaf", leaf_at).alias("leaf"), F.max(F.when(empty, F.col("_at"))).alias("empty_at"))
    last = staged(last.withColumn("_id", F.monotonically_increasing_id()), "last-writes")
    # Each end meets those at the paths above it, once: what was written later above (over) and later below (under) is told from the same pairs.
    up = F.explode(F.expr("transform(sequence(1, size(path) - 1), n -> slice(path, 1, n))"))
    below = last.where("size(path) > 1").select(F.col("_key").alias("_k"), up.alias("_up"), F.col("_id").alias("_low"), F.greatest("leaf_at", "empty_at").alias("_at"), F.col("empty_at").isNotNull().alias("_empty"))
    pairs = last.select("_key", "path", "_id", "leaf_at").join(below, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("path") == F.col("_up")))
    later, nothing = F.col("leaf_at") > F.col("_at"), F.lit(None).cast(last.schema["leaf_at"].dataType)
    over = F.when(later | F.col("leaf_at").isNotNull() & F.col("_empty"), F.struct(F.col("_low").alias("_of"), F.col("leaf_at").alias("over"), nothing.alias("under")))
    under = F.when(F.col("leaf_at").isNull() | ~later, F.struct(F.col("_id").alias("_of"), nothing.alias("over"), F.col("_at").alias("under")))
    facts = pairs.select(F.inline(F.array_compact(F.array(over, under)))).groupBy("_of").agg(F.max("over").alias("over"), F.max("under").alias("under"))
    every = last.join(facts, F.col("_id") == F.col("_of"), "left")
    beats = lambda a, b: F.col(b).isNull() | (F.col(a) > F.col(b))
    is_leaf = F.col("leaf_at").isNotNull() & beats("leaf_at", "empty_at") & beats("leaf_at", "over") & beats("leaf_at", "under")
    held = F.col("under").isNotNull() & beats("under", "over")
    is_empty = F.col("empty_at").isNotNull() & beats("empty_at", "leaf_at") & beats("empty_at", "over") & ~held
    return every.select("_key", "path", F.when(is_leaf, F.col("leaf")).when(is_empty, "{}").alias("leaf")).where("leaf is not null")


def assembled(leaves: DataFrame, key: str) -> DataFrame:
    """(key, json): the objects whose leaves (key, path, leaf) are given, names in order; built from the deepest level up."""
    leaves = staged(leaves.select(F.col(key).alias("_key"), "path", "leaf"), "leaves")
    deepest = leaves.agg(F.max(F.size("path"))).first()[0] or 0
    level = leaves.where(F.size("path") == deepest)
    for n in range(deepest, 0, -1):
        named = F.struct(F.element_at("path", n).alias("name"), F.col("leaf"))
        fields = F.transform(F.array_sort(F.collect_list(named)), lambda s: F.concat(quoted(s["name"]), F.lit(":"), s["leaf"]))
        up = level.groupBy("_key", F.slice("path", 1, n - 1).alias("path") if n > 1 else F.expr("cast(array() as array<string>)").alias("path"))
        level = up.agg(F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("}")).alias("leaf"))
        if n > 1:
            level = level.unionByName(leaves.where(F.size("path") == n - 1))
    return level.select(F.col("_key").alias(key), F.col("leaf").alias("json"))


def identity(item: str) -> Column:
    """What a list item (a Variant column) is told by: its first key of KEYS that is not empty, else its PARTS, else its whole text."""
    names = lambda ks: "array(" + ", ".join(f"'{k}'" for k in ks) + ")"
    of = lambda ks: f"filter(transform(f, x -> named_struct('p', int(array_position({names(ks)}, x.k)), 'v', x.v)), x -> x.p > 0)"
    full = f"filter(transform(map_entries(try_variant_get({item}, '$', '{MAP}')), e -> named_struct('k', e.key, 'v', to_json(e.value))), x -> x.v NOT IN ({', '.join(f"'{e}'" for e in EMPTY)}))"
    named = f"transform(array(array_min({of(KEYS)})), x -> concat(element_at({names(KEYS)}, x.p), ':', regexp_replace(x.v, '^\"|\"$', '')))[0]"
    parts = f"""concat('composite:{{', nullif(array_join(transform(array_sort({of(PARTS)}), x -> concat('"', element_at({names(PARTS)}, x.p), '":', x.v)), ','), ''), '}}')"""
    # One element, so that an item is opened once and not for each name that it may have.
    return F.expr(f"coalesce(transform(array({full}), f -> coalesce({named}, {parts}))[0], concat('item:', to_json({item})))")


def merged_lists(updates: DataFrame, key: str, order: list[str], json: str) -> DataFrame:
    """(key, place, identity, field, value): lists of items merged in order of the updates.

    An item that is there already is laid over by name, the later value of a
    name standing; a new one goes to the end. place counts from 0 in the order
    of first appearance. An item that is no object, or has no
    names, has the field null and is its own value. Updates that are no lists add nothing. Null keys are a key.
    """
    lists = updates.select(F.col(key).alias("_key"), F.struct(*order).alias("_order"), F.expr(f"try_variant_get(try_parse_json({json}), '$', '{LIST}')").alias("_items"))
    items = lists.select("_key", "_order", F.posexplode("_items").alias("_i", "item"))
    items = items.select("_key", F.struct("_order", "_i").alias("_at"), identity("item").alias("identity"), F.expr(f"try_variant_get(item, '$', '{MAP}')").alias("m"), "item")
    pairs = F.expr("CASE WHEN m IS NOT NULL THEN transform(map_entries(m), e -> named_struct('field', e.key, 'value', to_json(e.value))) ELSE array(named_struct('field', cast(null as string), 'value', to_json(item))) END")
    fields = items.select("_key", "_at", "identity", F.inline_outer(pairs))
    last = fields.groupBy("_key", "identity", "field").agg(F.max_by("value", "_at").alias("value"), F.min("_at").alias("_first"))
    last = staged(last, "fields")
    firsts = last.groupBy("_key", "identity").agg(F.min("_first").alias("_first"))
    seats = ranks.placed(firsts, ["_first"], "place", ["_key"]).select(F.col("_key").alias("_k"), F.col("identity").alias("_who"), (F.col("place") - 1).alias("place"))
    both = last.join(seats, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("identity") == F.col("_who")))
    return both.select(F.col("_key").alias(key), "place", "identity", "field", F.coalesce("value", F.lit("{}")).alias("value"))


def flat_text(df: DataFrame, keys: list[str], json: str, out: str = "text") -> DataFrame:
    """(keys, out): the texts of nested elements in order, joined by spaces.

    An element gives its TEXTS that are not empty and then what its CHILDREN
    give; a list gives its items; any other value its text, nothing for null,
    false, 0 and what is empty. What gives nothing still parts its neighbours
    by a space. keys must name a row. What is no JSON has no row. Any depth; a
    row's texts never part, so that nothing is sent or written.
    """

    # As a Variant writes it: numbers and names come to Python in their final form, and stay texts there.
    @F.arrow_udf("string")
    def said(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if (t := v.as_py()) is None else _said(t) for v in texts], pa.string())

    texts = df.select(*keys, said(F.to_json(F.try_parse_json(F.col(json)))).alias(out))
    return texts.where(F.col(out).isNotNull())


class _Number(str):
    """A number of a JSON text, as it is written there."""


def _json(value) -> str:
    """The JSON text of a value, numbers and control signs as a Variant writes them."""
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, str):
        return re.sub(r"\\u00([01][0-9a-f])", lambda m: "\\u00" + m[1].upper(), dumps(value, ensure_ascii=False)) if CONTROL.search(value) else dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_json(k)}:{_json(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(_json, value)) + "]" if isinstance(value, list) else dumps(value)


def _said(text: str) -> str:
    """The texts of one value, by a stack of what is still to be read."""
    empty = lambda v: v is None or v is False or v == "0" and isinstance(v, _Number) or not isinstance(v, _Number) and v in ("", [], {})
    plain = lambda v: "True" if v is True else str(v) if isinstance(v, str) else _json(v)
    out, stack = [], [loads(text, parse_int=_Number, parse_float=_Number)]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            found = [v[k] for k in TEXTS if k in v and not empty(v[k])]
            below = [v[k] for k in CHILDREN if k in v]
            out.extend(map(plain, found))
            if not found and not below:
                out.append("")
            stack.extend(reversed(below))
        elif isinstance(v, list) and v:
            stack.extend(reversed(v))
        else:
            out.append("" if empty(v) else plain(v))
    return " ".join(out)
