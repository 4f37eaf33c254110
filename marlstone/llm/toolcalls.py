"""Tool calls: linked with their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Turns of a conversation that are numbered in one place; calls that are put in topological order in one place.
STRETCH, BLOCK = 64, 4096
#: Tools that may be sent to every task; more are joined by shuffle.
FEW = 10_000
SURROGATE = re.compile("[\ud800-\udfff]")

TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v.is_integer()),
}


def canonical(value) -> str:
    """JSON with sorted keys and no spaces; whole floats are written as integers, lone surrogates as escapes."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**53 else v

    return writable(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def writable(text: str) -> str:
    """Text that UTF-8 can hold."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def usable(schema) -> bool:
    """Whether a JSON schema's keywords are of the kinds that problems() reads."""
    if isinstance(schema, bool):
        return True
    if not isinstance(schema, dict):
        return False
    kinds = schema.get("type", [])
    sound = isinstance(kinds, str) or isinstance(kinds, list) and all(isinstance(k, str) for k in kinds)
    sound = sound and isinstance(schema.get("enum", []), list) and all(TYPES["number"](schema.get(k, 0)) for k in ("minimum", "maximum"))
    sound = sound and all(TYPES["integer"](schema.get(k, 0)) for k in ("minLength", "maxLength", "minItems", "maxItems"))
    names, own = schema.get("required", []), schema.get("properties", {})
    sound = sound and isinstance(names, list) and all(isinstance(k, str) for k in names) and isinstance(own, dict)
    if not sound:
        return False
    if "pattern" in schema:
        try:
            re.compile(schema["pattern"])
        except (re.error, TypeError):
            return False
    return all(map(usable, [*own.values(), schema.get("items", True), schema.get("additionalProperties", True)]))


def problems(value, schema: dict | bool, at: str = "$") -> list[str]:
    """What in a value breaks a usable JSON schema: type, enum, const, bounds, lengths, pattern, properties and items.

    true is not 1, but 1.0 is.
    """
    if not isinstance(schema, dict):
        return [] if schema else [f"{at}: not allowed"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(TYPES.get(k, lambda v: True)(value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    if TYPES["number"](value):
        out += [f"{at}: under minimum"] if value < schema.get("minimum", -math.inf) else []
        out += [f"{at}: over maximum"] if value > schema.get("maximum", math.inf) else []
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", math.inf) else []
        out += [f"{at}: no match"] if "pattern" in schema and not re.search(schema["pattern"], value) else []
    if isinstance(value, list):
        out += [f"{at}: too few"] if len(value) < schema.get("minItems", 0) else []
        out += [f"{at}: too many"] if len(value) > schema.get("maxItems", math.inf) else []
        for i, x in enumerate(value if "items" in schema else []):
            out += problems(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        own = schema.get("properties", {})
        for k in sorted(value):
            if k in own:
                out += problems(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += problems(value[k], schema["additionalProperties"], f"{at}.{k}")
    return out


def _schema(text: str) -> dict | bool | None:
    """A usable schema, or None."""
    try:
        schema = json.loads(text)
        canonical(schema)
        return schema if usable(schema) else None
    except (ValueError, RecursionError):
        return None


def judge(call_id: str, name: str | None, arguments: str | None, schema: str | None, result: str | None) -> tuple[list[str], str]:
    """Problems with a call's arguments, and call and result as canonical JSON.

    Arguments that are no JSON, or nested too deeply to be read, are kept as
    the text they are. A schema that is none is a problem of each of its calls.
    """
    errors, value = [], arguments
    try:
        value = json.loads(arguments if arguments is not None else "")
        canonical({"arguments": value})
    except ValueError:
        value, errors = arguments, ["$: no JSON"]
    except RecursionError:
        value, errors = arguments, ["$: nested too deeply"]
    if schema is None:
        errors = [*errors, "no such tool"]
    elif (shape := _schema(schema)) is None:
        errors = [*errors, "no valid schema"]
    elif not errors:
        try:
            errors = problems(value, shape)
        except RecursionError:
            errors = ["$: nested too deeply"]
    return [writable(e) for e in errors], canonical({"arguments": value, "id": call_id, "name": name, "result": result})


def _peeled(part: pa.Table) -> pa.Table:
    """Levels of a block's calls, as far as they rest on calls of the block and on known ones."""
    names = part["call_id"].to_pylist()
    level, wait, after = dict(zip(names, part["base"].to_pylist(), strict=True)), {}, {}
    for name, parents, unknown in zip(names, part["inner"].to_pylist(), part["open"].to_pylist(), strict=True):
        wait[name] = len(parents or ()) + unknown
        for p in parents or ():
            after.setdefault(p, []).append(name)
    free, done = [x for x in names if not wait[x]], {}
    while free:
        name = free.pop()
        done[name] = level[name]
        for child in after.get(name, ()):
            level[child] = max(level[child], level[name] + 1)
            wait[child] -= 1
            if not wait[child]:
                free.append(child)
    return pa.table({"conv_id": part["conv_id"], "call_id": part["call_id"], "block": part["block"], "level": pa.array([done.get(x) for x in names], pa.int32())})


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest chain of calls before each call; null on and behind a cycle.

    calls: (conv_id, call_id, turn), distinct. edges: (conv_id, parent,
    call_id), distinct, between calls. A conversation's calls lie in blocks of
    BLOCK by turn, each of which one task takes as far as it can; what a call
    needs from other blocks comes by a join, in as many rounds as chains go
    from block to block.
    """
    placed = numbered(calls.select("conv_id", "call_id", "turn", F.lit(0).alias("level")), "conv_id", "level", "turn", "call_id")
    nodes = placed.select("conv_id", "call_id", F.floor((F.col("position") - 1) / BLOCK).alias("block"), F.lit(None).cast("int").alias("level"))
    nodes = staged(nodes, "calls")
    where = nodes.select("conv_id", F.col("call_id").alias("parent"), F.col("block").alias("from"))
    edges = edges.join(nodes.select("conv_id", "call_id", "block"), ["conv_id", "call_id"]).join(where, ["conv_id", "parent"])
    edges = staged(edges, "edges")
    inner = edges.where(F.col("block") == F.col("from")).groupBy("conv_id", "call_id").agg(F.collect_list("parent").alias("inner"))
    outer = edges.where(F.col("block") != F.col("from"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    left = nodes.count()
    while left:
        known = nodes.select("conv_id", F.col("call_id").alias("parent"), "level")
        rests = outer.join(known, ["conv_id", "parent"]).groupBy("conv_id", "call_id").agg((F.max("level") + 1).alias("base"), F.count(F.when(F.col("level").isNull(), 1)).alias("open"))
        todo = nodes.where("level is null").drop("level").join(inner, ["conv_id", "call_id"], "left").join(rests, ["conv_id", "call_id"], "left")
        # Calls of the block that are known from a round before wait for nothing and are waited for by nobody.
        done = nodes.where("level is not null")
        settled = done.select("conv_id", F.col("call_id").alias("parent"), F.col("level").alias("of"))
        again = edges.where(F.col("block") == F.col("from")).join(settled, ["conv_id", "parent"]).groupBy("conv_id", "call_id").agg(F.collect_list("parent").alias("past"), (F.max("of") + 1).alias("least"))
        todo = todo.join(again, ["conv_id", "call_id"], "left")
        todo = todo.select(
            "conv_id", "call_id", "block", F.when(F.col("past").isNull(), F.col("inner")).otherwise(F.array_except("inner", "past")).alias("inner"),
            F.greatest(F.lit(0), F.coalesce("base", F.lit(0)), F.coalesce("least", F.lit(0))).cast("int").alias("base"), F.coalesce("open", F.lit(0)).cast("int").alias("open"),
        )
        nodes = staged(done.unionByName(todo.groupBy("conv_id", "block").applyInArrow(_peeled, schema)), "calls")
        still = nodes.where("level is null").count()
        if still in (0, left):
            break
        left = still
    return nodes.select("conv_id", "call_id", "level")


def numbered(df: DataFrame, conv: str, *order: str) -> DataFrame:
    """df with position from 1 within conv by order, the first of which is a level, the second a turn.

    Stretches of turns are numbered apart and then moved on by the calls
    before them, so a conversation of any length is no single task's.
    """
    df = df.withColumn("_stretch", F.floor(F.coalesce(order[1], F.lit(-1)) / STRETCH))
    first = [F.col(order[0]).asc_nulls_last(), F.col("_stretch")]
    sizes = df.groupBy(conv, order[0], "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(conv).orderBy(*first).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(conv).alias("_c"), F.col(order[0]).alias("_l"), F.col("_stretch").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(conv, order[0], "_stretch").orderBy(*(F.col(c).asc_nulls_last() for c in order[1:]))
    df = df.withColumn("_rank", F.row_number().over(within))
    same = F.col(conv).eqNullSafe(F.col("_c")) & F.col(order[0]).eqNullSafe(F.col("_l")) & (F.col("_stretch") == F.col("_s"))
    moved = df.join(sizes, same).withColumn("position", (F.col("_before") + F.col("_rank")).cast("long"))
    return moved.drop("_stretch", "_c", "_l", "_s", "_before", "_rank")


def linked(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """(conv_id, position, turn, call_id, name, status, errors, canonical): one row for each call and each stray result.

    calls: conv_id, turn, call_id, name, arguments (JSON text), depends_on
    (ids of calls whose results it needs). results: conv_id, turn, call_id,
    content. tools: name, schema (JSON schema text; one for a name).

    Calls and results meet on conv_id and call_id. Of several results the
    first by turn and content counts; a call that repeats an id has status
    `duplicate_call` and no result. Other statuses: `invalid` (errors say
    why), `no_result`, `orphan_result` (a result whose call is nowhere),
    `cycle` (it waits for itself), `ok`; the first that holds in the order
    duplicate_call, orphan_result, cycle, invalid, no_result. Ids in
    depends_on that name no call of the conversation are not waited for.

    The order is topological: by turn where no call waits for one of a later
    turn, and otherwise by the longest chain before a call, then by turn; ties
    go by call_id and then by content. Null ids and conversations link to
    nothing. Repeated rows stay; extra columns are left out; empty tables give
    an empty result. Arguments that are no JSON, are nested too deeply or hold
    lone surrogates, and tools whose schema is none, give errors, not failures.
    """
    small_batches(calls.sparkSession)
    calls = calls.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), "name", "arguments", "depends_on")
    results = results.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("call_id").cast("string").alias("call_id"), "content")
    # Equal rows are counted, not numbered: a call that comes a million times is no single task's to sort.
    said = F.struct("turn", "name", "arguments")
    counted = F.min(F.struct(said.alias("said"), "depends_on"))
    firsts = calls.groupBy("conv_id", "call_id").agg(counted.alias("_first"))
    firsts = firsts.select("conv_id", "call_id", F.col("_first.said").alias("_said"), F.col("_first.depends_on").alias("_needs"))
    firsts = firsts.where("conv_id is not null and call_id is not null")
    answers = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("_answer"))
    alike = calls.groupBy("conv_id", "call_id", "turn", "name", "arguments").agg(F.count("*").cast("int").alias("_times"))
    alike = alike.join(firsts.select("conv_id", "call_id", "_said").join(answers, ["conv_id", "call_id"], "left"), ["conv_id", "call_id"], "left")
    each = alike.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    again = F.col("_said").isNotNull() & ((F.col("_copy") > 1) | ~F.col("_said").eqNullSafe(said))
    rows = each.withColumn("duplicate", again).select(
        "conv_id", "turn", "call_id", "name", "arguments", "duplicate", F.lit(False).alias("orphan"),
        F.when(~F.col("duplicate"), F.col("_answer.content")).alias("content"),
        (F.col("_answer").isNotNull() & ~F.col("duplicate")).alias("answered"),
    )
    stray = results.join(firsts.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select(
        "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.lit(False).alias("duplicate"), F.lit(True).alias("orphan"), "content", F.lit(True).alias("answered"),
    )
    rows = rows.unionByName(stray)

    known = firsts.select("conv_id", "call_id", F.col("_said.turn").alias("turn"), F.col("_needs").alias("needs"))
    waits = known.select("conv_id", "call_id", "turn", F.explode(F.array_distinct("needs")).alias("parent"))
    parents = known.select("conv_id", F.col("call_id").alias("parent"), F.col("turn").alias("parent_turn"))
    edges = waits.join(parents, ["conv_id", "parent"])
    late = staged(edges.where("parent_turn is null or turn is null or parent_turn >= turn").select("conv_id").distinct(), "late")
    if late.isEmpty():
        rows = rows.withColumn("level", F.lit(0)).withColumn("cycle", F.lit(False))
    else:
        deep = levels(known.join(late, "conv_id", "left_semi").select("conv_id", "call_id", "turn"), edges.join(late, "conv_id", "left_semi").select("conv_id", "parent", "call_id"))
        rows = rows.join(deep.withColumn("_deep", F.lit(True)), ["conv_id", "call_id"], "left")
        rows = rows.withColumn("cycle", F.col("_deep").isNotNull() & F.col("level").isNull() & ~F.col("orphan"))
        rows = rows.withColumn("level", F.when(F.col("_deep").isNull(), 0).otherwise(F.col("level"))).drop("_deep")
    rows = numbered(rows, "conv_id", "level", "turn", "call_id", "name", "arguments", "content")

    shape = staged(tools.where("name is not null").groupBy("name").agg(F.min("schema").alias("schema")), "tools")
    rows = rows.join(F.broadcast(shape) if shape.limit(FEW + 1).count() <= FEW else shape, "name", "left")

    @F.arrow_udf("errors array<string>, canonical string")
    def checked(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            found = [judge(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array([e for e, _ in found], pa.list_(pa.string())), pa.array([j for _, j in found], pa.string())], ["errors", "canonical"]
            )

    rows = rows.withColumn("_j", checked("call_id", "name", "arguments", "schema", "content"))
    status = (
        F.when(F.col("duplicate"), "duplicate_call").when(F.col("orphan"), "orphan_result").when(F.col("cycle"), "cycle")
        .when(F.size("_j.errors") > 0, "invalid").when(~F.col("answered"), "no_result").otherwise("ok")
    )
    errors = F.when(F.col("orphan"), F.array().cast("array<string>")).otherwise(F.col("_j.errors"))
    return rows.select("conv_id", "position", "turn", "call_id", "name", status.alias("status"), errors.alias("errors"), F.col("_j.canonical").alias("canonical"))


#: The tools that a plain conversation is read as: a question asked, instructions given.
TOOLS = [
    ("ask", '{"type":"object","required":["text","turn"],"properties":{"text":{"type":"string","minLength":1},"turn":{"type":"integer","minimum":0}},"additionalProperties":false}'),
    ("instruct", '{"type":"object","required":["text"],"properties":{"text":{"type":"string","minLength":1}},"additionalProperties":false}'),
]


def from_conversations(spark: SparkSession, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """calls, results and tools of a table of conversations (conv_id, turn, role, text).

    A turn of the assistant is the result of the call of the turn before it;
    a system turn calls `instruct`, any other `ask`. An `ask` needs the
    `instruct` of the two turns before it. Of two asks within two turns the
    longer one says more and comes first: the shorter needs it, though it may
    be of an earlier turn; of equally long ones the later needs the earlier.
    Rows that repeat a turn are calls that repeat an id.
    """
    name = lambda by: F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") + by).cast("string"))
    says = F.coalesce("role", F.lit("")) == "assistant"
    tool = F.when(F.col("role") == "system", "instruct").otherwise("ask")
    text: Column = F.coalesce("text", F.lit(""))
    arguments = F.when(tool == "ask", F.to_json(F.struct(text.alias("text"), "turn"))).otherwise(F.to_json(F.struct(text.alias("text"))))
    own = turns.where(~says).select(
        "conv_id", "turn", name(0).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), F.length(text).alias("size")
    )
    # The calls beside each call: a shuffle by conversation and turn, so that a long conversation is spread.
    one = own.groupBy("conv_id", "turn").agg(F.max("name").alias("name"), F.max("size").alias("size"))
    one = one.select("conv_id", "turn", "name", "size", F.explode(F.array(*map(F.lit, range(-2, 3)))).alias("by"))
    spot = F.struct((-F.col("by")).alias("by"), "name", "size")
    near = one.groupBy("conv_id", (F.col("turn") + F.col("by")).alias("turn")).agg(F.collect_list(spot).alias("near"), F.max(F.when(F.col("by") == 0, F.col("size"))).alias("mine"))
    own = own.join(near.where("mine is not null"), ["conv_id", "turn"], "left")
    longer = lambda x: (x["size"] > F.col("mine")) | (x["size"] == F.col("mine")) & (x["by"] < 0)
    first = F.filter("near", lambda x: F.when(x["name"] == "instruct", x["by"] < 0).otherwise(longer(x)))
    needs = F.when(F.col("name") == "ask", F.transform(first, lambda x: name(x["by"])))
    calls = own.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce(needs, F.array().cast("array<string>")).alias("depends_on"))
    results = turns.where(says).select("conv_id", "turn", name(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results, spark.createDataFrame(TOOLS, "name string, schema string")
