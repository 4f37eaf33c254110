"""Tool calls: order against a brute-force one, odd arguments and schemas, chains over several blocks."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.llm import queries, toolcalls

CALL = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"


def plain_levels(needs):
    """The longest chain before each call; None on and behind a cycle."""
    out = {}

    def level(call, path=()):
        if call in path:
            return None
        if call not in out:
            below = [level(p, (*path, call)) for p in needs[call] if p in needs]
            if None in below:
                return None
            out[call] = max(below, default=-1) + 1
        return out[call]

    return {c: level(c) for c in needs}


def test_order_of_the_query_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks.setdefault(r.conv_id, {})[r.turn] = r
    want, late = {}, 0
    for conv, turns in talks.items():
        role = {t: "assistant" if r.role == "assistant" else "instruct" if r.role == "system" else "ask" for t, r in turns.items()}
        size = {t: len(r.text or "") for t, r in turns.items()}
        needs = {t: [] for t in turns if role[t] != "assistant"}
        for t in (t for t in needs if role[t] == "ask"):
            for o in (t - 2, t - 1, t + 1, t + 2):
                if role.get(o) == "instruct" and o < t or role.get(o) == "ask" and (size[o], t) > (size[t], o):
                    needs[t].append(o)
        level = plain_levels(needs)
        ahead = any(p in needs and p >= t for t in needs for p in needs[t])
        late += ahead
        rows = [(level[t] if ahead else 0, t) for t in needs]
        rows += [(None if ahead else 0, t) for t in turns if role[t] == "assistant" and role.get(t - 1, "assistant") == "assistant"]
        rows.sort(key=lambda r: (r[0] is None, r))
        want |= {(conv, t): i + 1 for i, (_, t) in enumerate(rows)}
    rows = queries.op10_tool_call_linking(spark, sf).collect()
    assert late > 5 and {(r.conv_id, r.turn): r.position for r in rows} == want
    for r in rows:
        turn = talks[r.conv_id][r.turn]
        if turn.role == "assistant":
            assert r.status == "orphan_result"
            continue
        answer = talks[r.conv_id].get(r.turn + 1)
        told = answer is not None and answer.role == "assistant"
        assert r.status == ("invalid" if not turn.text else "ok" if told else "no_result")
        got = json.loads(r.canonical)
        assert got["arguments"]["text"] == turn.text and got["result"] == (answer.text if told else None)


ODD = [
    ('"\\ud800"', "{}", []), ("[" * 100_000, "{}", ["$: nested too deeply"]), ('{"\\ud800": 1}', '{"additionalProperties": false}', ["$.\\ud800: unknown"]),
    ("1", "{bad", ["no valid schema"]), ('"a"', '{"pattern": "("}', ["no valid schema"]), ("{}", '{"properties": null}', ["no valid schema"]),
    ("1", '{"minimum": "a"}', ["no valid schema"]), ("true", '{"enum": [1]}', ["$: not in enum"]), ("1.0", '{"enum": [1]}', []), ("true", '{"const": 1}', ["$: not the constant"]),
    ("NaN", "{}", ["$: no JSON"]), (None, "{}", ["$: no JSON"]), ("[[1]]", '{"items":' * 3000 + "{}" + "}" * 3000, ["no valid schema"]), ("3", "false", ["$: not allowed"]), ("3", "null", ["no valid schema"]),
]


def test_odd_arguments_and_schemas(spark):
    calls = spark.createDataFrame([(1, i, str(i), f"t{i}", a, []) for i, (a, _, _) in enumerate(ODD)], CALL)
    tools = spark.createDataFrame([(f"t{i}", s) for i, (_, s, _) in enumerate(ODD)] + [(None, None)], "name string, schema string")
    rows = {r.call_id: r for r in toolcalls.linked(calls, spark.createDataFrame([], RESULT), tools).collect()}
    assert {i: r.errors for i, r in rows.items()} == {str(i): e for i, (_, _, e) in enumerate(ODD)}
    assert rows["0"].canonical == '{"arguments":"\\ud800","id":"0","name":"t0","result":null}'
    assert all(json.loads(r.canonical)["id"] == i for i, r in rows.items())


@pytest.mark.parametrize("block", [4096, 7])
def test_chains_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(toolcalls, "BLOCK", block)
    # Against the order of turns, then with it, a bridge between them, and a cycle with one call behind it.
    edges = [(str(i + 1), str(i)) for i in range(18)] + [(str(i), str(i + 1)) for i in range(50, 68)] + [("0", "50"), ("100", "101"), ("101", "100"), ("101", "102")]
    needs = {str(i): [] for i in range(110)}
    for parent, child in edges:
        needs[child].append(parent)
    calls = spark.createDataFrame([(c, k, int(k)) for c in (1, 2) for k in needs], "conv_id long, call_id string, turn long").repartition(5)
    links = spark.createDataFrame([(c, p, k) for c in (1, 2) for p, k in edges], "conv_id long, parent string, call_id string")
    got = {(r.conv_id, r.call_id): r.level for r in toolcalls.levels(calls, links).collect()}
    want = plain_levels(needs)
    assert got == {(c, k): want[k] for c in (1, 2) for k in needs}


def test_calls_that_repeat(spark):
    rows = [(1, 3, "a", "t", "{}", None)] * 3 + [(1, 1, "a", "t", "[]", ["b"]), (1, 2, "b", "t", "{}", []), (None, 1, "a", "t", "{}", None), (None, 1, "a", "t", "{}", None)]
    calls = spark.createDataFrame(rows, CALL)
    out = toolcalls.linked(calls, spark.createDataFrame([(1, 9, "a", "A")], RESULT), spark.createDataFrame([("t", "{}")], "name string, schema string"))
    got = sorted((r.conv_id or 0, r.turn, r.call_id, r.status) for r in out.collect())
    assert got == [(0, 1, "a", "no_result")] * 2 + [(1, 1, "a", "ok"), (1, 2, "b", "no_result")] + [(1, 3, "a", "duplicate_call")] * 3
    assert [r.call_id for r in out.where("conv_id = 1").orderBy("position").collect()][0] == "b"


def test_from_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "user", None), (1, 2, "assistant", None), (None, 0, "user", "x"), (2, None, "user", "y"), (3, 0, None, "z"), (4, 0, "assistant", "stray")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, _corrects string")
    out = toolcalls.linked(*toolcalls.from_conversations(spark, turns)).collect()
    assert sorted((r.conv_id or 0, -1 if r.turn is None else r.turn, r.status) for r in out) == [
        (0, 0, "no_result"), (1, 0, "duplicate_call"), (1, 0, "no_result"), (1, 1, "invalid"), (2, -1, "invalid"), (3, 0, "no_result"), (4, 0, "orphan_result"),
    ]
    assert toolcalls.linked(*toolcalls.from_conversations(spark, turns.limit(0))).count() == 0
    assert turns.where(F.lit(True)).count() == len(rows)
