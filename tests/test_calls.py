"""Broken JSON, arguments and terms against plain functions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.jsons import mended
from marlstone.functions.texts import overlap_score
from marlstone.operators import aliases, arguments

DOC = {"k": 5, "name": "a b", "list": [1, "x", {"d": None}], "ok": True}


@pytest.mark.parametrize(
    ("broken", "want"),
    [
        ('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "no end', {"a": "no end"}), ('{"a": {"b": [1}', {"a": {"b": [1]}}), ("{'a': 'it''s'}", {"a": "it''s"}),
        ('{"a": 1, "b": 2,}', {"a": 1, "b": 2}), ("[1,,2,]", [1, 2]), ('[1 2 "x" "y"]', [1, 2, "x", "y"]), ('{"a": "x" "b": "y"}', {"a": "x", "b": "y"}), ("{a: b c, d: None}", {"a": "b c", "d": None}),
        ('{"a": }', {"a": None}), ('{"a"', {"a": None}), ('{"a":', {"a": None}), ('{"a": tru}', {"a": "tru"}), ('{"a": 01}', {"a": "01"}),
        ('{"a": "line\nend\t"}', {"a": "line\nend\t"}), ('{"a": "say "yes" now"}', {"a": 'say "yes" now'}), ('{"a": "c:\\dir\\x"}', {"a": "c:\\dir\\x"}),
        ("before [1, {\"a\": 2}] after", [1, {"a": 2}]), ('x```json\n{"a": 1}\n``` y {"b": 2}', {"a": 1}), ('{"a": 1}}]', {"a": 1}),
        ('{"a": 1 /* c */, // d\n"b": 2}', {"a": 1, "b": 2}), ('{“a”: “ü”}', {"a": "ü"}), ("{}", {}), ("[", []), ('{"a": "\\u00e9\\q"}', {"a": "é\\q"}), ('{"a" = 1}', {"a": 1}), ("{[1], a: 2}", None),
    ],
)
def test_broken_replies(broken, want):
    got = json.loads(mended(broken))
    assert want is None or got == want


def test_sound_json_is_left_alone():
    for value in (DOC, [], 5, "text", None, [DOC] * 3):
        for text in (json.dumps(value), json.dumps(value, indent=2), f" {json.dumps(value, ensure_ascii=False)}\n"):
            assert mended(text) == text
    assert mended(None) is None and mended("") is None and mended("no bracket") is None


def test_any_damage_gives_json():
    rng, text = random.Random(7), json.dumps([DOC, {"t": "é \"q\" \\ /", "n": -1.5e3}])
    for _ in range(3000):
        cut = list(text)
        for _ in range(rng.randint(1, 6)):
            i = rng.randrange(len(cut))
            cut[i : i + rng.randint(0, 2)] = rng.choice(["", '"', "}", "]", ",", ":", "{", "[", "\n", "'", "\\", "x"])
        broken = "".join(cut)
        found = mended(broken)
        if found is not None:
            json.loads(found)
    deep = "[" * 30_000
    assert mended(deep) == deep + "]" * 30_000
    assert json.loads(mended('{"a": "' + 'x " y' * 20_000))


def test_every_cut_of_a_reply_keeps_what_came_before():
    text = json.dumps({"a": [1, {"b": "two"}], "c": "three", "d": 4})
    for n in range(1, len(text)):
        got = json.loads(mended(text[:n]))
        assert set(got) <= {"a", "c", "d", ""}
        if n > text.index('"c"'):
            assert got["a"] == [1, {"b": "two"}]


SCHEMAS = {"t": {"properties": {"n": {"type": "integer"}, "x": {"type": ["number", "null"]}, "s": {"type": "string"}, "any": {}, "precision": {"type": "integer"}}, "required": ["n"]}}


@pytest.mark.parametrize(
    ("given", "status", "want"),
    [
        ('{"n": 1}', "ok", {"n": 1}), ('{"n": "a -12 b"}', "ok", {"n": -12}), ('{"n": "[3]"}', "ok", {"n": 3}), ('{"n": 4.0}', "ok", {"n": 4}), ('{"n": 4.5}', "dropped_call_bad_type:t.n", None),
        ('{"n": true}', "dropped_call_bad_type:t.n", None), ('{"n": null}', "dropped_call_bad_type:t.n", None), ('{"s": 1, "n": "none"}', "dropped_call_bad_type:t.s", None),
        ('{"n": 1, "x": "2.5e1"}', "ok", {"n": 1, "x": 25}), ('{"n": 1, "x": null}', "ok", {"n": 1, "x": None}), ('{"n": 1, "x": "nan"}', "dropped_call_bad_type:t.x", None),
        ('{"n": 1, "any": [1], "more": {"a": "ü"}}', "ok", {"n": 1, "any": [1], "more": {"a": "ü"}}), ('{"n": 1, "_precision": "2"}', "ok", {"n": 1, "precision": 2}),
        ('{"n": 1, "_precision": 2, "precision": 3}', "ok", {"n": 1, "_precision": 2, "precision": 3}), ("{}", "dropped_call_missing_required:t.n", None), (None, "dropped_call_missing_required:t.n", None), ("[1]", "dropped_call_missing_required:t.n", None),
    ],
)
def test_arguments(spark, given, status, want):
    r = arguments.coerced(spark.createDataFrame([("t", given)], "tool string, a string"), "tool", "a", SCHEMAS).first()
    assert r.status == status and (r.coerced is None if want is None else json.loads(r.coerced) == want)


def test_unknown_tools(spark):
    out = arguments.coerced(spark.createDataFrame([("u", "{}"), (None, "{}")], "tool string, a string"), "tool", "a", SCHEMAS).collect()
    assert {r.status for r in out} == {"dropped_call_tool_not_in_schema:u", "dropped_call_tool_not_in_schema:"}


def test_han_terms(spark):
    rows = [("本期净利润大幅增长", "净利润增长"), ("net income", "the net-income of x"), (None, "净利"), ("净利润", None), ("A  B 10-K", "a b 10-k 10-k")]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, q string").select(overlap_score(F.col("t"), F.col("q"))).collect()]
    # 净利润 (1.5), 净利, 利润, 增长 (1 each); words of three signs or more, each once.
    assert got == [4.5, 0.0, 0.0, 0.0, 2.0]


def test_longest_alias_first(spark):
    catalogue = spark.createDataFrame([(1, "New York", "NY"), (2, "York", "ny"), (3, "New", None), (None, "gone", "x"), (4, "!!", "")], "code int, name string, short string")
    found = aliases.index(catalogue, "code", ["name", "short"], "code")
    assert {(r.form, r.code, r.ambiguous) for r in found.collect()} == {("new york", 1, False), ("ny", 1, True), ("york", 2, False), ("new", 3, False)}
    texts = spark.createDataFrame([(1, "in New  York, new; york NY"), (2, ""), (3, None)], "id int, text string")
    got = sorted((r.at, r.form, r.code, r.ambiguous) for r in aliases.mentioned(texts, ["id"], "text", found).collect())
    assert got == [(1, "new york", 1, False), (3, "new york", 1, False), (5, "ny", 1, True)]
    assert aliases.mentioned(texts, ["id"], "text", found.limit(0)).isEmpty()
