"""Merges, flat texts, places and spans against plain folds."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import intervals, nested, ranks


def laid_over(a, b):
    """A plain deep merge of two objects."""
    out = dict(a)
    for k, v in b.items():
        out[k] = laid_over(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def leaves(doc, at=()):
    for k, v in doc.items():
        if isinstance(v, dict) and v:
            yield from leaves(v, (*at, k))
        else:
            yield (*at, k), v


def some_doc(rng, depth):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice([1, "x", None, True, [1, {"a": 2}], {}, "ü\"\\"])
    return {rng.choice("abc"): some_doc(rng, depth - 1) for _ in range(rng.randint(0, 3))}


def test_deep_merge_by_a_fold(spark):
    rng, rows, want = random.Random(3), [], {}
    for key in ("t1", "t2", None):
        state = {}
        for i in range(40):
            doc = some_doc(rng, 12)
            rows.append((key, i, json.dumps(doc)))
            if isinstance(doc, dict):
                state = laid_over(state, doc)
        rows.append((key, 99, "{broken"))
        want[key] = state
    df = spark.createDataFrame(rows, "task string, n int, state string")
    merged = nested.deep_merged(df, "task", ["n"], "state")
    got = {(r.task, tuple(r.path)): json.loads(r.leaf) for r in merged.collect()}
    assert got == {(k, p): v for k, doc in want.items() for p, v in leaves(doc)}
    docs = {r.task: json.loads(r.json) for r in nested.assembled(merged, "task").collect()}
    assert docs == {k: v for k, v in want.items() if v}


def test_deep_merge_of_nothing(spark):
    empty = spark.createDataFrame([], "task string, n int, state string")
    assert nested.deep_merged(empty, "task", ["n"], "state").isEmpty()
    one = spark.createDataFrame([("t", 1, "[1]"), ("t", 2, None), ("t", 3, "5")], empty.schema)
    assert nested.deep_merged(one, "task", ["n"], "state").isEmpty()


def test_lists_keep_their_places(spark):
    rows = [
        ("t", 1, '[{"id": 1, "a": 1}, {"entity": "e", "metric": "m"}, "x"]'),
        ("t", 2, '[{"id": 2, "slot": ""}, {"id": 1, "a": 2, "b": [3]}, "x", {"note": 1}, {}]'),
        ("t", 3, '[{"metric": "m", "entity": "e", "value": 5}, {"slot": "s", "id": 1}]'),
        ("t", 4, '{"no": "list"}'),
    ]
    df = spark.createDataFrame(rows, "task string, n int, items string")
    got = {}
    for r in nested.merged_lists(df, "task", ["n"], "items").collect():
        got.setdefault(r.place, {})[r.field] = r.value
    assert [got[i] for i in sorted(got)] == [
        {"id": "1", "a": "2", "b": "[3]"}, {"entity": '"e"', "metric": '"m"', "value": "5"}, {None: '"x"'},
        {"id": "2", "slot": '""'}, {"note": "1"}, {None: "{}"}, {"slot": '"s"', "id": "1"},
    ]


def plain_text(v):
    if isinstance(v, dict):
        parts = [str(v[k]) for k in nested.TEXTS if v.get(k)] + [plain_text(v[k]) for k in nested.CHILDREN if k in v]
        return " ".join(parts)
    return " ".join(map(plain_text, v)) if isinstance(v, list) else str(v or "")


def test_flat_text_by_recursion(spark):
    rng = random.Random(5)

    def tree(depth):
        if depth == 0 or rng.random() < 0.1:
            return rng.choice(["w", 7, None, True, "", "two words", 0])
        if rng.random() < 0.3:
            return [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        keys = rng.sample([*nested.TEXTS, *nested.CHILDREN, "other"], 4)
        return {k: rng.choice(["t", "", "x y"]) if k in nested.TEXTS else tree(depth - 1) for k in keys}

    deep = "end"
    for i in range(50):
        deep = {"text": f"n{i}", "children": [deep]} if i % 2 else [deep, "s"]
    docs = [tree(6) for _ in range(60)] + [deep, {"children": [{"text": "a"}] * 20_000}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, doc string")
    got = {r.id: r.text for r in nested.flat_text(df, ["id"], "doc").collect()}
    assert got == {i: plain_text(d) for i, d in enumerate(docs)}


@pytest.fixture(scope="module")
def hot(spark):
    """One group has most rows; there are ties, nulls and a null group."""
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), rng.choice([None, *range(5)]), rng.random() < 0.1) for i in range(3000)]
    return spark.createDataFrame(rows, "id int, g string, v int, mark boolean"), rows


def test_places_by_sorting(hot):
    df, rows = hot
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    want = {r[0]: i + 1 for i, r in enumerate(order)}
    assert {r.id: r.place for r in ranks.placed(df, ["v", "id"], "place").collect()} == want
    seen, own = {}, {}
    for r in order:
        seen[r[1]] = own[r[0]] = seen.get(r[1], 0) + 1
    assert {r.id: r.place for r in ranks.placed(df, ["v", "id"], "place", ["g"]).collect()} == own


def test_runs_and_sums_by_loops(hot):
    df, rows = hot
    run, total, runs, sums = {}, {}, {}, {}
    for i, g, v, mark in rows:
        run[g] = 0 if mark else run.get(g, 0) + 1
        total[g] = total.get(g, 0) + (v or 0)
        runs[i], sums[i] = run[g], total[g]
    assert {r.id: r.n for r in ranks.since_last(df, ["id"], F.col("mark"), "n", ["g"]).collect()} == runs
    assert {r.id: r.n for r in ranks.running_sum(df, ["id"], "v", "n", ["g"]).collect()} == sums
    assert ranks.placed(df.limit(0), ["id"], "place").isEmpty()


def test_epochs_differ_and_buckets_do_not(hot):
    df, rows = hot
    one, two = ({r.id: (r.bucket, r.position) for r in ranks.epoch_order(df.select("id", "v"), "id", ["v"], 64, "s", e).collect()} for e in (0, 1))
    assert sorted(p for _, p in one.values()) == list(range(len(rows)))
    assert {i: b for i, (b, _) in one.items()} == {i: b for i, (b, _) in two.items()} and one != two
    for places in (one, two):
        at = {}
        for b, p in places.values():
            at.setdefault(b, []).append(p)
        assert all(max(p) - min(p) == len(p) - 1 for p in at.values())


def test_spans_by_comparing_all(spark):
    rng = random.Random(2)
    start = date(1999, 12, 1)
    any_day = lambda: start + timedelta(rng.randint(-400, 400))
    spans = [(rng.choice("ab"), i, any_day(), rng.choice([None, any_day(), any_day()])) for i in range(120)] + [(None, 900, start, None), ("a", 901, None, None), ("a", 902, date(1850, 1, 1), date(2300, 1, 1))]
    days = [(rng.choice("ab"), i, any_day()) for i in range(150)] + [("a", 700, None), (None, 701, start)]
    got = intervals.valid_on(
        spark.createDataFrame(days, "k string, d int, day date"), spark.createDataFrame(spans, "k string, s int, since date, until date"), ["k"], "day", "since", "until"
    )
    want = sorted((d, s) for k, d, day in days for q, s, a, b in spans if k and k == q and day and a and a <= day and (b is None or day < b))
    assert sorted((r.d, r.s) for r in got.collect()) == want


def test_latest_span_reads_each_row_once(spark):
    from marlstone.operators import intervals

    spans = spark.sql("SELECT * FROM VALUES (1, 1.0D, DATE'1890-05-01', DATE'2020-01-01'), (1, 2.0D, DATE'2020-01-01', null), (2, 3.0D, DATE'2020-01-05', DATE'2020-01-07'), (null, 4.0D, DATE'2020-01-01', null) AS t(k, price, f, t)")
    days = spark.sql("SELECT * FROM VALUES (1, DATE'1895-01-01'), (1, DATE'2020-01-01'), (1, DATE'2019-12-31'), (2, DATE'2020-01-04'), (2, DATE'2020-01-06'), (2, DATE'2020-01-07'), (null, DATE'2020-01-02'), (1, null) AS t(k, day)")
    found = intervals.latest_on(days, spans, ["k"], "day", "f", "t")
    assert sorted((r.k, str(r.day), r.price) for r in found.collect()) == [(1, "1895-01-01", 1.0), (1, "2019-12-31", 1.0), (1, "2020-01-01", 2.0), (2, "2020-01-06", 3.0)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_merge_keeps_ends_alone(spark, monkeypatch):
    staged, seen = nested.staged, {}

    def watched(df, name):
        seen[name] = staged(df, name)
        return seen[name]

    monkeypatch.setattr(nested, "staged", watched)
    rows = [
        ("a", 1, '{"q": {"p": {"c": 1}}}'), ("a", 2, '{"q": 5}'), ("a", 3, '{"q": {"p": {}}}'), ("b", 1, '{"q": {"p": {"c": 1}}}'), ("b", 3, '{"q": {"p": {}}}'),
        ("c", 1, '{"q": {"p": {}, "r": {"s": {}}}}'), ("c", 2, '{"q": {"p": [1]}}'), ("t", 1, '{"q": 1}'), ("t", 1, '{"q": 2}'), ("t", 1, '{"q": 2}'), (None, 1, '{"n": null}'),
    ]
    got = nested.deep_merged(spark.createDataFrame(rows, "task string, n int, state string"), "task", ["n"], "state")
    assert {(r.task, ".".join(r.path), r.leaf) for r in got.collect()} == {("a", "q.p", "{}"), ("b", "q.p.c", "1"), ("c", "q.p", "[1]"), ("c", "q.r.s", "{}"), ("t", "q", "2"), (None, "n", "null")}
    # One row for each leaf or empty object of an update, and no text of an update beside it.
    assert seen["ends"].where("done").count() == 12
    assert all("state" not in df.schema.simpleString() and "_json" not in df.columns for df in seen.values())


def test_flat_texts_are_as_variants_write_them(spark):
    docs = ['{"text": {"b": [1.0, "\\u001f/é"], "a": null}, "items": [1.50, 0.0, -0, 1e30, 12345678901234567890, false, true, "0", {}]}', '{"title": 0.0, "html": [], "label": 2.50}', "[]", "3", "null", "no", '"t"', None, "[" * 400 + '"d"' + "]" * 400]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, doc string")
    found = nested.flat_text(df, ["id"], "doc")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.text for r in found.collect()}
    written = spark.sql("SELECT to_json(parse_json('[1.50, 1e30, 12345678901234567890]'))").first()[0].strip("[]").split(",")
    assert got.pop(0) == '{"a":null,"b":[1,"\\u001F/é"]} ' + f"{written[0]}   {written[1]} {written[2]}  True 0 "
    assert got == {1: "2.5", 2: "", 3: "3", 4: "", 6: "t", 8: "d"}
