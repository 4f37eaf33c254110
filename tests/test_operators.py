import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.functions import dates, numbers, texts
from marlstone.operators import evals, market, panels, rows, rules, sampling
from marlstone.plans import PlanError, lower, normalise
from marlstone.sources import html_tables, lines


def values(df, column):
    return [r[column] for r in df.collect()]


def test_comparisons_are_of_numbers_or_dates(spark):
    df = spark.createDataFrame([("3",), ("abc",), (None,), ("10",), ("2024-01-05",)], "v string")
    test = lambda op, x, **k: sorted(filter(None, values(rows.filtered(df, "v", op, x, **k), "v")))
    assert test("gt", 3) == ["10"]
    assert test(">=", "3") == ["10", "3"]
    assert test("gt", "2024-01-01") == ["2024-01-05"]
    assert test("ne", "3") == ["10", "2024-01-05", "abc"] and rows.filtered(df, "v", "ne", "3").count() == 4
    assert test("eq", 10.0) == ["10"]
    assert rows.filtered(df, "v", "contains", "on").count() == 0
    assert rows.filtered(df, "v", "contains", "on", legacy_nulls=True).count() == 1


def test_order_of_numbers_and_texts(spark):
    df = spark.createDataFrame([("3", 1), ("abc", 2), (None, 3), ("10", 4), ("", 5)], "v string, k int")
    assert values(rows.ordered(df, "v", True, ["k"]), "v") == ["abc", None, "", "10", "3"]
    assert values(rows.ordered(df, "v", False, ["k"]), "v") == ["3", "10", "abc", None, ""]


def test_rank_keeps_missing_values_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "k string, v double")
    for down, want in ((True, ["c", "a", "b"]), (False, ["a", "c", "b"])):
        out = rows.ranked(df, "v", 3, down, ["k"]).orderBy("rank")
        assert values(out, "k") == want and values(out, "rank") == [1, 2, 3]
    assert rows.extreme(df, "v", True, 5, ["k"]).count() == 2


def bars(spark, data):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), c) for s, d, c in data], "symbol_key string, date date, close double").select(
        "symbol_key", "date", *(F.col("close").alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume")
    )


BARS = [("a", "2024-01-02", 10.0), ("a", "2024-01-03", None), ("a", "2024-01-04", 12.0), ("a", "2024-01-05", 0.0), ("a", "2024-01-08", 5.0), ("b", "2024-01-04", 7.0)]


def test_previous_close_passes_over_nulls(spark):
    out = panels.long_panel(bars(spark, BARS), "2024-01-03", "2024-01-08").where("symbol_key = 'a'").orderBy("date").collect()
    assert [r.pre_close for r in out] == [10.0, 10.0, 12.0, 0.0]
    assert [r.pct_chg for r in out] == [None, pytest.approx(20.0), -100.0, None]


@pytest.mark.parametrize(("align", "day"), [("previous", "2024-01-05"), ("next", "2024-01-08"), ("exact", None)])
def test_single_dates(spark, align, day):
    out = panels.long_panel(bars(spark, BARS), "2024-01-06", "2024-01-06", align).where("symbol_key = 'a'").collect()
    assert [str(r.date) for r in out] == ([day] if day else [])


def test_spellings_of_a_plan_are_one():
    usual = normalise({"universe": {"type": "symbols", "symbols": ["A"]}, "metrics": [{"source": "price_panel", "start_date": "x", "end_date": "y"}], "operations": [{"op": "filter", "field": "close", "operator": "gt", "value": 3}, {"op": "sort", "field": "date", "order": "desc"}]})
    for other in (
        {"universe": "a", "metrics": ["ohlcv"], "start_date": "x", "end_date": "y", "operations": [{"filter": {"close": {"gt": 3}}}, {"sort": {"date": "desc"}}]},
        {"symbols": ["a"], "metrics": {"name": "prices", "from": "x", "to": "y"}, "operations": [{"type": "filter", "column": "close", "comparison": "gt", "threshold": 3}], "output": {"sort": "date_desc"}},
    ):
        got = normalise(other)
        assert (got["universe"]["symbols"], got["operations"]) == (usual["universe"]["symbols"], [{**o, "top": None} if o["op"] == "sort" else o for o in usual["operations"]])
        assert {k: got["metrics"][0][k] for k in ("source", "start", "end")} == {"source": "price_panel", "start": "x", "end": "y"}


@pytest.mark.parametrize(
    ("plan", "failure"),
    [
        ({"universe": {"type": "galaxy"}, "metrics": []}, "unsupported_universe"),
        ({"universe": "a", "metrics": ["mood"]}, "unsupported_metric"),
        ({"universe": {"type": "index"}, "metrics": [{"source": "price", "date": "2024-01-01"}]}, "unsupported_panel_universe"),
        ({"universe": "a", "metrics": ["price"]}, "missing_panel_dates"),
    ],
)
def test_plans_that_cannot_run(plan, failure):
    with pytest.raises(PlanError) as e:
        lower(normalise(plan), {})
    assert e.value.failure_class == failure


def test_aggregates_of_nothing(spark):
    df = spark.createDataFrame([("x",), (None,)], "v string")
    got = {f: rows.aggregated(df, f, "v").first() for f in ("sum", "mean", "count")}
    assert (got["sum"].value, got["mean"].value, got["count"].value, got["sum"].non_null_rows) == (0.0, None, 2.0, 0)


def test_formulas(spark):
    df = spark.createDataFrame([(2.0, 0.0)], "a double, b double")
    cols = {"a": F.col("a"), "b": F.col("b")}
    out = df.select(*(numbers.formula(t, cols).alias(str(i)) for i, t in enumerate(("a^3 - 1", "a / b", "max(a, b) + abs(-a)", "cagr_pct(1, a, 1)", "round(a / 3, 2)")))).first()
    assert tuple(out) == (7.0, None, 4.0, 100.0, 0.67)
    for bad in ("__import__('os')", "a.b", "c + 1", "[1]"):
        with pytest.raises(ValueError):
            numbers.formula(bad, cols)


def test_date_spellings(spark):
    cases = {"2024-2-5": ("20240205",) * 2, "2024Q1": ("20240101", "20240331"), "202402": ("20240201", "20240229"), "2023": ("20230101", "20231231"), "2024年2月": ("20240201", "20240229"), "x": (None, None), "20240131": ("20240131",) * 2}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    got = {r.d: (r.a, r.b) for r in df.select("d", dates.date_key(F.col("d")).alias("a"), dates.date_key(F.col("d"), True).alias("b")).collect()}
    assert got == cases


def test_overlaps_and_labels(spark):
    df = spark.createDataFrame([("The  Cat, 1,000 and 5%", "cat 1,000")], "a string, g string")
    out = df.select(texts.recall(texts.tokens(F.col("a")), texts.tokens(F.col("g"))).alias("r"), texts.numbers_in(F.col("a")).alias("n"), texts.answers_match(F.col("a"), F.col("g")).alias("m")).first()
    assert out.r == 1.0 and out.n == ["1,000", "5%"] and out.m


def test_quantiles_matthews_and_allocation(spark):
    q = evals.rank_quantiles(spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 6, 7)], "v int"), "v", {"p50": 0.5, "p10": 0.1}).first()
    assert (q.n, q.p50, q.p10) == (7, 3, 1)
    pairs = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "g string, p string")
    assert evals.matthews(pairs, "g", "p").first().mcc == pytest.approx(1.0)
    assert evals.matthews(pairs.limit(1), "g", "p").first().mcc is None
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double")
    assert {r.k: r.share for r in sampling.allocation(weights, 10, "k", "w").collect()} == {"a": 4, "b": 3, "c": 3}


def test_splits_keep_groups_whole(spark):
    df = spark.createDataFrame([(g, i) for g in range(7) for i in range(3)], "g int, i int")
    out = sampling.split(df, "g", 0.3, "s").groupBy("g").agg(F.countDistinct("is_eval").alias("n"), F.max("is_eval").alias("e")).collect()
    assert {r.n for r in out} == {1} and sum(r.e for r in out) == 2
    assert not any(values(sampling.split(df.where("g = 1"), "g", 0.3, "s"), "is_eval"))


def test_countries_without_a_latest_value_go(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("b", 1, 3.0)], "c string, d int, v double")
    newest = df.groupBy("c").agg(F.max("d").alias("d"))
    assert values(market.latest_ranked(df.join(newest, ["c", "d"]), "c", "d", "v"), "c") == ["b"]


def test_html_cells(spark):
    html = "<table><tr><th>Name<th colspan=2>Year</tr><tr><td rowspan=2>A&amp;B</td><td>1</td><td>2</td></tr><tr><td>3<td>4</table><p><table><tr><td>x</table>"
    out = html_tables.html_cells(spark.createDataFrame([(1, html), (2, None)], "id int, html string"), "id", "html").collect()
    grid = {(r.table_index, r.row_index, r.column_index): r.text for r in out}
    assert grid == {(0, 0, 0): "Name", (0, 0, 1): "Year", (0, 0, 2): "Year", (0, 1, 0): "A&B", (0, 1, 1): "1", (0, 1, 2): "2", (0, 2, 0): "A&B", (0, 2, 1): "3", (0, 2, 2): "4", (1, 0, 0): "x"}
    scores = html_tables.table_scores(spark.createDataFrame(out), "id", ["year", "a&b"]).where("table_index = 0").first()
    assert scores.score == pytest.approx(4 + 3 + 5 * 4 / 9)


def test_lines_and_delimited(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n\n{"k": 1, "v": "y"}\n{"k": 2, "v"')
    good, bad = lines.json_lines(spark, f"file://{tmp_path}/a.jsonl", "k int, v string", "k", "v")
    assert [(r.k, r.v) for r in good.collect()] == [(1, "y")] and bad.count() == 1
    (tmp_path / "b.csv").write_text("﻿name,,name\na,1,\n,,\nb,,2\n", encoding="utf-8")
    df = lines.delimited(spark, f"file://{tmp_path}/b.csv")
    assert df.count() == 2 and df.columns[1].startswith("column_")
    lines.write_csv(df.withColumn("none", F.lit(None).cast("string")), f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert "N/A" in text and "none" not in text
    table = spark.createDataFrame([("t", 1, "a|b"), ("t", 2, None)], "t string, i int, c string")
    assert lines.markdown(table, "t", "i", ["c"]).first().markdown == "| c |\n| --- |\n| a\\|b |\n|  |"


def test_places_by_blocks_are_places_in_the_whole_order(spark):
    rows = spark.range(3000).selectExpr("CAST(id AS INT) AS id", "CASE WHEN id % 10 < 7 THEN 'hot' WHEN id % 10 < 9 THEN 'x' END AS g").withColumn("_h", sampling.draw("s", "id"))
    got = {r.id: (r.g, r.place) for r in sampling.ranked(rows, ["g"], "id", "place").collect()}
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r["_h"], r.id)):
        seen[r.g] = seen.get(r.g, 0) + 1
        want[r.id] = (r.g, seen[r.g])
    assert got == want
    assert sampling.ranked(rows.limit(0), [], "id", "place").count() == 0


def test_rules_on_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (4, "**Answer:** ABC-1 (so)"), (5, "```json\n{\"a\": 1}\n``` {b")], "id int, t string")
    out = {r.id: r for r in df.select(
        "id", rules.answer_atom(F.col("t")).alias("atom"), rules.lenient_json(F.col("t")).alias("json"), rules.unit_hint(F.col("t")).alias("unit"),
        rules.names_acronym(F.lit("ABC-1"), F.col("t")).alias("acronym"), F.size(rules.field_candidates(F.col("t"), {"abc": {}})).alias("fields"),
    ).collect()}
    assert (out[1].atom, out[1].json, out[1].unit, out[1].acronym) == (None, None, None, None)
    assert (out[2].atom, out[2].json, out[2].fields) == ("", None, 0)
    assert (out[3].json, out[3].acronym) == (None, False)
    assert (out[4].atom, out[4].acronym, out[4].fields) == ("ABC-1", True, 1)
    assert out[5].json == '{"a": 1}'
