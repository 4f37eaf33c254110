"""Sources, units, dates and single providers' actions on odd rows."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import dates, texts
from marlstone.operators import aliases, evals, provenance, providers


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))


def test_authority_of_nothing_and_of_ports(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, None), ("web_reader", "", "", "https://DATA.gov:8080/x", ""), ("web_search", None, "FRED", None, None), ("structured_table_reader", "Read_Tables", None, "no address", "News"), ("web_reader", None, None, "http://x.org/a", None)],
        "tool string, action string, provider string, url string, title string",
    )
    cols = [F.col(c) for c in ("tool", "action", "provider", "url", "title")]
    got = [tuple(r) for r in df.select(provenance.authority(*cols), provenance.origin(*cols[:3]), provenance.inference_risk(cols[4], cols[3]), provenance.domain(cols[3])).collect()]
    assert got == [
        ("", "", "", ""), ("official_source", "reader_summary", "", "data.gov:8080"), ("official_structured_provider", "search_snippet", "", ""),
        ("table_document", "exact_table_extraction", "secondary_source_summary", ""), ("narrative_source", "reader_summary", "", "x.org"),
    ]


def test_units_of_odd_columns(spark):
    row = one(spark, a="x", e="y").select(*(provenance.field_unit(F.col("a"), F.col("e"), F.lit(c), F.lit(""), F.lit(None).cast("string")) for c in (None, "AMOUNT", "vol", " Close ", "total_mv", "nav"))).first()
    assert tuple(row) == ("", "", "", "source price unit", "", "CNY/unit")


def test_dates_that_fail(spark):
    df = spark.createDataFrame([("2024",), ("2024-02",), ("2024/02/03",), ("soon",), (None,), ("",)], "d string")
    assert [tuple(r) for r in df.select(dates.iso_day(F.col("d"), True), dates.period(F.col("d")), dates.first_year(F.col("d"))).collect()] == [
        ("2024-12-31", "2024", 2024), ("2024-02-28", "2024-02", 2024), ("2024-02-03", "2024-02", 2024), (None, None, None), (None, None, None), (None, None, None),
    ]
    assert df.limit(0).select(dates.clamped(F.col("d"), "2024-01-01")).isEmpty()
    for bad in ("2024", None):
        with pytest.raises(Exception, match="not in yyyy-mm-dd format"):
            one(spark, d=bad).select(dates.clamped(F.col("d"), "2024-01-01")).collect()


def test_series_and_metals_by_name(spark):
    assert providers.macro_table(" Money supply ") == "cn_m" and providers.macro_table("CPI") == "cn_cpi"
    assert (providers.metal_table("Gold"), providers.metal_table("silver", "am"), providers.metal_table("Platinum", "A.M.")) == ("gold_pm", "silver", "platinum_am")
    for f, x in ((providers.macro_table, "rates"), (providers.metal_table, "iron")):
        with pytest.raises(ValueError):
            f(x)
    prices = spark.createDataFrame([("2024-01-02", [1.0]), ("2024-01-03", []), ("2024-01-04", None)], "d string, v array<double>")
    got = [tuple(r) for r in providers.metal_prices({"silver": prices}, "silver", start="2024-01-02", end="2024").collect()]
    assert sorted(got) == [("2024-01-02", "silver", None, 1.0, None, None), ("2024-01-03", "silver", None, None, None, None), ("2024-01-04", "silver", None, None, None, None)]
    months = spark.createDataFrame([("202401", 1), ("2024-03", 2), (None, 3), ("202312", 4)], "month string, n int")
    assert sorted(r.n for r in providers.macro_series({"cn_m": months}, "m2", "2024-01-15", "20240301").collect()) == [1, 2]


def test_trade_of_unknown_areas(spark):
    areas = aliases.index(spark.createDataFrame([(1, "Aland"), (2, "Bland")], "code int, name string"), "code", ["name"], "code")
    flows = spark.createDataFrame([(1, p, "X", f"0{i}", 2020, float(i)) for p in (0, 2) for i in range(5)], "reporterCode int, partnerCode int, flowCode string, cmdCode string, period int, primaryValue double")
    asks = [(1, "aland", "", "export", "0", "2020"), (2, " ALAND", "bland", None, "03", "2020"), (3, "nowhere", "bland", "x", "0", "2020"), (4, "1", "World", "X", "", "2020"), (5, None, None, None, None, None), (6, "aland", "elsewhere", "x", "0", "2020")]
    requests = spark.createDataFrame(asks, "request int, reporter string, partner string, flow string, cmd string, period string")
    got = sorted((r.request, r.place, r.partnerCode, r.cmdCode) for r in providers.trade_series(flows, requests, areas, 2).collect())
    assert got == [(1, 1, 0, "00"), (1, 2, 0, "01"), (2, 1, 2, "03")]


def test_verdicts_of_odd_judges(spark):
    kinds = "answer_score string, trajectory_score string, answer_judgement string, trajectory_judgement string, contradiction boolean, scope string, criteria array<struct<answer_matched:boolean,trajectory_supported:boolean>>, anchors array<int>, eq boolean"
    rows = [
        ("1", "1", "correct", "sound", None, None, [(True, True)], [1], None), ("9", "-3", None, "odd", None, None, None, None, None), ("nan", None, "", "", None, None, [], [], None),
        ("0.9", "0.9", "Correct", "Sound", True, None, [(True, True)], [1], None), ("0.9", "0.9", "correct", "sound", False, None, [(True, None), (False, True)], None, None), ("0.1", "1", "incorrect", "sound", None, None, [(False, True)], [1], True),
    ]
    got = [(r.answer_score, r.trajectory_score, r.answer_judgement, r.trajectory_judgement, r.is_correct, r.overall_score) for r in evals.judged_replies(spark.createDataFrame(rows, kinds), atom=F.col("eq")).collect()]
    assert got == [
        (1.0, 1.0, "correct", "sound", True, 1.0), (0.5, 0.0, "partial", "no_trajectory", False, 0.325), (0.0, 0.0, "incorrect", "no_trajectory", False, 0.0),
        (0.9, 0.9, "correct", "sound", False, 0.9), (0.5, 0.5, "partial", "partially_sound", False, 0.5), (1.0, 1.0, "correct", "sound", True, 1.0),
    ]


def test_assets_of_nothing(spark):
    row = one(spark, a=None, q=None).select(texts.asset_score(F.col("a"), F.col("a"), F.col("a"), F.col("q"))).first()
    assert row[0] == -4.0


def test_periods_are_read_of_days_not_of_orders(spark):
    from marlstone import queries

    files = queries.QUERIES["macro_series"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/days-" in f for f in files)
