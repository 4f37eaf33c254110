"""Spellings of plans: each gives the same normal form; limits have an order."""

import json

import pytest

from marlstone.plans import lower, normalise

USUAL = {
    "universe": {"type": "symbols", "symbols": ["b", "a"]}, "metrics": [{"source": "price_panel", "start_date": "2024-01-02", "end_date": "2024-01-05"}],
    "operations": [{"op": "filter", "field": "close", "operator": ">", "value": "3"}],
}


@pytest.mark.parametrize(
    "change",
    [
        {"operations": {"op": "filter", "field": "close", "operator": ">", "value": "3"}}, {"operations": [{"operation": "filter", "field": "close", "comparison": ">", "threshold": "3"}]},
        {"operations": ["close > 3"]}, {"operations": "close > 3"}, {"operations": [{"op": "filter", "condition": "close > 3"}]}, {"operations": [{"filter": "close > 3"}]},
        {"operations": {"filter": {"close": {">": "3"}}}}, {"operations": [{"filter": ["close > 3"]}]}, {"operations": [{"filter": {"condition": "close > 3"}}]},
        {"metrics": None, "metric": USUAL["metrics"]}, {"metrics": {"price_panel": {"start": "2024-01-02", "end": "2024-01-05"}}}, {"metrics": ["ohlcv"], "start_date": "2024-01-02", "end_date": "2024-01-05"},
        {"universe": "b,a"}, {"universe": ["b", "a"]},
    ],
)
def test_spellings(change):
    plan = {k: v for k, v in (USUAL | change).items() if v is not None}
    want = normalise(USUAL)
    assert normalise(plan) == want
    assert normalise(json.dumps(plan)) == want and normalise({"plan": json.dumps(plan)}) == want


def test_output_gives_shape_and_fields():
    plan = normalise(USUAL | {"output": {"shape": "summary", "fields": ["close"], "sort": "close_desc"}})
    assert (plan["metrics"][0]["shape"], plan["metrics"][0]["fields"]) == ("summary", ["close"])
    assert plan["operations"][-1] == {"op": "sort", "field": "close", "descending": True, "top": None}


def test_computed_change_is_a_ratio():
    assert normalise(USUAL | {"operations": [{"compute": {"x": "pct_change(close)"}}]})["operations"][0]["as_ratio"] is True


@pytest.mark.parametrize("op", [{}, {"op": "nothing"}, "no condition", {"what": 1}])
def test_what_is_no_operation_is_refused(op):
    with pytest.raises(ValueError):
        normalise(USUAL | {"operations": [op]})


def test_limits_take_the_first_symbols_asked_for(spark):
    names = [f"S{i}" for i in range(15)][::-1]
    rows = [(s, f"2024-01-0{d}", 1.0, 1.0, 1.0, float(d), 1) for s in names for d in (2, 3)]
    bars = spark.createDataFrame(rows, "symbol_key string, date string, open double, high double, low double, close double, volume int").selectExpr("symbol_key", "cast(date as date) date", "open", "high", "low", "close", "volume")
    span = {"start_date": "2024-01-02", "end_date": "2024-01-03"}
    got = lower(normalise({"universe": names, "metrics": ["returns"], **span}), {"bars": bars.repartition(7)})
    assert "_pos" not in got.columns and [r.symbol_key for r in got.collect()] == names[:10]
    got = lower(normalise({"universe": names, "metrics": ["price_panel"], **span, "limit": 3, "operations": [{"list": "symbol_key,close"}]}), {"bars": bars.repartition(7)})
    assert [tuple(r) for r in got.collect()] == [("S14", 2.0), ("S14", 3.0), ("S13", 2.0)]


def test_metrics_keyed_by_source_in_a_list():
    plan = normalise({"metrics": [{"prices": {"start_date": "2024-01-01"}, "volume": {}}, {"action": "returns"}, {"type": "daily_basic"}, "price"]})
    assert [m["source"] for m in plan["metrics"]] == ["price_panel", "volume_panel", "return_panel", "equity_daily_basic", "price_panel"]
    assert plan["metrics"][0]["start"] == "2024-01-01"


def test_operations_named_by_action():
    assert normalise({"operations": [{"action": "Rank", "field": "close"}]})["operations"] == [{"op": "rank", "field": "close", "descending": True, "top": None}]
    with pytest.raises(ValueError, match="compute"):
        normalise({"operations": [{"compute": "close / open"}]})
