"""From a normalised plan to one lazy DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import formula
from ..operators import panels, rows, rules

PANELS = ("price_panel", "return_panel", "volume_panel")
#: Fields of single days: operations on them need the long shape.
DAILY = {"date", "trade_date", "open", "high", "low", "close", "pre_close", "pct_chg", "change", "volume", "vol", "amount"}
LONG_LIMIT = 200


class PlanError(ValueError):
    """failure_class: unsupported_universe, unsupported_metric, unsupported_panel_universe or missing_panel_dates."""

    def __init__(self, failure_class: str):
        super().__init__(failure_class)
        self.failure_class = failure_class


def check(plan: dict) -> None:
    """Refuses what cannot run before anything is read."""
    kind = plan["universe"]["type"]
    if kind not in ("symbols", "index_constituents", "index_weight", "index"):
        raise PlanError("unsupported_universe")
    for m in plan["metrics"]:
        if m["source"] not in (*PANELS, "equity_daily_basic"):
            raise PlanError("unsupported_metric")
        if m["source"] in PANELS and kind != "symbols":
            raise PlanError("unsupported_panel_universe")
        if m["source"] in PANELS and not (m["start"] and m["end"]):
            raise PlanError("missing_panel_dates")


def is_long(plan: dict, metric: dict) -> bool:
    used = {op.get(k) for op in plan["operations"] for k in ("field", "column", "start", "end")} | set(metric["fields"])
    used |= {f for op in plan["operations"] for f in op.get("fields") or []}
    return metric["shape"] == "long" or metric["shape"] != "summary" and metric["source"] == "price_panel" and bool(used & DAILY)


def universe(plan: dict, tables: dict[str, DataFrame], symbols: DataFrame) -> DataFrame:
    """The first max_entities keys, in the order asked for or else of the key."""
    wanted = plan["universe"]
    if wanted["type"] == "symbols":
        order = {s: i for i, s in reversed(list(enumerate(wanted["symbols"])))}
        pairs = sorted(order.items(), key=lambda p: p[1])[: plan["max_entities"]]
        return symbols.sparkSession.createDataFrame(pairs, "symbol_key string, _pos int")
    members = tables["constituents"].where(F.col("index_code") == wanted.get("index_code")).select("symbol_key").distinct()
    return members.orderBy("symbol_key").limit(plan["max_entities"])


def sourced(tables: dict[str, DataFrame], wanted: dict) -> dict[str, DataFrame]:
    """tables under the names that plans use: bars, keys and days are found by any of the names that sources give them.

    Bars are those of the universe's symbols, where it names them: a condition
    on the key, which reaches the scan before a day or a price is read.
    """
    found = {name: rules.canonical_rows(df) for name, df in tables.items() if name != "bars"}
    if "bars" in tables:
        bars = tables["bars"]
        known = {"symbol_key", "date", "open", "high", "low", "close", "volume"} <= set(bars.columns)
        if wanted["type"] == "symbols":
            key = F.col("symbol_key") if known else rules.first_present(bars, rules.KEY_NAMES)
            bars = bars.where(key.isin(list(wanted["symbols"])))
        found["bars"] = bars if known else (b := rules.canonical_bars(bars)).withColumn("date", b["date"].cast("date"))
    return found


def lower(plan: dict, tables: dict[str, DataFrame], lenient: bool = False) -> DataFrame:
    """The rows of a normalised plan.

    tables: bars (symbol_key, date, open, high, low, close, volume), and for
    other plans daily_basic (symbol_key, date, ...) and constituents
    (index_code, symbol_key); sources' own names of keys, days and prices are
    known too. Unknown operations fail, or with `lenient` are passed over.
    """
    check(plan)
    tables = sourced(tables, plan["universe"])
    frame, ties = universe(plan, tables, next(iter(tables.values()))), ["symbol_key"]
    long = False
    for m in plan["metrics"]:
        if m["source"] == "equity_daily_basic":
            basic = tables["daily_basic"].join(frame, "symbol_key", "left_semi")
            if m["start"] and m["end"]:
                basic = basic.where(F.col("date").between(F.lit(m["start"]).cast("date"), F.lit(m["end"]).cast("date")))
            frame = rows.left_merge(frame, panels.latest_by_symbol(basic, "symbol_key", "date"), ["symbol_key"], "date")
            continue
        bars = tables["bars"].join(frame, "symbol_key", "left_semi")
        if is_long(plan, m):
            panel = panels.long_panel(bars, m["start"], m["end"], m["align"])
            frame, ties, long = rows.expand_merge(frame, panel, "symbol_key", "symbol_key"), ["symbol_key", "date"], True
        else:
            frame = frame.join(panels.summary_panel(bars, m["start"], m["end"], m["source"]), "symbol_key", "left")
    frame = apply(frame, plan["operations"], plan["top_k"], ties, lenient)
    chosen = any(op["op"] in ("rank", "max_by", "min_by", "aggregate") for op in plan["operations"])
    limit = plan["limit"] or (LONG_LIMIT if long and not chosen else None if chosen else plan["top_k"])
    return (in_order(frame, plan["operations"]).limit(int(limit)) if limit else frame).drop("_pos")


def in_order(frame: DataFrame, operations: list[dict]) -> DataFrame:
    """frame in the order that was asked for, or else in that of its symbols and days, so that a limit has a meaning."""
    if any(op["op"] in ("sort", "rank", "max_by", "min_by", "aggregate") for op in operations):
        return frame
    keys = [c for c in ("_pos", "symbol_key", "date") if c in frame.columns]
    return frame.orderBy(*keys) if keys else frame


def apply(frame: DataFrame, operations: list[dict], top_k: int, ties: list[str], lenient: bool = False) -> DataFrame:
    start = frame
    for op in operations:
        kind, top = op["op"], int(op.get("top") or top_k)
        held = [t for t in ties if t in frame.columns]
        if kind == "filter":
            frame = rows.filtered(frame, op["field"], op["operator"], op["value"])
        elif kind == "add_column":
            frame = frame.withColumn(op["column"], formula(op["expression"], {c: F.col(c) for c in frame.columns}))
        elif kind == "sort":
            frame = rows.ordered(frame, op["field"], op["descending"], held)
        elif kind == "rank":
            frame = rows.ranked(frame, op["field"], top, op["descending"], held)
        elif kind in ("max_by", "min_by"):
            frame = rows.extreme(frame, op["field"], kind == "max_by", top, held)
        elif kind == "pct_change" and "column" in op:
            frame = rows.change_by_row(frame, op["column"], op["output"], as_ratio=op.get("as_ratio", False))
        elif kind == "pct_change":
            frame = rows.change_between(frame, op["start"], op["end"], op["output"])
        elif kind == "aggregate":
            frame = rows.aggregated(frame, op["function"], op["field"], start)
        elif kind in ("list", "select_fields"):
            fields = [f for f in op["fields"] if f in frame.columns]
            hidden = [c for c in ("_pos",) if c in frame.columns]
            limited = kind == "list" or op.get("top")
            frame = in_order(frame, operations) if limited else frame
            frame = frame.select(*fields, *hidden) if fields else frame
            frame = frame.limit(top) if limited else frame
        elif not lenient:
            raise ValueError(f"unknown operation: {kind}")
    return frame
