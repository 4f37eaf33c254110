"""Price panels: daily bars, trading-day alignment, long and summary shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import percent_change

PAD = 10


def daily_bars(ticks: DataFrame, symbol: str, day: Column, price: str, volume: str, order: list[str]) -> DataFrame:
    """Bars by symbol and day from single trades; first and last by `order`."""
    first = F.struct(*order)
    return ticks.groupBy(F.col(symbol).cast("string").alias("symbol_key"), day.alias("date")).agg(
        F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, first).alias("close"), F.sum(volume).alias("volume"),
    )


def asof_bounds(bars: DataFrame, start: str, end: str, align: str = "previous") -> DataFrame:
    """bars with actual_start and actual_end, the trading days that stand for the dates asked for.

    A span runs from the first day on or after its start to the last on or
    before its end. A single date takes the day on or before it, or with
    `next` on or after it, or itself with `exact`. Symbols without such days go.
    """
    d, s, e = F.col("date"), F.lit(start).cast("date"), F.lit(end).cast("date")
    if start != end:
        first, last = F.min(F.when(d >= s, d)), F.max(F.when(d <= e, d))
    else:
        modes = {"next": F.min(F.when(d >= s, d)), "on_or_after": F.min(F.when(d >= s, d)), "exact": F.max(F.when(d == s, d))}
        first = last = modes.get(align, F.max(F.when(d <= s, d)))
    bounds = bars.groupBy("symbol_key").agg(first.alias("actual_start"), last.alias("actual_end"))
    return bars.join(bounds.where("actual_start is not null and actual_end is not null"), "symbol_key")


def padded(bars: DataFrame, start: str, end: str) -> DataFrame:
    """The days that alignment and previous closes may need; the predicate reaches the scan."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    return bars.where(F.col("date").between(F.date_sub(s, PAD), F.date_add(e, PAD)))


def long_panel(bars: DataFrame, start: str, end: str, align: str = "previous") -> DataFrame:
    """A row for each symbol and trading day, with the last known close before it and the change."""
    before = Window.partitionBy("symbol_key").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    rows = asof_bounds(padded(bars, start, end), start, end, align)
    rows = rows.withColumn("pre_close", F.last("close", ignorenulls=True).over(before))
    rows = rows.where(F.col("date").between(F.col("actual_start"), F.col("actual_end")))
    off = (F.col("actual_start") != F.lit(start).cast("date")) | (F.col("actual_end") != F.lit(end).cast("date"))
    return rows.withColumns(
        {
            "pct_chg": percent_change(F.col("close"), F.col("pre_close")),
            "change": F.col("close") - F.col("pre_close"),
            "trading_day_aligned": off,
        }
    )


def summary_panel(bars: DataFrame, start: str, end: str, source: str = "return_panel") -> DataFrame:
    """A row for each symbol: closes at both ends, return, extremes with their first days, volume."""
    rows = asof_bounds(padded(bars, start, end), start, end).where(F.col("date").between(F.col("actual_start"), F.col("actual_end")))
    day = F.col("date")

    def low(c: str) -> Column:
        return F.min_by(F.struct(c, "date"), F.when(F.col(c).isNotNull(), F.struct(F.col(c), day)))

    def high(c: str) -> Column:
        return F.max_by(F.struct(c, "date"), F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.unix_date(day))))

    out = rows.groupBy("symbol_key").agg(
        F.min_by("close", "date").alias("start_close"), F.max_by("close", "date").alias("end_close"), F.count("*").alias("panel_row_count"),
        high("high").alias("_h"), low("low").alias("_l"), high("volume").alias("_v"),
        F.sum("volume").alias("volume_sum"), F.avg("volume").alias("avg_volume"),
    )
    out = out.withColumn("return_pct", percent_change(F.col("end_close"), F.col("start_close")))
    value = {"return_panel": "return_pct", "volume_panel": "volume_sum"}.get(source, "end_close")
    return out.select(
        "symbol_key", "start_close", "end_close", "return_pct", "panel_row_count", F.col("_h.high").alias("max_high"), F.col("_h.date").alias("max_high_date"),
        F.col("_l.low").alias("min_low"), F.col("_l.date").alias("min_low_date"), F.col("_v.volume").alias("max_volume"), F.col("_v.date").alias("max_volume_date"),
        "volume_sum", "avg_volume", F.col(value).alias("metric_value"),
    )


def latest_by_symbol(rows: DataFrame, symbol: str, *order: str) -> DataFrame:
    """The last row of each symbol."""
    last = Window.partitionBy(symbol).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
