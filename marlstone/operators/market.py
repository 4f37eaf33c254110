"""Typed market actions over tables: scans with dates, queries and limits; options, filings, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_key


def fetched(
    df: DataFrame, dates: list[str] | None = None, start: str | None = None, end: str | None = None, query: str | None = None,
    query_fields: list[str] | None = None, sort: list[str] | None = None, limit: int | None = None, tail: bool = False,
) -> DataFrame:
    """A table through the steps of every action: date range, substring query, order, first or last rows.

    The range is on the first of `dates` that a row has, both ends included;
    the query is an upper-case substring of any of the fields.
    """
    if dates and (start or end):
        day = F.coalesce(*(date_key(F.col(c)) for c in dates))
        df = df.where(day.between(start or "00000000", end or "99999999"))
    if query:
        found = [F.coalesce(F.upper(F.col(c).cast("string")).contains(query.upper()), F.lit(False)) for c in query_fields or df.columns]
        test = found[0]
        for f in found[1:]:
            test = test | f
        df = df.where(test)
    order = [F.col(c).desc() if tail else F.col(c).asc() for c in sort or []]
    df = df.orderBy(*order) if order else df
    return df.limit(limit) if limit else df


CONTRACT = r"^([A-Za-z]+)(\d{4})-?([CP])-?(\d+(?:\.\d+)?)$"


def option_metrics(chain: DataFrame, futures: DataFrame, metric: str = "time_value", top: int = 10) -> DataFrame:
    """Options with their underlying's settlement: intrinsic and time value, moneyness; the largest by metric.

    chain: contract, settle, close. futures: symbol, settle_price. The price
    is the settlement, or the close where that is missing. Contracts that do
    not parse or lack what the metric needs are left out.
    """
    part = lambda k: F.regexp_extract("contract", CONTRACT, k)
    rows = chain.where(F.col("contract").rlike(CONTRACT)).withColumns(
        {"symbol": F.upper(F.concat(part(1), part(2))), "kind": part(3), "strike": part(4).try_cast("double"), "price": F.coalesce("settle", "close")}
    )
    rows = rows.join(futures.select(F.upper("symbol").alias("symbol"), F.col("settle_price").alias("s")), "symbol", "left")
    call = F.col("kind") == "C"
    s, k, none = F.col("s"), F.col("strike"), F.lit(0.0)
    inner = F.when(s.isNotNull(), F.when(call, F.greatest(s - k, none)).otherwise(F.greatest(k - s, none)))
    rows = rows.withColumn("intrinsic", inner).withColumn("time_value", F.col("price") - F.col("intrinsic"))
    rows = rows.withColumn("moneyness", F.when(call, F.when(k != 0, s / k)).otherwise(F.when(s != 0, k / s)))
    return rows.where(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), "contract").limit(top).withColumnRenamed("s", "settle_price")


def best_filings(facts: DataFrame, forms: list[str], limit: int = 4) -> DataFrame:
    """facts: label, period, unit, form, filed, fy, val. The last filing of each label and period in its first unit, latest periods first."""
    rank = F.when(F.col("unit") == "USD", 0).when(F.col("unit") == "USD/shares", 1).when(F.col("unit") == "shares", 2).otherwise(3)
    rows = facts.where(F.col("form").isin(forms) & F.col("val").isNotNull()).withColumn("_u", F.struct(rank.alias("r"), "unit"))
    best = rows.groupBy("label").agg(F.min("_u").alias("_best"))
    rows = rows.join(best, "label").where("_u = _best")
    newest = Window.partitionBy("label", "period").orderBy(F.col("filed").desc(), F.col("fy").desc(), F.col("val").desc())
    rows = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    recent = Window.partitionBy("label").orderBy(F.col("period").desc())
    return rows.withColumn("place", F.row_number().over(recent)).where(F.col("place") <= limit).drop("_u", "_best", "_n")


def latest_ranked(series: DataFrame, country: str, date: str, value: str, descending: bool = True, top: int = 10) -> DataFrame:
    """The latest date of each country first, then rows without a value go, then the ranking."""
    newest = series.groupBy(country).agg(F.max_by(value, date).alias(value), F.max(date).alias(date)).where(F.col(value).isNotNull())
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(country)]
    return newest.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def coverage(rows: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """For each key asked for: row_count and whether there are rows."""
    asked = rows.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(wanted)], f"{key} string")
    counts = rows.where(F.col(key).isin(wanted)).groupBy(key).agg(F.count("*").alias("row_count"))
    out = asked.join(counts, key, "left").na.fill(0, ["row_count"])
    return out.withColumn("status", F.when(F.col("row_count") > 0, "ok").otherwise("empty"))


def code_score(text: Column, code: Column, leaf: Column, query: str) -> Column:
    """How well a catalogue entry fits a query: exact code 12 or its start 5, phrase 9, share of tokens 7, all of them 2 more, leaf 0.5."""
    words = [w for w in dict.fromkeys(query.lower().split()) if w]
    low = F.lower(text)
    hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    if query.isdigit():
        base = F.when(code == query, 12.0).when(code.startswith(query), 5.0).otherwise(0.0)
    else:
        base = F.when(low.contains(query.lower()), 9.0).otherwise(0.0)
    tokens = hits * 7.0 / max(1, len(words)) + F.when(hits == len(words), 2.0).otherwise(0.0)
    total = base + tokens
    return F.when(total > 0, total + F.when(leaf, 0.5).otherwise(0.0)).otherwise(0.0)
