"""Actions of single providers over their tables: futures and options, macro series, trade, metals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_key, iso_day
from . import aliases
from .market import fetched

#: Names of macro series and the tables that hold them.
MACRO = {
    "cn_gdp": ("gdp", "china_gdp", "cn_gdp"), "cn_cpi": ("cpi", "china_cpi", "cn_cpi"), "cn_ppi": ("ppi", "china_ppi", "cn_ppi"),
    "cn_m": ("m", "money", "money_supply", "m2", "cn_m"), "cn_pmi": ("pmi", "china_pmi", "cn_pmi"),
}
#: Metals with a morning and an afternoon price, and those with one a day.
TWICE, ONCE = ("gold", "platinum", "palladium"), ("silver",)


def macro_table(series: str) -> str:
    """The table of a macro series by any of its names; ValueError for others."""
    key = re.sub(r"[^a-z0-9]+", "_", series.lower()).strip("_")
    found = [table for table, names in MACRO.items() if key in names]
    if not found:
        raise ValueError(f"unsupported series: {series}; use gdp, cpi, ppi, money_supply or m2, or pmi")
    return found[0]


def macro_series(tables: dict[str, DataFrame], series: str, start: str | None = None, end: str | None = None, last: int | None = None) -> DataFrame:
    """Rows of a macro series between two periods, ends included; the last of them, if so many are asked for.

    A table has `quarter` (2024Q1) or `month` (202401 or 2024-01) and any
    columns; a bound is any spelling of a date, a quarter counting from its
    first to its last day. Rows without a period go.
    """
    table = macro_table(series)
    rows = tables[table]
    column = "quarter" if table == "cn_gdp" else "month"
    low, high = date_key(F.col(column)), date_key(F.col(column), is_end=True)
    kept = rows.where(low.isNotNull())
    if start:
        kept = kept.where(high >= date_key(F.lit(start)))
    if end:
        kept = kept.where(low <= date_key(F.lit(end), is_end=True))
    return kept.orderBy(low.desc()).limit(last) if last else kept


def contract_code(contract: Column, exchange: str | None = None) -> Column:
    """A contract in capitals, with its exchange behind a dot where it has none; null for nothing."""
    code = F.upper(F.trim(contract))
    full = F.when(code.contains("."), code).otherwise(F.concat(code, F.lit(f".{exchange.upper()}"))) if exchange else code
    return F.when(code != "", full)


def contract_bars(bars: DataFrame, contract: str, exchange: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """The days of one contract of futures or options between two dates, the last `limit` of them. bars: ts_code, trade_date and any columns."""
    code = contract_code(F.lit(contract), exchange)
    return fetched(bars.where(F.upper("ts_code") == code), ["trade_date"], start, end, sort=["trade_date"], limit=limit, tail=True)


def contracts(catalogue: DataFrame, exchange: str | None = None, query: str | None = None, limit: int | None = None) -> DataFrame:
    """Contracts of an exchange whose code, symbol or name holds the query; the first of them by code."""
    rows = catalogue.where(F.upper("exchange") == exchange.upper()) if exchange else catalogue
    return fetched(rows, query=query, query_fields=["ts_code", "symbol", "name", "exchange"], sort=["ts_code"], limit=limit)


def trade_series(flows: DataFrame, requests: DataFrame, areas: DataFrame, limit: int) -> DataFrame:
    """Trade rows for each request: at most `limit` of them, by partner, commodity and period.

    flows: reporterCode, partnerCode, flowCode, cmdCode, period, primaryValue.
    requests: request (unique), reporter, partner, flow, cmd (a code or its
    beginning), period. areas: an index of aliases (see aliases.index); a
    partner that is the world, or not named, is 0. Requests whose reporter or
    partner is not known, or that name no commodity or period, have no rows.
    """
    world = F.when(F.upper(F.trim("partner")).isin("WORLD", "WLD") | (F.coalesce(F.trim("partner"), F.lit("")) == ""), "0")
    named = aliases.resolved(requests, "reporter", areas).withColumnRenamed("code", "_reporter").drop("ambiguous")
    named = aliases.resolved(named, "partner", areas, world).withColumnRenamed("code", "_partner").drop("ambiguous")
    asked = named.where("_reporter is not null and _partner is not null and trim(cmd) <> '' and trim(period) <> ''")
    asked = asked.select("request", "_reporter", "_partner", aliases.flow_code(F.col("flow")).alias("_flow"), F.trim("cmd").alias("_cmd"), F.trim("period").alias("_period"))
    same = (F.col("reporterCode").cast("string") == F.col("_reporter")) & (F.col("partnerCode").cast("string") == F.col("_partner"))
    same = same & (F.col("flowCode") == F.col("_flow")) & (F.col("period").cast("string") == F.col("_period"))
    both = flows.join(asked, same).where(F.col("cmdCode").startswith(F.col("_cmd")))
    # A request's rows are cut to `limit` while they are gathered, on each task first.
    order = F.struct("cmdCode", "primaryValue", F.struct(*flows.columns).alias("row"))
    kept = both.withColumn("_salt", F.pmod(F.xxhash64("cmdCode", "primaryValue"), F.lit(64))).groupBy("request", "_salt").agg(F.slice(F.array_sort(F.collect_list(order)), 1, limit).alias("rows"))
    kept = kept.groupBy("request").agg(F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, limit).alias("rows"))
    return kept.select("request", F.posexplode("rows").alias("place", "r")).select("request", (F.col("place") + 1).alias("place"), "r.row.*")


def metal_table(metal: str, session: str | None = None) -> str:
    """The table of a metal's price: of the afternoon unless the morning is asked for; ValueError for other metals."""
    metal, session = (re.sub("[^a-z]", "", (x or "").lower()) for x in (metal, session))
    if metal in ONCE:
        return metal
    if metal in TWICE:
        return f"{metal}_{session if session in ('am', 'pm') else 'pm'}"
    raise ValueError("metal must be gold, silver, platinum or palladium")


def metal_prices(tables: dict[str, DataFrame], metal: str, session: str | None = None, start: str | None = None, end: str | None = None, limit: int = 20) -> DataFrame:
    """date, metal, session and the prices in dollars, pounds and euros of the last `limit` days between two dates.

    A table has d (a day) and v (prices in that order, any of them missing); a lone start is the end too.
    """
    name = metal_table(metal, session)
    low, high = iso_day(F.lit(start)), iso_day(F.lit(end or start), is_end=True)
    rows = tables[name]
    rows = rows.where(F.col("d") >= low) if start else rows
    rows = rows.where(F.col("d") <= high) if end or start else rows
    price = lambda i, c: F.get("v", F.lit(i)).alias(f"price_{c}")
    kind = name.partition("_")[2] or None
    return rows.select(F.col("d").alias("date"), F.lit(name.partition("_")[0]).alias("metal"), F.lit(kind).cast("string").alias("session"), price(0, "usd"), price(1, "gbp"), price(2, "eur")).orderBy(F.col("date").desc()).limit(limit)
