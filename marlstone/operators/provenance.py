"""Where a value comes from: the authority of its source, its origin, signs of inference, and its unit. Columns only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Providers, parts of domains and words by which a source is told, in the order in which they are asked.
STRUCTURED = ("world_bank", "fred", "alfred", "oecd", "iea", "comtrade", "wits", "lbma", "safe", "nfra", "tinyshare", "tushare", "tushare_http")
OFFICIAL = ("gov", "worldbank.org", "stlouisfed.org", "federalreserve.gov", "cninfo.com.cn", "sse.com.cn", "szse.cn", "hkexnews.hk")
SECONDARY = ("rating", "ratings", "research", "news", "summary", "reporter", "prnewswire", "businesswire")
INFERRED = ("inferred", "back-solved", "back solved", "reverse", "yoy", "year-over-year", "year over year", "同比", "反推", "倒推", "增长率")
REPORTED = ("rating report", "research report", "news", "summary", "评级报告", "研究报告", "新闻", "摘要")

#: Columns that have one unit wherever they come from, and those of prices.
UNITS = {
    "percent": ("pct_chg", "pct_change", "change_pct", "涨跌幅", "turnover_rate", "turnover_rate_f"),
    "ratio": ("pe", "pe_ttm", "pb", "ps", "ps_ttm", "dv_ratio", "dv_ttm", "volume_ratio"),
}
MARKET_VALUES, NET_VALUES = ("total_mv", "circ_mv", "float_mv"), ("nav", "unit_nav", "accum_nav", "adj_nav")
PRICES = ("open", "high", "low", "close", "pre_close", "change", "price")
AMOUNTS, VOLUMES = ("amount", "amt", "成交额"), ("vol", "volume", "成交量")


def _low(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def domain(address: Column) -> Column:
    """The host of an address with a scheme, in lower case, its port included; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def authority(tool: Column, action: Column, provider: Column, address: Column, titles: Column) -> Column:
    """How much a source is to be trusted, as a class; empty where nothing is known. Nulls are empty; titles is what the source is called."""
    tool, action, provider, host = _low(tool), _low(action), _low(provider), domain(address)
    called = F.concat_ws(" ", _low(address), _low(titles))
    tables = tool == "structured_table_reader"
    rules = [
        ((tool == "sec_reader") | provider.contains("sec") | host.contains("sec.gov"), "official_filing"), (provider.isin(*STRUCTURED), "official_structured_provider"),
        (_holds(host, OFFICIAL), "official_source"), (tables & (action == "discover_tables"), "source_discovery"), (tables & action.isin("read_tables", "default"), "table_document"),
        (_holds(called, SECONDARY) | _holds(host, SECONDARY), "secondary_summary"), (tool == "web_reader", "narrative_source"), (tool == "web_search", "search_snippet"),
    ]
    return F.coalesce(*(F.when(held, name) for held, name in rules), F.lit(""))


def origin(tool: Column, action: Column, provider: Column) -> Column:
    """How a value was had, as a class; empty where nothing is known."""
    tool, action, provider = _low(tool), _low(action), _low(provider)
    tables = tool == "structured_table_reader"
    rules = [
        (tool == "market_data", "structured_rows"), (tables & (action == "discover_tables"), "source_discovery"), (tables | (tool == "sec_reader") & action.contains("table"), "exact_table_extraction"),
        ((action == "official_attachment_table") | provider.isin("safe", "nfra"), "official_attachment_table"), (tool == "web_reader", "reader_summary"), (tool == "web_search", "search_snippet"), (tool == "calculator", "calculation"),
    ]
    return F.coalesce(*(F.when(held, name) for held, name in rules), F.lit(""))


def inference_risk(*texts: Column) -> Column:
    """The first sign, over the texts in order, that a value was inferred or only reported; empty without one."""
    def one(text: Column) -> Column:
        low = _low(text)
        return F.when(_holds(low, INFERRED), "possible_inference_or_derived_value").when(_holds(low, REPORTED), "secondary_source_summary")

    return F.coalesce(*map(one, texts), F.lit(""))


def field_unit(action: Column, endpoint: Column, column: Column, amount_unit: Column | None = None, volume_unit: Column | None = None) -> Column:
    """The unit of a column of market rows; empty where it has none. What the source says of amounts and volumes comes first."""
    name = _low(column)
    action, endpoint = F.coalesce(action, F.lit("")), F.coalesce(endpoint, F.lit(""))
    given = lambda c: F.when(c != "", c) if c is not None else F.lit(None).cast("string")
    price = F.when((action == "index_history") | (endpoint == "index_daily"), "index points")
    price = price.when(action.isin("equity_price_history", "fund_history") | endpoint.isin("daily", "fund_daily"), "CNY/share_or_unit").otherwise("source price unit")
    return F.coalesce(
        F.when(name.isin(*AMOUNTS), given(amount_unit)), F.when(name.isin(*VOLUMES), given(volume_unit)), *(F.when(name.isin(*names), unit) for unit, names in UNITS.items()),
        F.when(name.isin(*MARKET_VALUES) & (endpoint == "daily_basic"), "10k CNY"), F.when(name.isin(*NET_VALUES), "CNY/unit"), F.when(name.isin(*PRICES), price), F.lit(""),
    )
