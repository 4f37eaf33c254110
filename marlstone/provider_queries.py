"""Registered queries of sources' authority, units, requests' dates and single providers' actions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dates
from .operators import aliases, provenance, providers
from .queries import query, table
from .shared import staged

TOOLS = ["sec_reader", "web_reader", "web_search", "structured_table_reader", "market_data", "calculator"]


@query(
    f"""WITH c AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, {TOOLS!r}[1 + page_id % 6] AS tool,
      CASE WHEN page_id % 4 = 0 THEN 'discover_tables' WHEN page_id % 4 = 1 THEN 'read_tables' WHEN page_id % 4 = 2 THEN 'Official_Attachment_Table' END AS action,
      CASE page_id % 9 WHEN 0 THEN 'FRED' WHEN 1 THEN 'my-SEC' WHEN 2 THEN 'safe' END AS provider, CASE WHEN page_id % 5 = 0 THEN 'Credit rating report' WHEN page_id % 5 = 1 THEN '净利同比' ELSE NULL END AS title FROM pages)
    SELECT page_id, CASE WHEN tool = 'sec_reader' OR page_id % 9 = 1 OR contains(host, 'sec.gov') THEN 'official_filing' WHEN page_id % 9 IN (0, 2) THEN 'official_structured_provider' WHEN contains(host, 'gov') THEN 'official_source'
        WHEN tool = 'structured_table_reader' AND page_id % 4 = 0 THEN 'source_discovery' WHEN tool = 'structured_table_reader' AND page_id % 4 = 1 THEN 'table_document'
        WHEN page_id % 5 = 0 OR regexp_matches(lower(url), 'rating|research|news|summary|reporter') THEN 'secondary_summary' WHEN tool = 'web_reader' THEN 'narrative_source' WHEN tool = 'web_search' THEN 'search_snippet' ELSE '' END AS authority,
      CASE WHEN tool = 'market_data' THEN 'structured_rows' WHEN tool = 'structured_table_reader' AND page_id % 4 = 0 THEN 'source_discovery' WHEN tool = 'structured_table_reader' OR tool = 'sec_reader' AND page_id % 4 < 3 AND contains(lower(action), 'table') THEN 'exact_table_extraction'
        WHEN page_id % 4 = 2 OR page_id % 9 = 2 THEN 'official_attachment_table' WHEN tool = 'web_reader' THEN 'reader_summary' WHEN tool = 'web_search' THEN 'search_snippet' WHEN tool = 'calculator' THEN 'calculation' ELSE '' END AS origin,
      CASE WHEN page_id % 5 = 0 THEN 'secondary_source_summary' WHEN page_id % 5 = 1 THEN 'possible_inference_or_derived_value'
        WHEN regexp_matches(lower(url), 'inferred|reverse|yoy') THEN 'possible_inference_or_derived_value' WHEN regexp_matches(lower(url), 'news|summary') THEN 'secondary_source_summary' ELSE '' END AS risk FROM c"""
)
def sources_classified(spark, sf_dir):
    n = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.element_at(F.array(*map(F.lit, TOOLS)), (n % 6 + 1).cast("int")).alias("tool"),
        F.when(n % 4 == 0, "discover_tables").when(n % 4 == 1, "read_tables").when(n % 4 == 2, "Official_Attachment_Table").alias("action"),
        F.when(n % 9 == 0, "FRED").when(n % 9 == 1, "my-SEC").when(n % 9 == 2, "safe").alias("provider"), F.when(n % 5 == 0, "Credit rating report").when(n % 5 == 1, "净利同比").alias("title"),
    )
    tool, action, provider, url, title = (F.col(c) for c in ("tool", "action", "provider", "url", "title"))
    return rows.select(
        "page_id", provenance.authority(tool, action, provider, url, title).alias("authority"), provenance.origin(tool, action, provider).alias("origin"), provenance.inference_risk(title, url).alias("risk")
    )


COLUMNS = ["Close", "vol", "amount", "pct_chg", "pe_ttm", "total_mv", "unit_nav", "other", "成交额"]


@query(
    f"""WITH c AS (SELECT p_partkey, {COLUMNS!r}[1 + p_partkey % 9] AS name, CASE p_partkey % 4 WHEN 0 THEN 'index_daily' WHEN 1 THEN 'daily' WHEN 2 THEN 'daily_basic' END AS endpoint,
      CASE WHEN p_partkey % 5 = 0 THEN 'fund_history' END AS action, CASE WHEN p_size > 25 THEN 'CNY' ELSE '' END AS amount FROM part)
    SELECT p_partkey, CASE WHEN name IN ('amount', '成交额') THEN amount WHEN name = 'vol' THEN 'lots' WHEN name = 'pct_chg' THEN 'percent' WHEN name = 'pe_ttm' THEN 'ratio'
      WHEN name = 'total_mv' THEN CASE WHEN p_partkey % 4 = 2 THEN '10k CNY' ELSE '' END WHEN name = 'unit_nav' THEN 'CNY/unit'
      WHEN name = 'Close' THEN CASE WHEN p_partkey % 4 = 0 THEN 'index points' WHEN p_partkey % 5 = 0 OR p_partkey % 4 = 1 THEN 'CNY/share_or_unit' ELSE 'source price unit' END ELSE '' END AS unit FROM c"""
)
def units_of_fields(spark, sf_dir):
    n = F.col("p_partkey")
    endpoint = F.when(n % 4 == 0, "index_daily").when(n % 4 == 1, "daily").when(n % 4 == 2, "daily_basic")
    name = F.element_at(F.array(*map(F.lit, COLUMNS)), (n % 9 + 1).cast("int"))
    unit = provenance.field_unit(F.when(n % 5 == 0, "fund_history"), endpoint, name, F.when(F.col("p_size") > 25, "CNY").otherwise(""), F.lit("lots"))
    return table(spark, sf_dir, "part").select("p_partkey", unit.alias("unit"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y') || '-12-31' WHEN 1 THEN strftime(o_orderdate, '%Y-%m') || '-28' WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS last_day,
      least(strftime(o_orderdate, '%Y-%m-%d'), '1996-06-30') AS clamped, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE year(o_orderdate)::INT END AS first_year, CASE WHEN o_orderkey % 3 = 0 THEN 2001 WHEN o_orderkey % 5 = 4 THEN NULL ELSE year(o_orderdate)::INT END AS last_year,
      CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m') END AS period FROM orders"""
)
def dates_of_requests(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    spelled = lambda p: F.date_format(day, p)
    n = F.col("o_orderkey")
    asked = F.when(n % 5 == 0, spelled("yyyy")).when(n % 5 == 1, spelled("yyyy-MM")).when(n % 5 == 2, spelled("yyyy-MM-dd")).when(n % 5 == 3, spelled("yyyy.MM.dd")).otherwise("soon")
    first, last = dates.year_bounds(F.lit(None), F.when(n % 3 == 0, "to 2001"), asked)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.iso_day(asked, is_end=True).alias("last_day"), dates.clamped(spelled("yyyy-MM-dd"), "1996-06-30").alias("clamped"),
        first.alias("first_year"), last.alias("last_year"), dates.period(asked).alias("period"),
    )


@query(
    """WITH m AS (SELECT strftime(o_orderdate, '%Y%m') AS period, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, count(*) AS n FROM orders GROUP BY 1)
    SELECT 'm2' AS series, period, n FROM (SELECT * FROM m WHERE period BETWEEN '199503' AND '199611' ORDER BY period DESC LIMIT 12)
    UNION ALL SELECT 'gdp', period, n FROM q WHERE period BETWEEN '1994Q2' AND '1997Q1'"""
)
def macro_series(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    # Counted by day and written: a condition on periods would else be pushed below the counts and read a code for each order.
    days = staged(table(spark, sf_dir, "orders").groupBy(day.alias("day")).agg(F.count("*").alias("n")), "days")
    tables = {
        "cn_m": days.groupBy(dates.month_code(F.col("day")).alias("month")).agg(F.sum("n").alias("n")),
        "cn_gdp": days.groupBy(dates.quarter_code(F.col("day")).alias("quarter")).agg(F.sum("n").alias("n")),
    }
    money = providers.macro_series(tables, "Money-Supply", "1995-03", "199611", last=12).select(F.lit("m2").alias("series"), F.col("month").alias("period"), "n")
    gdp = providers.macro_series(tables, "China GDP", "1994-04-01", "1997Q1").select(F.lit("gdp").alias("series"), F.col("quarter").alias("period"), "n")
    return money.unionByName(gdp)


@query(
    """SELECT 'S' || l_suppkey || '.' || CASE WHEN l_suppkey % 2 = 0 THEN 'SHF' ELSE 'DCE' END AS ts_code, strftime(l_shipdate, '%Y%m%d') AS trade_date, max(l_extendedprice) AS settle, sum(l_quantity::DECIMAL(18, 2))::DOUBLE AS vol FROM lineitem
    WHERE l_suppkey = 7 AND strftime(l_shipdate, '%Y%m%d') BETWEEN '19940101' AND '19961231' GROUP BY ALL ORDER BY trade_date DESC LIMIT 40"""
)
def contract_days(spark, sf_dir):
    code = F.concat(F.lit("S"), "l_suppkey", F.lit("."), F.when(F.col("l_suppkey") % 2 == 0, "SHF").otherwise("DCE"))
    lines = table(spark, sf_dir, "lineitem").select(code.alias("ts_code"), F.date_format(F.col("l_shipdate").cast("date"), "yyyyMMdd").alias("trade_date"), "l_extendedprice", "l_quantity")
    bars = lines.groupBy("ts_code", "trade_date").agg(F.max("l_extendedprice").alias("settle"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("vol"))
    return providers.contract_bars(bars, " s7 ", "dce", "19940101", "19961231", 40)


@query(
    """WITH f AS (SELECT o_custkey % 25 AS reporter, o_orderkey // 8 % 25 AS partner, CASE WHEN o_orderkey % 2 = 0 THEN 'X' ELSE 'M' END AS flow, lpad((o_orderkey % 40)::VARCHAR, 2, '0') || '01' AS cmd, 1990 + o_orderkey % 3 AS period, o_totalprice AS v FROM orders),
    r AS (SELECT n_nationkey AS request, n_nationkey AS reporter, CASE n_nationkey % 4 WHEN 0 THEN 0 ELSE (n_nationkey + 1) % 25 END AS partner, CASE WHEN n_nationkey % 2 = 0 THEN 'X' ELSE 'M' END AS flow, CASE WHEN n_nationkey % 7 = 6 THEN '' ELSE ((n_nationkey // 2) % 4)::VARCHAR END AS cmd FROM nation)
    SELECT request, row_number() OVER (PARTITION BY request ORDER BY f.cmd, v)::INT AS place, f.cmd AS cmdCode, f.period, v AS primaryValue
    FROM r JOIN f ON r.reporter = f.reporter AND (r.partner = f.partner) AND r.flow = f.flow AND starts_with(f.cmd, r.cmd) AND f.period = 1990 + request % 3 WHERE r.cmd <> ''
    QUALIFY row_number() OVER (PARTITION BY request ORDER BY f.cmd, v) <= 3"""
)
def trade_rows(spark, sf_dir):
    """Orders as flows of trade between nations; each nation asks by names, the world's code or none."""
    nation, n = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    key = F.col("o_orderkey")
    flows = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 25).alias("reporterCode"), (F.floor(key / 8) % 25).alias("partnerCode"), F.when(key % 2 == 0, "X").otherwise("M").alias("flowCode"),
        F.concat(F.lpad((key % 40).cast("string"), 2, "0"), F.lit("01")).alias("cmdCode"), (1990 + key % 3).alias("period"), F.col("o_totalprice").alias("primaryValue"),
    )
    areas = aliases.index(nation, "n_nationkey", ["n_name"], "n_nationkey")
    next_name = nation.select((F.pmod(n - 1, F.lit(25))).alias("n_nationkey"), F.col("n_name").alias("next"))
    asked = nation.join(next_name, "n_nationkey").select(
        n.alias("request"), F.lower("n_name").alias("reporter"), F.when(n % 8 == 0, " world").when(n % 4 == 0, None).otherwise(F.concat(F.upper("next"), F.lit("."))).alias("partner"),
        F.when(n % 2 == 0, "Exports").otherwise("import").alias("flow"), F.when(n % 7 == 6, " ").otherwise((F.floor(n / 2) % 4).cast("string")).alias("cmd"), (1990 + n % 3).cast("string").alias("period"),
    )
    return providers.trade_series(flows, asked, areas, 3).select("request", "place", "cmdCode", "period", "primaryValue")


@query(
    """WITH d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, max(o_totalprice) AS usd, min(o_totalprice) AS gbp, count(*) AS n FROM orders GROUP BY 1)
    SELECT date, 'gold' AS metal, 'am' AS session, usd AS price_usd, CASE WHEN n % 2 = 0 THEN gbp END AS price_gbp, NULL::DOUBLE AS price_eur FROM d WHERE date BETWEEN '1995-01-01' AND '1996-12-31' ORDER BY date DESC LIMIT 30"""
)
def metal_days(spark, sf_dir):
    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    days = table(spark, sf_dir, "orders").groupBy(day.alias("d")).agg(F.max("o_totalprice").alias("usd"), F.min("o_totalprice").alias("gbp"), F.count("*").alias("n"))
    prices = days.select("d", F.when(F.col("n") % 2 == 0, F.array("usd", "gbp")).otherwise(F.array("usd", F.lit(None).cast("double"))).alias("v"))
    return providers.metal_prices({"gold_am": prices}, "Gold ", "A.M.", "1995", "1996", 30)
