"""Registered queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, numbers, symbols, texts
from .operators import evals, ledger, market, panels, retrieval, rows, sampling
from .plans import lower, normalise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_sum(c: str):
    """A sum of decimals: the same in whatever order rows come."""
    return F.sum(F.col(c).cast("decimal(18,6)")).cast("double")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of suppliers from lineitem."""
    order = ["l_orderkey", "l_linenumber", "l_partkey"]
    return panels.daily_bars(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_shipdate").cast("date"), "l_extendedprice", "l_quantity", order)


BARS = """bars AS (
  SELECT l_suppkey::VARCHAR AS symbol_key, l_shipdate::DATE AS date,
    first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey) AS open, max(l_extendedprice) AS high,
    min(l_extendedprice) AS low, last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_partkey) AS close,
    sum(l_quantity) AS volume
  FROM lineitem GROUP BY ALL)"""


def LONG(start: str, end: str, keys: str, first: str | None = None, last: str | None = None) -> str:
    first = first or f"min(date) FILTER (date >= DATE '{start}')"
    last = last or f"max(date) FILTER (date <= DATE '{end}')"
    return f"""{BARS},
    near AS (SELECT * FROM bars WHERE symbol_key IN ({keys})
      AND date BETWEEN DATE '{start}' - 10 AND DATE '{end}' + 10),
    bounds AS (SELECT symbol_key, {first} AS actual_start, {last} AS actual_end FROM near GROUP BY 1),
    held AS (SELECT near.*, actual_start, actual_end,
      last_value(close IGNORE NULLS) OVER (PARTITION BY near.symbol_key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pre_close
      FROM near JOIN bounds USING (symbol_key) WHERE actual_start IS NOT NULL AND actual_end IS NOT NULL),
    panel AS (SELECT *, CASE WHEN pre_close <> 0 THEN (close / pre_close - 1) * 100 END AS pct_chg
      FROM held WHERE date BETWEEN actual_start AND actual_end)"""


def run_plan(spark: SparkSession, sf_dir: str, plan: dict) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    orders = table(spark, sf_dir, "orders")
    basic = orders.groupBy(F.col("o_custkey").cast("string").alias("symbol_key"), day.alias("date")).agg(F.max("o_totalprice").alias("total_mv"), F.count("*").alias("trades"))
    supplier = table(spark, sf_dir, "supplier")
    members = supplier.select(F.col("s_nationkey").cast("string").alias("index_code"), F.col("s_suppkey").cast("string").alias("symbol_key"))
    return lower(normalise(plan), {"bars": bars(spark, sf_dir), "daily_basic": basic, "constituents": members})


KEYS = [str(k) for k in range(1, 9)]
IN_KEYS = ", ".join(f"'{k}'" for k in KEYS)
SPAN = {"start_date": "1996-03-01", "end_date": "1997-06-30"}


@query(
    f"""WITH {LONG("1996-03-01", "1997-06-30", IN_KEYS)}
    SELECT symbol_key, date, close, pre_close, pct_chg FROM panel WHERE pct_chg > 3"""
)
def panel_return_filter(spark, sf_dir):
    """Which suppliers' daily close moved over 3 % in a span, by date?"""
    return run_plan(
        spark, sf_dir,
        {
            "universe": {"type": "symbols", "symbols": KEYS}, "metrics": [{"source": "price_panel", **SPAN}], "limit": 1_000_000,
            "operations": [
                {"op": "filter", "field": "pct_chg", "operator": "gt", "value": 3}, {"op": "sort", "field": "date"},
                {"op": "select_fields", "fields": ["symbol_key", "date", "close", "pre_close", "pct_chg"]},
            ],
        },
    )


@query(
    f"""WITH {LONG("1996-03-01", "1997-06-30", IN_KEYS)}, s AS (
      SELECT symbol_key, arg_min(close, date) AS start_close, arg_max(close, date) AS end_close FROM panel GROUP BY 1),
    r AS (SELECT *, (end_close / start_close - 1) * 100 AS return_pct FROM s)
    SELECT symbol_key, start_close, end_close, return_pct, row_number() OVER (ORDER BY return_pct DESC, symbol_key)::INT AS rank
    FROM r ORDER BY rank LIMIT 3"""
)
def plan_return_rank(spark, sf_dir):
    plan = {"universe": ",".join(KEYS), "metrics": ["returns"], **SPAN, "operations": [{"rank": {"by": "return_pct", "top_k": 3}}]}
    return run_plan(spark, sf_dir, plan).select("symbol_key", "start_close", "end_close", "return_pct", "rank")


@query(SQL["plan_return_rank"])
def plan_from_raw_names(spark, sf_dir):
    """The same from bars as a source has them: its own names, days of eight digits, prices as text with gaps."""
    own = bars(spark, sf_dir)
    text = lambda c, name: F.when(F.col(c) > 0, F.col(c).cast("string")).otherwise("--").alias(name)
    raw = own.select(
        F.col("symbol_key").alias("ts_code"), F.date_format("date", "yyyyMMdd").alias("交易日期"), text("open", "开盘"), text("high", "最高价"), text("low", "最低"), text("close", "收盘价"), text("volume", "成交量")
    )
    plan = {"universe": ",".join(KEYS), "metrics": [{"returns": {}}], **SPAN, "operations": [{"action": "rank", "by": "return_pct", "top_k": 3}]}
    return lower(normalise(plan), {"bars": raw}).select("symbol_key", "start_close", "end_close", "return_pct", "rank")


def single_date(align: str, pick: str) -> None:
    day = "1996-07-06"

    def f(spark, sf_dir):
        plan = {"universe": KEYS, "metrics": [{"source": "ohlcv", "date": day, "align": align}], "limit": 100, "operations": ["close > 0"]}
        return run_plan(spark, sf_dir, plan).select("symbol_key", "date", "close", "trading_day_aligned")

    f.__name__ = f"plan_single_date_{align}"
    query(
        f"""WITH {LONG(day, day, IN_KEYS, pick, pick)}
        SELECT symbol_key, date, close, actual_start <> DATE '{day}' AS trading_day_aligned FROM panel WHERE close > 0"""
    )(f)


single_date("previous", "max(date) FILTER (date <= DATE '1996-07-06')")
single_date("next", "min(date) FILTER (date >= DATE '1996-07-06')")
single_date("exact", "max(date) FILTER (date = DATE '1996-07-06')")

SUMMARY = f"""WITH {LONG("1996-03-01", "1997-06-30", IN_KEYS)}
  SELECT symbol_key, arg_min(close, date) AS start_close, arg_max(close, date) AS end_close,
    (arg_max(close, date) / arg_min(close, date) - 1) * 100 AS return_pct, count(*) AS panel_row_count,
    max(high) AS max_high, first(date ORDER BY high DESC, date) AS max_high_date,
    min(low) AS min_low, first(date ORDER BY low, date) AS min_low_date,
    max(volume) AS max_volume, first(date ORDER BY volume DESC, date) AS max_volume_date,
    sum(volume) AS volume_sum, avg(volume) AS avg_volume, sum(volume) AS metric_value
  FROM panel GROUP BY 1"""


@query(SUMMARY)
def plan_volume_summary(spark, sf_dir):
    return run_plan(spark, sf_dir, {"universe": KEYS, "metrics": {"source": "volume", "shape": "summary"}, **SPAN, "limit": 100})


def extreme_query(kind: str, order: str) -> None:
    def f(spark, sf_dir):
        plan = {"universe": KEYS, "metrics": ["price_panel"], **SPAN, "operations": [{kind: {"field": "pct_chg", "top_k": 5}}]}
        return run_plan(spark, sf_dir, plan).select("symbol_key", "date", "pct_chg", "rank", "selected_by", "selection_op")

    f.__name__ = f"plan_{kind}"
    query(
        f"""WITH {LONG("1996-03-01", "1997-06-30", IN_KEYS)}
        SELECT symbol_key, date, pct_chg, row_number() OVER (ORDER BY pct_chg {order}, symbol_key, date)::INT AS rank,
          'pct_chg' AS selected_by, '{kind}' AS selection_op
        FROM panel WHERE pct_chg IS NOT NULL ORDER BY rank LIMIT 5"""
    )(f)


extreme_query("max_by", "DESC")
extreme_query("min_by", "ASC")


def aggregate_query(function: str, sql: str) -> None:
    def f(spark, sf_dir):
        plan = {"universe": KEYS, "metrics": ["price_panel"], **SPAN, "operations": ["pct_chg > 0", {"op": "aggregate", "function": function, "field": "volume"}]}
        return run_plan(spark, sf_dir, plan)

    f.__name__ = f"plan_aggregate_{function}"
    query(
        f"""WITH {LONG("1996-03-01", "1997-06-30", IN_KEYS)}
        SELECT {sql}::DOUBLE AS value, count(volume) AS non_null_rows, (SELECT count(*) FROM panel) AS input_rows,
          '{function}' AS aggregate_function, 'volume' AS field FROM panel WHERE pct_chg > 0"""
    )(f)


for _f, _sql in (("sum", "coalesce(sum(volume), 0)"), ("mean", "avg(volume)"), ("min", "min(volume)"), ("max", "max(volume)"), ("count", "count(*)")):
    aggregate_query(_f, _sql)


@query(
    f"""WITH {LONG("1996-03-01", "1997-06-30", IN_KEYS)}
    SELECT symbol_key, date, volume, volume / lag(volume) OVER (PARTITION BY symbol_key ORDER BY date) - 1 AS volume_change FROM panel"""
)
def plan_rowwise_change(spark, sf_dir):
    plan = {"universe": KEYS, "metrics": ["price_panel"], **SPAN, "limit": 1_000_000, "operations": [{"compute": {"volume_change": "pct_change(volume)"}}]}
    return run_plan(spark, sf_dir, plan).select("symbol_key", "date", "volume", "volume_change")


@query(
    f"""WITH {LONG("1996-03-01", "1997-06-30", IN_KEYS)}
    SELECT symbol_key, date, (high - low) / open * 100 AS spread FROM panel WHERE date::VARCHAR LIKE '%-12-%'"""
)
def plan_add_column_contains(spark, sf_dir):
    plan = {
        "universe": KEYS, "metrics": ["price_panel"], **SPAN, "limit": 1_000_000,
        "operations": [{"op": "add_column", "as": "spread", "expression": "(high - low) / open * 100"}, {"filter": {"date": {"contains": "-12-"}}}],
    }
    return run_plan(spark, sf_dir, plan).select("symbol_key", "date", "spread")


@query(
    """WITH b AS (SELECT o_custkey::VARCHAR AS symbol_key, o_orderdate::DATE AS date, max(o_totalprice) AS total_mv, count(*) AS trades
      FROM orders GROUP BY ALL),
    m AS (SELECT s_suppkey::VARCHAR AS symbol_key FROM supplier WHERE s_nationkey = 3 GROUP BY 1 ORDER BY 1 LIMIT 120),
    l AS (SELECT * FROM b WHERE date BETWEEN DATE '1995-06-01' AND DATE '1999-12-31'
      QUALIFY row_number() OVER (PARTITION BY symbol_key ORDER BY date DESC) = 1)
    SELECT m.symbol_key, date, total_mv, trades FROM m LEFT JOIN l USING (symbol_key)"""
)
def plan_daily_basic_of_index(spark, sf_dir):
    plan = {"universe": {"type": "index", "index_code": "3"}, "metrics": [{"name": "daily_basic", "from": "1995-06-01", "to": "1999-12-31"}], "limit": 1000}
    return run_plan(spark, sf_dir, plan)


@query(
    """SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (
      SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) ON o_custkey = c_custkey"""
)
def join_left_last_wins(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return rows.left_merge(left, right, ["c_custkey"], "o_orderkey")


@query(
    """SELECT s_nationkey, s_suppkey, c.c_custkey FROM supplier LEFT JOIN (
      SELECT * FROM customer WHERE c_acctbal > 5000 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1) c ON c_nationkey = s_nationkey"""
)
def join_expand_first_wins(spark, sf_dir):
    left = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("s_nationkey"), "c_custkey")
    right = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey")
    return rows.expand_merge(left, right, "s_nationkey", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def join_anti_resume(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_totalprice > 250000")
    return table(spark, sf_dir, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


OPTIONS = """chain AS (SELECT substr(p_brand, 1, 1) || 'R' || (2400 + p_size)::VARCHAR || (CASE WHEN p_partkey % 2 = 0 THEN '-C-' ELSE '-P-' END)
      || (p_partkey % 90 * 10 + 800)::VARCHAR AS contract,
    CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice / 10 END AS settle, p_retailprice / 9 AS close, p_partkey FROM part),
  futures AS (SELECT 'BR' || (2400 + k)::VARCHAR AS symbol, 1000.0::DOUBLE + 10 * k AS settle_price FROM (SELECT unnest(range(1, 41)) AS k))"""


def option_tables(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    contract = F.concat(
        F.substring("p_brand", 1, 1), F.lit("R"), (F.col("p_size") + 2400).cast("string"),
        F.when(F.col("p_partkey") % 2 == 0, "-C-").otherwise("-P-"), (F.col("p_partkey") % 90 * 10 + 800).cast("string"),
    )
    settle = F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice") / 10)
    chain = part.select(contract.alias("contract"), settle.alias("settle"), (F.col("p_retailprice") / 9).alias("close"), "p_partkey")
    futures = spark.range(1, 41).select(F.concat(F.lit("BR"), (F.col("id") + 2400).cast("string")).alias("symbol"), (F.col("id") * 10 + 1000).cast("double").alias("settle_price"))
    return chain, futures


@query(
    f"""WITH {OPTIONS}, parsed AS (SELECT contract, p_partkey, regexp_extract(contract, '^([A-Z]+)([0-9]{{4}})-([CP])-([0-9]+)$', 3) AS kind,
      regexp_extract(contract, '^([A-Z]+)([0-9]{{4}})-([CP])-([0-9]+)$', 4)::DOUBLE AS strike, coalesce(settle, close) AS price,
      regexp_extract(contract, '^([A-Z]+[0-9]{{4}})', 1) AS symbol FROM chain),
    valued AS (SELECT *, CASE WHEN kind = 'C' THEN greatest(settle_price - strike, 0.0) ELSE greatest(strike - settle_price, 0.0) END AS intrinsic
      FROM parsed JOIN futures USING (symbol))
    SELECT contract, symbol, kind, strike, price, settle_price, intrinsic, price - intrinsic AS time_value,
      CASE WHEN kind = 'C' THEN settle_price / strike ELSE strike / settle_price END AS moneyness
    FROM valued ORDER BY time_value DESC, contract, p_partkey LIMIT 20"""
)
def option_chain_metrics(spark, sf_dir):
    out = market.option_metrics(*option_tables(spark, sf_dir), top=20)
    return out.select("contract", "symbol", "kind", "strike", "price", "settle_price", "intrinsic", "time_value", "moneyness")


@query(
    """WITH facts AS (SELECT o_orderpriority AS label, strftime(o_orderdate, '%Y-%m') AS period, CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'shares' END AS unit,
      CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '10-Q' END AS form, o_orderdate AS filed, year(o_orderdate)::INT AS fy, o_totalprice AS val FROM orders),
    best AS (SELECT * FROM facts WHERE form = '10-K' AND unit = 'USD'
      QUALIFY row_number() OVER (PARTITION BY label, period ORDER BY filed DESC, fy DESC, val DESC) = 1)
    SELECT label, period, unit, form, filed, fy, val, row_number() OVER (PARTITION BY label ORDER BY period DESC)::INT AS place
    FROM best QUALIFY row_number() OVER (PARTITION BY label ORDER BY period DESC) <= 4"""
)
def filings_latest_by_period(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    facts = orders.select(
        F.col("o_orderpriority").alias("label"), F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        F.when(F.col("o_orderkey") % 3 == 0, "USD").otherwise("shares").alias("unit"), F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("form"),
        F.col("o_orderdate").alias("filed"), F.year("o_orderdate").alias("fy"), F.col("o_totalprice").alias("val"),
    )
    return market.best_filings(facts, ["10-K"])


@query(
    """WITH s AS (SELECT c_nationkey AS country, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS value
      FROM orders JOIN customer ON o_custkey = c_custkey),
    l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY country ORDER BY seq DESC) = 1)
    SELECT country, value, seq, row_number() OVER (ORDER BY value DESC, country)::INT AS rank FROM l WHERE value IS NOT NULL ORDER BY rank LIMIT 10"""
)
def series_latest_ranked(spark, sf_dir):
    """The latest row of each country counts even if it has no value: such a country is not ranked."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    series = orders.select(F.col("c_nationkey").alias("country"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("value"))
    newest = series.groupBy("country").agg(F.max("seq").alias("seq"))
    return market.latest_ranked(series.join(newest, ["country", "seq"]), "country", "seq", "value")


@query(
    """SELECT w AS n_name, count(n.n_name) AS row_count, CASE WHEN count(n.n_name) > 0 THEN 'ok' ELSE 'empty' END AS status
    FROM (SELECT unnest(['NATION_1', 'NATION_2', 'ATLANTIS']) AS w) LEFT JOIN nation n ON n.n_name = w GROUP BY 1"""
)
def batch_coverage(spark, sf_dir):
    return market.coverage(table(spark, sf_dir, "nation"), "n_name", ["NATION_1", "NATION_2", "ATLANTIS"])


@query(
    """SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE strftime(o_orderdate, '%Y%m%d') BETWEEN '19960101' AND '19961231'
    AND upper(o_orderpriority) LIKE '%URG%' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25"""
)
def action_fetch_tail(spark, sf_dir):
    return market.fetched(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), ["o_orderdate"], "19960101", "19961231", "urg",
        ["o_orderpriority"], ["o_orderdate", "o_orderkey"], 25, tail=True,
    )


@query(
    """WITH s AS (SELECT p_partkey, p_name, p_type, (CASE WHEN contains(lower(p_type), 'steel') THEN 1 ELSE 0 END
        + CASE WHEN contains(lower(p_type), 'small') THEN 1 ELSE 0 END) AS hits, contains(lower(p_type), 'small steel') AS phrase, p_size < 10 AS leaf FROM part),
    t AS (SELECT p_partkey, (CASE WHEN phrase THEN 9.0::DOUBLE ELSE 0 END) + (hits * 7.0::DOUBLE / 2 + CASE WHEN hits = 2 THEN 2.0::DOUBLE ELSE 0 END) AS base, leaf FROM s)
    SELECT p_partkey, CASE WHEN base > 0 THEN base + CASE WHEN leaf THEN 0.5::DOUBLE ELSE 0 END ELSE 0 END AS score FROM t
    ORDER BY score DESC, p_partkey LIMIT 50"""
)
def catalogue_scores(spark, sf_dir):
    score = market.code_score(F.col("p_type"), F.col("p_partkey").cast("string"), F.col("p_size") < 10, "small steel")
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score")).orderBy(F.col("score").desc(), "p_partkey").limit(50)


@query(
    r"""SELECT page_id, regexp_replace(lower(regexp_extract(b, '^[^/]*')), '^www\.', '') || regexp_replace(regexp_extract(b, '/.*$'), '/+$', '') AS address,
      regexp_extract(regexp_replace(lower(regexp_extract(b, '^[^/]*')), '^www\.', ''), '^[^/:]*') AS domain
    FROM (SELECT page_id, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '') AS b FROM pages)"""
)
def text_addresses(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.address(F.col("url")).alias("address"), texts.domain(F.col("url")).alias("domain"))


@query(
    r"""SELECT page_id, len(regexp_extract_all(html, '(?i)<a\s+href="([^"]*)"', 1)) AS n_links,
      array_to_string(regexp_extract_all(html, '(?i)<a\s+href="([^"]*)"', 1), ' ') AS links FROM pages"""
)
def text_links(spark, sf_dir):
    found = texts.links(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).cast("long").alias("n_links"), F.array_join(found, " ").alias("links"))


@query(
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
      '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g') AS h FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a)
    SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
      '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM b"""
)
def text_from_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.plain_text(F.col("html")).alias("plain"))


PAIRS = """pairs AS (SELECT doc_id, item_id, d.text AS answer, b.text AS gold FROM documents d
  JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)"""


def pairs(spark, sf_dir):
    """Documents as answers to benchmark items, one item each."""
    items = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents").withColumn("item_id", F.col("doc_id") % F.lit(items.count()))
    return docs.select("doc_id", "item_id", F.col("text").alias("answer")).join(items.select("item_id", F.col("text").alias("gold")), "item_id")


@query(
    rf"""WITH {PAIRS}, t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(answer), '{texts.TOKEN}')) AS a, list_distinct(regexp_extract_all(lower(gold), '{texts.TOKEN}')) AS g FROM pairs)
    SELECT doc_id, len(list_intersect(a, g))::DOUBLE / len(g) AS recall, len(list_intersect(a, g))::DOUBLE / len(list_distinct(a || g)) AS jaccard FROM t"""
)
def score_token_overlap(spark, sf_dir):
    a, g = texts.tokens(F.col("answer")), texts.tokens(F.col("gold"))
    return pairs(spark, sf_dir).select("doc_id", texts.recall(a, g).alias("recall"), texts.jaccard(a, g).alias("jaccard"))


@query(
    rf"""SELECT doc_id, len(n) AS n_numbers, array_to_string(list_sort(n), ' ') AS numbers FROM (
      SELECT doc_id, list_distinct(regexp_extract_all(text, '{texts.NUMBER}')) AS n FROM documents)"""
)
def text_numbers(spark, sf_dir):
    n = texts.numbers_in(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(n).cast("long").alias("n_numbers"), F.array_join(F.array_sort(n), " ").alias("numbers"))


@query(
    rf"""WITH {PAIRS}, t AS (SELECT doc_id, lower(trim(regexp_replace(answer, '\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(gold, '\s+', ' ', 'g'))) AS g FROM pairs),
    n AS (SELECT *, list_distinct(regexp_extract_all(a, '{texts.NUMBER}')) AS an, list_distinct(regexp_extract_all(g, '{texts.NUMBER}')) AS gn FROM t)
    SELECT doc_id, (a <> '' AND g <> '' AND (a = g OR contains(a, g) OR contains(g, a)))
      OR (CASE WHEN len(gn) > 0 THEN len(list_intersect(an, gn))::DOUBLE / len(gn) ELSE 0 END) >= 0.8 AS correct FROM n"""
)
def score_answers(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", texts.answers_match(F.col("answer"), F.col("gold")).alias("correct"))


LABELS = {"legal": r"license|copyright", "secret": r"token|password|api[_ ]?key", "contact": r"@|phone"}


@query(
    r"""WITH f AS (SELECT doc_id, list_filter([CASE WHEN regexp_matches(lower(text), 'license|copyright') THEN 'legal' END,
      CASE WHEN regexp_matches(lower(text), 'token|password|api[_ ]?key') THEN 'secret' END, CASE WHEN regexp_matches(lower(text), '@|phone') THEN 'contact' END],
      lambda x: x IS NOT NULL) AS l FROM documents)
    SELECT doc_id, l[1] AS label, len(l) > 1 AS ambiguous FROM f"""
)
def text_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.label(F.col("text"), LABELS).alias("l")).select("doc_id", "l.label", "l.ambiguous")


GUESS = """guess AS (SELECT doc_id, lang, source, CASE WHEN contains(text, 'ß') OR contains(text, ' und ') THEN 'de' WHEN contains(text, 'ñ') THEN 'es'
  WHEN contains(text, 'è') OR contains(text, 'ê') THEN 'fr' ELSE 'en' END AS guess FROM documents)"""


def guessed(spark, sf_dir):
    t = F.col("text")
    guess = F.when(t.contains("ß") | t.contains(" und "), "de").when(t.contains("ñ"), "es").when(t.contains("è") | t.contains("ê"), "fr").otherwise("en")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", guess.alias("guess"))


@query(f"WITH {GUESS} SELECT lang, guess, count(*) AS n FROM guess GROUP BY ALL")
def eval_confusion(spark, sf_dir):
    return evals.confusion(guessed(spark, sf_dir), "lang", "guess")


@query(
    f"""WITH {GUESS}, k AS (SELECT DISTINCT lang AS label FROM guess UNION SELECT DISTINCT guess FROM guess),
    s AS (SELECT label, (SELECT count(*) FROM guess WHERE lang = label) AS support, (SELECT count(*) FROM guess WHERE guess = label) AS claimed,
      (SELECT count(*) FROM guess WHERE lang = label AND guess = label) AS hits FROM k),
    p AS (SELECT label, support, CASE WHEN claimed > 0 THEN hits::DOUBLE / claimed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall FROM s)
    SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM p"""
)
def eval_precision_recall(spark, sf_dir):
    return evals.precision_recall(guessed(spark, sf_dir), "lang", "guess")


@query(
    f"""WITH {GUESS}, t AS (SELECT lang AS k, count(*)::DOUBLE AS t FROM guess GROUP BY 1), p AS (SELECT guess AS k, count(*)::DOUBLE AS p FROM guess GROUP BY 1),
    b AS (SELECT coalesce(t, 0) AS t, coalesce(p, 0) AS p FROM t FULL JOIN p USING (k)),
    s AS (SELECT sum(t) AS s, sum(t * p) AS tp, sum(p * p) AS pp, sum(t * t) AS tt FROM b), c AS (SELECT count(*) AS c FROM guess WHERE lang = guess)
    SELECT (c * s - tp) / sqrt((s * s - pp) * (s * s - tt)) AS mcc FROM s, c"""
)
def eval_matthews(spark, sf_dir):
    return evals.matthews(guessed(spark, sf_dir), "lang", "guess")


JUDGED = """judged AS (SELECT d.doc_id, d.lang, d.source, quality = 1 AS correct, (quality * 2 - 1 - toxic)::DOUBLE AS score, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""


def judged(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "lang", "source", (F.col("quality") == 1).alias("correct"), (F.col("quality") * 2 - 1 - F.col("toxic")).cast("double").alias("score"), "quality", "toxic"
    )


@query(
    f"""WITH {JUDGED} SELECT source, count(*) AS total, count(correct) AS judged, count(*) FILTER (correct) AS correct_rows,
    CASE WHEN count(correct) > 0 THEN (count(*) FILTER (correct))::DOUBLE / count(correct) END AS accuracy, avg(score) AS average_score FROM judged GROUP BY 1"""
)
def eval_summary_by_source(spark, sf_dir):
    return evals.summary(judged(spark, sf_dir), "source")


@query(
    f"""WITH {JUDGED} SELECT lang, source, grouping(lang, source)::INT AS grouping, count(*) AS total, (count(*) FILTER (score = 1))::DOUBLE / count(*) AS "right",
    (count(*) FILTER (score = 0))::DOUBLE / count(*) AS missing, (count(*) FILTER (score = -1))::DOUBLE / count(*) AS wrong
    FROM judged GROUP BY GROUPING SETS ((), (lang), (source))"""
)
def eval_protocol(spark, sf_dir):
    return evals.protocol(judged(spark, sf_dir), "score", "lang", "source")


@query(
    f"""WITH {JUDGED} SELECT field, value, count(*) AS n FROM (SELECT 'lang' AS field, lang AS value FROM judged UNION ALL SELECT 'source', source FROM judged
    UNION ALL SELECT 'quality', quality::VARCHAR FROM judged UNION ALL SELECT 'toxic', toxic::VARCHAR FROM judged) WHERE value IS NOT NULL GROUP BY ALL"""
)
def eval_histograms(spark, sf_dir):
    fields = ["lang", "source", "quality", "toxic"]
    long = judged(spark, sf_dir).select(*(F.col(c).cast("string").alias(c) for c in fields)).unpivot([], fields, "field", "value")
    return long.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))


@query(
    """WITH v AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS i, count(*) OVER () AS n FROM documents)
    SELECT max(n) AS n, min(n_chars) AS min, max(n_chars) FILTER (i = greatest(1, floor(n * 0.5))) AS p50, max(n_chars) FILTER (i = greatest(1, floor(n * 0.9))) AS p90,
      max(n_chars) FILTER (i = greatest(1, floor(n * 0.99))) AS p99, max(n_chars) AS max FROM v"""
)
def eval_rank_quantiles(spark, sf_dir):
    return evals.rank_quantiles(table(spark, sf_dir, "documents"), "n_chars", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query(
    """WITH l AS (SELECT l_linenumber AS id, 'l_quantity' AS "column", l_quantity AS value FROM lineitem UNION ALL SELECT l_linenumber, 'l_discount', l_discount FROM lineitem)
    SELECT "column", min(value) AS least, first(id ORDER BY value, id) AS least_at, max(value) AS most, first(id ORDER BY value DESC, id) AS most_at FROM l GROUP BY 1"""
)
def eval_extremes(spark, sf_dir):
    return evals.extremes(table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_discount"), ["l_quantity", "l_discount"], "l_linenumber")


@query(
    """WITH k AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT lang FROM documents)),
    q AS (SELECT lang, 50 // k + CASE WHEN i < 50 % k THEN 1 ELSE 0 END AS quota FROM k),
    r AS (SELECT doc_id, d.lang, quota, md5('seed|' || doc_id) AS h, row_number() OVER (PARTITION BY d.lang ORDER BY md5('seed|' || doc_id), doc_id) AS r FROM documents d JOIN q USING (lang))
    SELECT doc_id, lang FROM r ORDER BY (r > quota), h, doc_id LIMIT 50"""
)
def sample_stratified(spark, sf_dir):
    return sampling.stratified(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 50, "seed", "doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('r|' || doc_id), doc_id LIMIT 30")
def sample_reservoir(spark, sf_dir):
    return sampling.reservoir(table(spark, sf_dir, "documents").select("doc_id"), 30, "r", "doc_id")


@query(
    """WITH g AS (SELECT DISTINCT conv_id FROM conversations), n AS (SELECT count(*) AS n FROM g),
    r AS (SELECT conv_id, row_number() OVER (ORDER BY md5('s|' || conv_id), conv_id) AS i FROM g)
    SELECT c.conv_id, c.turn, r.i <= least(greatest(1, round(n * 0.1)), n - 1) AS is_eval FROM conversations c JOIN r USING (conv_id), n"""
)
def split_by_episode(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "conversations"), "conv_id", 0.1, "s").select("conv_id", "turn", "is_eval")


MIX = """w AS (SELECT * FROM (VALUES ('en', 0.65::DOUBLE), ('fr', 0.25::DOUBLE), ('de', 0.10::DOUBLE)) t(lang, weight)),
  e AS (SELECT lang, 777 * weight / (SELECT sum(weight) FROM w) AS x FROM w),
  f AS (SELECT lang, floor(x)::BIGINT AS f, row_number() OVER (ORDER BY x - floor(x) DESC, lang) AS i FROM e),
  shares AS (SELECT lang, (f + CASE WHEN i <= 777 - (SELECT sum(f) FROM f) THEN 1 ELSE 0 END)::BIGINT AS share FROM f)"""


def mix_weights(spark):
    return spark.createDataFrame([("en", 0.65), ("fr", 0.25), ("de", 0.10)], "lang string, weight double")


@query(
    """WITH e AS (SELECT source, 777 * count(*)::DOUBLE / (SELECT count(*) FROM documents) AS x FROM documents GROUP BY 1), f AS (SELECT source, floor(x)::BIGINT AS f, row_number() OVER (ORDER BY x - floor(x) DESC, source) AS i FROM e)
    SELECT source, (f + CASE WHEN i <= 777 - (SELECT sum(f) FROM f) THEN 1 ELSE 0 END)::BIGINT AS share FROM f"""
)
def mixture_allocation(spark, sf_dir):
    weights = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").cast("double").alias("weight"))
    return sampling.allocation(weights, 777, "source", "weight").select("source", "share")


@query(
    f"""WITH {MIX}, n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1),
    r AS (SELECT doc_id, d.lang, share, n, row_number() OVER (PARTITION BY d.lang ORDER BY md5('m|' || doc_id), doc_id) AS r FROM documents d JOIN shares USING (lang) JOIN n USING (lang)),
    t AS (SELECT doc_id, lang, share // n + CASE WHEN r <= share % n THEN 1 ELSE 0 END AS times FROM r)
    SELECT doc_id, lang, unnest(range(1, times + 1))::INT AS copy FROM t WHERE times > 0"""
)
def mixture_rows(spark, sf_dir):
    shares = sampling.allocation(mix_weights(spark), 777, "lang", "weight")
    return sampling.mixture(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", shares, "m")


@query("SELECT doc_id, CASE WHEN n_chars <= 1000 THEN 'short' WHEN n_chars <= 3000 THEN 'middle' ELSE 'long' END AS bucket FROM documents")
def length_buckets(spark, sf_dir):
    return sampling.bucketed(table(spark, sf_dir, "documents"), "n_chars", {"short": 1000, "middle": 3000}, "long").select("doc_id", "bucket")


@query(
    """SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (role <> 'assistant') AS question,
      last(text ORDER BY turn) FILTER (role = 'assistant') AS answer, count(*) AS n_turns FROM conversations GROUP BY 1"""
)
def messages_to_question(spark, sf_dir):
    """A conversation's messages are gathered by conversation: as long as one is."""
    said = F.when(F.col("role") != "assistant", F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t")))
    reply = F.when(F.col("role") == "assistant", F.col("turn"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda s: s["t"]), "\n").alias("question"),
        F.max_by("text", reply).alias("answer"), F.count("*").alias("n_turns"),
    ).withColumn("question", F.when(F.col("question") != "", F.col("question")))


@query(
    """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS step, count(*) OVER (PARTITION BY conv_id) AS n_steps FROM conversations"""
)
def episode_steps(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "role", F.row_number().over(w.orderBy("turn")).alias("step"), F.count("*").over(w).alias("n_steps"))


@query(
    """SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty'
      WHEN n_chars < 100 THEN 'too_short' WHEN n_chars > 8000 THEN 'too_long' END AS reason FROM documents) GROUP BY 1"""
)
def quarantine_counts(spark, sf_dir):
    reason = F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(F.col("n_chars") < 100, "too_short").when(F.col("n_chars") > 8000, "too_long")
    return table(spark, sf_dir, "documents").select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    """SELECT sha1(concat_ws(chr(31), user_id::VARCHAR, event_type)) AS fingerprint, min(event_id) AS first_seen, max(event_id) AS last_seen, count(*) AS times FROM events GROUP BY 1"""
)
def ledger_deduplicated(spark, sf_dir):
    return ledger.deduplicated(table(spark, sf_dir, "events"), ledger.fingerprint(F.col("user_id"), F.col("event_type")), "event_id")


@query(
    """SELECT user_id, last(event_type ORDER BY ts, event_id) AS event_type, last(value ORDER BY ts, event_id) FILTER (value IS NOT NULL) AS value,
      last(props ORDER BY ts, event_id) FILTER (trim(props) <> '') AS props FROM events GROUP BY 1"""
)
def ledger_upserted(spark, sf_dir):
    return ledger.upserted(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value", "props"])


@query(
    """WITH g AS (SELECT event_id, user_id, ts, event_type = 'purchase' AS gain FROM events),
    i AS (SELECT *, sum(gain::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
    SELECT event_id, sum((NOT gain)::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::INT AS no_gain_run FROM i"""
)
def ledger_no_gain_runs(spark, sf_dir):
    return ledger.runs_without_gain(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("event_id", "no_gain_run")


@query("SELECT user_id, props, count(*) AS n, max(event_id) AS last_step FROM events GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, last_step DESC, user_id, props LIMIT 12")
def ledger_repeated_calls(spark, sf_dir):
    return ledger.repeated_calls(table(spark, sf_dir, "events"), ["user_id", "props"], "event_id")


@query(
    """SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 12000"""
)
def ledger_within_budget(spark, sf_dir):
    return ledger.within_budget(table(spark, sf_dir, "documents"), "source", ["doc_id"], "n_chars", 12_000).select("source", "doc_id", "used")


@query()
def ledger_best_fit(spark, sf_dir):
    return ledger.best_fit(table(spark, sf_dir, "documents"), "source", ["doc_id"], "n_chars", 12_000, "doc_id")


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def store_keep_latest(spark, sf_dir):
    return ledger.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"])


@query(
    """WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
    SELECT event_id, CASE WHEN n = 0 THEN user_id::VARCHAR ELSE printf('%s__dup%02d_', user_id::VARCHAR, n) END AS unique_id FROM n"""
)
def ids_named_apart(spark, sf_dir):
    return ledger.named_apart(table(spark, sf_dir, "events"), "user_id", ["event_id"]).select("event_id", "unique_id")


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS month_start, strftime(last_day(o_orderdate), '%Y%m%d') AS month_end,
      strftime(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH), '%Y%m%d') AS quarter_end, strftime(o_orderdate, '%Y') || '1231' AS year_end FROM orders"""
)
def date_keys(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.date_key(d.cast("string")).alias("day"), dates.date_key(dates.month_code(d)).alias("month_start"), dates.date_key(dates.month_code(d), True).alias("month_end"),
        dates.date_key(dates.quarter_code(d), True).alias("quarter_end"), dates.date_key(F.year(d), True).alias("year_end"),
    )


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem),
    s AS (SELECT *, greatest(0.0::DOUBLE, least(x + 10, z + 12) - greatest(x, z)) * greatest(0.0::DOUBLE, least(y + 8, 9.0::DOUBLE) - greatest(y, 1.0::DOUBLE)) AS i FROM b)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN 80 + 96 - i > 0 THEN i / (80 + 96 - i) ELSE 0 END AS iou FROM s"""
)
def box_overlap(spark, sf_dir):
    x, y, z = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    iou = numbers.overlap_of_boxes([x + 10, y + 8, x, y], [z, F.lit(1.0), z + 12, F.lit(9.0)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", iou.alias("iou"))


@query(
    """SELECT o_orderkey, power(o_totalprice / 1000, 1 / 3.0::DOUBLE) - 1 AS growth, sqrt(o_totalprice) + abs(-(o_totalprice % 7)) AS mixed FROM orders"""
)
def calculator(spark, sf_dir):
    price = {"price": F.col("o_totalprice")}
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.formula("cagr(1000, price, 3)", price).alias("growth"), numbers.formula("sqrt(price) + abs(-(price % 7))", price).alias("mixed"))


@query(
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)"""
)
def set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return count("union", a.union(b).distinct()).union(count("intersect", a.intersect(b))).union(count("except", a.subtract(b)))


@query(
    """SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE left(text, 60) || ' … ' || right(text, 60) END AS shown,
      sha1(array_to_string(list_sort(list_distinct(string_split(lower(text), ' '))), ' ')) AS signature FROM documents"""
)
def text_shown_and_signed(spark, sf_dir):
    words = F.split(F.lower("text"), " ")
    return table(spark, sf_dir, "documents").select("doc_id", texts.head_and_tail(F.col("text"), 120).alias("shown"), texts.signature(words).alias("signature"))


@query(
    rf"""SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE left(text, 60) || ' … ' || right(text, 60) END AS shown,
      sha1(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '{texts.TOKEN}'))), ' ')) AS signature FROM documents"""
)
def text_shown_and_signed_whole(spark, sf_dir):
    """text_shown_and_signed with the words of the whole text in the signature."""
    return table(spark, sf_dir, "documents").select("doc_id", texts.head_and_tail(F.col("text"), 120).alias("shown"), texts.signature(texts.tokens(F.col("text"))).alias("signature"))


@query("SELECT json_extract(props, '$.k')::BIGINT AS k, count(*) AS n, sum(value::DECIMAL(18, 6))::DOUBLE AS total FROM events GROUP BY 1")
def json_path_histogram(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), exact_sum("value").alias("total"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark, sf_dir):
    """An extension: the reference has no windows of time."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


CODES = """codes AS (SELECT o_orderkey, lpad((o_custkey * 7919 % 1000000)::VARCHAR, 6, '0') AS code FROM orders)"""


@query(
    rf"""WITH {CODES} SELECT o_orderkey, CASE WHEN regexp_matches(code, '^[69]') THEN code || '.SH' WHEN regexp_matches(code, '^[023]') THEN code || '.SZ'
      WHEN regexp_matches(code, '^[48]') THEN code || '.BJ' ELSE code END AS equity,
    CASE WHEN regexp_matches(code, '^(399|159|16)') THEN code || '.SZ' WHEN regexp_matches(code, '^(000|50|51|88|93)') THEN code || '.SH'
      WHEN regexp_matches(code, '^[69]') THEN code || '.SH' WHEN regexp_matches(code, '^[023]') THEN code || '.SZ' WHEN regexp_matches(code, '^[48]') THEN code || '.BJ' ELSE code END AS "index",
    CASE WHEN regexp_matches(code, '^[56]') THEN code || '.SH' WHEN regexp_matches(code, '^[0-3]') THEN code || '.SZ' ELSE code END AS fund FROM codes"""
)
def symbol_suffixes(spark, sf_dir):
    code = F.lpad((F.col("o_custkey") * 7919 % 1000000).cast("string"), 6, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", symbols.equity(code).alias("equity"), symbols.index(code).alias("index"), symbols.fund(code).alias("fund"))


TERMS = rf"""WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{texts.TOKEN}'), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'der', 'die')) AS ws FROM documents)),
    f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM f),
    t AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS terms FROM r WHERE place <= 80 GROUP BY 1)
    SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(terms, '') END AS terms FROM documents LEFT JOIN t USING (doc_id)"""


@query(TERMS)
def text_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(retrieval.terms(F.col("text"), ["the", "and", "der", "die"]), " ").alias("terms"))


@query(TERMS)
def text_terms_whole(spark, sf_dir):
    """The same rows as text_terms, which once had a limit of length."""
    return text_terms(spark, sf_dir)


@query(
    """WITH t AS (SELECT * FROM (VALUES ('license', 0, 1), ('that', 1, 1), ('nicht', 2, 1)) v(term, i, w)),
    r AS (SELECT doc_id, text, term, i, w, instr(lower(text), term) AS pos FROM documents, t WHERE contains(lower(text), term))
    SELECT doc_id, term, greatest(1, pos - 40) AS start, substr(text, greatest(1, pos - 40), 80) AS "window" FROM r
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, i) = 1"""
)
def text_best_window(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.best_window(docs, "doc_id", "text", ["license", "that", "nicht"], 80)


@query(
    """SELECT p_partkey, (0.3::DOUBLE * a + 0.25::DOUBLE * coalesce(b, 0) + 0.45::DOUBLE * c) / (0.75::DOUBLE + CASE WHEN b IS NULL THEN 0 ELSE 0.25::DOUBLE END) AS score FROM (
      SELECT p_partkey, p_size / 50.0::DOUBLE AS a, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice / 2000 END AS b, (p_partkey % 10) / 10.0::DOUBLE AS c FROM part)"""
)
def score_components(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size") / 50.0).alias("a"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice") / 2000).alias("b"), ((F.col("p_partkey") % 10) / 10.0).alias("c")
    )
    return part.select("p_partkey", retrieval.weighted_mean({"a": 0.3, "b": 0.25, "c": 0.45}).alias("score"))


@query(
    """WITH s AS (SELECT o_custkey AS k, o_orderpriority AS source, count(*) AS n, list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority) AS place FROM orders GROUP BY ALL)
    SELECT k, source, n FROM s WHERE place > 0 QUALIFY place = min(place) OVER (PARTITION BY k)"""
)
def provider_fallback(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("n"))
    return retrieval.best_source(counts, "k", "source", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query(
    """SELECT user_id, count(*) AS steps, sum(value::DECIMAL(18, 6))::DOUBLE AS total, sum(value::DECIMAL(18, 6))::DOUBLE / count(*) AS mean, count(DISTINCT event_type) AS tools,
      array_to_string(list_sort(list(DISTINCT event_type)), ' ') AS tool_names FROM events GROUP BY 1"""
)
def episode_summary(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("steps"), exact_sum("value").alias("total"), (exact_sum("value") / F.count("*")).alias("mean"), F.countDistinct("event_type").alias("tools"),
        F.array_join(F.array_sort(F.collect_set("event_type")), " ").alias("tool_names"),
    )


@query("SELECT n_regionkey, n_nationkey, grouping(n_regionkey, n_nationkey) AS g, count(*) AS n, sum(c_acctbal::DECIMAL(18, 6))::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup_by_region(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.rollup("n_regionkey", "n_nationkey").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), exact_sum("c_acctbal").alias("balance"))


@query(
    """WITH a AS (SELECT doc_id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, n_chars / 3000.0::DOUBLE)) AS answer, (doc_id % 10) / 10.0::DOUBLE AS trajectory FROM documents)
    SELECT doc_id, 0.65::DOUBLE * answer + 0.35::DOUBLE * trajectory AS overall, answer >= 0.8 AND trajectory >= 0.7 AS passed FROM a"""
)
def score_blend(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", numbers.clamped(F.col("n_chars") / 3000.0).alias("a"), ((F.col("doc_id") % 10) / 10.0).alias("t"))
    return docs.select("doc_id", (0.65 * F.col("a") + 0.35 * F.col("t")).alias("overall"), ((F.col("a") >= 0.8) & (F.col("t") >= 0.7)).alias("passed"))


@query(
    """SELECT l_shipmonth, l_returnflag, sum(l_quantity) AS qty FROM (SELECT strftime(l_shipdate, '%Y%m') AS l_shipmonth, l_returnflag, l_quantity FROM lineitem) GROUP BY ALL"""
)
def series_by_month(spark, sf_dir):
    month = dates.month_code(F.col("l_shipdate")).alias("l_shipmonth")
    return table(spark, sf_dir, "lineitem").groupBy(month, "l_returnflag").agg(F.sum("l_quantity").alias("qty"))


@query()
def query_clusters(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("words", retrieval.query_terms(F.col("text")))
    turns = turns.withColumn("anchors", retrieval.query_anchors(F.col("text"), F.col("words")))
    return retrieval.clusters(turns, "conv_id", "turn", "words", anchors="anchors")


@query()
def query_clusters_fused(spark, sf_dir):
    """Event types as the words of their users' queries: clusters that two queries running told nothing new."""
    k = F.get_json_object("props", "$.k").cast("int")
    words = F.array(F.concat(F.lit("topic"), k % 5), F.concat(F.lit("kind"), k % 2), "event_type", F.lit("shared"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", words.alias("words"))
    return retrieval.fused(retrieval.clusters(rows, "user_id", "event_id", "words", alike=0.6))


@query(
    """SELECT c_custkey, n_name, contains(regexp_replace(lower(n_name), '[^0-9a-z]', '', 'g'), regexp_replace(lower(c_mktsegment), '[^0-9a-z]', '', 'g'))
      OR contains(regexp_replace(lower(c_mktsegment), '[^0-9a-z]', '', 'g'), regexp_replace(lower(n_name), '[^0-9a-z]', '', 'g')) AS alike
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def fuzzy_dimension(spark, sf_dir):
    both = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.select("c_custkey", "n_name", retrieval.either_contains(F.col("n_name"), F.col("c_mktsegment")).alias("alike"))


from . import action_queries, call_queries, nested_queries, provider_queries, rule_queries, source_queries  # noqa: E402, F401  (register more queries)
