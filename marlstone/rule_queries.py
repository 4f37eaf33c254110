"""Registered queries of rules over rows and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import texts
from .operators import ledger, rules
from .queries import query, table

FIELDS = {
    "ring": {"label": "small ring", "aliases": ["ring economy"]}, "widget": {"label": "red widget", "aliases": ["gadget"]},
    "size": {"label": "standard", "aliases": ["economy", "promo"]},
}


@query(
    """WITH r AS (SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_type), '[^0-9a-z一-鿿]+', '', 'g') AS q FROM part),
    s AS (SELECT p_partkey, 'ring' AS field, CASE WHEN q IN ('smallring', 'ringeconomy') THEN 12.0 WHEN contains(q, 'ring') THEN 10.0 WHEN contains(q, 'smallring') THEN 9.0 WHEN contains(q, 'ringeconomy') THEN 8.0 ELSE 0.0 END::DOUBLE AS score FROM r
      UNION ALL SELECT p_partkey, 'widget', CASE WHEN q IN ('redwidget', 'gadget') THEN 12.0 WHEN contains(q, 'widget') THEN 10.0 WHEN contains(q, 'redwidget') THEN 9.0 WHEN contains(q, 'gadget') THEN 8.0 ELSE 0.0 END::DOUBLE FROM r
      UNION ALL SELECT p_partkey, 'size', CASE WHEN q IN ('standard', 'economy', 'promo') THEN 12.0 WHEN contains(q, 'size') THEN 10.0 WHEN contains(q, 'standard') THEN 9.0 WHEN contains(q, 'economy') OR contains(q, 'promo') THEN 8.0 ELSE 0.0 END::DOUBLE FROM r)
    SELECT p_partkey, field, score FROM s WHERE score > 0 QUALIFY score >= max(score) OVER (PARTITION BY p_partkey) - 0.5"""
)
def fields_requested(spark, sf_dir):
    request = F.concat_ws(" ", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(rules.field_candidates(request, FIELDS)))


@query(
    """SELECT p_partkey, contains(lower(p_name || ' ' || p_type), 'blue ring promo') OR
      (contains(lower(p_name || ' ' || p_type), 'blue')::INT + contains(lower(p_name || ' ' || p_type), 'ring')::INT + contains(lower(p_name || ' ' || p_type), 'promo')::INT) >= 3 AS matches FROM part"""
)
def catalogue_matches(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rules.catalogue_match(F.concat_ws(" ", "p_name", "p_type"), "Blue ring, promo").alias("matches"))


@query(
    """WITH t AS (SELECT conv_id, turn, lower(text) AS x FROM conversations)
    SELECT conv_id, turn, regexp_matches(x, '(^|[^0-9a-z])(and|nicht)($|[^0-9a-z])') AS words, contains(x, 'of the') AS phrase FROM t"""
)
def turns_mentioning(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.mentions(text, ["and", "nicht"]).alias("words"), rules.mentions(text, ["of the"]).alias("phrase"))


ACTIONS = {
    "small_ring": {"terms": ["small", "red"], "about": "ring of any size"}, "widget": {"terms": ["wid", "blue"], "about": "large widget promo"},
    "economy": {"terms": ["eco"], "about": "standard economy ring"},
}


@query(
    r"""WITH r AS (SELECT p_partkey, trim(regexp_replace(replace(lower(p_name || ' ' || p_type), '-', '_'), '\s+', ' ', 'g')) AS q FROM part),
    w AS (SELECT p_partkey, q, list_distinct(regexp_extract_all(q, '[a-z0-9_./]{2,}')) AS ws FROM r),
    s AS (SELECT p_partkey, 'small_ring' AS action, 12 * regexp_matches(q, '(^|[^0-9a-z_])small_ring($|[^0-9a-z_])')::INT + 8 * contains(q, 'small ring')::INT + 5 * contains(q, 'small')::INT + 3 * contains(q, 'red')::INT
        + least(6, len(list_intersect(ws, ['small', 'ring', 'of', 'any', 'size']))) AS score FROM w
      UNION ALL SELECT p_partkey, 'widget', 12 * regexp_matches(q, '(^|[^0-9a-z_])widget($|[^0-9a-z_])')::INT + 3 * contains(q, 'wid')::INT + 5 * contains(q, 'blue')::INT + least(6, len(list_intersect(ws, ['widget', 'large', 'promo']))) FROM w
      UNION ALL SELECT p_partkey, 'economy', 12 * regexp_matches(q, '(^|[^0-9a-z_])economy($|[^0-9a-z_])')::INT + 3 * contains(q, 'eco')::INT + least(6, len(list_intersect(ws, ['economy', 'standard', 'ring']))) FROM w)
    SELECT p_partkey, action, score::INT AS score FROM s WHERE score >= 3 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, action) <= 2"""
)
def actions_retrieved(spark, sf_dir):
    found = rules.best_actions(F.concat_ws(" ", "p_name", "p_type"), ACTIONS, most=2)
    return table(spark, sf_dir, "part").select("p_partkey", F.inline(found))


@query(
    """WITH s AS (SELECT p_brand, p_name, p_partkey, p_size / 4.0::DOUBLE AS score FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY score DESC, p_partkey) AS n FROM s),
    t AS (SELECT p_brand, p_name, max(CASE WHEN n = 1 THEN p_partkey END) AS best, max(CASE WHEN n = 1 THEN score END) AS s1, max(CASE WHEN n = 2 THEN score END) AS s2 FROM r WHERE n <= 2 GROUP BY ALL)
    SELECT p_brand, p_name, best, s1 >= 8 AND (s1 - coalesce(s2, 0) >= 1.5 OR coalesce(s2, 0) < 6) AS clear FROM t"""
)
def choice_is_clear(spark, sf_dir):
    scored = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey", (F.col("p_size") / 4.0).alias("score"))
    place = F.row_number().over(Window.partitionBy("p_brand", "p_name").orderBy(F.col("score").desc(), "p_partkey"))
    at = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    two = scored.withColumn("n", place).where("n <= 2").groupBy("p_brand", "p_name").agg(at("p_partkey", 1).alias("best"), at("score", 1).alias("s1"), at("score", 2).alias("s2"))
    return two.select("p_brand", "p_name", "best", rules.clear_choice(F.col("s1"), F.col("s2")).alias("clear"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'So: **Answer: ' || text ELSE text END AS x FROM conversations),
    l AS (SELECT conv_id, turn, regexp_extract(regexp_replace(regexp_replace(trim(x), '(?is)^.*?answer\s*[:：]\s*', ''), '^[\s*_#-]+', ''), '^[^\n]*') AS line FROM t)
    SELECT conv_id, turn, regexp_replace(regexp_extract(line, '^(.*?)(?:\s+[-–—]{1,2}\s+|\s+\(|[.;]\s+|$)', 1), '^[\s*:：`"'']+|[\s*:：`"'']+$', '', 'g') AS atom FROM l"""
)
def answer_atoms(spark, sf_dir):
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("So: **Answer: "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.answer_atom(said).alias("atom"))


@query(
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS ref, CASE l_linenumber % 3 WHEN 0 THEN l_partkey::VARCHAR || '.' || l_suppkey::VARCHAR WHEN 1 THEN l_partkey::VARCHAR || '00' ELSE l_partkey::VARCHAR || '00000000' END AS said,
      l_returnflag <> 'A' AS asks FROM lineitem), d AS (SELECT *, CASE WHEN length(ref) >= 3 THEN ref ELSE '' END AS r,
      CASE WHEN length(split_part(said, '.', 1)) BETWEEN 3 AND 10 THEN replace(said, '.', '') WHEN length(split_part(said, '.', 2)) BETWEEN 3 AND 10 THEN split_part(said, '.', 2) ELSE '' END AS p FROM c)
    SELECT l_orderkey, l_linenumber, asks AND length(r) >= 3 AND length(p) > length(r) AND starts_with(p, r) AS extends FROM d"""
)
def codes_extended(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    kind, flag = F.col("l_linenumber") % 3, F.col("l_returnflag")
    said = F.when(kind == 0, F.concat_ws(".", part, supp)).when(kind == 1, F.concat(part, F.lit("00"))).otherwise(F.concat(part, F.lit("00000000")))
    asked = F.when(flag == "R", "Which HS code prefix?").when(flag == "N", "Which tariff?\n\nDataset Output Constraint: the exact code only").otherwise("Which six-digit tariff?")
    return lines.select("l_orderkey", "l_linenumber", rules.code_extends(asked, part, said).alias("extends"))


@query(
    """SELECT o_orderkey, o_orderpriority NOT LIKE '%NOT%' AND o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 AS named
    FROM orders"""
)
def acronyms_named(spark, sf_dir):
    """References are capitals where the priority has no NOT; answers name them, not so for thirds, or rule them out for fifths."""
    reference = F.when(F.col("o_orderpriority").contains("NOT"), "Low Volume").otherwise("L.V-2")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.lit("an L.V-20 entry")).when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("anything except "), reference)).otherwise(F.concat(F.lit("the "), F.lower(reference), F.lit(", as before")))
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.names_acronym(reference, said).alias("named"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, ['ZS', 'BZ', 'GC', 'XX'][1 + l_partkey % 4] AS root, month(l_shipdate) AS m, year(l_shipdate) AS y FROM lineitem)
    SELECT l_orderkey, l_linenumber, root || substr('FGHJKMNQUVXZ', m, 1) || lpad((y % 100)::VARCHAR, 2, '0') || CASE root WHEN 'ZS' THEN '.CBT' WHEN 'BZ' THEN '.NYM' WHEN 'GC' THEN '.CMX' ELSE '' END AS symbol FROM r"""
)
def futures_symbols(spark, sf_dir):
    root = F.get(F.array(*map(F.lit, ("zs", "BZ", "gc", "xx"))), (F.col("l_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rules.futures_symbol(root, F.month("l_shipdate"), F.year("l_shipdate")).alias("symbol"))


@query(
    """SELECT 'C' || o_custkey AS symbol_key, strftime(o_orderdate, '%Y-%m-%d') AS date, NULL::DOUBLE AS open, NULL::DOUBLE AS high, o_totalprice / 2 AS low,
      CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE o_totalprice / 4 END AS close, o_orderkey::DOUBLE AS volume, NULL::DOUBLE AS amount FROM orders WHERE o_orderkey % 7 > 0"""
)
def bars_canonical(spark, sf_dir):
    day, key, price = F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_totalprice")
    raw = table(spark, sf_dir, "orders").select(
        F.when(key % 2 == 0, F.concat(F.lit("C"), "o_custkey")).otherwise(" ").alias("ts_code"), F.concat(F.lit("C"), "o_custkey").alias("symbol"),
        F.when(key % 7 == 0, "").when(key % 2 == 0, F.date_format(day, "yyyyMMdd")).otherwise(F.date_format(day, "yyyy-MM-dd HH:mm")).alias("日期"),
        F.when(key % 3 == 0, price.cast("string")).otherwise("--").alias("close"), (price / 4).alias("收盘"), (price / 2).alias("最低价"), key.cast("string").alias("vol"),
    )
    return rules.canonical_bars(raw, ["date", "trade_date", "日期"])


@query(
    """WITH p AS (SELECT o_custkey, max((o_orderstatus = 'F' AND o_totalprice IS NOT NULL)::INT) AS a, max((o_orderkey % 5 = 0)::INT) AS b FROM orders GROUP BY 1),
    e AS (SELECT coalesce(a, 0) + coalesce(b, 0) AS n FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN p ON c_custkey = o_custkey),
    s AS (SELECT count(*) AS entities, sum(n)::BIGINT AS filled_slots FROM e)
    SELECT entities, filled_slots, entities * 2 - filled_slots AS missing_slots, filled_slots::DOUBLE / (entities * 2) AS coverage,
      CASE WHEN filled_slots = 0 THEN 'empty' WHEN filled_slots = entities * 2 THEN 'complete' ELSE 'partial' END AS status, filled_slots = entities * 2 AS can_answer_now FROM s"""
)
def execution_card(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    panel = orders.select(F.col("o_custkey").alias("key"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 5 == 0, 1).alias("fifth"))
    return rules.card(panel, "key", table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), ["price", "fifth"])


@query("SELECT min(strftime(l_shipdate, '%Y-%m-%d')) || '..' || max(strftime(l_shipdate, '%Y-%m-%d')) AS date_range FROM lineitem")
def result_date_range(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.lit(None).cast("string").alias("date"), F.lit(" ").alias("trade_date"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("end_date"), F.col("l_orderkey").alias("year"))
    return rules.date_range(lines, ["date", "observation_date", "trade_date", "end_date", "year"])


@query(
    """WITH e AS (SELECT user_id * 10 + event_id % 10 AS task_index, event_id % 3 AS shard, event_id, value FROM events)
    SELECT task_index, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY task_index ORDER BY shard DESC, event_id DESC) = 1"""
)
def shards_merged(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("task_index"), "event_id", "value")
    return rules.merged_shards([rows.where(F.col("event_id") % 3 == i) for i in range(3)], "task_index")


@query(
    """WITH k AS (SELECT o_orderkey, 'ev' || o_orderkey AS name, 0 AS kind FROM orders UNION ALL SELECT o_orderkey, 'call' || o_custkey, 1 FROM orders UNION ALL SELECT o_orderkey, 'step:' || (o_orderkey % 100), 2 FROM orders),
    r AS (SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN 'ev' || (l_orderkey * 2) WHEN 1 THEN 'call' || l_partkey ELSE 'step:' || l_suppkey END AS ref FROM lineitem)
    SELECT ref, o_orderkey, kind FROM r LEFT JOIN k ON ref = name QUALIFY row_number() OVER (PARTITION BY ref ORDER BY kind, o_orderkey) = 1"""
)
def evidence_resolved(spark, sf_dir):
    number = F.col("l_linenumber") % 3
    ref = F.when(number == 0, F.concat(F.lit("ev"), F.col("l_orderkey") * 2)).when(number == 1, F.concat(F.lit("call"), "l_partkey")).otherwise(F.concat(F.lit("step:"), "l_suppkey"))
    names = [F.concat(F.lit("ev"), "o_orderkey"), F.concat(F.lit("call"), "o_custkey"), F.concat(F.lit("step:"), F.col("o_orderkey") % 100)]
    return rules.resolved(table(spark, sf_dir, "lineitem").select(ref.alias("ref")), "ref", table(spark, sf_dir, "orders"), names, "o_orderkey")


@query(
    """SELECT l_suppkey AS table_id, l_linenumber AS "row", l_returnflag AS col, l_quantity AS x, l_discount AS y, l_linestatus AS text, min(l_orderkey) AS first_at FROM lineitem GROUP BY ALL"""
)
def cells_deduplicated(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.col("l_returnflag").alias("col"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_linestatus").alias("text"), F.col("l_orderkey").alias("first_at")
    )
    return rules.deduplicated_cells(cells, ["table_id", "row", "col", "x", "y", "text"], "first_at")


@query(
    """WITH d AS (SELECT lang || '-' || (doc_id % 300) AS sample_id, coalesce(trim(text), '') = '' OR coalesce(trim(source), '') = '' AS bad FROM documents)
    SELECT count(*) AS row_count, count(*) FILTER (bad) AS bad_rows, count(DISTINCT sample_id) AS unique_ids, count(sample_id) - count(DISTINCT sample_id) AS duplicate_ids FROM d"""
)
def dataset_validated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("sample_id", F.concat("lang", F.lit("-"), F.col("doc_id") % 300))
    return rules.validated(docs, ["text", "source"], "sample_id")


@query(
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'name' END, CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_custkey % 5 = 0 THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS missing FROM customer"""
)
def records_required(spark, sf_dir):
    key = F.col("c_custkey")
    wide = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(key % 2 > 0, F.col("c_name")).alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.when(key % 5 > 0, F.col("c_mktsegment")).otherwise(" ").alias("segment")
    )
    return wide.select("c_custkey", F.array_join(rules.missing_fields(["name", "balance", "segment"]), ",").alias("missing"))


@query(
    r"""WITH l AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '(?i)<a\s+href="([^"]*)"', 1))) AS href FROM pages),
    s AS (SELECT page_id, href, 3.0::DOUBLE * contains(href, 'nicht')::INT + 3.0 * contains(href, 'page')::INT + 8.0 * (contains(href, 'ex-99') OR contains(href, 'ex99') OR contains(href, '99.1'))::INT
      + 5.0 * (contains(href, 'press') OR contains(href, 'release') OR contains(href, 'earnings'))::INT + 1.0 * (href LIKE '%.htm' OR href LIKE '%.html')::INT AS score FROM l)
    SELECT page_id, count(*) AS links, sum(score)::DOUBLE AS total, max(score)::DOUBLE AS best FROM s GROUP BY 1"""
)
def links_scored(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(texts.links(F.col("html"))).alias("href"))
    score = rules.link_score(F.col("href"), ["nicht", "page", "of"])
    return links.select("page_id", score.alias("score")).groupBy("page_id").agg(F.count("*").alias("links"), F.sum("score").alias("total"), F.max("score").alias("best"))


@query(
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s+href="([^"]*)"', 1)) AS raw FROM pages),
    h AS (SELECT page_id, raw || CASE WHEN length(raw) % 3 = 0 THEN '/ex-99.htm' ELSE '' END AS href, CASE WHEN length(raw) % 2 = 0 THEN 'Press release' ELSE 'other' END AS label FROM l),
    s AS (SELECT page_id, href, label, lower(href || ' ' || label) AS x FROM h WHERE trim(href) <> '' AND NOT starts_with(trim(href), '#')),
    p AS (SELECT DISTINCT page_id, href, label, 3.0::DOUBLE * contains(x, 'nicht')::INT + 8.0 * contains(x, 'ex-99')::INT + 5.0 * contains(x, 'press')::INT AS score FROM s WHERE contains(x, 'ex-') OR contains(x, 'press') OR contains(x, '.htm') OR contains(x, '.pdf') OR contains(x, '.txt'))
    SELECT page_id, href, label, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, string_split(href, '/')[-1], href)::INT AS place FROM p QUALIFY place <= 4"""
)
def links_of_exhibits(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(texts.links(F.col("html"))).alias("raw"))
    n = F.length("raw")
    shown = links.select("page_id", F.concat("raw", F.when(n % 3 == 0, "/ex-99.htm").otherwise("")).alias("href"), F.when(n % 2 == 0, "Press release").otherwise("other").alias("label"))
    return rules.links_ranked(shown.distinct(), "page_id", "href", "label", ["nicht"], most=4)


@query(
    r"""WITH e AS (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' Three months ended June 30, ' || 1990 + doc_id % 30 ELSE '' END || ' 1' || 2000 + doc_id % 7 || ' ' || 1900 + doc_id % 150 || ', 2012 and 2011-2012' AS text FROM documents),
    d AS (SELECT doc_id, text, lower(text) AS x FROM e),
    p AS (SELECT doc_id, list_filter([CASE WHEN regexp_extract(x, 'in\s+(thousand|million|billion)', 1) <> '' THEN 'in ' || regexp_extract(x, 'in\s+(thousand|million|billion)', 1) || 's' END,
      CASE WHEN contains(x, 'per share') THEN 'per-share amounts unscaled' END,
      CASE WHEN contains(text, '$') OR regexp_matches(x, '(^|[^0-9a-z_])(usd|us dollars?)($|[^0-9a-z_])') THEN 'USD' WHEN contains(text, '€') OR regexp_matches(x, '(^|[^0-9a-z_])(eur)($|[^0-9a-z_])') THEN 'EUR'
        WHEN contains(text, '£') OR regexp_matches(x, '(^|[^0-9a-z_])(gbp)($|[^0-9a-z_])') THEN 'GBP' WHEN contains(text, '%') THEN 'percent' END], lambda v: v IS NOT NULL) AS parts, regexp_extract(x, '((?:year|quarter|three|six|nine|twelve)[\w ]*?ended[\w ,]*?\d{4})', 1) AS phrase,
      regexp_extract_all(text, '\b((?:19|20)[0-9]{2})\b') AS years FROM d)
    SELECT doc_id, CASE WHEN len(parts) > 0 THEN array_to_string(parts, '; ') END AS unit, array_to_string(list_concat(CASE WHEN phrase <> '' THEN [trim(phrase)] ELSE [] END,
      list_filter(years, lambda y, i: list_position(years, y) = i))[1:8], '; ') AS years FROM p"""
)
def units_and_years(spark, sf_dir):
    n = F.col("doc_id")
    phrase = F.when(n % 2 == 0, F.concat(F.lit(" Three months ended June 30, "), 1990 + n % 30)).otherwise("")
    text = F.concat("text", phrase, F.lit(" 1"), 2000 + n % 7, F.lit(" "), 1900 + n % 150, F.lit(", 2012 and 2011-2012"))
    return table(spark, sf_dir, "documents").select("doc_id", rules.unit_hint(text).alias("unit"), F.array_join(rules.periods_in(text), "; ").alias("years"))


@query("SELECT sha1(user_id::VARCHAR || chr(31) || props) AS fingerprint, count(*) AS failures, min(event_id) AS blocked_from FROM events WHERE event_type = 'error' AND event_id % 3 = 1 GROUP BY 1")
def calls_blocked(spark, sf_dir):
    retry = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 2)
    return rules.fuses(table(spark, sf_dir, "events"), ledger.fingerprint(F.col("user_id"), F.col("props")), F.col("event_type") == "error", retry, "event_id")


@query(
    r"""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS x, len(regexp_extract_all(text, '(?m)^[^\S\n]*\|.*\|[^\S\n]*$')) AS n FROM documents)
    SELECT doc_id, round(0.4::DOUBLE * ((contains(x, 'the')::INT + contains(x, 'license')::INT) / 2) + 0.45::DOUBLE * ((contains(x, 'nicht')::INT + contains(x, 'tion')::INT + contains(x, 'ing')::INT) / 3) + 0.15::DOUBLE * least(1.0::DOUBLE, n / 3), 4) AS score FROM d WHERE x IS NOT NULL
    UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL"""
)
def reports_scored(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rules.report_score(F.col("text"), ["the", "License"], ["nicht", "tion", "ing"]).alias("score"))


@query(
    r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '') AS title FROM pages"""
)
def titles_between(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", rules.between(F.col("html"), "<title>", "</title>").alias("title"))


@query(
    """SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events"""
)
def json_repaired(spark, sf_dir):
    kind, props = F.col("event_id") % 4, F.col("props")
    reply = F.when(kind == 0, props).when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), props, F.lit("\n```\nDone {now}."))).when(kind == 2, F.concat(F.lit("so "), props, F.lit(" then"))).otherwise(F.concat(F.lit("none { "), props))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(rules.lenient_json(reply), "$.k").cast("long").alias("k"))


@query(
    """SELECT o_custkey, o_orderkey, 'o_totalprice' AS field, 'revenue' AS label, o_totalprice / 10000 AS value FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT o_custkey, o_orderkey, 'shares', 'shares issued', (o_custkey + 1)::DOUBLE FROM orders"""
)
def statement_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"), (F.col("o_custkey") + 1).cast("double").alias("shares"))
    return rules.labelled(orders, ["o_custkey", "o_orderkey"], {"o_totalprice": ("revenue", 1e4), "shares": ("shares issued", 1.0)})


@query(
    """SELECT 'L1' AS level, c_name AS name, NULL AS parent, c_acctbal AS weight FROM customer
    UNION ALL SELECT 'L2', s_name, s_nationkey::VARCHAR, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END FROM supplier"""
)
def constituents_of_levels(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(F.lit("L1").alias("level"), F.col("c_name").alias("con_name"), F.col("c_acctbal").alias("权重"))
    second = table(spark, sf_dir, "supplier").select(F.lit("L2").alias("level"), F.col("s_name").alias("名称"), F.col("s_nationkey").alias("parent"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal").cast("string")).otherwise("n/a").alias("weight"))
    return rules.constituents([first, second], {"level": ["level"], "name": ["con_name", "名称"], "parent": ["parent", "parent_code"]}, ["weight", "权重"])


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'eco') OR contains(lower(p_type), 'eco') OR contains(p_partkey::VARCHAR, 'eco')")
def any_column_contains(spark, sf_dir):
    return rules.any_contains(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), "Eco")


@query("SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS price, format('{:,}', o_orderkey) AS key FROM orders")
def numbers_with_commas(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", rules.shown(F.col("o_totalprice"), 2).alias("price"), rules.shown(F.col("o_orderkey"), 0).alias("key"))
