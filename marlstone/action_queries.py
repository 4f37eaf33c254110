"""Registered queries of typed actions, evaluation joins and scalar rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import dates, numbers, texts
from .operators import actions, evals, ranks
from .queries import GUESS, guessed, query, table


@query(
    """WITH b AS (SELECT o_custkey, o_orderdate::DATE AS day, max(o_totalprice) AS high, min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS low FROM orders GROUP BY ALL)
    SELECT o_custkey, day, high, low FROM b QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC) <= 5"""
)
def bars_of_arrays(spark, sf_dir):
    day = F.col("o_orderdate").cast("date").alias("day")
    bars = table(spark, sf_dir, "orders").groupBy("o_custkey", day).agg(F.max("o_totalprice").alias("high"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("low"))
    one = F.array_sort(F.collect_list(F.struct("day", "high", "low")))
    arrays = bars.groupBy("o_custkey").agg(one.alias("b")).select("o_custkey", F.col("b.day").alias("day"), F.col("b.high").alias("high"), F.col("b.low").alias("low"))
    return actions.bars_from_arrays(arrays, "o_custkey", "day", ["high", "low"], 5)


@query(
    """SELECT l_partkey, l_linenumber, last(l_extendedprice ORDER BY l_shipdate, l_extendedprice) AS l_extendedprice, max(l_shipdate)::DATE AS realtime_start, count(*) AS vintages
    FROM lineitem WHERE l_shipdate::DATE <= DATE '1996-06-30' GROUP BY ALL"""
)
def series_as_known_on(spark, sf_dir):
    series = table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return actions.as_known_on(series, ["l_partkey", "l_linenumber"], "l_shipdate", "l_extendedprice", "1996-06-30")


@query("SELECT l_suppkey, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day, count(*) AS row_count FROM lineitem GROUP BY 1")
def catalogue_from_series(spark, sf_dir):
    return actions.spans(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate")


@query(
    """WITH b AS (SELECT o_custkey AS k, o_orderdate::DATE AS day, max(o_totalprice) AS close FROM orders GROUP BY ALL),
    f AS (SELECT o_custkey AS k, o_orderdate::DATE AS day, 1 + max(o_orderkey % 10) / 10.0::DOUBLE AS factor FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL),
    l AS (SELECT k, arg_max(factor, day) AS last FROM f GROUP BY 1)
    SELECT k, day, close, factor, coalesce(close * factor / last, close) AS adj_close FROM b LEFT JOIN f USING (k, day) LEFT JOIN l USING (k)"""
)
def factor_history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("date").alias("day"), "o_totalprice", "o_orderkey", "o_orderstatus")
    bars = orders.groupBy("k", "day").agg(F.max("o_totalprice").alias("close"))
    factors = orders.where("o_orderstatus <> 'P'").groupBy("k", "day").agg((1 + F.max(F.col("o_orderkey") % 10) / 10.0).alias("factor"))
    return actions.adjusted(bars, factors, "k", "day", "close", "factor")


@query(
    """WITH u AS (SELECT DISTINCT o_orderkey AS task, unnest([0, 1, 2]) AS idx FROM orders),
    r AS (SELECT l_orderkey AS task, l_linenumber - 1 AS place, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 6 - 1 END AS named, l_quantity AS score FROM lineitem SEMI JOIN u ON l_orderkey = task),
    c AS (SELECT task, place, score, CASE WHEN named IS NOT NULL AND named BETWEEN 0 AND 2 THEN named WHEN place BETWEEN 0 AND 2 THEN place END AS idx FROM r)
    SELECT task, idx, score FROM u LEFT JOIN (SELECT task, idx, score FROM c WHERE idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task, idx ORDER BY place, score) = 1) USING (task, idx)"""
)
def join_rubric_results(spark, sf_dir):
    """Three rubrics a task; results that name none, one out of range, or one that an earlier result has taken."""
    results = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task"), (F.col("l_linenumber") - 1).cast("int").alias("place"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey") % 6 - 1).cast("int").alias("idx"), F.col("l_quantity").alias("score")
    )
    rubrics = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task")).distinct().select("task", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("idx"))
    return actions.rubric_results(rubrics, results, "task", "idx", "place", "score")


@query(
    """WITH b AS (SELECT l_orderkey AS box, l_linenumber AS n, l_orderkey // 8 AS doc, l_orderkey % 8 // 2 AS page, l_suppkey % 2 AS t, l_quantity AS x, l_discount * 100 AS y, l_partkey % 3 = 0 AS is_wanted FROM lineitem),
    w AS (SELECT box, n, any_value(doc) AS doc, any_value(page) AS page, min(t) AS t, min(x) AS x, min(y) AS y FROM b WHERE is_wanted GROUP BY box, n),
    f AS (SELECT doc, page, t, x, y FROM b WHERE NOT is_wanted),
    p AS (SELECT w.box, w.n, w.doc, f.page = w.page AS on_page, f.t = w.t AS keyed, greatest(0.0::DOUBLE, least(w.x, f.x) + 10 - greatest(w.x, f.x)) * greatest(0.0::DOUBLE, least(w.y, f.y) + 8 - greatest(w.y, f.y)) AS i FROM w JOIN f USING (doc)),
    a AS (SELECT *, bool_or(on_page) OVER (PARTITION BY box, n) AS some_on_page FROM p),
    k AS (SELECT *, bool_or(keyed) OVER (PARTITION BY box, n) AS some_keyed FROM a WHERE on_page OR NOT some_on_page)
    SELECT w.box, w.n, w.doc, coalesce(max(i / (160 - i)), 0) AS score FROM w LEFT JOIN (SELECT * FROM k WHERE keyed OR NOT some_keyed) s ON w.box = s.box AND w.n = s.n GROUP BY ALL"""
)
def box_best_match(spark, sf_dir):
    """Boxes of lines: every third is wanted, the others are found; eight orders are a document, two a page."""
    line = table(spark, sf_dir, "lineitem")
    boxes = line.select(
        F.col("l_orderkey").alias("box"), F.col("l_linenumber").alias("n"), F.floor(F.col("l_orderkey") / 8).alias("doc"), F.floor(F.col("l_orderkey") % 8 / 2).alias("page"),
        (F.col("l_suppkey") % 2).alias("t"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_partkey") % 3 == 0).alias("is_wanted"),
    )
    wanted = boxes.where("is_wanted").groupBy("box", "n", "doc", "page").agg(F.min("t").alias("t"), F.struct(F.min("x").alias("x"), F.min("y").alias("y")).alias("place"))
    found = boxes.where("not is_wanted").select("doc", "page", "t", F.struct("x", "y").alias("place"))

    def iou(a, b):
        shared = F.greatest(F.lit(0.0), F.least(a["x"], b["x"]) + 10 - F.greatest(a["x"], b["x"])) * F.greatest(F.lit(0.0), F.least(a["y"], b["y"]) + 8 - F.greatest(a["y"], b["y"]))
        return shared / (160 - shared)

    return actions.best_boxes(wanted, found, ["box", "n"], "doc", "page", ["t"], "place", iou)


@query(
    f"""WITH {GUESS}, k AS (SELECT DISTINCT lang AS label FROM guess UNION SELECT DISTINCT guess FROM guess),
    s AS (SELECT label, (SELECT count(*) FROM guess WHERE lang = label) AS support, (SELECT count(*) FROM guess WHERE guess = label) AS claimed,
      (SELECT count(*) FROM guess WHERE lang = label AND guess = label) AS hits FROM k),
    p AS (SELECT label, support, CASE WHEN claimed > 0 THEN hits::DOUBLE / claimed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall FROM s)
    SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall,
      round(avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 9) AS macro_f1, sum(support)::BIGINT AS support FROM p"""
)
def eval_macro(spark, sf_dir):
    out = actions.macro(evals.precision_recall(guessed(spark, sf_dir), "lang", "guess"))
    return out.select(*(F.round(c, 9).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1")), "support")


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 50000)::BIGINT AS score, CASE o_orderkey % 5 WHEN 0 THEN 'Superseded' WHEN 1 THEN NULL WHEN 2 THEN 'conflict' ELSE 'supported' END AS status FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey DESC) AS r FROM o),
    s AS (SELECT o_custkey, coalesce(min(r) FILTER (lower(status) IN ('conflict', 'conflicting', 'alternative', 'rejected', 'superseded', 'reopened')), min(r)) AS second FROM r WHERE r > 1 GROUP BY 1)
    SELECT o_custkey, o_orderkey, status, CASE WHEN r = 1 THEN 1 ELSE 2 END AS place FROM r LEFT JOIN s USING (o_custkey) WHERE r = 1 OR r = second"""
)
def evidence_top_two(spark, sf_dir):
    mod = F.col("o_orderkey") % 5
    status = F.when(mod == 0, "Superseded").when(mod == 2, "conflict").when(mod > 2, "supported")
    claims = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 50000).alias("score"), status.alias("status"))
    return actions.top_two(claims, "o_custkey", "score", "o_orderkey", "status").drop("score")


@query(
    """WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_type || ' Jan 1' || p_size || ' ' || p_size) AS x FROM part),
    h AS (SELECT p_partkey, contains(x, 'small')::INT + contains(x, 'january')::INT + contains(x, 'jan')::INT + contains(x, 'economy')::INT + list_contains(string_split(x, ' '), '15')::INT AS n FROM t),
    s AS (SELECT p_partkey, CASE WHEN n >= 2 THEN n ELSE 0 END AS hits FROM h)
    SELECT p_partkey, hits, row_number() OVER (ORDER BY hits DESC, p_partkey)::INT AS place FROM s ORDER BY hits DESC, p_partkey LIMIT 60"""
)
def rows_matches_first(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", F.concat(F.lit("Jan 1"), "p_size"), "p_size").alias("x"))
    return actions.matches_first(rows, F.col("x"), "the small ones of January in ECONOMY, 15", "p_partkey", 60).drop("x")


@query(
    """WITH s AS (SELECT user_id, event_type, max(event_id) AS seen FROM events GROUP BY ALL)
    SELECT user_id, event_type, seen, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC)::INT AS place FROM s QUALIFY place <= 3"""
)
def ordered_set_last(spark, sf_dir):
    return actions.last_distinct(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", 3)


@query(
    """SELECT event_id, coalesce(nullif(trim(json_extract_string(CASE WHEN event_id % 2 = 0 THEN props END, '$.k')), ''), nullif(trim(json_extract_string('{"k":"' || event_type || '"}', '$.k')), '')) AS k FROM events"""
)
def metadata_coalesced(spark, sf_dir):
    first = F.when(F.col("event_id") % 2 == 0, F.col("props"))
    second = F.concat(F.lit('{"k":"'), F.col("event_type"), F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", actions.from_containers([first, second], "$.k").alias("k"))


@query(
    """WITH f AS (SELECT conv_id, min(turn * 1000000000000 + conv_id) AS first FROM conversations GROUP BY 1), p AS (SELECT conv_id, row_number() OVER (ORDER BY first, conv_id)::INT AS episode FROM f)
    SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS speaker, episode FROM conversations JOIN p USING (conv_id)"""
)
def messages_by_role(spark, sf_dir):
    """Episodes are numbered by their first place in the feed, here that of turn and conversation."""
    turns = table(spark, sf_dir, "conversations")
    first = F.min(F.col("turn") * F.lit(10**12) + F.col("conv_id"))
    episodes = ranks.placed(turns.groupBy("conv_id").agg(first.alias("first")), ["first", "conv_id"], "episode")
    spoken = F.initcap(F.when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")))
    return turns.join(episodes, "conv_id").select("conv_id", "turn", actions.role(spoken).alias("speaker"), F.col("episode").cast("int").alias("episode"))


@query(
    """SELECT o_orderkey, floor(o_totalprice)::BIGINT::VARCHAR AS low, ceil(o_totalprice)::BIGINT::VARCHAR AS high, round(o_totalprice::DECIMAL(28, 10), 1)::DECIMAL(28, 1)::VARCHAR AS fixed,
      o_totalprice / 10000 AS wan, CASE WHEN o_orderkey > o_custkey THEN o_custkey::DOUBLE / o_orderkey ELSE o_orderkey::DOUBLE / o_custkey END AS alike FROM orders"""
)
def numbers_shown(spark, sf_dir):
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", actions.rounded(price, "floor").alias("low"), actions.rounded(price, "ceil").alias("high"), actions.rounded(price, "fixed1").alias("fixed"),
        numbers.in_unit(price, "万元").alias("wan"), numbers.count_similarity(F.col("o_orderkey"), F.col("o_custkey")).alias("alike"),
    )


@query(
    r"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %Y%m%d %Y/%m/%d %Y.%m.%d %m/%d/%Y') AS spellings,
      strftime(o_orderdate, 'on %Y-%m-%d or %Y%m%d') AS text, strftime(o_orderdate, '%Y-%m-%d') || ' ' || strftime(o_orderdate, '%Y%m%d') AS found, year(o_orderdate)::INT AS year FROM orders"""
)
def dates_spelled(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    text = F.concat(F.lit("on "), F.date_format(day, "yyyy-MM-dd"), F.lit(" or "), F.date_format(day, "yyyyMMdd"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(dates.spellings(day), " ").alias("spellings"), text.alias("text"), F.array_join(dates.dates_in(text), " ").alias("found"), F.year(day).alias("year")
    )


@query(
    r"""SELECT c_custkey, trim(regexp_replace(replace(c_name, '#', 'No'), '([a-z0-9])([A-Z])', '\1 \2', 'g')) AS human, regexp_replace(regexp_replace(c_name || '/' || c_mktsegment, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS stem,
      (CASE WHEN contains(lower(c_name), 'customer') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(c_name), '7') THEN 1 ELSE 0 END) AS weight FROM customer"""
)
def names_shown(spark, sf_dir):
    name = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", actions.humanised(F.replace(name, F.lit("#"), F.lit("No"))).alias("human"), texts.stem(F.concat(name, F.lit("/"), F.col("c_mktsegment"))).alias("stem"),
        texts.weighted_hits(name, F.array(F.lit("customer"), F.lit("7"))).alias("weight"),
    )
