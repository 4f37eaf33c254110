"""Registered queries of nested values, global orders and spans of validity, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import intervals, nested, ranks
from .queries import query, table
from .shared import shared_dir, staged
from .streaming import feed

STATE = """updates AS (
  SELECT user_id, event_id, list_aggregate(list_transform(range(0, event_id % 10 + 1), lambda i: '{"k' || ((event_id >> i::INT) & 1) || '":'), 'string_agg', '')
    || CASE WHEN event_id % 11 = 0 THEN '{}' WHEN event_id % 3 = 0 THEN (event_id % 7)::VARCHAR ELSE props END || repeat('}', (event_id % 10 + 1)::INT) AS state
  FROM events)"""


def state_updates(spark, sf_dir):
    """Updates of one to eleven levels, from each event's id and properties."""
    depth = (F.col("event_id") % 10).cast("int")
    name = lambda i: F.concat(F.lit('{"k'), F.pmod(F.floor(F.col("event_id") / F.pow(F.lit(2), i)), F.lit(2)).cast("string"), F.lit('":'))
    leaf = F.when(F.col("event_id") % 11 == 0, "{}").when(F.col("event_id") % 3 == 0, (F.col("event_id") % 7).cast("string")).otherwise(F.col("props"))
    opened = F.array_join(F.transform(F.sequence(F.lit(0), depth), name), "")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(opened, leaf, F.repeat(F.lit("}"), depth + 1)).alias("state"))


@query(
    f"""WITH {STATE}, merged AS (
      SELECT user_id, list_reduce(list(state::JSON ORDER BY event_id), lambda a, b: json_merge_patch(a, b)) AS doc FROM updates GROUP BY 1)
    SELECT user_id, substr(t.fullkey, 3) AS path, t.value::VARCHAR AS leaf FROM merged, json_tree(merged.doc) t WHERE t.type <> 'OBJECT' OR t.value::VARCHAR = '{{}}'"""
)
def state_deep_merge(spark, sf_dir):
    merged = nested.deep_merged(state_updates(spark, sf_dir), "user_id", ["event_id"], "state")
    return merged.select("user_id", F.array_join("path", ".").alias("path"), "leaf")


@query(
    f"""WITH {STATE}, merged AS (
      SELECT user_id, list_reduce(list(state::JSON ORDER BY event_id), lambda a, b: json_merge_patch(a, b)) AS doc FROM updates GROUP BY 1)
    SELECT user_id, (SELECT count(*) FROM json_tree(merged.doc) t WHERE t.type <> 'OBJECT' OR t.value::VARCHAR = '{{}}') AS leaves,
      length(doc::VARCHAR) AS signs, json_extract(doc, '$.k0.k1')::VARCHAR IS NOT NULL AS has_k0_k1 FROM merged"""
)
def state_assembled(spark, sf_dir):
    """Merged states as JSON again; their length does not depend on the order of names."""
    merged = staged(nested.deep_merged(state_updates(spark, sf_dir), "user_id", ["event_id"], "state"), "merged")
    counts = merged.groupBy("user_id").agg(F.count("*").alias("leaves"))
    docs = nested.assembled(merged, "user_id").withColumnRenamed("user_id", "_u")
    return counts.join(docs, F.col("user_id") == F.col("_u")).select(
        "user_id", "leaves", F.length("json").cast("long").alias("signs"), F.get_json_object("json", "$.k0.k1").isNotNull().alias("has_k0_k1")
    )


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k, value FROM events),
    items AS (
      SELECT user_id, event_id, 0 AS i, 'slot_id:' || event_type AS identity, unnest([struct_pack(field := 'slot_id', value := '"' || event_type || '"'),
        struct_pack(field := 'k', value := k::VARCHAR), struct_pack(field := 'n' || k % 3, value := event_id::VARCHAR)], recursive := true) FROM e
      UNION ALL SELECT user_id, event_id, 1, 'composite:{"metric":"m' || k % 5 || '","source":"' || event_type || '"}', unnest([struct_pack(field := 'metric', value := '"m' || k % 5 || '"'),
        struct_pack(field := 'source', value := '"' || event_type || '"'), struct_pack(field := 'at', value := event_id::VARCHAR)], recursive := true) FROM e WHERE event_id % 2 = 1
      UNION ALL SELECT user_id, event_id, 2, 'item:' || k % 4, NULL, (k % 4)::VARCHAR FROM e WHERE event_id % 6 = 1),
    seen AS (SELECT user_id, identity, min(event_id * 10 + i) AS first FROM items GROUP BY user_id, identity),
    firsts AS (SELECT user_id, identity, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS place FROM seen)
    SELECT user_id, place, identity, field, arg_max(items.value, event_id * 10 + i) AS value FROM items JOIN firsts USING (user_id, identity) GROUP BY ALL"""
)
def state_keyed_lists(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    slot = F.concat(F.lit('{"slot_id":'), text(F.col("event_type")), F.lit(',"k":'), k, F.lit(',"n'), k % 3, F.lit('":'), F.col("event_id"), F.lit("}"))
    part = F.concat(F.lit('{"metric":"m'), k % 5, F.lit('","source":'), text(F.col("event_type")), F.lit(',"at":'), F.col("event_id"), F.lit("}"))
    items = F.concat_ws(",", slot, F.when(F.col("event_id") % 2 == 1, part), F.when(F.col("event_id") % 6 == 1, (k % 4).cast("string")))
    updates = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit("["), items, F.lit("]")).alias("items"))
    return nested.merged_lists(updates, "user_id", ["event_id"], "items")


@query(
    """SELECT event_id, event_type || ' h' || user_id || ' v' || json_extract_string(props, '$.k') || '  n' || event_id || '  True tail' AS text FROM events"""
)
def text_flattened(spark, sf_dir):
    json = F.concat(
        F.lit('{"children":[{"items":["v'), F.get_json_object("props", "$.k"), F.lit('",0,{"nodes":["n'), F.col("event_id"), F.lit('"],"x":["no"]}],"heading":"h'),
        F.col("user_id"), F.lit('"},[],true,"tail"],"text":"","label":"'), F.col("event_type"), F.lit('"}'),
    )
    return nested.flat_text(table(spark, sf_dir, "events").select("event_id", json.alias("json")), ["event_id"], "json")


@query(
    """SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS place,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS place_of_supplier FROM lineitem"""
)
def rows_placed(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"]
    both = ranks.placed(ranks.placed(rows, order, "place"), order, "place_of_supplier", ["l_suppkey"], descending=True)
    return both.select("l_orderkey", "l_linenumber", "place", "place_of_supplier")


@query(
    """SELECT l_orderkey, l_linenumber, sum(l_quantity::DECIMAL(18, 2)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto FROM lineitem"""
)
def rows_running_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    summed = ranks.running_sum(rows, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], "q", "upto", ["l_suppkey"])
    return summed.select("l_orderkey", "l_linenumber", F.col("upto").cast("double").alias("upto"))


@query(
    """WITH e AS (SELECT conv_id, max(length(text)) AS most, count(*) AS turns FROM conversations GROUP BY 1),
    b AS (SELECT conv_id, (row_number() OVER (ORDER BY most, turns, conv_id) - 1) // 16 AS bucket FROM e)
    SELECT conv_id, bucket, row_number() OVER (ORDER BY md5('order|2|' || bucket), bucket, md5('order|2|' || conv_id), conv_id) - 1 AS position FROM b"""
)
def epoch_order(spark, sf_dir):
    episodes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.length("text")).alias("most"), F.count("*").alias("turns"))
    return ranks.epoch_order(episodes, "conv_id", ["most", "turns"], 16, "order", 2).select("conv_id", "bucket", "position")


@query(
    """WITH v AS (SELECT l_partkey, l_shipdate::DATE AS valid_from, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
    s AS (SELECT *, lead(valid_from) OVER (PARTITION BY l_partkey ORDER BY valid_from) AS valid_to FROM v),
    d AS (SELECT DISTINCT l_partkey, o_orderdate::DATE AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_partkey, day, price, valid_from, valid_to FROM d JOIN s USING (l_partkey) WHERE valid_from <= day AND (valid_to IS NULL OR day < valid_to)"""
)
def prices_known_on_days(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    series = lines.select("l_partkey", F.col("l_shipdate").cast("date").alias("known"), F.col("l_extendedprice").alias("price"))
    spans = intervals.vintages(series, ["l_partkey"], "known", "price")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    days = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "day").distinct()
    return intervals.latest_on(days, spans, ["l_partkey"], "day", "valid_from", "valid_to")

FEED = """numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
lines AS (
  SELECT user_id || '-' || n // 12 AS run_id, n % 12 AS seq, ts, event_id,
    CASE WHEN n % 12 = 11 THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END WHEN event_type IN ('view', 'purchase') THEN 'answer_delta' ELSE 'step' END AS type,
    event_type || json_extract_string(props, '$.k')::BIGINT % 3 AS step_id, CASE WHEN event_id % 2 = 0 THEN 'complete' ELSE 'running' END AS status, 't' || event_id || ' ' AS text
  FROM numbered WHERE event_id % 97 <> 5)"""


def feed_lines(spark, sf_dir):
    """Lines of JSON: runs of twelve events of a user; a few are lost, a few come twice."""
    rows = ranks.placed(table(spark, sf_dir, "events"), ["event_id"], "n", ["user_id"]).withColumn("n", F.col("n") - 1)
    kept = rows.where("event_id % 97 <> 5").withColumn("times", F.when(F.col("event_id") % 50 == 3, 2).otherwise(1))
    kept = kept.withColumn("time", F.explode(F.sequence(F.lit(1), "times")))
    last = F.when(F.col("event_type") == "error", "error").otherwise("done")
    kind = F.when(F.col("n") % 12 == 11, last).when(F.col("event_type").isin("view", "purchase"), "answer_delta").otherwise("step")
    line = F.struct(
        F.concat_ws("-", "user_id", F.floor(F.col("n") / 12)).alias("run_id"), (F.col("n") % 12).alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"),
        F.concat("event_type", F.get_json_object("props", "$.k").cast("long") % 3).alias("step_id"),
        F.when(F.col("event_id") % 2 == 0, "complete").otherwise("running").alias("status"), F.concat(F.lit("t"), "event_id", F.lit(" ")).alias("text"),
    )
    return kept.select(F.to_json(line).alias("value"), "event_id", "ts")


FEED_TOLD = f"""WITH {FEED}, ends AS (SELECT run_id, max(seq) FILTER (type IN ('done', 'error')) AS stop, max(ts) AS last, max(seq) AS most, count(*) AS n FROM lines GROUP BY 1),
  runs AS (SELECT *, coalesce(stop, most) + 1 - n AS missing FROM ends),
  steps AS (SELECT run_id, step_id, min(seq) AS first, last(status ORDER BY seq) AS status FROM lines WHERE type = 'step' GROUP BY ALL),
  s AS (SELECT run_id, count(*) AS steps, count(*) FILTER (status = 'complete') AS complete, arg_max(step_id, first) AS last_step FROM steps GROUP BY 1),
  a AS (SELECT run_id, string_agg(text, '' ORDER BY seq) FILTER (type = 'answer_delta') AS answer, any_value(type) FILTER (type IN ('done', 'error')) AS ending,
    any_value(text) FILTER (type IN ('done', 'error')) AS message FROM lines GROUP BY 1)
  SELECT run_id, CASE WHEN stop IS NOT NULL AND missing = 0 THEN ending ELSE 'expired' END AS outcome, n AS events, missing, coalesce(steps, 0) AS steps,
    coalesce(complete, 0) AS complete, last_step, coalesce(answer, '') AS answer, message
  FROM runs LEFT JOIN s USING (run_id) JOIN a USING (run_id)
  WHERE stop IS NOT NULL AND missing = 0 OR (SELECT max(ts)::TIMESTAMP FROM lines) - INTERVAL 1 DAY > last::TIMESTAMP + INTERVAL 10 DAYS"""


@query(FEED_TOLD)
def run_feed(spark, sf_dir):
    return feed.told(feed.read_events(feed_lines(spark, sf_dir)), "1 DAY", "10 DAYS")


#: Lines of a file of the stream, at least, if a batch has more than one file.
LINES = 100_000


@query(FEED_TOLD)
def run_feed_streamed(spark, sf_dir):
    """The same from a stream: four batches of lines by their time, each in no order, told as the state says."""
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    lines = staged(feed_lines(spark, sf_dir), "lines")
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = lines.agg(F.percentile_approx(time, [0.25, 0.5, 0.75])).first()[0] or []
    lines = lines.withColumn("part", sum((F.coalesce(time > c, F.lit(False)).cast("int") for c in cuts), F.lit(0)))
    sizes = dict(lines.groupBy("part").count().collect())
    # Files go to the batches by their number: all parts have the same, and none is empty, as lines are dealt out in turn.
    files = max(1, min(sizes.values(), default=0) // LINES)
    for part in sorted(sizes) or [0]:
        lines.where(F.col("part") == part).select("value").repartition(files).write.mode("append").text(f"{path}/in")
    events = feed.read_events(spark.readStream.option("maxFilesPerTrigger", files).text(f"{path}/in"))
    stream = feed.telling(events, "1 DAY", "10 DAYS").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    run = stream.trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(feed.TOLD).parquet(f"{path}/out")
