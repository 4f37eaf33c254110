"""What a row costs: plans that do a step once and not at each use of it."""

from pyspark.sql import functions as F

from marlstone import queries
from marlstone.functions import texts
from marlstone.operators import nested, rules


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_headings_are_lowered_once(spark):
    df = spark.createDataFrame([(1, "in Millions, US  dollars"), (2, "In\tbillions, us Dollars per share"), (3, "xusd"), (4, "Year Ended 2003; thousand €"), (5, None)], "id int, t string")
    hint = df.select("id", rules.unit_hint(F.concat("t", F.lit(" "), "id")).alias("unit"))
    assert plan(hint).count("concat(t#") <= 2 and plan(hint).count("lower(") <= 1
    assert [r.unit for r in hint.orderBy("id").collect()] == ["in millions", "in billions; per-share amounts unscaled; USD", None, "EUR", None]
    spans = df.select("id", rules.periods_in(F.concat("t", F.lit(" "), "id")).alias("p"))
    assert plan(spans).count("concat(t#") <= 2
    assert [r.p for r in spans.orderBy("id").collect()] == [[], [], [], ["year ended 2003", "2003"], None]


def test_terms_of_a_plain_query_are_found_once(spark):
    df = spark.createDataFrame([(1, "Red  widget.png", "table"), (2, None, None), (3, "logo red.png", "图表 economy")], "id int, s string, l string")
    score = lambda q: texts.asset_score(F.col("s"), F.col("l"), F.lit(None), q)
    both = df.select("id", score("a red widget, Economy").alias("a"), score(F.lit("a red widget, Economy")).alias("b"))
    assert [(r.a, r.b) for r in both.orderBy("id").collect()] == [(10.75, 10.75), (-4.0, -4.0), (-0.5, -0.5)]
    assert "regexp_extract_all" not in plan(queries.QUERIES["assets_scored"](spark, "/root/testdata/sf0.001"))


def test_only_a_plan_s_symbols_are_read_as_bars(spark):
    found = plan(queries.QUERIES["plan_from_raw_names"](spark, "/root/testdata/sf0.001"))
    filters = [line for line in found.splitlines() if "Filter" in line and "l_suppkey" in line]
    assert filters and all("IN (1,2,3" in f and f.index("IN (1,2,3") < f.index("l_shipdate") for f in filters)


def test_list_items_are_opened_once(spark):
    docs = ['{"slot": "", "id": "a\\"b", "key": 2}', '{"metric": "m", "entity": 1.0, "x": 3, "period": null}', '{"x": 1}', "3", "null", "[1]", '{"slot_id": {"a": 1}}', "{}"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, d string").selectExpr("id", "parse_json(d) AS item")
    who = df.select("id", nested.identity("item").alias("who"))
    assert plan(who).count("variant_get(") == 1
    assert [r.who for r in who.orderBy("id").collect()] == ['id:a\\"b', 'composite:{"entity":1,"metric":"m"}', 'item:{"x":1}', "item:3", "item:null", "item:[1]", 'slot_id:{"a":1}', "item:{}"]


def test_feed_reads_its_events_once(spark):
    files = queries.QUERIES["run_feed"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/events-once-" in f for f in files)


def test_boxes_are_aggregated_by_hash(spark):
    found = queries.QUERIES["box_best_match"](spark, "/root/testdata/sf0.001")
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
