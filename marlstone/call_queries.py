"""Registered queries of mended JSON, coerced arguments, overlaps of terms and aliases, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import jsons, texts
from .operators import aliases, arguments, evals
from .queries import query, table


@query(
    """SELECT event_id, event_id % 11 AS kind, json_extract_string(props, '$.k')::BIGINT AS k, event_type AS type, user_id AS last, event_id % 11 = 0 AS untouched FROM events"""
)
def replies_mended(spark, sf_dir):
    """Replies with the same content, broken in ten ways, and sound ones."""
    k, kind, user = F.get_json_object("props", "$.k"), F.col("event_type"), F.col("user_id").cast("string")
    sound = F.concat(F.lit('{"k": '), k, F.lit(', "type": "'), kind, F.lit('", "list": [1, '), user, F.lit("]}"))
    broken = [
        sound,
        F.concat(F.lit("Sure, here it is:\n```json\n"), sound, F.lit("\n```\nAnything else?")),
        F.concat(F.lit("{k: "), k, F.lit(", type: "), kind, F.lit(", list: [1, "), user, F.lit("]}")),
        F.concat(F.lit("{'k': "), k, F.lit(", 'type': '"), kind, F.lit("', 'list': [1, "), user, F.lit("]}")),
        F.concat(F.lit('{"k": '), k, F.lit(', "type": "'), kind, F.lit('", "list": [1, '), user),
        F.concat(F.lit('{"k": '), k, F.lit(',, "type": "'), kind, F.lit('", "list": [1, '), user, F.lit(",],}")),
        F.concat(F.lit('{"k": '), k, F.lit(' "type": "'), kind, F.lit('" "list": [1 '), user, F.lit("]}")),
        F.concat(F.lit('{"k": '), k, F.lit(', // the count\n"type": "'), kind, F.lit('", /* more */ "list": [1, '), user, F.lit("]}")),
        F.concat(F.lit('{"k": '), k, F.lit(', "type": "'), kind, F.lit('", "list": [1, '), user, F.lit("}")),
        F.concat(F.lit('{"said": "he said "no" to it\n", "ok": True, "none": None, "k": '), k, F.lit(', "type": "'), kind, F.lit('", "list": [1, '), user, F.lit("]}")),
        F.concat(F.lit('The answer {"k" = '), k, F.lit(', “type”: “'), kind, F.lit('”, "list": [1, '), user, F.lit(']}}} is this')),
    ]
    which = F.col("event_id") % len(broken)
    reply = F.element_at(F.array(*broken), (which + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", which.alias("kind"), reply.alias("reply"))
    rows = rows.withColumn("json", jsons.json_mended(F.col("reply")))
    value = lambda path: F.get_json_object("json", path)
    return rows.select("event_id", "kind", value("$.k").cast("long").alias("k"), value("$.type").alias("type"), value("$.list[1]").cast("long").alias("last"), (F.col("json") == F.col("reply")).alias("untouched"))


SCHEMAS = {
    "view": {"properties": {"count": {"type": "integer"}, "note": {"type": "string"}}, "required": ["count"], "additionalProperties": False},
    "click": {"properties": {"ratio": {"type": "number"}, "rows": {"type": ["array", "null"]}, "precision": {"type": "integer"}}, "required": ["ratio"]},
    "purchase": {"properties": {"options": {"type": "object"}, "flag": {"type": "boolean"}, "table_index": {"type": ["integer", "string"]}}, "required": ["options", "flag"], "additionalProperties": False},
    "signup": {"properties": {"count": {"type": "string"}}},
}


@query(
    """WITH c AS (SELECT event_id, event_type AS tool, event_id % 4 AS form, json_extract_string(props, '$.k')::BIGINT AS k FROM events)
    SELECT event_id, tool,
      CASE WHEN tool = 'error' THEN 'dropped_call_tool_not_in_schema:error' WHEN tool = 'view' AND form = 3 THEN 'dropped_call_missing_required:view.count'
        WHEN tool = 'click' AND form = 2 THEN 'dropped_call_bad_type:click.ratio' WHEN tool = 'purchase' AND form = 1 THEN 'dropped_call_bad_type:purchase.flag'
        WHEN tool = 'purchase' AND form = 3 THEN 'dropped_call_missing_required:purchase.options,flag' WHEN tool = 'signup' AND form = 0 THEN 'dropped_call_bad_type:signup.count' ELSE 'ok' END AS status,
      CASE WHEN tool = 'view' AND form < 3 THEN '{"count":' || k || '}' WHEN tool = 'click' AND form = 0 THEN '{"ratio":' || k || ',"rows":[1,2],"other":1}'
        WHEN tool = 'click' AND form = 1 THEN '{"ratio":' || k || ',"rows":null,"precision":2}' WHEN tool = 'click' AND form = 3 THEN '{"ratio":' || k || '}'
        WHEN tool = 'purchase' AND form = 0 THEN '{"options":{"a":' || k || '},"flag":true,"table_index":4}' WHEN tool = 'purchase' AND form = 2 THEN '{"options":{},"flag":false}'
        WHEN tool = 'signup' AND form = 1 THEN '{"count":"' || k || '"}' WHEN tool = 'signup' AND form > 1 THEN '{}' END AS coerced,
      CASE WHEN tool = 'view' THEN CASE form WHEN 0 THEN '' WHEN 1 THEN 'coerced_argument:view.count' WHEN 2 THEN 'removed_extra_argument:view.a;removed_extra_argument:view.b;coerced_argument:view.count' ELSE 'removed_extra_argument:view.counts' END
        WHEN tool = 'click' THEN CASE form WHEN 0 THEN 'coerced_argument:click.ratio;coerced_argument:click.rows' WHEN 1 THEN 'argument_alias:click._precision->precision;coerced_argument:click.precision' ELSE '' END
        WHEN tool = 'purchase' THEN CASE form WHEN 0 THEN 'argument_alias:purchase.table_indices->table_index;coerced_argument:purchase.options' ELSE '' END ELSE '' END AS notes
    FROM c"""
)
def arguments_coerced(spark, sf_dir):
    k, form = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    given = {
        "view": ['{"count": #}', '{"count": "about # of them"}', '{"b": 1, "count": "[#]", "a": {}}', '{"counts": #}'],
        "click": ['{"ratio": " # ", "rows": "[1, 2]", "other": 1}', '{"ratio": #, "rows": null, "_precision": "2 digits"}', '{"rows": [], "ratio": "many"}', '{"ratio": #}'],
        "purchase": ['{"options": "{\\"a\\": #}", "flag": true, "table_indices": 4}', '{"options": {}, "flag": "true"}', '{"options": {}, "flag": false}', "[]"],
        "signup": ['{"count": #}', '{"count": "#"}', "{}", None],
        "error": ["{}"] * 4,
    }
    text = F.element_at(F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in given.items() for x in pair)), F.col("event_type"))
    calls = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("tool"), F.replace(F.element_at(text, (form + 1).cast("int")), F.lit("#"), k).alias("given"))
    return arguments.coerced(calls, "tool", "given", SCHEMAS).select("event_id", "tool", "status", "coerced", F.array_join("notes", ";").alias("notes"))


LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + 7 * i) for i in range(26))


@query(
    f"""WITH t AS (SELECT conv_id, turn, translate(lower(text), '{LATIN}', '{HAN}') || ' net income 10-k' AS text FROM conversations),
    q AS (SELECT a.conv_id, a.turn, b.text AS text, substr(a.text, 1, 30) || ' NET 10-K of' AS query FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    runs AS (SELECT conv_id, turn, text, query, generate_subscripts(r, 1) AS n, unnest(r) AS run FROM (SELECT *, regexp_extract_all(query, '[一-鿿]{{2,}}') AS r FROM q)),
    grams AS (
      SELECT conv_id, turn, n, 0 AS s, 0 AS i, run AS term FROM runs
      UNION ALL SELECT conv_id, turn, n, s, i, substr(run, i::INT, size) FROM (SELECT *, unnest(range(1, length(run) - size + 2)) AS i FROM runs, (VALUES (8, 1), (6, 2), (4, 3), (3, 4), (2, 5)) v(size, s) WHERE length(run) >= size)
      UNION ALL SELECT conv_id, turn, 0, 0, generate_subscripts(w, 1), unnest(w) FROM (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(query), '[a-z0-9$%._-]+'), lambda x: length(x) > 2) AS w FROM q)),
    terms AS (SELECT conv_id, turn, term, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(n * 1000000 + s * 100000 + i)) AS place FROM grams GROUP BY conv_id, turn, term)
    SELECT q.conv_id, q.turn, count(term) AS n_terms, coalesce(sum(CASE WHEN contains(lower(q.text), term) THEN least(greatest(length(term), 2), 8) / 2.0 ELSE 0 END), 0)::DOUBLE AS score
    FROM q LEFT JOIN (SELECT * FROM terms WHERE place <= 60) t USING (conv_id, turn) GROUP BY ALL"""
)
def han_overlap(spark, sf_dir):
    """Turns, their letters as Han signs, against the next turn's opening words."""
    han = F.concat(F.translate(F.lower("text"), LATIN, HAN), F.lit(" net income 10-k"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", han.alias("text"))
    queries = turns.select("conv_id", "turn", F.concat(F.substring("text", 1, 30), F.lit(" NET 10-K of")).alias("query"))
    both = queries.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), "text"), ["conv_id", "turn"])
    return both.select(
        "conv_id", "turn", F.size(texts.overlap_terms(F.col("query"))).cast("long").alias("n_terms"), texts.overlap_score(F.col("text"), F.col("query")).alias("score")
    )


@query(
    """WITH names AS (SELECT p_partkey AS code, p_partkey AS rank, trim(regexp_replace(lower(unnest([p_name, p_brand])), '[^a-z0-9]+', ' ', 'g')) AS form FROM part),
    idx AS (SELECT form, arg_min(code, rank) AS code, min(code) <> max(code) AS ambiguous FROM names WHERE form <> '' GROUP BY 1),
    asked AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '  ' || upper(p_name) || '! ' WHEN 1 THEN '00' || p_partkey WHEN 2 THEN replace(p_brand, '#', ' no ') ELSE p_brand END AS asked FROM part)
    SELECT p_partkey, asked, CASE WHEN regexp_full_match(trim(asked), '[0-9]+') THEN p_partkey::VARCHAR ELSE code::VARCHAR END AS code,
      CASE WHEN regexp_full_match(trim(asked), '[0-9]+') THEN false ELSE coalesce(ambiguous, false) END AS ambiguous
    FROM asked LEFT JOIN idx ON trim(regexp_replace(lower(asked), '[^a-z0-9]+', ' ', 'g')) = form"""
)
def codes_of_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = aliases.index(part, "p_partkey", ["p_name", "p_brand"], "p_partkey")
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    asked = F.when(kind == 0, F.concat(F.lit("  "), F.upper(name), F.lit("! "))).when(kind == 1, F.concat(F.lit("00"), F.col("p_partkey"))).when(kind == 2, F.replace("p_brand", F.lit("#"), F.lit(" no "))).otherwise(F.col("p_brand"))
    return aliases.resolved(part.select("p_partkey", asked.alias("asked")), "asked", found)


@query(
    """WITH asked AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'exports' WHEN 1 THEN ' Re-Import ' WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN 'm' ELSE 'transit' END AS flow FROM part)
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'X' WHEN 1 THEN 'RM' WHEN 2 THEN 'X' WHEN 3 THEN 'X' WHEN 4 THEN 'M' ELSE 'TRANSIT' END AS flow_code, lpad(p_partkey::VARCHAR, 10, '0') AS padded FROM asked"""
)
def flows_and_padded_codes(spark, sf_dir):
    kind = F.col("p_partkey") % 6
    flow = F.when(kind == 0, "exports").when(kind == 1, " Re-Import ").when(kind == 3, "").when(kind == 4, "m").when(kind == 5, "transit")
    return table(spark, sf_dir, "part").select("p_partkey", aliases.flow_code(flow).alias("flow_code"), aliases.padded_code(F.col("p_partkey")).alias("padded"))


@query(
    """WITH idx AS (SELECT lower(n_name) AS form, n_nationkey AS code FROM nation),
    said AS (SELECT c_custkey, lower(c_mktsegment) AS seg, lower(a.n_name) AS one, a.n_nationkey AS one_code, lower(b.n_name) AS two, b.n_nationkey AS two_code
      FROM customer JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON (c_custkey % 25) = b.n_nationkey)
    SELECT c_custkey, 2 AS at, trim(regexp_replace(one, '[^a-z0-9]+', ' ', 'g')) AS form, one_code AS code FROM said
    UNION ALL SELECT c_custkey, 3 + len(string_split(trim(regexp_replace(one, '[^a-z0-9]+', ' ', 'g')), ' ')), trim(regexp_replace(two, '[^a-z0-9]+', ' ', 'g')), two_code FROM said"""
)
def names_mentioned(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    found = aliases.index(nation, "n_nationkey", ["n_name"], "n_nationkey")
    names = nation.select("n_nationkey", "n_name")
    said = table(spark, sf_dir, "customer").join(names.toDF("c_nationkey", "one"), "c_nationkey").withColumn("k", F.col("c_custkey") % 25).join(names.toDF("k", "two"), "k")
    text = F.concat_ws(" ", F.lit("Trade from"), "one", F.lit("to"), "two", F.lit("grew."))
    return aliases.mentioned(said.select("c_custkey", text.alias("text")), ["c_custkey"], "text", found).select("c_custkey", "at", "form", "code")


@query(
    """WITH r AS (SELECT o_orderkey AS k, o_totalprice, CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE (o_orderkey % 150) / 100.0::DOUBLE END AS a, (o_custkey % 101) / 100.0::DOUBLE AS t,
      o_orderkey % 5 AS n, least(o_orderkey % 5, o_custkey % 5) AS hit, least(o_orderkey % 5, o_custkey % 3 + 1) AS sup, o_custkey % 4 > 0 AS anchored, o_orderkey % 7 = 0 AS clash FROM orders),
    c AS (SELECT *, least(a, 1.0) AS a1, CASE WHEN n > 0 THEN least(a, 1.0, hit::DOUBLE / n) WHEN least(a, 1.0) >= 0.8 OR t >= 0.7 THEN least(a, 0.5) ELSE least(a, 1.0) END AS a2,
      CASE WHEN n > 0 THEN least(t, sup::DOUBLE / n) WHEN least(a, 1.0) >= 0.8 OR t >= 0.7 THEN least(t, 0.5) ELSE t END AS t2 FROM r),
    d AS (SELECT *, CASE WHEN t2 > 0.5 AND NOT anchored THEN 0.5 ELSE t2 END AS t3 FROM c),
    j AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'correct' WHEN a1 >= 0.8 THEN 'correct' WHEN a1 >= 0.25 THEN 'partial' ELSE 'incorrect' END AS aj, CASE WHEN k % 3 = 1 THEN CASE WHEN t2 > 0.5 AND NOT anchored THEN 'partially_sound' ELSE 'sound' END
      WHEN t >= 0.9 THEN CASE WHEN t2 > 0.5 AND NOT anchored THEN 'partially_sound' ELSE 'sound' END WHEN t >= 0.5 THEN 'partially_sound' WHEN t <= 0 THEN 'no_trajectory' ELSE 'unsound' END AS tj FROM d),
    f AS (SELECT *, CASE WHEN a2 < 0.8 AND aj = 'correct' THEN CASE WHEN a2 >= 0.25 THEN 'partial' ELSE 'incorrect' END ELSE aj END AS aj2,
      CASE WHEN t3 < 0.7 AND tj IN ('sound', 'partially_sound') THEN CASE WHEN t3 >= 0.5 THEN 'partially_sound' WHEN t3 <= 0 THEN 'no_trajectory' ELSE 'unsound' END ELSE tj END AS tj2 FROM j)
    SELECT k, a2 AS answer_score, t3 AS trajectory_score, aj2 AS answer_judgement, tj2 AS trajectory_judgement, a2 >= 0.8 AND aj2 = 'correct' AND NOT (clash AND k % 2 = 0) AND t3 >= 0.7 AND tj2 IN ('sound', 'partially_sound') AND NOT clash AS is_correct,
      a2 < a1 OR t3 < t AS capped FROM f"""
)
def replies_judged(spark, sf_dir):
    """Verdicts with scores out of range, words that are none, criteria met in part, and contradictions of the path or of both."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    n, hit, sup = key % 5, F.least(key % 5, cust % 5), F.least(key % 5, cust % 3 + 1)
    criteria = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long")), lambda i: F.when(i <= n, F.struct((i <= hit).alias("answer_matched"), (i <= sup).alias("trajectory_supported"))))
    rows = table(spark, sf_dir, "orders").select(
        key.alias("k"), F.when(key % 13 == 0, "none").otherwise(((key % 150) / 100.0).cast("string")).alias("answer_score"), ((cust % 101) / 100.0).alias("trajectory_score"),
        F.when(key % 3 == 0, " Correct").otherwise("perhaps").alias("answer_judgement"), F.when(key % 3 == 1, "SOUND").alias("trajectory_judgement"), (key % 7 == 0).alias("contradiction"),
        F.when(key % 2 == 0, "both").otherwise("trajectory").alias("scope"), criteria.alias("criteria"), F.when(cust % 4 > 0, F.array(F.lit(1))).alias("anchors"),
    )
    return evals.judged_replies(rows).select("k", "answer_score", "trajectory_score", "answer_judgement", "trajectory_judgement", "is_correct", "capped")


@query(
    """WITH p AS (SELECT p_partkey, p_name || '.png' AS source, CASE p_partkey % 3 WHEN 0 THEN 'Site Logo' WHEN 1 THEN '统计表' ELSE p_type END AS label, p_brand AS context FROM part),
    q AS (SELECT *, lower(source || ' ' || label || ' ' || context) AS x FROM p), o AS (SELECT *, (CASE WHEN contains(x, 'red') THEN 1.5 ELSE 0 END + CASE WHEN contains(x, 'widget') THEN 3 ELSE 0 END + CASE WHEN contains(x, 'economy') THEN 3.5 ELSE 0 END)::DOUBLE AS overlap FROM q)
    SELECT p_partkey, (CASE WHEN p_partkey % 3 = 1 OR contains(x, 'table') OR contains(x, 'chart') THEN 4 ELSE 0 END + overlap * 1.5 - CASE WHEN p_partkey % 3 = 0 OR contains(x, 'icon') OR contains(x, 'red.png') OR contains(x, 'share') OR contains(x, 'banner') THEN 12 ELSE 0 END
      - CASE WHEN NOT (p_partkey % 3 = 1 OR contains(x, 'table') OR contains(x, 'chart')) AND overlap < 2 THEN 4 ELSE 0 END)::DOUBLE AS score FROM o"""
)
def assets_scored(spark, sf_dir):
    n = F.col("p_partkey") % 3
    label = F.when(n == 0, "Site Logo").when(n == 1, "统计表").otherwise(F.col("p_type"))
    score = texts.asset_score(F.concat("p_name", F.lit(".png")), label, F.col("p_brand"), "a red widget, Economy")
    return table(spark, sf_dir, "part").select("p_partkey", score.alias("score"))
