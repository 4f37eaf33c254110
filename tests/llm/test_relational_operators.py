import base64
import gzip
import hashlib
import json
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, mixing, queries, toolcalls, warc

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau upsilon phi chi psi omega"


def bag(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def plain_leaks(docs, items):
    out = {}
    for d, text in docs:
        for k, item in items:
            s, want = bag(text), Counter(bag(item))
            n = sum(want.values())
            for a in range(max(1, len(s) - n + 1)) if n and s else ():
                window = Counter(s[a : a + n])
                both = sum((window & want).values())
                score = both / (sum(window.values()) + n - both)
                if score >= 0.8 and score > out.get((d, k), (0,))[0]:
                    out[d, k] = score, a
    return out


@pytest.mark.parametrize("few", [1_000_000, 1])
def test_leaks_by_brute_force(spark, sf, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW", few)
    words = ITEM.split()
    changed = words[:3] + ["other"] + words[4:]
    planted = [
        (1, f"x y z {ITEM.upper()}. and more"), (2, " ".join(changed)), (3, " ".join(words[1:])), (4, " ".join(words[::-1])), (5, ITEM.replace(" ", ",\n")),
        (6, None), (7, ""), (8, "alpha beta gamma delta"), (8, ITEM), (9, " ".join(words[:12] + ["q"] * 3 + words[12:])), (10, " ".join(words[12:] + words[:12])),
        (11, " ".join(words[:12]) + " filler " * 300 + ITEM + " the end"),
    ]
    docs = [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + planted
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, ITEM), (901, "too short"), (902, None), (903, ITEM + " " + ITEM)]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs] + [(None, ITEM, "z")], "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontaminate.found(df, bench).collect()}
    want = plain_leaks(docs, items)
    assert {k: v[0] for k, v in got.items()} == {k: pytest.approx(v[0]) for k, v in want.items()}
    assert got[1, 900] == (1.0, 3) and got[11, 900][0] == 1.0 and (2, 900) not in got
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns
    assert left.count() == sum(d not in {k for k, _ in want} for d, _ in docs) + 1
    assert decontaminate.found(df.limit(0), bench).count() == 0 and decontaminate.found(df, bench.limit(0)).count() == 0


def test_mixture_by_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = Counter((r[0], r[5], r[6], r[7]) for r in con.execute(mixing.oracle()).fetchall())
    rows = queries.op4_poisson_mixing(spark, sf).collect()
    assert Counter((r.doc_id, r.repeats, r["copy"], r.shuffle_key) for r in rows) == want


def test_mixture_reaches_its_weights(spark, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 100 == 1, None).otherwise("b").alias("source"), F.lit("t").alias("copy"))
    weights = spark.createDataFrame([("a", 3.0), (None, 1.0), ("ghost", 9.0)], "source string, weight double")
    for few in (10_000, 1):
        monkeypatch.setattr(mixing, "FEW", few)
        out = mixing.mixed(docs, weights).groupBy("source").count().collect()
        sizes = {r.source: r["count"] for r in out}
        assert set(sizes) == {"a", None}
        assert sizes["a"] == pytest.approx(20_000 * 3 / 4, rel=0.03) and sizes[None] == pytest.approx(5_000, rel=0.05)
    one = spark.createDataFrame([(1, "s"), (1, "s"), (None, "s")], "doc_id long, source string")
    times = {r.repeats for r in mixing.mixed(one, epochs=700.0).where("doc_id = 1").collect()}
    assert len(times) == 1 and 600 < times.pop() < 800
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_fingerprints_by_brute_force(spark):
    rnd = random.Random(2)
    rows = [([rnd.getrandbits(64) - (1 << 63) for _ in range(n)],) for n in (1, 2, 7, 127, 128, 1000, 40_000)]
    for r in decontaminate._fingerprinted(spark.createDataFrame(rows, "hs array<long>")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r.hs) > len(r.hs))
        assert r.fp % (1 << 64) == want


PAGES = [(3, "http://a/ b", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://c", None), (5, "http://d", ""), (7, "u", "x" * 5000), (7, "u", "x" * 5000), (9, "u", "x" * 5000), (None, "n", "<p>é</p>"), (11, "w", "WARC/1.1\r\n\r\nodd")]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, h, "z") for i, u, h in PAGES], "page_id long, url string, html string, payload string")
    path = f"file://{tmp_path}/a"
    warc.write(pages, path)
    rows = warc.read(spark, path).collect()
    assert len(rows) == len(PAGES)
    by = {}
    for r in rows:
        by.setdefault(r.record_id, []).append(r)
    for i, _, html in PAGES:
        for r in by[f"urn:x-page:{'null' if i is None else i}"]:
            raw = (html or "").encode()
            first = min(j for j, _, h in PAGES if j is not None and (h or "") == (html or ""))
            assert r.payload_bytes == len(raw)
            assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
            assert (r.warc_type, r.refers_to, r.payload) == (("response", None, raw) if i == first else ("revisit", f"urn:x-page:{first}", None))
    whole = gzip.decompress(b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("*.gz"))))
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == len(PAGES)
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "x.warc").write_bytes(whole)
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz" / "y.warc.gz").write_bytes(b"".join(gzip.compress(b"WARC/1.1\r\n" + m) for m in whole.split(b"WARC/1.1\r\n")[1:3]))
    same = lambda p: Counter((r.record_id, r.warc_type, r.payload) for r in warc.read(spark, f"file://{tmp_path}/{p}").collect())
    assert same("plain") == same("a") and sum(same("gz").values()) == 2
    warc.write(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_archive_splits_and_filters(spark, tmp_path):
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id") % 7).alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    warc.write(pages.coalesce(1), f"file://{tmp_path}/a")
    read = warc.read(spark, f"file://{tmp_path}/a")
    split = spark.read.format("warc").option("split_bytes", 700).load(f"file://{tmp_path}/a")
    assert split.rdd.getNumPartitions() > 20
    assert {r.record_id for r in split.collect()} == {f"urn:x-page:{i}" for i in range(300)} and split.count() == 300
    some = read.where("warc_type = 'response' and target_uri = 'http://h/3'").select("record_id")
    assert some.count() == len([i for i in range(300) if i % 7 == 3])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)
    reader = warc.WarcReader(f"file://{tmp_path}/a", ["record_id"], 1 << 20)
    assert list(reader.pushFilters([warc.EqualTo(("warc_type",), "response"), warc.EqualTo(("payload_bytes",), 3)])) == [warc.EqualTo(("payload_bytes",), 3)]


def test_pages_of_the_query(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op8_warc_source(spark, sf).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest) for r in rows} == {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for i, b in pages.items()}


SCHEMA = json.dumps({"type": "object", "required": ["q"], "properties": {"q": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 0}}, "additionalProperties": False})
CALLS = [
    (1, 5, "b", "find", '{"n": 2.0, "q": "x"}', ["a"]), (1, 7, "a", "find", '{"q": "é"}', []), (1, 1, "c", "find", '{"q": ""}', ["b", "nowhere"]),
    (2, 1, "a", "find", "{bad", None), (2, 2, "a", "find", '{"q": "again"}', None), (2, 3, "d", "none", "{}", None), (2, 4, "e", "find", '{"q": "x", "z": 1}', None),
    (3, 1, "p", "find", '{"q": "x"}', ["r"]), (3, 2, "q", "find", '{"q": "x"}', ["p"]), (3, 3, "r", "find", '{"q": "x"}', ["q"]), (None, 1, "a", "find", '{"q": "x"}', []), (4, None, None, None, None, None),
]
RESULTS = [(1, 6, "b", "B"), (1, 8, "a", "late"), (1, 7, "a", "first"), (2, 9, "stray", "S"), (3, 5, "p", None), (2, 5, "e", "E")]


def test_links_orders_and_validates(spark):
    calls = spark.createDataFrame([(*c, "z") for c in CALLS], "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, level string")
    results = spark.createDataFrame(RESULTS, "conv_id long, turn long, call_id string, content string")
    tools = spark.createDataFrame([("find", SCHEMA)], "name string, schema string")
    rows = toolcalls.linked(calls, results, tools).collect()
    assert len(rows) == len(CALLS) + 1
    one = sorted((r.position, r.call_id, r.status) for r in rows if r.conv_id == 1)
    assert one == [(1, "a", "ok"), (2, "b", "ok"), (3, "c", "invalid")]
    said = {(r.conv_id, r.turn, r.call_id): r for r in rows}
    assert said[1, 5, "b"].canonical == '{"arguments":{"n":2,"q":"x"},"id":"b","name":"find","result":"B"}'
    assert json.loads(said[1, 7, "a"].canonical)["result"] == "first"
    assert said[1, 1, "c"].errors == ["$.q: too short"]
    assert said[2, 1, "a"].errors == ["$: no JSON"] and said[2, 2, "a"].status == "duplicate_call"
    assert said[2, 3, "d"].errors == ["no such tool"] and said[2, 4, "e"].errors == ["$.z: unknown"]
    assert said[2, 9, "stray"].status == "orphan_result"
    assert {r.status for r in rows if r.conv_id == 3} == {"cycle"}
    assert said[None, 1, "a"].status == "no_result"
    assert toolcalls.linked(calls.limit(0), results.limit(0), tools).count() == 0


def test_long_conversations_are_numbered_by_stretches(spark):
    turns = spark.range(1000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("role"), F.lit("t").alias("text"))
    rows = toolcalls.linked(*toolcalls.from_conversations(spark, turns)).orderBy("position").collect()
    assert [(r.position, r.turn, r.status) for r in rows] == [(i + 1, 2 * i, "ok") for i in range(500)]


def test_calls_of_all_conversations(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    by = {(r.conv_id, r.turn): r for r in turns}
    rows = queries.op10_tool_call_linking(spark, sf).collect()
    assert len(rows) == sum(r.role != "assistant" or by.get((r.conv_id, r.turn - 1), r).role == "assistant" for r in turns)
    for r in rows:
        if r.status == "ok":
            got = json.loads(r.canonical)
            assert got["arguments"]["text"] == by[r.conv_id, r.turn].text and got["result"] == by[r.conv_id, r.turn + 1].text
            assert r.canonical == json.dumps(got, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
