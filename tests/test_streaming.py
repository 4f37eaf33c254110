from pyspark.sql import functions as F

from marlstone.operators import ledger
from marlstone.streaming import ledger as live

EVENTS = "/root/testdata/sf0.001/events.parquet"


def events(spark):
    df = spark.read.parquet(EVENTS)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark, tmp_path, parts=3):
    df = events(spark)
    df.repartitionByRange(parts, "event_id").write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_windows_agree_with_the_table(spark, tmp_path):
    flat = lambda df: {(r.window.start, r.event_type, r.n) for r in df.collect()}
    got = run(live.counts_by_window(stream(spark, tmp_path), "ts", ["event_type"], "6 hours", late="40 days"), "complete", "windows", tmp_path)
    assert flat(got) == flat(live.counts_by_window(events(spark), "ts", ["event_type"], "6 hours"))


def test_first_seen_once(spark, tmp_path):
    got = run(live.first_seen(stream(spark, tmp_path), "ts", ["user_id", "event_type"], "60 days"), "append", "seen", tmp_path)
    assert got.count() == events(spark).select("user_id", "event_type").distinct().count()


def test_no_gain_runs_agree_with_the_table(spark, tmp_path):
    gain = F.col("event_type") == "purchase"
    got = run(live.no_gain_runs(stream(spark, tmp_path), "user_id", "event_id", gain), "append", "runs", tmp_path)
    want = ledger.runs_without_gain(events(spark), "user_id", ["event_id"], gain)
    # Files come in any order: within one user the runs agree where its events came in order.
    assert got.count() == want.count()
    assert got.where("no_gain_run = 0").count() == want.where("no_gain_run = 0").count()
    assert got.where("blocked <> (no_gain_run >= 2)").count() == 0


def test_upserts_by_batches(spark, tmp_path):
    path = f"{tmp_path}/table"
    q = stream(spark, tmp_path).writeStream.foreachBatch(live.upsert_into(path, "user_id", ["event_id"], ["event_type", "value"])).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, r.event_type, r.value) for r in live.current(spark, path).collect()}
    want = {(r.user_id, r.event_type, r.value) for r in ledger.upserted(events(spark), "user_id", ["event_id"], ["event_type", "value"]).collect()}
    assert got == want


def test_upserts_touch_only_their_parts(spark, tmp_path):
    path, fold = f"{tmp_path}/t", live.upsert_into(f"{tmp_path}/t", "k", ["n"], ["v"])
    rows = lambda *r: spark.createDataFrame(r, "k string, n int, v string")
    assert live.current(spark, path) is None
    fold(rows(*((f"k{i}", 1, f"a{i}") for i in range(200)), (None, 1, "none")), 0)
    fold(rows(("k7", 2, "b"), ("k7", 3, ""), (None, 2, "later")), 1)
    fold(rows(("k7", 2, "b"), ("k7", 3, ""), (None, 2, "later")), 1)
    fold(rows().limit(0), 2)
    got = {r.k: (r.n, r.v) for r in live.current(spark, path).collect()}
    assert got == {f"k{i}": (1, f"a{i}") for i in range(200)} | {"k7": (3, "b"), None: (2, "later")}
    assert len(list((tmp_path / "t" / "_version=1").glob("_bucket=*"))) == 2


def test_sessions(spark):
    out = live.sessions(events(spark), "ts", ["user_id"], "30 minutes")
    assert out.agg(F.sum("n")).first()[0] == events(spark).count()
