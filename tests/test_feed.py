"""The run feed: stream and table alike, whatever order, repeats and gaps the lines have."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from marlstone.streaming import feed


def lines():
    rng, out = random.Random(4), []
    def line(run, seq, minute, kind, **more):
        out.append(json.dumps({"run_id": run, "seq": seq, "ts": f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00", "type": kind, **more}))

    for k in range(20):
        n = rng.randint(1, 9)
        for s in range(n):
            kind = rng.choice(["step", "answer_delta"])
            line(f"r{k}", s, k * 10 + s, kind, step_id=f"s{rng.randint(0, 2)}", status=rng.choice(["running", "complete", None]), text=f"p{s}")
        if k % 5 != 4:
            line(f"r{k}", n, k * 10 + n, "error" if k % 7 == 3 else "done", text="end")
        if k % 4 == 1:
            line(f"r{k}", n + 1, k * 10 + n, "step", step_id="behind", status="complete")
    out.remove(next(x for x in out if '"r2"' in x))
    out += rng.sample(out, 20) + ["no json", '{"seq": 1}', '{"run_id": "r1", "seq": -1, "ts": "2024-01-01", "type": "step"}', '{"run_id": "r1", "seq": 3, "type": "other"}']
    line("clock", 0, 23 * 60, "step", step_id="x", status="running")
    return out


def test_stream_equals_table(spark, tmp_path):
    all_lines = lines()
    want = feed.told(feed.read_events(spark.createDataFrame([(x,) for x in all_lines], "value string")), "2 hours", "3 hours")
    want = sorted(map(tuple, want.collect()), key=str)
    assert {w[1] for w in want} == {"done", "error", "expired"} and len(want) == 20
    (tmp_path / "in").mkdir()
    random.Random(9).shuffle(all_lines)
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(all_lines[k::3]))
    # All within one trigger's reach of the watermark: the last batch brings the clock forward.
    stream = spark.readStream.text(f"{tmp_path}/in")
    told = feed.telling(feed.read_events(stream), "2 hours", "3 hours")
    run = told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.schema(feed.TOLD).parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_streamed_feed_of_events_whose_ids_are_not_in_order_of_time(spark, tmp_path):
    from marlstone import queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    later = events.selectExpr("event_id + 1000000 AS event_id", "ts", "user_id + 1000000 AS user_id", "event_type", "value", "props")
    events.unionByName(later, allowMissingColumns=True).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    table, stream = (sorted(map(tuple, queries.QUERIES[q](spark, str(tmp_path)).collect()), key=str) for q in ("run_feed", "run_feed_streamed"))
    assert table == stream and table


def streamed(spark, path, batches, late, wait):
    """The stream's rows and progress; each batch is one file."""
    (path / "in").mkdir()
    for k, batch in enumerate(batches):
        (path / "in" / f"{k}.json").write_text("\n".join(batch))
        os.utime(path / "in" / f"{k}.json", (k + 1, k + 1))
    told = feed.telling(feed.read_events(spark.readStream.option("maxFilesPerTrigger", 1).text(f"{path}/in")), late, wait)
    run = told.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return sorted(map(tuple, spark.read.schema(feed.TOLD).parquet(f"{path}/out").collect()), key=str), [p["stateOperators"][0] for p in run.recentProgress]


def test_state_is_not_written_run_by_run(spark, tmp_path):
    line = lambda run, seq, kind, hour: json.dumps({"run_id": f"r{run}", "seq": seq, "ts": f"2024-01-01 {hour:02d}:00:00", "type": kind, "text": f"t{seq}"})
    whole, begun = [line(r, 0, "done", 0) for r in range(8000)], [line(r, 0, "answer_delta", 0) for r in range(8000, 16000)]
    again = [line(r, 0, "step", 1) for r in range(0, 8000, 2)]
    ended = [line(r, 1, "done", 1) for r in range(8000, 16000, 2)]
    rows, states = streamed(spark, tmp_path, [whole + begun, again + ended], "2 hours", "9 hours")
    assert len(rows) == 12000 == len({r[0] for r in rows}) and {r[7] for r in rows} == {"", "t0"}
    assert sum(s["numRowsUpdated"] for s in states) < 12000


def test_waiting_runs_expire_at_their_own_time_in_any_zone(spark, tmp_path):
    line = lambda run, seq, hour: json.dumps({"run_id": run, "seq": seq, "ts": f"2024-01-01 {hour:02d}:00:00", "type": "answer_delta", "text": run})
    late = [[line(f"a{k}", 0, k) for k in range(12)], [line("a1", 1, 7), line("b", 0, 8)], [line("clock", 0, 13)], [line("clock", 1, 16)]]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")
        rows, _ = streamed(spark, tmp_path, late, "2 hours", "6 hours")
        want = feed.told(feed.read_events(spark.createDataFrame([(x,) for batch in late for x in batch], "value string")), "2 hours", "6 hours")
        assert rows == sorted(map(tuple, want.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert {r[0] for r in rows} == {f"a{k}" for k in range(8)}


@pytest.mark.parametrize("kind", ["many files", "one time", "none"])
def test_streamed_feed_has_four_batches_of_as_many_files(spark, tmp_path, monkeypatch, kind):
    from marlstone import nested_queries, queries

    monkeypatch.setattr(nested_queries, "LINES", 40)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    middle = events.agg({"ts": "min"}).first()[0]
    changed = {"many files": events, "one time": events.withColumn("ts", F.when(F.col("event_id") % 10 < 7, F.lit(middle)).otherwise(F.col("ts")).cast(events.schema["ts"].dataType)), "none": events.limit(0)}
    changed[kind].coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    table, stream = (sorted(map(tuple, queries.QUERIES[q](spark, str(tmp_path)).collect()), key=str) for q in ("run_feed", "run_feed_streamed"))
    assert table == stream and bool(table) == (kind != "none")
