"""The feed of a run's events (steps, answer deltas, its end) as keyed state with timers.

Events of one run carry a number `seq` from 0 and come in any order, late or
more than once. A run is told once: when all events up to its end are there,
or when the time of the stream has passed its last event by `wait`; then what
is missing is counted and the run is told as expired. The end is the first
`done` or `error`; what a run numbers behind it does not count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..shared import staged

#: One line of JSON each. type: step (step_id, status), answer_delta (text is the piece), done or error (text is the message).
EVENT = "run_id string, seq long, ts timestamp, type string, step_id string, status string, text string"
TYPES = ("step", "answer_delta", "done", "error")
TOLD = "run_id string, outcome string, events long, missing long, steps long, complete long, last_step string, answer string, message string"
NAMES = [f.split()[0] for f in TOLD.split(", ")]
#: What the processor takes of an event; at is ts in milliseconds, NO_TIME if it has none.
COLUMNS = ["run_id", "seq", "at", "type", "step_id", "status", "text"]
NO_TIME = -(1 << 63)


def read_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """EVENT's columns from lines of JSON; lines that are no JSON, name no run, have no number or another type go."""
    parsed = lines.select(F.from_json(value, EVENT).alias("e")).select("e.*")
    return parsed.where(F.col("run_id").isNotNull() & (F.col("seq") >= 0) & F.col("type").isin(*TYPES))


def told(events: DataFrame, late: str, wait: str) -> DataFrame:
    """TOLD's columns of a table of events: the runs that the stream tells once it has read it all.

    Events of one number count once, the least by type and texts. Runs that are
    not complete are told as expired if the table's last time less `late` has
    passed their own last time plus `wait`, and not at all before. steps are
    told apart by step_id; a step has the status of its last event, and
    last_step is the one that began last. A missing text is empty.
    """
    one = F.struct("type", *(F.coalesce(c, F.lit("")).alias(c) for c in ("step_id", "status", "text")))
    once = events.groupBy("run_id", "seq").agg(F.min(one).alias("e"), F.max("ts").alias("ts")).select("run_id", "seq", "ts", "e.*")
    # Written once: it is read for the ends, for each of the two sums and for the table's last time.
    once = staged(once, "events-once")
    ending = F.when(F.col("type").isin("done", "error"), F.col("seq"))
    ends = once.groupBy("run_id").agg(F.min(ending).alias("end"), F.max("ts").alias("last"), F.min_by(F.struct("type", "text"), ending).alias("said"))
    rows = once.join(ends, "run_id").where("end is null or seq <= end")
    steps = rows.where("type = 'step'").groupBy("run_id", "step_id").agg(F.min("seq").alias("first"), F.max_by("status", "seq").alias("status"))
    steps = steps.groupBy("run_id").agg(F.count("*").alias("steps"), F.count_if(F.col("status") == "complete").alias("complete"), F.max_by("step_id", "first").alias("last_step"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("type") == "answer_delta", F.struct("seq", "text"))))
    runs = rows.groupBy("run_id", "end", "last", "said").agg(F.count("*").alias("events"), F.max("seq").alias("most"), F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("answer"))
    runs = runs.withColumn("missing", F.coalesce("end", "most") + 1 - F.col("events"))
    full = F.col("end").isNotNull() & (F.col("missing") == 0)
    now = once.agg(F.max("ts").alias("now"))
    timed = runs.join(F.broadcast(now), F.lit(True))  # one row
    timed = timed.where(full | (F.col("now") - F.expr(f"INTERVAL {late}") > F.col("last") + F.expr(f"INTERVAL {wait}")))
    both = timed.withColumn("outcome", F.when(full, F.col("said.type")).otherwise("expired")).join(steps, "run_id", "left")
    return both.withColumn("message", F.col("said.text")).na.fill(0, ["steps", "complete"]).select(*NAMES)


class Runs(StatefulProcessor):
    """Keeps the events of a shard's runs by number until each is told, and after that only that it was.

    A call of the state is a message to the JVM and back, so a batch reads and
    writes a shard's open runs together, as JSON in pieces of PIECE events. The
    names of told runs lie in BUCKETS by a hash; a batch reads those that its
    new runs fall into. One timer a shard stands for the run that expires first.
    """

    PIECE = 10_000
    BUCKETS = 16

    def __init__(self, wait_ms: int):
        self.wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "piece string")
        self.told = handle.getMapState("told", "bucket long", "runs string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs, past, whole = self._read(), {}, {}
        for frame in rows:
            for run, seq, at, *event in frame[COLUMNS].itertuples(index=False, name=None):
                if run not in runs and (run in whole or run in self._past(run, past)):
                    continue
                # The number of its end, its last time, its events.
                state = runs.setdefault(run, [None, NO_TIME, {}])
                state[1] = max(state[1], at)
                end, _, events = state
                if end is not None and seq > end or seq in events:
                    continue
                events[seq] = event
                if event[0] in ("done", "error"):
                    state[0] = end = seq
                    state[2] = events = {k: v for k, v in events.items() if k <= end}
                if end is not None and len(events) == end + 1:
                    whole[run] = runs.pop(run)
        yield from self._tell(whole, past)
        self._write(runs)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, now = self._read(), timerValues.getCurrentWatermarkInMs()
        self.timer.clear()  # It goes by itself once it has fired; the next lies behind now.
        late = {run: runs.pop(run) for run, (_, at, _) in list(runs.items()) if at != NO_TIME and at + self.wait < now}
        yield from self._tell(late, {})
        self._write(runs)

    def _read(self) -> dict[str, list]:
        runs: dict[str, list] = {}
        for (piece,) in self.open.get():
            for run, end, at, seq, *event in json.loads(piece):
                runs.setdefault(run, [end, at, {}])[2][seq] = event
        return runs

    def _write(self, runs: dict[str, list]) -> None:
        rows = [(run, end, at, seq, *event) for run, (end, at, events) in runs.items() for seq, event in events.items()]
        self.open.clear()
        for i in range(0, len(rows), self.PIECE):
            self.open.appendValue((json.dumps(rows[i : i + self.PIECE]),))
        first = min((at for _, at, _ in runs.values() if at != NO_TIME), default=None)
        # A timer fires at its time, but a run expires only once that has passed.
        before, then = self.timer.get(), None if first is None else (first + self.wait + 1,)
        if before and before != then:
            self.handle.deleteTimer(before[0])
            self.timer.clear()
        if then and before != then:
            self.handle.registerTimer(then[0])
            self.timer.update(then)

    def _past(self, run: str, past: dict[int, set[str]]) -> set[str]:
        """The told runs of a run's bucket, read once a batch into past."""
        bucket = crc32(run.encode()) % self.BUCKETS
        if bucket not in past:
            kept = self.told.getValue((bucket,))
            past[bucket] = set(json.loads(kept[0])) if kept else set()
        return past[bucket]

    def _tell(self, runs: dict[str, list], past: dict[int, set[str]]) -> Iterator[pd.DataFrame]:
        for run in runs:
            self._past(run, past).add(run)
        for bucket in {crc32(run.encode()) % self.BUCKETS for run in runs}:
            self.told.updateValue((bucket,), (json.dumps(list(past[bucket])),))
        if runs:
            yield pd.DataFrame([told_run(run, end, events) for run, (end, _, events) in runs.items()], columns=NAMES)

    def close(self) -> None:
        pass


def told_run(run: str, end: int | None, held: dict[int, list]) -> tuple:
    """TOLD's columns of one run: its end's number, if there is one, and its events up to there by number."""
    events = sorted((k, *v) for k, v in held.items())
    steps: dict[str, str] = {}
    for _, kind, step, status, _ in events:
        if kind == "step":
            steps[step] = status
    missing = (events[-1][0] if end is None else end) + 1 - len(events)
    outcome = "expired" if end is None or missing else events[-1][1]
    answer = "".join(text for _, kind, _, _, text in events if kind == "answer_delta")
    complete = sum(s == "complete" for s in steps.values())
    return run, outcome, len(events), missing, len(steps), complete, next(reversed(steps), None), answer, None if end is None else events[-1][4]


def milliseconds(spark: SparkSession, duration: str) -> int:
    return spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {duration})").first()[0]


def telling(events: DataFrame, late: str, wait: str, shards: int = 256) -> DataFrame:
    """A stream of EVENT's columns as a stream of TOLD's: the same rows as told() gives for all its events.

    Events more than `late` behind the stream's time are dropped by it, and a
    stream's time has whole milliseconds. Needs
    the RocksDB state store, which this sets for the session. A told run leaves
    one flag behind, so that repeats of its events stay without effect. Runs
    are dealt out to `shards` by a hash; a shard's open runs are read together
    in each batch that has an event of theirs, and one task holds them. More
    shards suit small batches and more open runs; a checkpoint keeps to its own.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("step_id", "status", "text")}
    at = F.coalesce(F.unix_millis("ts"), F.lit(NO_TIME))
    timed = events.withWatermark("ts", late).withColumns(texts | {"at": at, "shard": F.pmod(F.xxhash64("run_id"), F.lit(shards))})
    runs = Runs(milliseconds(spark, wait))
    return timed.groupBy("shard").transformWithStateInPandas(statefulProcessor=runs, outputStructType=TOLD, outputMode="append", timeMode="eventTime")
