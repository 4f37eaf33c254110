"""The ledger's operators on streams: dedup, upsert, runs without gain, windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(events: DataFrame, time: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the time that late events may take."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def counts_by_window(events: DataFrame, time: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts of tumbling, or with `slide` of sliding, windows. Works on tables too."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window.alias("window"), *by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *by).agg(F.count("*").alias("n"))


def no_gain_runs(events: DataFrame, task: str, order: str, gain: Column, limit: int = 2) -> DataFrame:
    """(task, order, no_gain_run, blocked): steps since the last gain and whether the task should stop.

    State is one number for each task. Events of one batch are taken in their
    order; an event that comes in a later batch counts when it comes.
    """
    rows = events.select(F.col(task).cast("string").alias("task"), F.col(order).cast("long").alias("step"), F.coalesce(gain, F.lit(False)).alias("gain"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for batch in batches:
            batch = batch.sort_values("step", kind="stable")
            out = []
            for g in batch["gain"]:
                n = 0 if g else n + 1
                out.append(n)
            yield pd.DataFrame({"task": key[0], "step": batch["step"], "no_gain_run": out, "blocked": [x >= limit for x in out]})
        state.update((n,))

    schema = "task string, step long, no_gain_run int, blocked boolean"
    return rows.groupBy("task").applyInPandasWithState(run, schema, "n int", "append", GroupStateTimeout.NoTimeout)


#: Parts of an upserted table, by a hash of the key.
BUCKETS = 64


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The table that upsert_into keeps at path, as of its last batch (or the last one before a number); None before the first."""
    try:
        versions = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if before is not None:
        versions = versions.where(F.col("_version") < before)
    # As many rows as there are parts; only the files that hold them are read.
    last = versions.groupBy("_bucket").agg(F.max("_version").alias("_version"))
    return versions.join(F.broadcast(last), ["_bucket", "_version"]).drop("_version")


def upsert_into(path: str, key: str, order: list[str], columns: list[str]):
    """For foreachBatch: folds a batch into the table at path, by key the last values that are not empty.

    The table lies in BUCKETS parts; a batch writes anew those that hold one of
    its keys, as a version with its number, and reads no others. A batch that is
    run again writes the same version again. current() reads the table.
    """
    from ..operators.ledger import upserted

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(key, *order, *columns).withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).persist()
        try:
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]
            if not touched:
                return
            old = current(spark, path, number)
            both = new if old is None else old.where(F.col("_bucket").isin(touched)).select(*new.columns).unionByName(new)
            latest = both.groupBy("_bucket", key).agg(*(F.max(c).alias(c) for c in order))
            folded = upserted(both, key, order, columns)
            same = F.col(key).eqNullSafe(F.col("_key"))
            kept = folded.withColumnRenamed(key, "_key").join(latest, same).select(key, *order, *columns, "_bucket")
            kept.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/_version={number}")
        finally:
            new.unpersist()

    return fold
