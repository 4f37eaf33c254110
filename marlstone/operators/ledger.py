"""Evidence ledgers in batch: fingerprints, upserts, runs without gain, budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def fingerprint(*parts: Column) -> Column:
    """SHA-1 of the parts' texts; nulls are empty."""
    return F.sha1(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))


def deduplicated(df: DataFrame, key: Column, step: str) -> DataFrame:
    """fingerprint, first_seen, last_seen and times: partial sums on each task, then one row each."""
    return df.groupBy(key.alias("fingerprint")).agg(F.min(step).alias("first_seen"), F.max(step).alias("last_seen"), F.count("*").alias("times"))


def upserted(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The last value of each column that is not empty, by key."""
    at = F.struct(*order)
    full = lambda c: F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return df.groupBy(key).agg(*(F.max_by(c, F.when(full(c), at)).alias(c) for c in columns))


def runs_without_gain(df: DataFrame, task: str, order: list[str], gain: Column) -> DataFrame:
    """df with no_gain_run: rows since the task's last gain; a gain is 0. A task may hold most of the rows: it is cut into blocks."""
    return ranks.since_last(df, order, gain, "no_gain_run", [task])


def repeated_calls(df: DataFrame, call: list[str], step: str, most: int = 12) -> DataFrame:
    """Calls made twice or more: count and last step; the most frequent, then the latest, come first."""
    groups = df.groupBy(*call).agg(F.count("*").alias("n"), F.max(step).alias("last_step")).where("n >= 2")
    return groups.orderBy(F.col("n").desc(), F.col("last_step").desc(), *call).limit(most)


def within_budget(df: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows in order until the budget is passed for the first time."""
    return ranks.running_sum(df, order, size, "used", [group]).where(F.col("used") <= budget)


def best_fit(df: DataFrame, group: str, order: list[str], size: str, budget: int, key: str) -> DataFrame:
    """(group, used, key): rows in order, passing over those that do not fit in what is left of the budget.

    Each choice rests on those before it, so a group is one fold, but a
    stream: rows beyond the budget go first, Spark sorts (and spills) the rest
    by group and order, and a task holds one batch of rows and the keys it has
    chosen. Rows without a size go; sizes below 0 count as 0.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.where(F.col(size) <= budget).select(F.col(group).alias("g"), F.greatest(F.col(size).cast("long"), F.lit(0).cast("long")).alias("size"), F.col(key).alias("key"), F.struct(*order).alias("at"))
    rows = rows.repartition("g").sortWithinPartitions("g", "at").select("g", "size", "key")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, started, used = None, False, 0
        for frame in frames:
            taken = []
            for g, n in zip(frame["g"].array, frame["size"].array, strict=True):
                if not started or not (g == now or pd.isna(g) and pd.isna(now)):
                    now, started, used = g, True, 0
                taken.append(used + n <= budget)
                used += n if taken[-1] else 0
            yield frame[taken]

    chosen = rows.mapInPandas(fold, f"g {kinds[group]}, size long, key {kinds[key]}")
    total = F.sum("size").over(Window.partitionBy("g"))
    return chosen.select(F.col("g").alias(group), total.alias("used"), F.col("key").alias(key))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    newest = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def named_apart(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """df with unique_id: a repeated key gets __dup and its number."""
    rows = ranks.placed(df, order, "_n", [key]).withColumn("_n", F.col("_n") - 1)
    return rows.withColumn("unique_id", F.when(F.col("_n") == 0, F.col(key).cast("string")).otherwise(F.format_string("%s__dup%02d_", F.col(key).cast("string"), F.col("_n")))).drop("_n")
