"""Samples, splits and mixtures by hashes of ids: the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, *ids: str) -> Column:
    """A place in a random order."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(c).cast("string") for c in ids)))


#: Hash digits that part a random order into blocks, each small enough to be ranked by one task.
DIGITS = 3


def ranked(df: DataFrame, group: list[str], key: str, out: str) -> DataFrame:
    """df with out: a row's place from 1 in the order of (_h, key) within its group.

    Blocks of the hash are counted first, so that a group with most of the
    rows is ranked by thousands of tasks, not by one.
    """
    rows = df.withColumn("_block", F.left(F.col("_h"), F.lit(DIGITS)))
    upto = Window.partitionBy(*(group or [F.lit(1)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*group, "_block").agg(F.count("*").alias("_size")).withColumn("_before", F.coalesce(F.sum("_size").over(upto), F.lit(0)))
    starts = sizes.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_block").alias("_b"), "_before")
    same = F.col("_block") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*group, "_block").orderBy("_h", key)
    placed = rows.withColumn(out, F.row_number().over(within)).join(starts, same).withColumn(out, F.col(out) + F.col("_before"))
    return placed.drop("_block", "_b", "_before", *(f"_g{i}" for i in range(len(group))))


def stratified(df: DataFrame, stratum: str, n: int, seed: str, key: str) -> DataFrame:
    """n rows: equal quotas, the first strata in order get the remainder, gaps are filled from what is left over."""
    strata = df.groupBy(stratum).agg(F.count("*").alias("_size"))
    order = Window.partitionBy(F.lit(1)).orderBy(stratum)
    k = F.count("*").over(Window.partitionBy(F.lit(1)))
    quota = strata.withColumn("_i", F.row_number().over(order) - 1).withColumn("_k", k)
    quota = quota.withColumn("_quota", (F.floor(F.lit(n) / F.col("_k")) + F.when(F.col("_i") < F.lit(n) % F.col("_k"), 1).otherwise(0)).cast("int"))
    rows = df.withColumn("_h", draw(seed, key)).join(quota.select(F.col(stratum).alias("_s"), "_quota"), F.col(stratum) == F.col("_s"))
    # Nobody past n in a stratum can be chosen: each task keeps its own first n.
    first = Window.partitionBy(stratum).orderBy("_h", key)
    rows = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= n)
    over = F.when(F.col("_r") > F.col("_quota"), 1).otherwise(0)
    out = rows.withColumn("_over", over).orderBy("_over", "_h", key).limit(n)
    return out.drop("_h", "_s", "_quota", "_r", "_over")


def reservoir(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    return df.withColumn("_h", draw(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def split(df: DataFrame, group: str, share: float, seed: str) -> DataFrame:
    """df with is_eval: whole groups, round(share * groups) of them, at least one and not all; a lone group trains."""
    groups = df.select(group).distinct().withColumn("_h", draw(seed, group))
    n = groups.count()
    k = min(max(1, round(n * share)), n - 1) if n > 1 else 0
    chosen = ranked(groups, [], group, "_r").where(F.col("_r") <= k).select(F.col(group).alias("_g"))
    return df.join(chosen.withColumn("is_eval", F.lit(True)), F.col(group) == F.col("_g"), "left").drop("_g").na.fill(False, ["is_eval"])


def allocation(weights: DataFrame, total: int, name: str, weight: str) -> DataFrame:
    """Whole shares of total by weight: floors, and one more for the largest remainders."""
    every = Window.partitionBy(F.lit(1))
    exact = F.lit(float(total)) * F.col(weight) / F.sum(weight).over(every)
    rows = weights.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("long"))
    left = F.lit(total) - F.sum("_floor").over(every)
    place = F.row_number().over(every.orderBy((F.col("_exact") - F.col("_floor")).desc(), name))
    return rows.withColumn("share", (F.col("_floor") + F.when(place <= left, 1).otherwise(0)).cast("long")).drop("_exact", "_floor")


def mixture(df: DataFrame, source: str, key: str, shares: DataFrame, seed: str) -> DataFrame:
    """As many rows of each source as `share` says, each row repeated as evenly as it takes."""
    sizes = df.groupBy(source).agg(F.count("*").alias("_n"))
    plan = sizes.join(shares.select(F.col(source).alias("_s"), "share"), F.col(source) == F.col("_s")).select("_s", "_n", "share")
    rows = ranked(df.withColumn("_h", draw(seed, key)), [source], key, "_r").join(plan, F.col(source) == F.col("_s"))
    times = F.floor(F.col("share") / F.col("_n")) + F.when(F.col("_r") <= F.col("share") % F.col("_n"), 1).otherwise(0)
    rows = rows.withColumn("_times", times.cast("int")).where("_times > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_s", "_n", "share", "_r", "_times", "_h")


def bucketed(df: DataFrame, value: str, limits: dict[str, int], beyond: str) -> DataFrame:
    """df with bucket: the first whose limit is not passed."""
    name = F.lit(beyond)
    for k, most in sorted(limits.items(), key=lambda p: -p[1]):
        name = F.when(F.col(value) <= most, k).otherwise(name)
    return df.withColumn("bucket", name)
