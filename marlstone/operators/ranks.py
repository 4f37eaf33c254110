"""Exact places, running sums and orders over whole tables, by range partitions and their offsets.

Rows are dealt out by range and sorted within each partition, so a partition
is a block of the global order. Blocks are counted, and a block's offset is the
sum of those before it: as many numbers as there are blocks, whatever the
table holds. No window spans more than one block, also where one group has
most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import staged

#: Places within a block lie in the low bits of Spark's increasing ids.
PLACE = (1 << 33) - 1


def blocks(df: DataFrame, order: list[str], descending: bool = False, parts: int | None = None) -> DataFrame:
    """df in blocks of its order, staged: _block, and _place within it from 0.

    The order should be total: rows that tie in all of it share a block. Nulls
    come first, or last if descending.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).desc() if descending else F.col(c) for c in order]
    dealt = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    placed = dealt.withColumns({"_block": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit(PLACE))})
    return staged(placed.drop("_id"), "blocks")


def _with(rows: DataFrame, other: DataFrame, group: list[str]) -> DataFrame:
    """rows joined with what is known of each group's part of a block; null groups are groups."""
    names = [f"_g{i}" for i in range(len(group))]
    renamed = other.select(*(F.col(g).alias(n) for g, n in zip(group, names, strict=True)), F.col("_block").alias("_b"), *(c for c in other.columns if c not in (*group, "_block")))
    same = F.col("_block") == F.col("_b")
    for g, n in zip(group, names, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(n))
    return rows.join(renamed, same).drop("_b", *names)


def _before(group: list[str]) -> Window:
    """The blocks of a group before this one."""
    return Window.partitionBy(*(group or [F.lit(1)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _within(group: list[str]) -> Window:
    return Window.partitionBy(*group, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)


def placed(df: DataFrame, order: list[str], out: str, group: list[str] | None = None, descending: bool = False) -> DataFrame:
    """df with out (long): a row's place from 1 in the order, within its group if one is named.

    Ties are told apart, in no stated way: name a total order. Null groups are
    a group; an empty table stays empty.
    """
    group = group or []
    rows = blocks(df, [*group, *order], descending)
    sizes = rows.groupBy(*group, "_block").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    starts = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(_before(group)), F.lit(0)) - F.col("_first") + 1).drop("_n", "_first")
    return _with(rows, starts, group).withColumn(out, F.col("_place") + F.col("_offset")).drop("_block", "_place", "_offset")


def running_sum(df: DataFrame, order: list[str], value: str, out: str, group: list[str] | None = None) -> DataFrame:
    """df with out: the sum of value over the rows up to this one in its group; nulls add nothing."""
    group = group or []
    rows = blocks(df, [*group, *order])
    sums = rows.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    starts = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(_before(group)), F.lit(0))).drop("_sum")
    upto = F.coalesce(F.sum(value).over(_within(group)), F.lit(0)) + F.col("_offset")
    return _with(rows, starts, group).withColumn(out, upto).drop("_block", "_place", "_offset")


def since_last(df: DataFrame, order: list[str], mark: Column, out: str, group: list[str] | None = None) -> DataFrame:
    """df with out (int): rows since the group's last marked one, 0 at a mark; before the first mark, rows so far. Null is no mark."""
    group = group or []
    rows = blocks(df.withColumn("_mark", F.coalesce(mark, F.lit(False))), [*group, *order])
    at = F.when(F.col("_mark"), F.col("_place"))
    parts = rows.groupBy(*group, "_block").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"), F.max(at).alias("_last"))
    # Places in the group, from 1: of the block's first row less one, and of the last mark before the block.
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_n").over(_before(group)), F.lit(0)) - F.col("_first") + 1)
    parts = parts.withColumn("_carried", F.coalesce(F.max(F.col("_last") + F.col("_offset")).over(_before(group)), F.lit(0))).drop("_n", "_first", "_last")
    last = F.coalesce(F.max(at).over(_within(group)) + F.col("_offset"), F.col("_carried"))
    run = (F.col("_place") + F.col("_offset") - last).cast("int")
    return _with(rows, parts, group).withColumn(out, run).drop("_mark", "_block", "_place", "_offset", "_carried")


def epoch_order(df: DataFrame, key: str, sizes: list[str], bucket: int, seed: str, epoch: int = 0) -> DataFrame:
    """df with bucket and position (both from 0): buckets of `bucket` rows by size, shuffled inside and among themselves.

    Rows are ranked by sizes and key and cut into buckets; the last may be
    smaller. A hash of seed, epoch and bucket orders the buckets, one of seed,
    epoch and key the rows within, so another epoch has another order and a
    rerun the same. key must be unique.
    """
    rows = placed(df, [*sizes, key], "_rank")
    rows = rows.withColumn("bucket", F.expr(f"(_rank - 1) div {int(bucket)}"))
    drawn = lambda c: F.md5(F.concat_ws("|", F.lit(seed), F.lit(str(epoch)), F.col(c).cast("string")))
    rows = rows.withColumns({"_hb": drawn("bucket"), "_hr": drawn(key)})
    out = placed(rows, ["_hb", "bucket", "_hr", key], "position")
    return out.withColumn("position", F.col("position") - 1).drop("_rank", "_hb", "_hr")
