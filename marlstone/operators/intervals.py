"""Joins of days with spans of validity, as equality joins on dyadic blocks of days.

A span of days is the union of at most two blocks of each size 1, 2, 4 and so
on (aligned, as in a segment tree); a day lies in one block of each size. So a
span makes some dozens of keys however long it lasts, a day as many as there
are sizes, and whoever meets on (key, size, block) truly overlaps: there is no
range condition left and no pair is found twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sizes of blocks, as powers of two: the longest has 65,536 days. Days count from EPOCH, spans are cut to what LEVELS reach.
LEVELS = 17
EPOCH, DAYS = "1900-01-01", 1 << (LEVELS - 1)


def _day(c: Column) -> Column:
    return F.datediff(c, F.lit(EPOCH).cast("date"))


def span_blocks(start: Column, end: Column) -> Column:
    """The aligned blocks (level, block) that make up the days from start to before end; none for an empty or null span.

    A null end never comes. Days outside the 65,536 from EPOCH are left out.
    """
    a = F.greatest(_day(start), F.lit(0))
    b = F.least(F.coalesce(_day(end), F.lit(DAYS)), F.lit(DAYS))
    found = []
    for level in range(LEVELS):
        size = 1 << level
        # Rounded up to this level's blocks from the left, down from the right; what the next level would take is left to it.
        low, high = F.ceil(a / size).cast("int"), F.floor(b / size).cast("int")
        top = level == LEVELS - 1
        left = F.when((low < high) & (F.lit(top) | (low % 2 == 1)), low)
        right = F.when((low < high) & F.lit(not top) & (high % 2 == 1), high - 1)
        found += [F.struct(F.lit(level).alias("level"), x.alias("block")) for x in (left, right)]
    return F.when(start.isNotNull(), F.filter(F.array(*found), lambda s: s["block"].isNotNull()))


def day_blocks(day: Column) -> Column:
    """The block of each level that a day lies in; none for a null day or one out of reach."""
    d = _day(day)
    own = F.array(*(F.struct(F.lit(k).alias("level"), F.floor(d / (1 << k)).cast("int").alias("block")) for k in range(LEVELS)))
    return F.when((d >= 0) & (d < DAYS), own)


def valid_on(days: DataFrame, spans: DataFrame, keys: list[str], day: str, start: str, end: str) -> DataFrame:
    """days joined with the spans of the same keys that hold on the day: start <= day < end, a null end being open.

    An inner join: days without a span go, several spans give several rows.
    Null keys never meet. Columns of the two sides must differ but for keys.
    """
    left = days.withColumn("_b", F.explode(day_blocks(F.col(day)))).select(*days.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
    right = spans.withColumn("_b", F.explode(span_blocks(F.col(start), F.col(end)))).select(*spans.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
    return left.join(right, [*keys, "_level", "_block"]).drop("_level", "_block")


def vintages(series: DataFrame, keys: list[str], known: str, value: str) -> DataFrame:
    """(keys, value, valid_from, valid_to): a revised series as spans; each vintage holds until the next, the last stays open.

    Of vintages of one day the greatest value counts. Rows without a day go.
    """
    days = series.where(F.col(known).isNotNull()).groupBy(*keys, F.col(known).alias("valid_from")).agg(F.max(value).alias(value))
    following = F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from"))
    return days.withColumn("valid_to", following).select(*keys, value, "valid_from", "valid_to")


def latest_on(days: DataFrame, spans: DataFrame, keys: list[str], day: str, start: str, end: str) -> DataFrame:
    """valid_on() for spans of a key that do not overlap, as vintages are: the last one that began by the day, if it still holds.

    Days and spans of a key are read in one order, each once; a long key is sorted and spilled, not held.
    """
    own, more = [c for c in days.columns if c not in keys], [c for c in spans.columns if c not in keys]
    known = reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))
    left = days.where(known & F.col(day).isNotNull()).select(*keys, F.col(day).alias("_at"), F.lit(1).alias("_asks"), F.struct(*own).alias("_day"))
    right = spans.where(known & F.col(start).isNotNull()).select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_asks"), F.struct(*more).alias("_span"))
    upto = Window.partitionBy(*keys).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_span", F.last("_span", ignorenulls=True).over(upto))
    held = both.where("_asks = 1 and _span is not null").where(F.col("_span")[end].isNull() | (F.col("_at") < F.col("_span")[end]))
    return held.select(*keys, *(F.col("_day")[c].alias(c) for c in own), *(F.col("_span")[c].alias(c) for c in more))
