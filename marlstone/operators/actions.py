"""Typed actions and evaluation joins over tables: vintages, parallel arrays, spans, matches, normal forms."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars_from_arrays(rows: DataFrame, key: str, day: str, values: list[str], tail: int | None = None) -> DataFrame:
    """Parallel arrays as rows: one for each place; rows without any value go; the last `tail` days of each key stay."""
    zipped = F.arrays_zip(day, *values)
    held = F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in values))
    out = rows.select(key, F.inline(zipped)).where(held)
    if tail is None:
        return out
    last = Window.partitionBy(key).orderBy(F.col(day).desc())
    return out.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= tail).drop("_n")


def as_known_on(series: DataFrame, keys: list[str], known: str, value: str, day: str) -> DataFrame:
    """A revised series as it was known on a day: of each key the last vintage up to it, by one aggregation."""
    seen = series.where(F.col(known) <= F.lit(day).cast("date"))
    return seen.groupBy(*keys).agg(F.max_by(value, F.struct(known, value)).alias(value), F.max(known).alias("realtime_start"), F.count("*").alias("vintages"))


def spans(series: DataFrame, key: str, day: str) -> DataFrame:
    """A catalogue row for each key from its series alone: first and last day, rows."""
    return series.groupBy(key).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("row_count"))


def adjusted(bars: DataFrame, factors: DataFrame, key: str, day: str, close: str, factor: str) -> DataFrame:
    """Closes by their factor over the key's last one; days without a factor keep their close."""
    last = factors.groupBy(key).agg(F.max_by(factor, day).alias("_last"))
    both = bars.join(factors.select(key, day, factor), [key, day], "left").join(last, key, "left")
    return both.withColumn("adj_close", F.coalesce(F.col(close) * F.col(factor) / F.col("_last"), F.col(close))).drop("_last")


def rubric_results(rubrics: DataFrame, results: DataFrame, task: str, index: str, place: str, value: str) -> DataFrame:
    """rubrics (task, index from 0) with the judge's value of each, null where none counts.

    A result counts at the index that it names, or at its own place (from 0) if
    it names none within the task's rubrics; at each index the first by place
    counts. Results whose place lies outside too do not count.
    """
    sizes = rubrics.groupBy(task).agg(F.count("*").alias("_n"))
    inside = lambda c: (c >= 0) & (c < F.col("_n"))
    named, own = F.col(index).cast("int"), F.col(place).cast("int")
    at = F.when(inside(named), named).when(inside(own), own)
    counted = results.join(sizes, task).withColumn("_at", at).where("_at is not null")
    first = counted.groupBy(task, F.col("_at").alias(index)).agg(F.min_by(value, F.struct(place, value)).alias(value))
    return rubrics.join(first, [task, index], "left")


def best_boxes(wanted: DataFrame, found: DataFrame, ids: list[str], doc: str, page: str, keys: list[str], box: str, iou: Callable[[Column, Column], Column]) -> DataFrame:
    """(ids, doc, score): how well the best found box of its document overlaps each wanted one; 0.0 where there is none.

    Boxes of the same page come first: others count only where the page has
    none. Among those that are left, boxes with the same keys (nulls are equal)
    come first. ids name a wanted box.
    """
    other = found.select(F.col(doc).alias("_doc"), F.col(page).alias("_page"), *(F.col(k).alias(f"_{k}") for k in keys), F.col(box).alias("_box"))
    same_page = F.col(page).eqNullSafe(F.col("_page"))
    on_page = wanted.join(other, (F.col(doc) == F.col("_doc")) & same_page)
    lone = wanted.join(other, (F.col(doc) == F.col("_doc")) & same_page, "left_anti").join(other, F.col(doc) == F.col("_doc"))
    keyed = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_{k}")), keys, F.lit(True))
    # Plain numbers, which are aggregated by hash and not by sorting; boxes without a pair come in as rows of their own, not by another join.
    pairs = on_page.unionByName(lone).select(*ids, doc, keyed.alias("_keyed"), iou(F.col(box), F.col("_box")).alias("_score"))
    alone = wanted.select(*ids, doc, F.lit(None).cast("boolean").alias("_keyed"), F.lit(None).cast("double").alias("_score"))
    best = pairs.unionByName(alone).groupBy(*ids, doc).agg(F.max("_keyed").alias("_keyed"), F.max(F.when(F.col("_keyed"), F.col("_score"))).alias("_first"), F.max("_score").alias("_any"))
    score = F.when(F.col("_keyed"), F.col("_first")).otherwise(F.col("_any"))
    return best.select(*ids, doc, F.coalesce(score, F.lit(0.0)).alias("score"))


def macro(per_label: DataFrame) -> DataFrame:
    """One row: the plain means of precision, recall and f1 over labels, and the rows they stand for."""
    return per_label.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))


#: States of a claim that stand against another.
AGAINST = ("conflict", "conflicting", "alternative", "rejected", "superseded", "reopened")


def top_two(rows: DataFrame, key: str, score: str, step: str, status: str) -> DataFrame:
    """Of each key the best row and one more: the best of those in a state of AGAINST, or else the next; place is 1 or 2.

    Better is the higher score, then the later step, which is unique in a key.
    Three aggregations of one row a key; no key is sorted as a whole.
    """
    at, row = F.struct(score, step), F.struct(*rows.columns)
    best = rows.groupBy(key).agg(F.max_by(row, at).alias("_best"))
    behind = rows.join(best.select(F.col(key).alias("_k"), "_best"), F.col(key).eqNullSafe(F.col("_k"))).where((F.col(score) < F.col("_best")[score]) | (F.col(step) < F.col("_best")[step]) & F.col(score).eqNullSafe(F.col("_best")[score]))
    against = F.lower(F.coalesce(F.col(status), F.lit(""))).isin(*AGAINST)
    second = behind.groupBy(key).agg(F.coalesce(F.max_by(row, F.when(against, at)), F.max_by(row, at)).alias("_second"))
    return best.select("_best.*", F.lit(1).alias("place")).unionByName(second.select("_second.*", F.lit(2).alias("place")))


#: Words of a query that say nothing, and the short names of months.
STOP = ("and", "for", "from", "in", "of", "the", "to", "with")
SHORT_MONTHS = {
    "january": "jan", "february": "feb", "march": "mar", "april": "apr", "june": "jun", "july": "jul",
    "august": "aug", "september": "sep", "october": "oct", "november": "nov", "december": "dec",
}


def row_terms(query: str) -> list[str]:
    """What is looked for in rows: the query's words of two signs or more, months also in short."""
    words = [w for w in re.findall(r"[a-z0-9一-鿿]+", query.lower()) if len(w) > 1 and w not in STOP]
    return list(dict.fromkeys(t for w in words for t in (w, SHORT_MONTHS.get(w)) if t))


def matches_first(rows: DataFrame, text: Column, query: str, order: str, n: int) -> DataFrame:
    """n rows with hits and place: first those that hold two terms of the query (or its only one), most hits first; then the others.

    A number must be a whole word of the row, other terms may be part of one. Ties and the others are by order.
    """
    terms, held = row_terms(query), F.lower(text)
    words = F.regexp_extract_all(held, F.lit("([a-z0-9一-鿿]+)"))
    hits = sum((F.coalesce(F.array_contains(words, t) if t.isdigit() else held.contains(t), F.lit(False)).cast("int") for t in terms), F.lit(0))
    scored = rows.withColumn("hits", F.when(hits >= min(2, len(terms)) if terms else F.lit(False), hits).otherwise(0))
    by = [F.col("hits").desc(), F.col(order)]
    return scored.orderBy(*by).limit(n).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*by)))  # n rows


def last_distinct(rows: DataFrame, key: str, value: str, order: str, most: int) -> DataFrame:
    """The last `most` distinct values of each key, by when they were last seen."""
    seen = rows.groupBy(key, value).agg(F.max(order).alias("seen"))
    recent = Window.partitionBy(key).orderBy(F.col("seen").desc())
    return seen.withColumn("place", F.row_number().over(recent)).where(F.col("place") <= most)


def from_containers(json: list[Column], path: str) -> Column:
    """The first value that is not empty at a path of several JSON texts."""
    values = [F.get_json_object(j, path) for j in json]
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values))


def humanised(c: Column) -> Column:
    """CamelCase as words."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z])([A-Z][a-z])", "$1 $2"))


def role(c: Column) -> Column:
    """The usual names of who speaks; what is unknown speaks as the user."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("assistant", "gpt", "bot", "model"), "assistant").when(low.isin("system", "developer"), "system").when(low.isin("tool", "function", "observation"), "tool").otherwise("user")


def rounded(c: Column, mode: str) -> Column:
    """A number as text: floor, ceil, nearest, or fixed0 to fixed4 decimals, halves away from zero."""
    if mode in ("floor", "ceil"):
        return (F.floor(c) if mode == "floor" else F.ceil(c)).cast("string")
    places = 0 if mode == "nearest" else int(mode.removeprefix("fixed"))
    return F.round(c.cast("decimal(38,10)"), places).cast(f"decimal(38,{places})").cast("string")
