"""The operations of a plan on rows, each from a DataFrame to a DataFrame.

`ties` are the columns that settle equal values; together they should be
unique, so that ranks and limits are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import number, percent_change

#: Spellings of tests.
ALIASES = {
    ">": "gt", "greater_than": "gt", ">=": "ge", "gte": "ge", "<": "lt", "less_than": "lt", "<=": "le", "lte": "le",
    "!=": "ne", "not_equal": "ne", "like": "contains",
}


def matches(c: Column, operator: str, value, legacy_nulls: bool = False) -> Column:
    """Whether a value passes a test, always true or false.

    Comparisons are of numbers, or of dates where the value is no number but a
    date; what reads as neither fails. Equality is of numbers where both are
    such, else of texts. With legacy_nulls a null reads as "None".
    """
    op = ALIASES.get(operator, operator)
    a, b = number(c.cast("string")), number(F.lit(value).cast("string"))
    text, want = c.cast("string"), F.lit(str(value))
    if op in ("gt", "ge", "lt", "le"):
        day, day_wanted = text.try_cast("date"), want.try_cast("date")
        test = {"gt": "__gt__", "ge": "__ge__", "lt": "__lt__", "le": "__le__"}[op]
        found = F.when(b.isNotNull(), getattr(a, test)(b)).otherwise(getattr(day, test)(day_wanted))
    elif op == "contains":
        found = F.lower(F.coalesce(text, F.lit("None")) if legacy_nulls else text).contains(str(value).lower())
    else:
        equal = F.when(a.isNotNull() & b.isNotNull(), a == b).otherwise(F.coalesce(text, F.lit("None")) == want)
        found = ~equal if op == "ne" else equal
    return F.coalesce(found, F.lit(False))


def filtered(df: DataFrame, field: str, operator: str, value, **options) -> DataFrame:
    return df.where(matches(F.col(field), operator, value, **options))


def sort_order(field: str, descending: bool, ties: list[str]) -> list[Column]:
    """Numbers before texts going up, texts (nulls as empty) before numbers going down."""
    c = F.col(field)
    n = number(c.cast("string"))
    text = F.when(n.isNull(), F.coalesce(c.cast("string"), F.lit("")))
    blank = F.when(text == "", F.lit(1)).otherwise(0)
    if descending:
        return [n.isNull().desc(), text.desc_nulls_last(), n.desc_nulls_last(), *map(F.col, ties)]
    return [n.isNull().asc(), blank.asc(), text.asc_nulls_first(), n.asc_nulls_last(), *map(F.col, ties)]


def ordered(df: DataFrame, field: str, descending: bool = False, ties: list[str] | None = None) -> DataFrame:
    return df.orderBy(*sort_order(field, descending, ties or []))


def ranked(df: DataFrame, field: str, top: int = 10, descending: bool = True, ties: list[str] | None = None, drop_missing: bool = False) -> DataFrame:
    """The first `top` rows with rank 1, 2, ...; values that are no numbers come last, or go.

    Each task keeps its own first rows, so only those meet for the ranks.
    """
    n = number(F.col(field).cast("string"))
    order = [n.desc_nulls_last() if descending else n.asc_nulls_last(), *map(F.col, ties or [])]
    first = (df.where(n.isNotNull()) if drop_missing else df).orderBy(*order).limit(top)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def extreme(df: DataFrame, field: str, largest: bool, top: int = 10, ties: list[str] | None = None) -> DataFrame:
    out = ranked(df, field, top, largest, ties, drop_missing=True)
    return out.withColumns({"selected_by": F.lit(field), "selection_op": F.lit("max_by" if largest else "min_by")})


def change_by_row(df: DataFrame, column: str, output: str, symbol: str = "symbol_key", day: str = "date", as_ratio: bool = False) -> DataFrame:
    """The change from the symbol's last row that has a number."""
    before = Window.partitionBy(symbol).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    n = number(F.col(column).cast("string"))
    last = F.last(n, ignorenulls=True).over(before)
    return df.withColumn(output, F.when(last != 0, n / last - 1) if as_ratio else percent_change(n, last))


def change_between(df: DataFrame, start: str, end: str, output: str) -> DataFrame:
    return df.withColumn(output, percent_change(number(F.col(end).cast("string")), number(F.col(start).cast("string"))))


def aggregated(df: DataFrame, function: str, field: str | None, input_rows: DataFrame | None = None) -> DataFrame:
    """One row: aggregate_function, field, value, input_rows, non_null_rows.

    Only numbers count, but `count` counts all rows; sums of none are 0 and
    other functions of none null. input_rows: the rows at the plan's start.
    """
    n = number(F.col(field).cast("string")) if field else F.lit(None).cast("double")
    value = {
        "sum": F.coalesce(F.sum(n), F.lit(0.0)), "mean": F.avg(n), "avg": F.avg(n), "average": F.avg(n),
        "min": F.min(n), "minimum": F.min(n), "max": F.max(n), "maximum": F.max(n),
    }.get(function, F.count("*").cast("double"))
    out = df.agg(value.alias("value"), F.count(n).alias("non_null_rows"), F.count("*").alias("_rows"))
    if input_rows is None:
        out = out.withColumnRenamed("_rows", "input_rows")
    else:  # one row each
        out = out.drop("_rows").join(F.broadcast(input_rows.agg(F.count("*").alias("input_rows"))), F.lit(True))
    return out.withColumns({"aggregate_function": F.lit(function), "field": F.lit(field or "")})


def left_merge(left: DataFrame, right: DataFrame, keys: list[str], last: str) -> DataFrame:
    """Left join in which left values win and of equal right keys the last row by `last` counts."""
    newest = Window.partitionBy(*keys).orderBy(F.col(last).desc())
    one = right.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    extra = [c for c in one.columns if c not in left.columns]
    return left.join(one.select(*keys, *extra), keys, "left")


def expand_merge(left: DataFrame, right: DataFrame, key: str, first: str) -> DataFrame:
    """Right outer join in which right values win and of equal left keys the first row by `first` counts."""
    oldest = Window.partitionBy(key).orderBy(F.col(first))
    one = left.withColumn("_n", F.row_number().over(oldest)).where("_n = 1").drop("_n")
    extra = [c for c in one.columns if c not in right.columns]
    return right.join(one.select(key, *extra), key, "left")
