"""Dates as they come in financial tables: 8, 6 or 4 digits, quarters, dashes, CJK marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(c: Column, is_end: bool = False) -> Column:
    """yyyyMMdd of a date in any known spelling, else null.

    Years, months and quarters give their first day or, with is_end, their
    last: the true end of the month.
    """
    s = F.regexp_replace(F.trim(c.cast("string")), "[年月./]", "-")
    s = F.regexp_replace(F.regexp_replace(s, "日", ""), "-$", "")
    full = F.regexp_extract(s, r"^(\d{4})-(\d{1,2})-(\d{1,2})", 0)
    part = lambda k: F.regexp_extract(s, r"^(\d{4})-(\d{1,2})-(\d{1,2})", k)
    month = lambda k: F.regexp_extract(s, r"^(\d{4})-?(\d{1,2})$", k)
    quarter = lambda k: F.regexp_extract(F.upper(s), r"^(\d{4})-?Q([1-4])$", k)

    def span(year: Column, first: Column, months: int) -> Column:
        start = F.try_to_timestamp(
            F.concat(year, F.lpad(first.cast("string"), 2, "0"), F.lit("01")), F.lit("yyyyMMdd")
        )
        day = start.cast("date")
        return F.date_format(F.last_day(F.add_months(day, months - 1)) if is_end else day, "yyyyMMdd")

    return (
        F.when(s.rlike(r"^\d{8}$"), s)
        .when(full != "", F.concat(part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
        .when(quarter(1) != "", span(quarter(1), quarter(2).try_cast("int") * 3 - 2, 3))
        .when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("1231" if is_end else "0101")))
        .when(month(1) != "", span(month(1), month(2), 1))
    )


def month_code(d: Column) -> Column:
    return F.date_format(d, "yyyyMM")


def quarter_code(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def spellings(d: Column) -> Column:
    """A date in five spellings."""
    return F.array(*(F.date_format(d, p) for p in ("yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "yyyy.MM.dd", "MM/dd/yyyy")))


def dates_in(text: Column) -> Column:
    """Dates that a text names, in order."""
    return F.regexp_extract_all(text, F.lit(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\b\d{8}\b"), F.lit(0))


def iso_day(c: Column, is_end: bool = False) -> Column:
    """yyyy-MM-dd of a year, a month, a day or eight digits with anything between, else null.

    A month's last day is its 28th, as the sources that are asked so take it.
    """
    s = F.trim(c.cast("string"))
    digits = F.regexp_replace(s, "[^0-9]", "")
    return (
        F.when(s.rlike(r"^\d{4}$"), F.concat(s, F.lit("-12-31" if is_end else "-01-01")))
        .when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-28" if is_end else "-01")))
        .when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s)
        .when(digits.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))
    )


def clamped(c: Column, last: str) -> Column:
    """A yyyy-MM-dd day, `last` if it is later; the row fails where it is spelled in another way."""
    s = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    fail = F.raise_error(F.concat(F.lit("'"), s, F.lit("' is not in yyyy-mm-dd format"))).cast("string")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.least(s, F.lit(last))).otherwise(fail)


def first_year(c: Column) -> Column:
    """The first four digits in a text, as a number; null without them."""
    return F.regexp_extract(c.cast("string"), r"(\d{4})", 1).try_cast("int")


def year_bounds(start: Column, end: Column, one: Column) -> tuple[Column, Column]:
    """First and last year of a request: its start and end, else its one year; a lone start is the end too."""
    low, high, year = first_year(start), first_year(end), first_year(one)
    first = F.coalesce(low, year)
    return first, F.coalesce(high, year, first)


def period(c: Column) -> Column:
    """yyyy or yyyy-MM out of a year, a month, a day or a text that names a year and perhaps a month; null without one."""
    s = F.trim(c.cast("string"))
    at = lambda k: F.regexp_extract(s, r"((?:19|20)\d{2})(?:[-/.年](\d{1,2}))?", k)
    return (
        F.when(s.rlike(r"^(?:\d{4}|\d{4}-\d{2})$"), s).when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(s, 1, 7))
        .when(at(2) != "", F.concat_ws("-", at(1), F.lpad(at(2), 2, "0"))).when(at(1) != "", at(1))
    )
