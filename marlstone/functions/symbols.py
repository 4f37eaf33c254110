"""Security codes: exchange suffixes and normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def equity(c: Column) -> Column:
    """A six-digit code with its exchange: 6 and 9 Shanghai, 0, 2 and 3 Shenzhen, 4 and 8 Beijing; others as they are."""
    s = F.upper(F.trim(c))
    digits = F.regexp_extract(s, r"^(?:SH|SZ|BJ)?(\d{6})(?:\.(?:SH|SS|SZ|BJ))?$", 1)
    suffix = F.when(digits.rlike("^[69]"), ".SH").when(digits.rlike("^[023]"), ".SZ").when(digits.rlike("^[48]"), ".BJ").otherwise("")
    return F.when(digits != "", F.concat(digits, suffix)).otherwise(s)


def index(c: Column) -> Column:
    """Index codes: 399, 159 and 16 Shenzhen; 000, 50, 51, 88 and 93 Shanghai; others as equities."""
    s = F.trim(c)
    return F.when(s.rlike(r"^(399|159|16)\d*$"), F.concat(s, F.lit(".SZ"))).when(s.rlike(r"^(000|50|51|88|93)\d*$"), F.concat(s, F.lit(".SH"))).otherwise(equity(s))


def fund(c: Column) -> Column:
    s = F.trim(c)
    return F.when(s.rlike(r"^[56]\d{5}$"), F.concat(s, F.lit(".SH"))).when(s.rlike(r"^[0-3]\d{5}$"), F.concat(s, F.lit(".SZ"))).otherwise(s)


def market(c: Column) -> Column:
    """cn, hk, us or null by the form of a symbol."""
    s = F.upper(F.trim(c))
    return F.when(s.rlike(r"^\d{6}(\.(SH|SS|SZ|BJ))?$"), "cn").when(s.rlike(r"^\d{1,5}\.HK$"), "hk").when(s.rlike(r"^[A-Z][A-Z0-9.]{0,9}$"), "us")


def hong_kong(c: Column) -> Column:
    return F.concat(F.lpad(F.regexp_extract(F.upper(F.trim(c)), r"^0*(\d+)", 1), 4, "0"), F.lit(".HK"))
