"""Codes of names: an index from normal forms of aliases to codes, looked up whole or inside texts.

The index has one row for each normal form, with the code that counts and
whether others claim it. It is sent to every task while it has up to FEW rows,
and met in a shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import staged

#: Forms that may be sent to every task (some 100 bytes each).
FEW = 100_000

#: Flows of trade by their names.
FLOWS = {
    "EXPORT": "X", "EXPORTS": "X", "X": "X", "IMPORT": "M", "IMPORTS": "M", "M": "M",
    "RE-EXPORT": "RX", "REEXPORT": "RX", "RE-EXPORTS": "RX", "RX": "RX", "RE-IMPORT": "RM", "REIMPORT": "RM", "RE-IMPORTS": "RM", "RM": "RM",
}


def normal(c: Column) -> Column:
    """Lower-case words of letters and digits, parted by single spaces."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def flow_code(c: Column) -> Column:
    """The code of a flow; what has no name here is its own code, nothing is an export."""
    upper = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    known = F.create_map(*(F.lit(x) for pair in FLOWS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, upper), F.when(upper != "", upper), F.lit("X"))


def padded_code(c: Column, width: int = 10) -> Column:
    """A number as text with leading zeros."""
    return F.lpad(c.cast("long").cast("string"), width, "0")


def index(catalogue: DataFrame, code: str, names: list[str], rank: str) -> DataFrame:
    """(form, code, ambiguous, words): the aliases in the columns `names`; of several codes that of the first by rank and code counts.

    Empty forms and rows without a code give no alias; ambiguous: another code has the same form.
    """
    rows = catalogue.where(F.col(code).isNotNull()).select(F.col(code).alias("code"), F.col(rank).alias("_rank"), F.explode(F.array(*(normal(F.col(c).cast("string")) for c in names))).alias("form"))
    rows = rows.where("form <> ''")
    first = F.min_by("code", F.struct("_rank", "code"))
    found = rows.groupBy("form").agg(first.alias("code"), (F.min("code") != F.max("code")).alias("ambiguous"))
    return staged(found.withColumn("words", F.size(F.split("form", " "))), "aliases")


def _sent(found: DataFrame) -> DataFrame:
    return F.broadcast(found) if found.limit(FEW + 1).count() <= FEW else found


def resolved(rows: DataFrame, value: str, found: DataFrame, fixed: Column | None = None) -> DataFrame:
    """rows with code and ambiguous: a number is its own code, `fixed` comes next, then the index; null where nothing is known."""
    text = F.trim(F.col(value).cast("string"))
    digits = F.when(text.rlike("^[0-9]+$"), F.regexp_replace(text, "^0+(?=[0-9])", ""))
    own = F.coalesce(digits, fixed) if fixed is not None else digits
    keyed = rows.withColumns({"_own": own, "_form": F.when(own.isNull(), normal(text))})
    index = _sent(found.select(F.col("form").alias("_f"), F.col("code").cast("string").alias("_code"), F.col("ambiguous").alias("_many")))
    both = keyed.join(index, F.col("_form") == F.col("_f"), "left")
    return both.select(*rows.columns, F.coalesce("_own", "_code").alias("code"), F.coalesce("_many", F.lit(False)).alias("ambiguous"))


def mentioned(rows: DataFrame, keys: list[str], text: str, found: DataFrame) -> DataFrame:
    """(keys, at, form, code, ambiguous): aliases in a text, the longest at each word; one that begins within a longer one does not count.

    at: the number of its first word, from 0. Windows of as many words as the
    longest alias has are looked up; a text's hits are cleaned in one place,
    they are no more than its words. keys must name a row.
    """
    most = found.agg(F.max("words")).first()[0] or 0
    words = F.filter(F.split(normal(F.col(text)), " "), lambda w: w != "")
    if not most:
        return rows.select(*keys, F.lit(0).alias("at"), F.lit("").alias("form"), F.lit(None).cast(found.schema["code"].dataType).alias("code"), F.lit(False).alias("ambiguous")).limit(0)
    windows = rows.select(*keys, words.alias("_w")).select(*keys, "_w", F.posexplode("_w").alias("at", "_first"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(most), F.size("_w") - F.col("at")))
    forms = F.transform(sizes, lambda n: F.array_join(F.slice("_w", F.col("at") + 1, n), " "))
    hits = windows.select(*keys, "at", F.explode(forms).alias("form")).join(_sent(found), "form")
    best = hits.groupBy(*keys, "at").agg(F.max_by(F.struct("form", "code", "ambiguous", "words"), "words").alias("hit"))
    listed = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "hit"))).alias("hits"))
    start = F.struct(F.lit(0).alias("free"), F.expr("filter(hits, h -> false)").alias("kept"))
    taken = F.aggregate("hits", start, lambda a, h: F.when(h["at"] < a["free"], a).otherwise(F.struct((h["at"] + h["hit"]["words"]).alias("free"), F.array_append(a["kept"], h).alias("kept"))), lambda a: a["kept"])
    return listed.select(*keys, F.inline(taken)).select(*keys, "at", "hit.form", "hit.code", "hit.ambiguous")
