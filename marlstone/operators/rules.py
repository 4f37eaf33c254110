"""Rules over rows and texts: field and action scores, answer atoms, contracts, labels, lookups and cards.

All are columns or one aggregation: what is matched against (fields, actions,
aliases) is a small catalogue given in code, never a table.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import number, ratio
from ..functions.texts import normal


def lookup_form(text: str) -> str:
    return re.sub(r"[^0-9a-z一-鿿]+", "", text.lower())


def _form(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^0-9a-z一-鿿]+", "")


def field_candidates(request: Column, fields: dict[str, dict], within: float = 0.5) -> Column:
    """(field, score) of the fields that a request names, best first: those within `within` of the best.

    A field is {"label": ..., "aliases": [...]}. Fixed values: 12 for the label
    or an alias that is the whole request, 10 for the field's name in it, 9
    for its label, 8 for an alias.
    """
    asked = _form(request)

    def score(name: str, label: str, aliases: list[str]) -> Column:
        names = [n for n in map(lookup_form, (label, *aliases)) if n]
        levels = [(asked == n, 12.0) for n in names]
        levels += [(asked.contains(lookup_form(name)), 10.0)] if lookup_form(name) else []
        levels += [(asked.contains(lookup_form(label)), 9.0)] if lookup_form(label) else []
        levels += [(asked.contains(n), 8.0) for n in map(lookup_form, aliases) if n]
        return F.coalesce(*(F.when(held, value) for held, value in levels), F.lit(0.0))

    scored = F.array(*(F.struct((-score(n, m.get("label", ""), m.get("aliases", []))).alias("less"), F.lit(n).alias("field")) for n, m in fields.items()))
    ordered = F.array_sort(F.filter(scored, lambda s: s["less"] < 0))
    near = F.filter(ordered, lambda s: s["less"] <= F.get(ordered, F.lit(0))["less"] + within)
    return F.transform(near, lambda s: F.struct(s["field"].alias("field"), (-s["less"]).alias("score")))


def catalogue_match(text: Column, query: str) -> Column:
    """Whether an entry holds the query, or three of its words (all, if it has fewer)."""
    asked, low = query.strip().lower(), F.lower(text)
    words = [w for w in re.split(r"[^0-9a-z一-鿿]+", asked) if len(w) >= 2]
    if not asked:
        return F.lit(True)
    hits = sum((low.contains(w).cast("int") for w in words), F.lit(0))
    return low.contains(asked) | (hits >= min(len(words), 3) if words else F.lit(False))


def mentions(text: Column, terms: list[str]) -> Column:
    """Whether a text names one of the terms: words stand alone, phrases and Chinese terms may be part of more."""
    low = F.lower(text)

    def one(term: str) -> Column:
        if re.search("[一-鿿]", term):
            return _form(text).contains(lookup_form(term))
        if " " in term or "-" in term:
            return low.contains(term)
        return low.rlike(rf"(^|[^0-9a-z]){re.escape(term)}($|[^0-9a-z])")

    return reduce(lambda a, b: a | b, (one(t.lower().strip()) for t in terms if t.strip()), F.lit(False))


#: Words that every action's description has.
COMMON = [
    "market", "data", "market_data", "provider", "query", "date", "start_date", "end_date", "limit", "fields", "fetch", "rows", "through", "returns", "source", "family",
    "preferred", "actions", "action", "typed", "schema", "use", "optional", "required", "the", "to", "an", "and", "then", "find",
]
TOKEN = r"[a-z0-9_./]{2,}|[一-鿿]{2,}"


def best_actions(query: Column, actions: dict[str, dict], least: int = 3, most: int = 8) -> Column:
    """(action, score) of the actions that fit a query, best first.

    An action is {"terms": [...], "about": text}. Fixed values: 12 for its
    name as a word, 8 for the name with spaces, 5 for a term of four letters
    or more and 3 for a shorter one, one for each word (COMMON aside) or run of
    Han signs shared with what the action is about, 6 at most.
    """
    text = F.trim(F.regexp_replace(F.replace(F.lower(query), F.lit("-"), F.lit("_")), r"\s+", " "))
    words = F.array_except(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array(*map(F.lit, COMMON)))

    def score(name: str, terms: list[str], about: str) -> Column:
        total = F.when(text.rlike(rf"(^|[^0-9a-z_]){re.escape(name)}($|[^0-9a-z_])"), 12).otherwise(0)
        if "_" in name:
            total = total + F.when(text.contains(name.replace("_", " ")), 8).otherwise(0)
        for t in terms:
            total = total + F.when(text.contains(t), 5 if len(t) >= 4 else 3).otherwise(0)
        known = sorted(set(re.findall(TOKEN, f"{name.replace('_', ' ')} {about}".lower().replace("-", "_"))))
        return total + F.least(F.lit(6), F.size(F.array_intersect(words, F.array(*map(F.lit, known)))))

    scored = F.array(*(F.struct((-score(n, a["terms"], a["about"])).alias("less"), F.lit(n).alias("action")) for n, a in actions.items()))
    kept = F.slice(F.array_sort(F.filter(scored, lambda s: s["less"] <= -least)), 1, most)
    return F.transform(kept, lambda s: F.struct(s["action"].alias("action"), (-s["less"]).alias("score")))


def clear_choice(best: Column, second: Column) -> Column:
    """Whether the best entry of a catalogue may be taken without asking. 8 at least, 1.5 ahead or the next under 6."""
    return (best >= 8) & ((best - F.coalesce(second, F.lit(0.0)) >= 1.5) | (F.coalesce(second, F.lit(0.0)) < 6))


def answer_atom(text: Column) -> Column:
    """The short answer that a reply leads with: its first line, behind "answer:", up to a dash, bracket or stop."""
    said = F.regexp_replace(F.trim(text), r"(?is)^.*?answer\s*[:：]\s*", "")
    line = F.regexp_extract(F.regexp_replace(said, r"^[\s*_#-]+", ""), r"^[^\n]*", 0)
    head = F.regexp_extract(line, r"^(.*?)(?:\s+[-–—]{1,2}\s+|\s+\(|[.;]\s+|$)", 1)
    return F.regexp_replace(head, r"^[\s*:：`\"']+|[\s*:：`\"']+$", "")


#: Headings of the lines behind a question that say what form the answer must have.
CONSTRAINTS = ("Dataset Output Constraint", "Reference URLs", "Seed URL")


def code_extends(question: Column, reference: Column, said: Column) -> Column:
    """Whether the code in an answer goes on from the reference's, where the question asks for a code by its start."""
    code = lambda c: F.regexp_replace(F.regexp_extract(c, r"(?U)\b([0-9]{3,10}(?:[.\-][0-9]{1,8})*)\b", 1), r"[^0-9]", "")
    # What is asked ends where the constraints on the answer's form begin.
    question = F.regexp_extract(question, rf"(?s)^(.*?)(?:\n(?:{'|'.join(CONSTRAINTS)}):.*)?$", 1)
    asks = F.lower(question).rlike(r"(^|\W)(prefix|code prefix|classification code|tariff|hs code|heading)($|\W)")
    exact = F.lower(question).rlike(r"(^|\W)(exact|only|4-digit|four-digit|six-digit|6-digit|8-digit|eight-digit)($|\W)")
    ref, own = code(reference), code(said)
    return asks & ~exact & (F.length(ref) >= 3) & (F.length(own) > F.length(ref)) & own.startswith(ref)


def names_acronym(reference: Column, said: Column, longest: int = 120) -> Column:
    """Whether an answer of some words names an acronym (three signs or more, in capitals) and does not rule it out."""
    bare = F.regexp_replace(reference, "[^A-Za-z0-9]", "")
    is_acronym = bare.rlike("[A-Za-z]") & (F.length(bare) >= 3) & (F.upper(bare) == bare)
    quoted = F.concat(F.lit(r"\Q"), F.trim(reference), F.lit(r"\E"))
    named = F.regexp_like(said, F.concat(F.lit("(?i)(^|[^A-Za-z0-9])"), quoted, F.lit("($|[^A-Za-z0-9])")))
    ruled_out = F.regexp_like(said, F.concat(F.lit(r"(?i)(^|\W)(not|except|excluding|without)\s+"), quoted, F.lit(r"($|\W)")))
    return is_acronym & (F.length(F.trim(said)) <= longest) & named & ~ruled_out


#: Codes of delivery months, and where contracts of a commodity are traded.
MONTHS = "FGHJKMNQUVXZ"
EXCHANGES = {".CBT": ["ZS", "ZC", "ZW", "KE", "ZM", "ZL"], ".NYM": ["CL", "BZ", "NG", "RB", "HO"], ".CMX": ["GC", "SI", "HG", "PL", "PA"]}


def futures_symbol(root: Column, month: Column, year: Column) -> Column:
    """Root, month code, two digits of the year and the exchange's suffix, if it is known; null without a month from 1 to 12."""
    suffix = F.coalesce(*(F.when(F.upper(root).isin(roots), s) for s, roots in EXCHANGES.items()), F.lit(""))
    code = F.when(month.between(1, 12), F.substring(F.lit(MONTHS), month.cast("int"), F.lit(1)))
    return F.concat(F.upper(root), code, F.lpad((year % 100).cast("string"), 2, "0"), suffix)


def first_present(df: DataFrame, names: list[str], numeric: bool = False) -> Column:
    """The first of the columns that df has with a value that is not empty (numeric: that reads as a number)."""
    here = [F.col(f"`{n}`") for n in names if n in df.columns]
    held = [number(c.cast("string")) if numeric else F.when(F.trim(c.cast("string")) != "", F.trim(c.cast("string"))) for c in here]
    return F.coalesce(*held, F.lit(None).cast("double" if numeric else "string"))


#: The names under which sources give what a bar has, in the order in which they count.
BAR_NAMES = {
    "open": ["raw_unadjusted_open", "open", "开盘", "开盘价"], "high": ["high", "最高", "最高价"], "low": ["low", "最低", "最低价"],
    "close": ["raw_unadjusted_close", "close", "收盘", "收盘价", "最新价"], "volume": ["volume", "vol", "成交量"], "amount": ["amount", "成交额"],
}
KEY_NAMES = ["symbol_key", "ts_code", "constituent_code", "ticker", "symbol"]
DAY_NAMES = ["date", "trade_date", "日期", "交易日期", "时间"]


def canonical_day(df: DataFrame, day: list[str]) -> Column:
    """The first day that a row gives under any of the names, as yyyy-MM-dd: its first ten signs, or eight digits; else null."""

    def told(text: Column) -> Column:
        digits = F.regexp_replace(text, r"\D", "")
        spelled = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)).when(F.length(digits) == 8, spelled)

    # One element, so that the text is made once and not at each of its uses.
    return F.transform(F.array(first_present(df, day)), told)[0]


def canonical_rows(df: DataFrame) -> DataFrame:
    """df with symbol_key and, where it has a day under any name, date, if it lacks them; rows without a key or a day go."""
    if "symbol_key" not in df.columns:
        df = df.withColumn("symbol_key", first_present(df, KEY_NAMES)).where("symbol_key is not null")
    if "date" not in df.columns and any(c in df.columns for c in DAY_NAMES):
        df = df.withColumn("date", canonical_day(df, DAY_NAMES).cast("date")).where("date is not null")
    return df


def canonical_bars(df: DataFrame, day: list[str] = DAY_NAMES) -> DataFrame:
    """symbol_key, date and the six values of a bar, whatever names the source gives them; rows without a date go."""
    date = canonical_day(df, day)
    values = [first_present(df, names, numeric=True).alias(k) for k, names in BAR_NAMES.items()]
    return df.select(first_present(df, KEY_NAMES).alias("symbol_key"), date.alias("date"), *values).where("date is not null")


def card(panel: DataFrame, key: str, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """One row on what a panel holds of what was asked for: a slot is a key of `wanted` with a field.

    A slot is filled if some row of its key has a value. status is complete,
    partial or empty; can_answer_now is whether every slot is filled.
    """
    held = panel.groupBy(key).agg(*(F.max(F.col(f).isNotNull().cast("int")).alias(f) for f in fields))
    each = wanted.select(key).distinct().join(held, key, "left")
    full = sum((F.coalesce(F.col(f), F.lit(0)) for f in fields), F.lit(0))
    out = each.agg(F.count("*").alias("entities"), F.coalesce(F.sum(full), F.lit(0)).alias("filled_slots"))
    out = out.withColumn("missing_slots", F.col("entities") * len(fields) - F.col("filled_slots"))
    coverage = F.coalesce(ratio(F.col("filled_slots"), F.col("entities") * len(fields)), F.lit(0.0))
    status = F.when(F.col("filled_slots") == 0, "empty").when(F.col("missing_slots") == 0, "complete").otherwise("partial")
    return out.withColumns({"coverage": coverage, "status": status, "can_answer_now": status == "complete"})


def date_range(df: DataFrame, candidates: list[str]) -> DataFrame:
    """One row, date_range: least..greatest of the first column that has any value, as texts."""
    here = [c for c in candidates if c in df.columns]
    text = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c).cast("string"))
    spans = df.agg(*(F.concat(F.min(text(c)), F.lit(".."), F.max(text(c))).alias(c) for c in here))
    return spans.select(F.coalesce(*here, F.lit("")).alias("date_range"))


def merged_shards(shards: list[DataFrame], key: str) -> DataFrame:
    """All rows by key; a later shard's row counts. Of a key twice in a shard the greatest row counts."""
    whole = [s.select(F.lit(i).alias("_shard"), F.struct(*s.columns).alias("_row")) for i, s in enumerate(shards)]
    rows = reduce(DataFrame.unionByName, whole)
    return rows.groupBy(F.col("_row")[key].alias("_key")).agg(F.max(F.struct("_shard", "_row"))["_row"].alias("_row")).select("_row.*")


def resolved(refs: DataFrame, ref: str, evidence: DataFrame, names: list[Column], row: str) -> DataFrame:
    """Each distinct reference with the row it names: by the first of `names` that fits; of equals the smallest row."""
    known = evidence.select(row, F.posexplode(F.array(*names)).alias("_kind", "_name")).where("_name is not null")
    known = known.groupBy("_name").agg(F.min(F.struct("_kind", row)).alias("_at"))
    found = refs.select(ref).distinct().join(known, F.col(ref) == F.col("_name"), "left")
    return found.select(ref, F.col("_at")[row].alias(row), F.col("_at._kind").alias("kind"))


def deduplicated_cells(cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first of the cells that agree in all keys."""
    return cells.groupBy(*keys).agg(F.min(order).alias(order))


def validated(df: DataFrame, required: list[str], key: str) -> DataFrame:
    """One row: rows, those without a required text, distinct keys and rows that repeat one. Keys are counted first."""
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    bad = reduce(lambda a, b: a | b, map(empty, required), F.lit(False))
    by_key = df.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(bad, 1)).alias("bad"))
    named = F.col(key).isNotNull()
    return by_key.agg(
        F.sum("n").alias("row_count"), F.sum("bad").alias("bad_rows"), F.count(F.when(named, 1)).alias("unique_ids"),
        F.sum(F.when(named, F.col("n") - 1).otherwise(0)).alias("duplicate_ids"),
    )


def missing_fields(required: list[str]) -> Column:
    """Names of required columns without a text, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required)))


def link_score(text: Column, terms: list[str]) -> Column:
    """How much a link looks like an exhibit asked for. 3 a term, 8 and 5 for their usual names, 1 for a page."""
    low = F.lower(text)
    has = lambda *words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    points = [(low.contains(t.lower()), 3.0) for t in terms if len(t) > 2]
    points += [(has("ex-99", "ex99", "99.1"), 8.0), (has("press", "release", "earnings"), 5.0), (low.endswith(".htm") | low.endswith(".html"), 1.0)]
    return sum((F.when(c, v).otherwise(0.0) for c, v in points), F.lit(0.0))


def links_ranked(links: DataFrame, page: str, href: str, label: str, terms: list[str], kind: str = "", most: int = 20) -> DataFrame:
    """(page, href, label, score, place): the links of a page that may lead to an exhibit, best first, then by file name and address.

    Empty addresses and those within the page are none; `kind` must be part of
    address or label. Fixed values: what address or label must have one of.
    """
    low = F.lower(F.concat_ws(" ", href, label))
    marks = ("ex-", "exhibit", "press", "release", "earnings", ".htm", ".html", ".txt", ".pdf", ".xlsx")
    kept = links.where((F.trim(href) != "") & ~F.startswith(F.trim(href), F.lit("#")) & reduce(lambda a, b: a | b, (low.contains(m) for m in marks)) & low.contains(kind.lower()))
    rows = kept.select(page, href, label, link_score(low, terms).alias("score"), F.substring_index(href, "/", -1).alias("_file"))
    order = F.struct((-F.col("score")).alias("s"), "_file", href, F.struct(page, href, label, "score").alias("row"))
    best = rows.groupBy(page).agg(F.slice(F.array_sort(F.collect_list(order)), 1, most).alias("_best"))
    return best.select(F.posexplode("_best").alias("_p", "_b")).select("_b.row.*", (F.col("_p") + 1).alias("place"))


def unit_hint(text: Column) -> Column:
    """Scale and currency that a table's heading states, as in "in millions; USD"; null if none."""

    def told(t: Column) -> Column:
        low = t["low"]
        # A pattern is tried only where one of its words is held at all.
        scale = F.when(low.contains("thousand") | low.contains("million") | low.contains("billion"), F.nullif(F.regexp_extract(low, r"in\s+(thousand|million|billion)", 1), F.lit("")))
        word = lambda held, w: low.contains(held) & low.rlike(rf"(^|[^0-9a-z_])({w})($|[^0-9a-z_])")
        dollars = t["text"].contains("$") | word("usd", "usd") | word("us dollar", "us dollars?")
        money = F.when(dollars, "USD").when(t["text"].contains("€") | word("eur", "eur"), "EUR").when(t["text"].contains("£") | word("gbp", "gbp"), "GBP").when(t["text"].contains("%"), "percent")
        parts = F.concat_ws("; ", F.concat(F.lit("in "), scale, F.lit("s")), F.when(low.contains("per share"), "per-share amounts unscaled"), money)
        return F.nullif(parts, F.lit(""))

    # One element, so that the text is made and lowered once and not at each of its uses.
    once = F.array(F.struct(text.alias("text"), F.lower(text).alias("low")))
    return F.transform(once, told)[0]


def fuses(calls: DataFrame, fingerprint: Column, failed: Column, retry: Column, step: str) -> DataFrame:
    """Calls that failed for good: how often and when first; they are not to be made again. Failures that may be retried, or say nothing of it, block nothing."""
    rows = calls.where(failed & ~F.coalesce(retry, F.lit(True))).groupBy(fingerprint.alias("fingerprint"))
    return rows.agg(F.count("*").alias("failures"), F.min(step).alias("blocked_from"))


def report_score(text: Column, sections: list[str], subsections: list[str]) -> Column:
    """0.4 of the sections, 0.45 of the subsections and 0.15 of the table lines that a report has; weights are fixed values."""
    low = normal(text)
    share = lambda names: sum((low.contains(n.lower()).cast("int") for n in names), F.lit(0)) / len(names)
    lines = F.regexp_count(text, F.lit(r"(?m)^[^\S\n]*\|.*\|[^\S\n]*$"))
    return F.round(0.4 * share(sections) + 0.45 * share(subsections) + 0.15 * F.least(F.lit(1.0), lines / len(subsections)), 4)


def between(text: Column, start: str, end: str) -> Column:
    """What stands between two marks, the first time; null without them."""
    found = F.regexp_extract(text, rf"(?s){re.escape(start)}(.*?){re.escape(end)}", 1)
    return F.when(text.contains(start) & (found != ""), F.trim(found))


def lenient_json(text: Column) -> Column:
    """The JSON object in a reply: inside a fence, or from the first brace to the last; null if it does not parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    held = F.when(fenced != "", fenced).otherwise(braced)
    return F.when((held != "") & F.json_object_keys(held).isNotNull(), held)


def labelled(df: DataFrame, ids: list[str], labels: dict[str, tuple[str, float]]) -> DataFrame:
    """Statement rows in long form: ids, field, its label and the value in the label's unit; fields without a value go."""
    long = df.unpivot(ids, list(labels), "field", "raw").where("raw is not null")
    name = F.create_map(*(F.lit(x) for f, (label, _) in labels.items() for x in (f, label)))
    unit = F.create_map(*(F.lit(x) for f, (_, by) in labels.items() for x in (f, by)))
    return long.select(*ids, "field", F.element_at(name, F.col("field")).alias("label"), (F.col("raw") / F.element_at(unit, F.col("field"))).alias("value"))


def constituents(levels: list[DataFrame], names: dict[str, list[str]], weight: list[str]) -> DataFrame:
    """Rows of several catalogues under one set of names; a column that a level lacks is null, weights become numbers."""
    forms = [df.select(*(first_present(df, n).alias(k) for k, n in names.items()), first_present(df, weight, numeric=True).alias("weight")) for df in levels]
    return reduce(DataFrame.unionByName, forms)


def any_contains(df: DataFrame, query: str) -> DataFrame:
    """Rows one of whose columns holds the query, whatever its case."""
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c).cast("string")).contains(query.lower()), F.lit(False)) for c in df.columns)))


def shown(c: Column, places: int) -> Column:
    """A number with commas and fixed decimals."""
    return F.format_number(c.cast(f"decimal(38,{places})"), places)


def periods_in(text: Column, cells: Column | None = None, most: int = 8) -> Column:
    """The periods that a heading gives: its phrase of a year, quarter or months "ended" with a year, then distinct years from 1900 to 2099, in order.

    Years are those of the whole text, or of cells alone where they are given.
    """

    def told(t: Column) -> Column:
        low = F.lower(t["text"])
        phrase = F.when(low.contains("ended"), F.regexp_extract(low, r"((?:year|quarter|three|six|nine|twelve)[\w ]*?ended[\w ,]*?\d{4})", 1))
        years = F.regexp_extract_all(t["cells"], F.lit(r"(?U)\b((?:19|20)[0-9]{2})\b"), F.lit(1))
        return F.slice(F.array_distinct(F.concat(F.filter(F.array(F.trim(phrase)), lambda p: p != ""), years)), 1, most)

    once = F.array(F.struct(text.alias("text"), (text if cells is None else cells).alias("cells")))
    return F.transform(once, told)[0]
