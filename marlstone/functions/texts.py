"""Texts: normal forms, overlaps, addresses, labels and light HTML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What counts as a number, and as a word.
NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?%?"
TOKEN = r"[\p{L}\p{N}_]+"


def normal(c: Column) -> Column:
    """Lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)))


def numbers_in(c: Column) -> Column:
    """Numbers as written: commas and percent signs stay."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)))


def recall(found: Column, wanted: Column) -> Column:
    """The share of wanted elements that were found; 0 where none is wanted."""
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(found, wanted)) / F.size(wanted)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def answers_match(answer: Column, gold: Column) -> Column:
    """Equal, or one holds the other, or 0.8 of the numbers are there."""
    a, g = normal(answer), normal(gold)
    said = (a != "") & (g != "")
    return said & ((a == g) | a.contains(g) | g.contains(a)) | (recall(numbers_in(a), numbers_in(g)) >= 0.8)


def label(c: Column, aliases: dict[str, str]) -> Column:
    """A struct: the first label whose pattern is found, and whether several were."""
    found = F.array_compact(F.array(*(F.when(F.lower(c).rlike(p), F.lit(name)) for name, p in aliases.items())))
    return F.struct(F.try_element_at(found, F.lit(1)).alias("label"), (F.size(found) > 1).alias("ambiguous"))


def address(c: Column) -> Column:
    """A web address without scheme, www., query, fragment and closing slashes; host in lower case."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"[?#].*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/]*", 0)), r"^www\.", "")
    return F.concat(host, F.regexp_replace(F.regexp_extract(bare, r"/.*$", 0), r"/+$", ""))


def domain(c: Column) -> Column:
    return F.regexp_extract(address(c), r"^[^/:]*", 0)


def plain_text(html: Column) -> Column:
    """HTML without scripts, styles, comments and tags."""
    for kind in ("script", "style", "noscript"):
        html = F.regexp_replace(html, rf"(?is)<{kind}[^>]*>.*?</{kind}>", " ")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    html = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(html, r"\s+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s+href="([^"]*)"'), F.lit(1))


def term_weight(term: Column) -> Column:
    """max(1, min(8, a quarter of the letters))."""
    return F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.length(term) / 4).cast("int")))


def weighted_hits(text: Column, terms: Column) -> Column:
    """The weights of the terms that a text holds."""
    low = F.lower(text)
    return F.aggregate(terms, F.lit(0), lambda s, t: s + F.when(low.contains(t), term_weight(t)).otherwise(0))


def stem(c: Column, most: int = 80) -> Column:
    """A file name's stem: runs of other signs become one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", ""), 1, most)


def head_and_tail(c: Column, most: int, mark: str = " … ") -> Column:
    """A long text's first and last half."""
    half = most // 2
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(half)), F.lit(mark), F.right(c, F.lit(most - half))))


def signature(terms: Column) -> Column:
    """SHA-1 of sorted, distinct terms."""
    return F.sha1(F.array_join(F.array_sort(F.array_distinct(terms)), " "))


#: How long the n-grams of Han signs are, how many terms of a query count, and what a term may weigh.
HAN_GRAMS, MOST_TERMS, WEIGHTS = (8, 6, 4, 3, 2), 60, (2, 8)


def overlap_terms(query: Column, most: int = MOST_TERMS) -> Column:
    """The different terms of a query: words of over two signs, then runs of Han signs, each with its n-grams, long ones first."""
    low = F.lower(F.coalesce(query, F.lit("")))
    words = F.filter(F.regexp_extract_all(low, F.lit(r"([a-z0-9$%._-]+)")), lambda w: F.length(w) > 2)
    runs = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("([一-鿿]{2,})"))

    def grams(run: Column) -> Column:
        places = lambda n: F.sequence(F.lit(1), F.length(run) - n + 1)
        cut = lambda n: F.when(F.length(run) >= n, F.transform(places(n), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(run), *(cut(n) for n in HAN_GRAMS))

    return F.slice(F.array_distinct(F.concat(words, F.flatten(F.transform(runs, grams)))), 1, most)


def overlap_score(text: Column, query: Column | str, most: int = MOST_TERMS) -> Column:
    """Half the length (from 2 to 8 signs) of each term of the query that the text holds; nulls are empty.

    The terms of a query that is a plain text are found once, not once a row.
    """
    held = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    low, high = WEIGHTS
    hit = lambda t: F.when(F.contains(held, t), F.least(F.greatest(F.length(t), F.lit(low)), F.lit(high)) / 2.0).otherwise(0.0)
    if isinstance(query, str):
        terms = SparkSession.active().range(1).select(overlap_terms(F.lit(query), most)).first()[0]
        return sum((hit(F.lit(t)) for t in terms), F.lit(0.0))
    return F.aggregate(overlap_terms(query, most), F.lit(0.0), lambda a, t: a + hit(t))


#: Words near an image that likely shows a table, and near one that is decoration.
TABLE_HINTS = (
    "table", "statistical", "statistics", "data table", "chart", "spreadsheet",
    "表", "统计表", "情况表", "数据表", "指标表", "截图", "图片", "图表", "统计信息", "批准预售",
)
NOISE = (
    "logo", "icon", "qrcode", "qr-code", "share", "banner", "wechat", "weibo", "jiucuo", "finderror", "red.png", "ga.png", "pe-m-logo",
    "二维码", "扫一扫", "分享", "微信", "微博", "版权", "导航", "找错", "纠错", "备案", "公安",
)


def asset_score(source: Column, label: Column, context: Column, query: Column | str) -> Column:
    """How likely an image shows what a query asks for. 4 for a hint of a table, 1.5 of the terms' overlap, 12 off for decoration, 4 off where neither speaks for it."""
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (source, label, context)))
    low, overlap = F.lower(text), overlap_score(text, query)
    any_of = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    hint = any_of(TABLE_HINTS)
    return F.when(hint, 4.0).otherwise(0.0) + overlap * 1.5 - F.when(any_of(NOISE), 12.0).otherwise(0.0) - F.when(~hint & (overlap < 2), 4.0).otherwise(0.0)
