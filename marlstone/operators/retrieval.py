"""Retrieval: term scores, windows of text, clusters of queries and their novelty."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import term_weight
from . import ranks


def terms(text: Column, stopwords: list[str], most: int = 80, least: int = 3) -> Column:
    """Distinct lower-case words in order, without short ones and stopwords, the first `most`."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(stopwords))
    return F.slice(F.array_distinct(kept), 1, most)


#: Words that say nothing about a query, and the patterns of its terms, of names in capitals and of dates.
COMMON = [
    "the", "and", "for", "from", "with", "that", "this", "what", "when", "where", "which",
    "official", "source", "sources", "website", "page", "web", "search", "google", "serper", "latest", "data",
]
TERM = r"[\u4e00-\u9fff]{2,}|[a-z0-9][a-z0-9._$%-]+"
CAPITALS = r"(?U)\b[A-Z]{1,8}(?:[.\-][A-Z0-9]{1,5})?\b"
DATES = r"(?U)\b(?:19|20)\d{2}(?:[-/]\d{1,2})?(?:[-/]\d{1,2})?\b"


def query_terms(text: Column) -> Column:
    """Distinct terms of a whole query, sorted: runs of Han signs, words of ASCII letters and digits, without addresses and COMMON."""
    low = F.regexp_replace(F.lower(text), r"(?U)https?://\S+", " ")
    found = F.regexp_extract_all(low, F.lit(TERM), F.lit(0))
    bare = F.transform(F.filter(found, lambda t: ~t.isin(COMMON)), lambda t: F.regexp_replace(t, r"^[._$%-]+|[._$%-]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda t: t != "")))


def query_anchors(text: Column, terms: Column) -> Column:
    """What names a query's subject: short words in capitals, years and dates, terms with digits; sorted."""
    capitals = F.regexp_extract_all(text, F.lit(CAPITALS), F.lit(0))
    capitals = F.filter(F.transform(capitals, F.lower), lambda t: ~t.isin(COMMON))
    dates = F.regexp_extract_all(text, F.lit(DATES), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(capitals, dates, F.filter(terms, lambda t: t.rlike("[0-9]")))))


def best_window(df: DataFrame, key: str, text: str, wanted: list[str], width: int) -> DataFrame:
    """(key, term, start, window): the text around the weightiest term that is found, the first of equals."""
    one = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.lit(i).alias("i")) for i, t in enumerate(wanted))))
    rows = df.select(key, text, one.alias("t")).select(key, text, "t.*").withColumn("at", F.instr(F.lower(text), F.col("term"))).where("at > 0")
    start = F.greatest(F.lit(1), F.col("at") - F.lit(width // 2))
    best = F.max_by(F.struct("term", start.alias("start"), F.substr(text, start, F.lit(width)).alias("window")), F.struct(term_weight(F.col("term")), -F.col("i")))
    return rows.groupBy(key).agg(best.alias("b")).select(key, "b.*")


def either_contains(a: Column, b: Column) -> Column:
    """Whether one of two normal forms holds the other."""
    form = lambda c: F.regexp_replace(F.lower(c), r"[^0-9a-z一-鿿]", "")
    return (form(a) != "") & (form(b) != "") & (form(a).contains(form(b)) | form(b).contains(form(a)))


def weighted_mean(parts: dict[str, float]) -> Column:
    """The mean of columns by weight; null ones leave, and the weights of the others are scaled up."""
    held = [(F.col(c), w) for c, w in parts.items()]
    total = sum((F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in held), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in held), F.lit(0.0))
    return F.when(weight > 0, total / weight)


#: How alike the terms of a query and a cluster are, without and with a shared anchor.
ALIKE, ANCHORED = 0.82, 0.62


class _Clusters:
    """Clusters of one task, found by the words that a query shares with them."""

    def __init__(self, alike: float, anchored: float):
        self.alike, self.anchored = alike, anchored
        self.words: list[set] = []
        self.anchors: list[set] = []
        self.opened: dict[frozenset, int] = {}
        self.having: dict[str, list[int]] = defaultdict(list)

    def place(self, words: set, anchors: set) -> tuple[int | None, bool]:
        if not words:
            return None, False
        best = self.opened.get(frozenset(words))
        if best is None:
            shared = Counter(i for w in words for i in self.having.get(w, ()))
            alike = {i: n / (len(words) + len(self.words[i]) - n) for i, n in shared.items()}
            fits = [i for i, s in alike.items() if s >= self.alike or s >= self.anchored and anchors & self.anchors[i]]
            best = min(fits, key=lambda i: (-alike[i], i), default=None)
        new = best is None
        if new:
            best = self.opened[frozenset(words)] = len(self.words)
            self.words.append(set())
            self.anchors.append(set())
        fresh = words - self.words[best]
        self.words[best] |= fresh
        self.anchors[best] |= anchors
        for w in fresh:
            self.having[w].append(best)
        return best, new or bool(fresh)


def clusters(queries: DataFrame, task: str, step: str, words: str, alike: float = ALIKE, anchored: float = ANCHORED, anchors: str | None = None) -> DataFrame:
    """(task, step, cluster, novel): queries of a task in order, each put to the most similar cluster or to a new one.

    A query with the same words as the one that opened a cluster goes there.
    Queries without words are in no cluster (null) and not novel. A cluster's
    words grow with its queries, so a query's cluster rests on all before it: a
    task's queries are folded one by one, in a stream that Spark sorts and
    spills, and only clusters with a word of the query are compared.
    """
    columns = [F.col(task).cast("string").alias("task"), F.col(step).cast("long").alias("step"), F.col(words).alias("words")]
    rows = queries.select(*columns, (F.col(anchors) if anchors else F.array().cast("array<string>")).alias("anchors"))
    rows = rows.repartition("task").sortWithinPartitions("task", "step")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, known = object(), None
        for frame in frames:
            out = []
            for t, w, a in zip(frame["task"], frame["words"], frame["anchors"], strict=True):
                if known is None or t != now:
                    now, known = t, _Clusters(alike, anchored)
                out.append(known.place(set(w if w is not None else ()), set(a if a is not None else ())))
            yield pd.DataFrame({"task": frame["task"], "step": frame["step"], "cluster": pd.array([c for c, _ in out], "Int32"), "novel": [n for _, n in out]})

    return rows.mapInPandas(fold, "task string, step long, cluster int, novel boolean")


def fused(clustered: DataFrame, limit: int = 2) -> DataFrame:
    """Rows of clusters() with no_gain_run and fused: whether `limit` queries running have told their cluster nothing new.

    Queries in no cluster stay out. Cut into blocks, so that a task or a cluster may hold most rows.
    """
    run = ranks.since_last(clustered.where("cluster is not null"), ["step"], F.col("novel"), "no_gain_run", ["task", "cluster"])
    return run.withColumn("fused", F.col("no_gain_run") >= limit)


def best_source(df: DataFrame, key: str, source: str, order: list[str]) -> DataFrame:
    """Rows of the first source in order that has any, by key."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    first = df.where(place > 0).groupBy(key).agg(F.min(place).alias("_first"))
    return df.where(place > 0).withColumn("_place", place).join(first, key).where("_place = _first").drop("_place", "_first")
