"""Benchmark decontamination by SimHash windows. DataFrame functions only.

A text's windows are as long as a benchmark item. A window that is similar to
an item holds some of its shingles; moved on to start at the first of those it
holds no fewer, so only windows that start at a shingle of an item of that
length are cut. Their SimHash fingerprints meet those of items of the same
length in a multi-index: with more blocks than the radius has bits, two
fingerprints within the radius agree in a block. The exact similarity of the
two bags of shingles then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import split_off, staged

WIDTH = 5
SIMILARITY = 0.8
#: Of 64 bits. At a similarity of 0.8 fingerprints differ in 9.7 bits, 2.9 about; five deviations more are kept.
RADIUS = 24
#: Shingles of a benchmark that may be sent to every task.
FEW = 1_000_000


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row, however often others use it.

    A generator between them keeps the optimiser from copying the expression
    into lambdas, where it would run for each element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _shingled(df: DataFrame, text_col: str) -> DataFrame:
    return _once(_once(df, "ws", _words(F.col(text_col))), "hs", _shingles(F.col("ws"))).drop("ws")


def _shingles(words: Column) -> Column:
    """Hashes of WIDTH words running; none for fewer words."""
    last = F.size(words) - WIDTH
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WIDTH))))


def _fingerprinted(df: DataFrame) -> DataFrame:
    """df with fp, the SimHash of hs: a bit is set if it is set in over half of the hashes.

    Votes are counted for several bits at once, in lanes of a number that are
    wide enough for as many hashes as there are, the sign apart.
    """
    n = F.size("hs")
    width = F.when(n < 1 << 7, 8).when(n < 1 << 15, 16).otherwise(64)
    masks = {8: 0x0101010101010101, 16: 0x0001000100010001, 64: 1}
    df = df.withColumn("_width", width)
    mask = F.element_at(F.create_map(*(F.lit(x) for k, v in masks.items() for x in (k, v))), F.col("_width")).cast("long")
    df = _once(df, "_mask", mask)
    right = lambda x, k: F.call_function("shiftrightunsigned", x, k)
    votes = lambda k: F.aggregate("hs", F.lit(0).cast("long"), lambda s, h: s + right(h, k).bitwiseAND(F.col("_mask")))
    df = _once(df, "_votes", F.transform(F.sequence(F.lit(0), F.col("_width") - 1), votes))
    lane = F.when(F.col("_width") == 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_width")) - 1)

    def bit(fp: Column, b: Column) -> Column:
        count = right(F.get("_votes", b % F.col("_width")), b - b % F.col("_width")).bitwiseAND(F.col("_lane"))
        return fp.bitwiseOR(F.when(2 * count > F.size("hs"), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

    df = _once(df, "_lane", lane)
    df = _once(df, "fp", F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit))
    return df.drop("_width", "_mask", "_votes", "_lane")


def _blocks(fp: Column, radius: int) -> Column:
    """radius + 1 keys: the block's number and its bits."""
    n, keys, at = radius + 1, [], 0
    for i in range(n):
        size = 64 // n + (i < 64 % n)
        bits = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        keys.append(F.shiftleft(F.lit(i).cast("long"), 40).bitwiseOR(bits))
        at += size
    return F.array(*keys)


def _windows(whole: DataFrame, benchmark: DataFrame, item_text_col: str) -> DataFrame:
    """(doc, n, start, hs): windows of n shingles that start where documents hold one of an item of n shingles.

    Shingles are looked up by their longest word, which few words of a text
    are, and only then hashed; a window is cut where the text's words are at
    hand. That is one pass without a shuffle, as long as the benchmark's
    shingles may be sent to every task. Beyond FEW of them the hashes of all
    shingles meet in a shuffle, and the texts that are hit are read again.
    """
    items = _once(benchmark.select(F.col(item_text_col).alias("text")), "ws", _words(F.col("text"))).where(F.size("ws") >= WIDTH)
    items = items.select("ws", (F.size("ws") - WIDTH + 1).alias("n"), F.explode(F.sequence(F.lit(0), F.size("ws") - WIDTH)).alias("at"))
    hashed = lambda ws, at: F.xxhash64(*(F.get(ws, at + k) for k in range(WIDTH)))
    offsets = F.array(*(F.struct((-F.length(F.get("ws", F.col("at") + k))).alias("l"), F.lit(k).alias("k")) for k in range(WIDTH)))
    held = items.withColumn("back", F.array_min(offsets)["k"])
    held = held.select("n", "back", F.get("ws", F.col("at") + F.col("back")).alias("word"), hashed("ws", F.col("at")).alias("h"))
    held = staged(held.distinct(), "shingles")
    start = lambda at, size: F.greatest(F.lit(0), F.least(at, size - F.col("n")))
    if held.limit(FEW + 1).count() <= FEW:
        size = F.size("ws") - WIDTH + 1
        spots = _once(whole, "ws", _words(F.col("text"))).select("doc", "ws", F.posexplode("ws").alias("place", "word"))
        at = F.col("place") - F.col("back")
        hit = spots.join(F.broadcast(held), "word").where((at >= 0) & (at < size) & (hashed("ws", at) == F.col("h")))
        first = start(at, size)
        cut = hit.select("doc", "n", first.alias("start"), F.slice("ws", first + 1, F.col("n") + WIDTH - 1).alias("ws"))
        return _once(cut, "hs", _shingles(F.col("ws"))).drop("ws")
    spots = _shingled(whole, "text").select("doc", F.size("hs").alias("all"), F.posexplode("hs").alias("pos", "h"))
    hit = spots.join(held.select("n", "h").distinct(), "h").select("doc", "n", start(F.col("pos"), F.col("all")).alias("start"))
    starts = hit.groupBy("doc").agg(F.collect_set(F.struct("n", "start")).alias("starts"))
    again = _shingled(whole.join(starts, "doc"), "text")
    cut = F.transform("starts", lambda s: F.struct(s["n"].alias("n"), s["start"].alias("start"), F.slice("hs", s["start"] + 1, s["n"]).alias("hs")))
    return again.select("doc", F.inline(cut)).where(F.size("hs") > 0)


def _short(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """(item, words, back, word): items of fewer than WIDTH words, and where their longest word stands in them."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    items = _once(items, "words", _words(F.col("text"))).where(F.size("words").between(1, WIDTH - 1))
    places = F.transform("words", lambda w, k: F.struct((-F.length(w)).alias("l"), k.alias("k")))
    items = items.withColumn("back", F.array_min(places)["k"])
    return staged(items.select("item", "words", "back", F.get("words", F.col("back")).alias("word")), "short-items")


def _held_whole(whole: DataFrame, short: DataFrame) -> DataFrame:
    """(doc, item, similarity, start, distance): documents that hold all words of a short item in a row, at the first place."""
    spots = _once(whole, "ws", _words(F.col("text"))).select("doc", "ws", F.posexplode("ws").alias("place", "word"))
    few = short.limit(FEW + 1).count() <= FEW
    at = F.col("place") - F.col("back")
    hit = spots.join(F.broadcast(short) if few else short, "word").where((at >= 0) & (F.slice("ws", F.greatest(at, F.lit(0)) + 1, F.size("words")) == F.col("words")))
    first = hit.groupBy("doc", "item").agg(F.min(at).alias("start"))
    return first.select("doc", "item", F.lit(1.0).alias("similarity"), "start", F.lit(0).alias("distance"))


def found(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS,
) -> DataFrame:
    """(id_col, item_col, similarity, start, distance): each document and item that it holds, at the best window.

    start counts words from 0; of equal windows the first is given. Words are
    lower-cased runs of letters and digits. An item of fewer than WIDTH words
    is one shingle as a whole: it matches where its words stand in a row, with
    similarity 1. Null or empty texts match nothing. A document
    shorter than an item is held against it whole. Rows with a null id are
    left out; rows that repeat an id count as one document. Empty tables give
    an empty result; other columns are ignored.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    items = _shingled(items, "text").where(F.size("hs") > 0).select("item", "hs", F.size("hs").alias("n"))

    whole = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    windows, marked = _fingerprinted(_windows(whole, benchmark, item_text_col)), staged(_fingerprinted(items), "items")

    left = windows.select("doc", "n", "start", "hs", "fp", F.explode(_blocks(F.col("fp"), radius)).alias("block"))
    right = marked.select("item", "n", F.col("hs").alias("item_hs"), F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"), radius)).alias("block"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # Few items go to every task; more meet the windows in a shuffle.
    near = left.join(F.broadcast(right) if (marked.agg(F.sum("n")).first()[0] or 0) <= FEW else right, ["n", "block"]).where(distance <= radius)
    # A pair may meet in several blocks: only the first of them brings it on.
    both = F.zip_with(_blocks(F.col("fp"), radius), _blocks(F.col("item_fp"), radius), lambda a, b: F.when(a == b, a))
    near = near.where(F.col("block") == F.element_at(F.array_compact(both), 1)).withColumn("distance", distance)
    many = lambda array, h: F.size(F.filter(array, lambda x: x == h))
    shared = F.array_intersect("hs", "item_hs")
    single = (F.size(F.array_distinct("hs")) == F.size("hs")) | (F.size(F.array_distinct("item_hs")) == F.size("item_hs"))
    bags = F.aggregate(shared, F.lit(0), lambda s, h: s + F.least(many(F.col("hs"), h), many(F.col("item_hs"), h)))
    near = _once(near, "common", F.when(single, F.size(shared)).otherwise(bags))
    near = _once(near, "similarity", F.col("common") / (F.size("hs") + F.size("item_hs") - F.col("common")))
    best = F.max_by(F.struct("similarity", "start", "distance"), F.struct("similarity", -F.col("start")))
    pairs = near.where(F.col("similarity") >= similarity).groupBy("doc", "item").agg(best.alias("best"))
    pairs = pairs.select("doc", "item", "best.*")
    short = _short(benchmark, item_col, item_text_col)
    if not short.isEmpty():
        pairs = pairs.unionByName(_held_whole(whole, short))
    return pairs.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "similarity", "start", "distance")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that hold no item; rows with a null id stay.

    All rows of an id go if one of them holds an item; settings as of found().
    """
    leaks = staged(found(docs, benchmark, id_col, text_col, **settings).select(id_col).distinct(), "leaks")
    return split_off(docs, id_col, leaks, "left_anti")
