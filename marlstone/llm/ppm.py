"""Language identification by prediction by partial matching.

Each language has a context tree of bytes up to ORDER deep, with escape
probabilities of method C, frozen after training. A text's code length in a
language is the sum over its words' bytes of what the deepest known context
takes, with escapes down to shorter contexts on the way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Ids, small_batches, staged

ORDER = 4
#: Words whose code lengths a task remembers at once.
CACHE = 400_000


def _keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every position's last ORDER bytes and its own byte as one number; and where each word starts.

    A word is led in by spaces and ends in one.
    """
    joined = b"".join(b" " * ORDER + w + b" " for w in words)
    raw = np.frombuffer(joined, np.uint8).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) + np.repeat((np.arange(len(words)) + 1) * ORDER, lengths)
    key = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        key = key << 8 | raw[at - back]
    return key, starts


@dataclass
class Trees:
    """levels[k]: keys of k context bytes and a symbol with bits by language; escapes[k]: contexts of k bytes with bits."""

    languages: list[str]
    levels: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    def _level(self, k: int, key: np.ndarray) -> np.ndarray:
        """Bits of keys of k context bytes in every language, with escapes down to the uniform byte."""
        if k < 0:
            return np.full((len(key), len(self.languages)), 8.0)
        known, bits = self.levels[k]
        at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        found = known[at] == key if len(known) else np.zeros(len(key), bool)
        out = np.empty((len(key), len(self.languages)))
        out[found] = bits[at[found]]
        if not found.all():
            short = key[~found]
            contexts, escape = self.escapes[k]
            parent = short >> 8
            c = np.minimum(np.searchsorted(contexts, parent), max(0, len(contexts) - 1))
            seen = contexts[c] == parent if len(contexts) else np.zeros(len(short), bool)
            lower, place = np.unique(short & ((1 << 8 * k) - 1) if k else np.zeros(len(short), np.int64), return_inverse=True)
            rest = self._level(k - 1, lower)[place]
            rest[seen] += escape[c[seen]]
            out[~found] = rest
        return out

    def bits(self, words: list[bytes]) -> np.ndarray:
        """Code lengths of words, by language."""
        if not words:
            return np.empty((0, len(self.languages)))
        key, starts = _keys(words)
        own, place = np.unique(key, return_inverse=True)
        return np.add.reduceat(self._level(ORDER, own)[place], starts, axis=0)


def freeze(counts: list[tuple[str, int, int]]) -> Trees:
    """Trees from (language, key of ORDER context bytes and a symbol, count)."""
    languages = sorted({c[0] for c in counts})
    which = {g: i for i, g in enumerate(languages)}
    lang = np.array([which[c[0]] for c in counts], np.int64)
    full = np.array([c[1] for c in counts], np.int64)
    n = np.array([c[2] for c in counts], np.float64)
    trees = Trees(languages, [], [])
    for k in range(ORDER + 1):
        own, place = np.unique(full & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        table = np.zeros((len(own), len(languages)))
        np.add.at(table, (place, lang), n)
        contexts, under = np.unique(own >> 8, return_inverse=True)
        total, kinds = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
        np.add.at(total, under, table)
        np.add.at(kinds, under, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
            bits = np.where(table > 0, np.log2((total + kinds)[under] / table), 0.0)
        shorter = trees._level(k - 1, own & ((1 << 8 * k) - 1)) if k else np.full(bits.shape, 8.0)
        trees.levels.append((own, np.where(table > 0, bits, escape[under] + shorter)))
        trees.escapes.append((contexts, escape))
    return trees


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def _chosen(known: DataFrame, most: int) -> DataFrame:
    """(_lang, _id): the first `most` ids of each language by hash.

    A share of the hashes, small for a language of many rows, holds them all:
    only that share is ranked, so no task gets a language's rows. It is
    widened where repeated ids left too few in it.
    """
    hashed = known.select(F.col("lang").alias("_lang"), F.col("id").alias("_id"), F.xxhash64("id").alias("_h"))
    sizes = staged(hashed.groupBy("_lang").agg(F.count("*").alias("_all")), "languages")
    place, times = F.shiftrightunsigned("_h", 11), 2
    while True:
        share = F.lit(float(times * most + 64)) / F.col("_all")
        near = hashed.join(F.broadcast(sizes), "_lang").where(place / F.lit(float(1 << 53)) <= share)
        near = staged(near.select("_lang", "_id", place.alias("_place")).distinct(), "near")
        held = sizes.join(near.groupBy("_lang").agg(F.count("*").alias("_n")), "_lang", "left")
        if held.where((F.coalesce("_n", F.lit(0)) < most) & (share < 1)).isEmpty():
            break
        times *= 16
    first = Window.partitionBy("_lang").orderBy("_place", "_id")
    return near.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("_lang", "_id")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = 500) -> Trees:
    """Trees from at most `most` documents of each language, in the order of a hash of the id.

    What the driver gathers is bounded by those documents' contexts. Languages
    are few: each has a column in the trees. Rows with a null text or language
    are left out, also where they repeat the id of another; rows that repeat
    an id and language are one document with all their texts. An empty table
    knows no language.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    known = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    same = (F.col("lang") == F.col("_lang")) & F.col("id").eqNullSafe(F.col("_id"))
    texts = known.join(F.broadcast(_chosen(known, most)), same)
    texts = texts.select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tally.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in tally.items():
            if not words:
                continue
            key, starts = _keys(list(words))
            times = np.repeat(np.fromiter(words.values(), np.int64), np.diff(np.append(starts, len(key))))
            own, place = np.unique(key, return_inverse=True)
            n = np.bincount(place, times).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own), pa.array(n)], ["lang", "key", "n"])

    rows = texts.mapInArrow(counted, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    return freeze(list(rows.sort_values(["lang", "key"]).itertuples(index=False, name=None)))


class Reader:
    """Code lengths of texts; remembers those of words."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.clear()

    def clear(self) -> None:
        self.ids, self.known = Ids(), np.empty((0, len(self.trees.languages)))

    def bits(self, texts: list[str]) -> np.ndarray:
        if len(self.ids) > CACHE:
            self.clear()
        cut = [words_of(t) for t in texts]
        at = [np.fromiter(map(self.ids.__getitem__, w), np.int64, len(w)) for w in cut]
        new = list(self.ids)[len(self.known) :]
        self.known = np.concatenate([self.known, self.trees.bits(new)])
        return np.array([self.known[a].sum(axis=0) for a in at]).reshape(len(texts), len(self.trees.languages))


def with_language(df: DataFrame, trees: Trees, text_col: str = "text", out: str = "language") -> DataFrame:
    """df with a struct: lang_pred, score (the language's share if all are equally likely), bits (its code length).

    `und` with score 0 for texts that are null or have no letter, and for all
    texts where no language was learned. Of equal lengths the first language
    in order wins. Repeated rows get the same; an empty table stays empty; a
    column of df that is named like `out` gives way.
    """
    small_batches(df.sparkSession)
    schema = "lang_pred string, score double, bits double"

    @F.arrow_udf(schema)
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(trees)
        for batch in batches:
            texts = batch.to_pylist()
            ok = np.array([bool(trees.languages and t and any(map(str.isalpha, t))) for t in texts], bool)
            names, scores, lengths = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if ok.any():
                bits = reader.bits([t for t, k in zip(texts, ok, strict=True) if k])
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(best)), best]
                scores[ok] = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
                lengths[ok] = least
                for i, b in zip(np.flatnonzero(ok), best, strict=True):
                    names[i] = trees.languages[b]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(lengths)], ["lang_pred", "score", "bits"])

    return df.withColumn(out, told(F.col(text_col)))
