"""Quality rules on tokeniser fertility.

Public vocabularies cut each word of a text; characters per token, the share
of byte-fallback tokens and the entropy of the tokens are held against bands
for the text's language or, where it has none, its script. A base rule on
length and on repeated passages goes before.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ranks
from .common import Ids, small_batches, spare, split_off, staged

#: Where the vocabularies lie; a parameter, for they are no part of this repository.
TOKENIZERS = "/opt/tokenizers"

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Words whose tokens a task remembers at once.
CACHE = 300_000


@dataclass(frozen=True)
class Band:
    """What a text may have: at least, at most; entropy in bits from `full` tokens on."""

    chars_per_token: tuple[float, float] = (1.0, 9.0)
    chars_per_byte_token: tuple[float, float] = (0.0, 16.0)
    fallback_share: tuple[float, float] = (0.0, 0.2)
    entropy: tuple[float, float] = (3.2, 16.0)


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    max_repeat_percent: int = 30
    #: Below so many tokens the entropy says little and is not judged.
    full: int = 60
    languages: dict[str, Band] = field(default_factory=lambda: dict(LANGUAGES))
    scripts: dict[str, Band] = field(default_factory=lambda: dict(SCRIPTS))


LANGUAGES = {
    "en": Band(chars_per_token=(1.7, 6.0)),
    "de": Band(chars_per_token=(1.6, 6.0)),
    "fr": Band(chars_per_token=(1.5, 6.0)),
    "es": Band(chars_per_token=(1.45, 6.0)),
}
#: Bands for texts without a known language; the last is for all other scripts.
SCRIPTS = {
    "latin": Band(chars_per_token=(1.3, 8.0)),
    "cyrillic": Band(chars_per_token=(0.9, 6.0), fallback_share=(0.0, 0.3)),
    "greek": Band(chars_per_token=(0.5, 4.0), fallback_share=(0.0, 0.5)),
    "han": Band(chars_per_token=(0.3, 3.0), fallback_share=(0.0, 0.9)),
    "other": Band(chars_per_token=(0.25, 9.0), fallback_share=(0.0, 1.0)),
}
RANGES = {
    "latin": re.compile(r"[A-Za-zÀ-ɏ]"),
    "greek": re.compile(r"[Ͱ-Ͽ]"),
    "cyrillic": re.compile(r"[Ѐ-ԯ]"),
    "han": re.compile(r"[぀-ヿ㐀-鿿가-힯]"),
}

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_tokens long, chars_per_token double, chars_per_byte_token double, fallback_share double, "
    "token_entropy double, band string"
)


def script_of(text: str) -> str:
    """The script of most letters; ties go to the first in order."""
    counts = {name: len(found.findall(text)) for name, found in RANGES.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


class Tokens:
    """Tokens of words under a piece vocabulary with byte fallback and a byte-level one."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, "piece_bpe_32k.model"))
        with open(os.path.join(folder, "byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.fallback = np.array([self.pieces.IsByte(i) for i in range(self.pieces.get_piece_size())])
        self.clear()

    def clear(self) -> None:
        self.ids = Ids()
        self.done = 0
        self.flat, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.byte_tokens = np.empty(0, np.int32)

    def learn(self) -> None:
        """Cuts the words that were numbered since."""
        if self.done == len(self.ids):
            return
        new = [w.decode("utf-8", "replace") for w in list(self.ids)[self.done :]]
        cut = self.pieces.encode(new, num_threads=1)
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        self.flat = np.concatenate([self.flat, np.fromiter((t for c in cut for t in c), np.int32, int(lengths.sum()))])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        own = np.fromiter((len(self.bytes.encode_ordinary(" " + w)) for w in new), np.int32, len(new))
        self.byte_tokens = np.concatenate([self.byte_tokens, own])
        self.done = len(self.ids)


#: Fixed value: the public pre-tokeniser pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words which the text has twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x94D049BB133111EB) + mixed[k : k + n]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = Counter(x for x in raw.split(b"\n") if x and not x.isspace())
    return sum(lines.values()) - len(lines)


def _numbered(raw: bytes, tokens: Tokens) -> tuple[list[bytes], np.ndarray]:
    words = raw.split()
    return words, np.fromiter(map(tokens.ids.__getitem__, words), np.int64, len(words))


def measured(texts: list[str | None], langs: list[str | None], tokens: Tokens, rules: Rules) -> list[tuple]:
    """METRICS of each text."""
    if len(tokens.ids) > CACHE:
        tokens.clear()
    raws = [(t or "").encode("utf-8", "replace") for t in texts]
    cut = [_numbered(raw, tokens) for raw in raws]
    tokens.learn()
    return [_document(t or "", raw, *c, g, tokens, rules) for t, raw, c, g in zip(texts, raws, cut, langs, strict=True)]


def _document(text: str, raw: bytes, words: list[bytes], ids: np.ndarray, lang: str | None, tokens: Tokens, rules: Rules) -> tuple:
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeat = repeated_words(ids)
    failed = len(words) < rules.min_words or 100 * repeat > rules.max_repeat_percent * len(words)
    name = lang if lang in rules.languages else script_of(text)
    band = rules.languages.get(name) or rules.scripts[name]
    own, times = np.unique(ids, return_counts=True)
    size = tokens.start[own + 1] - tokens.start[own]
    at = np.repeat(tokens.start[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(own) else np.empty(0, np.int64)
    seen = tokens.flat[at]
    weight = np.repeat(times, size)
    n = int(weight.sum())
    fallback = int(weight[tokens.fallback[seen]].sum()) / n if n else 0.0
    order = np.argsort(seen)
    heads = np.flatnonzero(np.diff(seen[order], prepend=-1)) if n else np.empty(0, np.int64)
    p = np.add.reduceat(weight[order], heads) / n if n else np.empty(0)
    entropy = float(-(p * np.log2(p)).sum()) if n else 0.0
    per_token = chars / n if n else 0.0
    n_bytes = int(tokens.byte_tokens[own] @ times) if len(own) else 0
    per_byte_token = chars / n_bytes if n_bytes else 0.0
    fits = (
        band.chars_per_token[0] <= per_token <= band.chars_per_token[1]
        and band.chars_per_byte_token[0] <= per_byte_token <= band.chars_per_byte_token[1]
        and band.fallback_share[0] <= fallback <= band.fallback_share[1]
        and (n < rules.full or band.entropy[0] <= entropy <= band.entropy[1])
    )
    return (
        len(words), chars, symbols, duplicate_lines(raw), repeat, bool(failed), bool(not failed and fits),
        n, per_token, per_byte_token, fallback, entropy, name,
    )


def with_fertility(
    df: DataFrame, text_col: str = "text", lang_col: str | None = "lang", rules: Rules | None = None,
    tokenizers: str = TOKENIZERS, out: str = "fertility",
) -> DataFrame:
    """df with a struct column `out`: the base counts, the metrics, the band's name and the verdict.

    A null text counts as an empty one: no words, base_failed. A null or
    unknown language takes the band of the text's script. Windows of words are
    compared by 64-bit hashes within one text. Repeated rows and other columns
    stay as they are, but for one named like `out`; an empty table stays empty.
    The vocabularies lie in the folder `tokenizers`, on every executor; where
    it is missing the job fails.
    """
    small_batches(df.sparkSession)
    rules = rules or Rules()

    @F.arrow_udf(METRICS)
    def measure(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tokens = Tokens(tokenizers)
        kind = pa.struct([(n, t) for n, t in zip(*_fields(), strict=True)])
        for texts, langs in batches:
            rows = measured(texts.to_pylist(), langs.to_pylist(), tokens, rules)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _fields()[1], strict=True)] if rows else [pa.array([], t) for t in _fields()[1]]
            yield pa.StructArray.from_arrays(columns, fields=list(kind))

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    return df.withColumn(out, measure(F.col(text_col), lang))


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    least: int = 100, share: float = 0.001, rules: Rules | None = None, tokenizers: str = TOKENIZERS,
) -> Rules:
    """rules with bands from the documents that are known to be good: a language's lower bounds are the measures that all but `share` of its own reach.

    Characters per token under both vocabularies and the entropy of tokens are
    bounded so, each by itself, for languages with `least` good documents or
    more that pass the base rule; others keep the bands that rules have. Upper
    bounds and byte fallback stay as they are. All documents of label 1 are
    measured, and the bounds are exact percentiles; an id with several labels
    counts with the least, null ids do not count. Without labels, or without
    documents, rules come back unchanged.
    """
    rules = rules or Rules()
    chosen = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).where("_lang is not null")
    found = with_fertility(split_off(chosen, "_of", _good(labels, label_col, id_col), "left_semi"), "_text", "_lang", rules, tokenizers, "_f")
    # Staged before the filter, which would else be pushed below and measure twice.
    return _fitted(staged(found.select("_lang", "_f"), "measured"), rules, least, share)


def _good(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    good = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label")).where("_label = 1")
    return staged(good.select("_id"), "good")


def _fitted(measured: DataFrame, rules: Rules, least: int, share: float) -> Rules:
    """rules with the bounds of (_lang, _f), what good documents measure."""
    found = measured.select("_lang", "_f.*").where("not base_failed")
    full = F.when(F.col("n_tokens") >= rules.full, F.col("token_entropy"))
    named = {"chars_per_token": F.col("chars_per_token"), "chars_per_byte_token": F.col("chars_per_byte_token"), "entropy": full}
    values = F.array(*(F.struct(F.lit(k).alias("_metric"), c.alias("_value")) for k, c in named.items()))
    languages = dict(rules.languages)
    enough = {r["_lang"] for r in found.groupBy("_lang").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    lows: dict[str, dict[str, float]] = {lang: {} for lang in enough}
    for r in percentiles(found.select("_lang", F.inline(values)).where("_value is not null"), ["_lang", "_metric"], "_value", share).collect():
        if r["_lang"] in enough:
            lows[r["_lang"]][r["_metric"]] = r["_low"]
    for lang, low in lows.items():
        old = languages.get(lang, Band())
        languages[lang] = replace(old, **{k: (v, getattr(old, k)[1]) for k, v in low.items()})
    return replace(rules, languages=languages)


def with_fitted(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    least: int = 100, share: float = 0.001, rules: Rules | None = None, tokenizers: str = TOKENIZERS, out: str = "fertility",
) -> DataFrame:
    """(id_col, out): with_fertility() under the rules that fit() gives for the same tables, each text measured once.

    The measures are written without the texts; the bands are held against them afterwards.
    """
    rules = rules or Rules()
    rows = docs.select(F.col(id_col).alias("_of"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    found = staged(with_fertility(rows, "_text", "_lang", rules, tokenizers, "_f").drop("_text"), "measured")
    good = split_off(found.where("_lang is not null"), "_of", _good(labels, label_col, id_col), "left_semi")
    own = _judged(F.col("_f"), F.col("_lang"), _fitted(good, rules, least, share))
    return found.select(F.col("_of").alias(id_col), own.alias(out))


def _judged(f: Column, lang: Column, rules: Rules) -> Column:
    """METRICS f with the band and the verdict that rules give; f was measured under rules with no other languages than these."""
    bands = rules.scripts | rules.languages
    limits = F.create_map(*(x for n, b in bands.items() for x in (F.lit(n), F.array(*(F.lit(float(v)) for v in (*b.chars_per_token, *b.chars_per_byte_token, *b.fallback_share, *b.entropy))))))
    name = F.when(lang.isin(*rules.languages), lang).otherwise(f["band"])
    at = limits[name]
    within = lambda c, i: (f[c] >= at[i]) & (f[c] <= at[i + 1])
    fits = within("chars_per_token", 0) & within("chars_per_byte_token", 2) & within("fallback_share", 4) & ((f["n_tokens"] < rules.full) | within("token_entropy", 6))
    return f.withField("kept", ~f["base_failed"] & fits).withField("band", name)


def percentiles(rows: DataFrame, group: list[str], value: str, share: float) -> DataFrame:
    """(group, _low): each group's exact percentile, between the two values next to it; values are placed by range, so no task holds a group."""
    counts = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    at = (F.col("_n") - 1) * F.lit(share)
    ends = counts.select(*(F.col(g).alias(f"_of_{g}") for g in group), F.floor(at).alias("_below"), F.ceil(at).alias("_above"), at.alias("_at"))
    same = reduce(Column.__and__, (F.col(g) == F.col(f"_of_{g}") for g in group))
    seat = F.col("_seat") - 1
    near = ranks.placed(rows, [value], "_seat", group).join(ends, same & (seat >= F.col("_below")) & (seat <= F.col("_above")))
    low, high = F.min(value), F.max(value)
    weighed = (F.first("_above") - F.first("_at")) * low + (F.first("_at") - F.first("_below")) * high
    return near.groupBy(*group).agg(F.when(low == high, low).otherwise(weighed).alias("_low"))


def _fields() -> tuple[list[str], list[pa.DataType]]:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
    pairs = [x.split() for x in METRICS.split(", ")]
    return [n for n, _ in pairs], [kinds[t] for _, t in pairs]


def keep_fertile(
    df: DataFrame, text_col: str = "text", lang_col: str | None = "lang", rules: Rules | None = None, tokenizers: str = TOKENIZERS,
) -> DataFrame:
    """The rows of df that pass, with df's columns.

    Null and empty texts fail the base rule and go; a null or unknown language
    takes the band of the text's script; repeated rows stay or go together;
    columns may have any names; an empty table stays empty.
    """
    out = spare("_fertility", df)
    return with_fertility(df, text_col, lang_col, rules, tokenizers, out).where(F.col(out)["kept"]).drop(out)
