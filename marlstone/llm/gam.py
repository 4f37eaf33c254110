"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: in each round every feature in turn gets a shallow tree on
its own histogram, added to the feature's lookup table; then the pairs of
features that explain most of what is left get tables of their own. A score is
a sum of table entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, small_batches
from .fertility import SYMBOLS, duplicate_lines, repeated_words

FEATURES = (
    "log_words", "word_length", "symbol_share", "pipe_words", "exclamation_share", "upper_share", "digit_share",
    "stop_share", "distinct_share", "repeat_share", "repeated_lines", "line_words", "top_share", "short_words",
    "odd_ends", "same_next",
)

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".,;:?"
ODD_END = re.compile(rb"[^\w\s.,;:?\x80-\xff\"')]+(?=\s|$)")


def features(text: str | None) -> list[float]:
    """FEATURES of a text; an empty or null one has zeros only."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    ids = Ids()
    at = np.fromiter(map(ids.__getitem__, words), np.int64, n)
    size = len(b"".join(words))
    count = lambda kinds: len(raw) - len(raw.translate(None, kinds))
    upper, lower = count(UPPER), count(LOWER)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    tally = Counter(words)
    return [
        np.log1p(n), size / n, count(SYMBOLS) / size, tally.get(b"|", 0) / n, count(b"!") / size,
        upper / max(1, upper + lower), count(DIGITS) / size, count(STOPS) / n, len(ids) / n,
        repeated_words(at) / n, duplicate_lines(raw) / len(lines), np.log1p(n / len(lines)),
        max(tally.values()) / n, float((lengths <= 3).mean()), len(ODD_END.findall(raw)) / n,
        float((at[1:] == at[:-1]).sum()) / n,
    ]


@dataclass
class Gam:
    """edges: bin limits of each feature; tables: log odds by bin; pairs: (i, j, table by coarse bins)."""

    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for i, (edge, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edge, x[:, i], "right")]
        for i, j, values in self.pairs:
            a = np.searchsorted(self.coarse[i], x[:, i], "right")
            b = np.searchsorted(self.coarse[j], x[:, j], "right")
            total += values[a, b]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _limits(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1], method="higher")) for i in range(x.shape[1])]


def _gain(g, h, l2: float):
    return g * g / (h + l2)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """A tree of so many leaves on a histogram of gradients, as a value for each bin."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            won = _gain(left_g, left_h, l2) + _gain(all_g - left_g, all_h - left_h, l2) - _gain(all_g, all_h, l2)
            at = int(np.argmax(won))
            if won[at] > best[0]:
                best = (won[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The best cut of a pair's histogram into four quarters: gain and values."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quads = []
    for c in (cg, ch):
        low = c[:-1, :-1]
        quads.append((low, c[:-1, -1:] - low, c[-1:, :-1] - low, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + low))
    won = sum(_gain(a, b, l2) for a, b in zip(*quads, strict=True))
    if not won.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(won)), won.shape)
    out = np.zeros_like(g)
    for k, part in enumerate((np.s_[: i + 1, : j + 1], np.s_[: i + 1, j + 1 :], np.s_[i + 1 :, : j + 1], np.s_[i + 1 :, j + 1 :])):
        out[part] = quads[0][k][i, j] / (quads[1][k][i, j] + l2)
    return float(won[i, j] - _gain(cg[-1, -1], ch[-1, -1], l2)), out


def train(
    x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 12, rounds: int = 200, rate: float = 0.1,
    leaves: int = 3, pairs: int = 6, l2: float = 1.0,
) -> Gam:
    """Fits a Gam. Without rows of both labels it returns their share for every text (0.5 without rows)."""
    start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    edges, rough = (_limits(x, bins), _limits(x, coarse)) if len(y) else ([np.empty(0)] * x.shape[1],) * 2
    model = Gam(start, edges, [np.zeros(len(e) + 1) for e in edges], rough, [])
    if not 0 < y.sum() < len(y):
        return model
    at = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]
    margin = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, b in enumerate(at):
            g, h = slopes()
            step = rate * _tree(np.bincount(b, g, len(edges[i]) + 1), np.bincount(b, h, len(edges[i]) + 1), leaves, l2)
            model.tables[i] += step
            margin += step[b]
    flat = [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(rough)]

    def grid(i: int, j: int, w: np.ndarray) -> np.ndarray:
        shape = len(rough[i]) + 1, len(rough[j]) + 1
        return np.bincount(flat[i] * shape[1] + flat[j], w, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = {(i, j): _quarters(grid(i, j, g), grid(i, j, h), l2)[0] for i, j in combinations(range(x.shape[1]), 2)}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:pairs]
    tables = {p: np.zeros((len(rough[p[0]]) + 1, len(rough[p[1]]) + 1)) for p in chosen}
    for _ in range(rounds // 4):
        for i, j in chosen:
            g, h = slopes()
            step = rate * _quarters(grid(i, j, g), grid(i, j, h), l2)[1]
            tables[i, j] += step
            margin += step[flat[i], flat[j]]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def with_features(df: DataFrame, text_col: str = "text", out: str = "features") -> DataFrame:
    """df with an array of FEATURES."""
    small_batches(df.sparkSession)

    @F.arrow_udf("array<double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return df.withColumn(out, measured(F.col(text_col)))


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", most: int = 20_000, **settings) -> Gam:
    """Learns from at most `most` labelled documents, taken in the order of a hash of the id.

    labels: id_col and label_col (0 or 1; rows with other or null values are
    left out). `most` bounds what the driver gathers: that many rows of
    features. An id with several labels counts with the least of them, an id
    with several texts with the least of those.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    chosen = chosen.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    rows = with_features(chosen, "_text", "_x").select("_id", "_label", "_x").toPandas().sort_values("_id", kind="stable")
    x = np.array(rows["_x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return train(x, rows["_label"].to_numpy(np.float64), **settings)


def with_score(df: DataFrame, model: Gam, text_col: str = "text", out: str = "score") -> DataFrame:
    """df with the model's probability of label 1. Null texts count as empty ones.

    Repeated rows get the same; an empty table stays empty; a column of df
    that is named like `out` gives way.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t) for t in texts.to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.array(model.scores(x), pa.float64())

    return df.withColumn(out, scored(F.col(text_col)))
