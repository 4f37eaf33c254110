"""Toxicity of texts behind a noisy channel.

Writers hide words by letters that look alike (leetspeak), by spacing letters
out and by repeating them. Suspect tokens become lattices of the letters they
may stand for; Viterbi decoding under a character model of the corpus restores
them, and a linear model scores the words and word beginnings of the result.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "(": "c",
}
SEPARATORS = ".-_*~'’·"
WORD = re.compile(r"[^\W\d_]+")
#: Letters one by one, two at least, whatever stands between them; a sign of LEET is a letter.
ONE = r"(?:[^\W_]|[@$!|+€£¢(])(?![^\W_])"
SPACED = re.compile(rf"""(?<![^\s"\[{{(“„«]){ONE}(?:[\s.\-_*~·]+{ONE})+""")
TRAILING = re.compile(r"(?:\${3,}|[^\w@$])+$")
LEADING = re.compile(r"^[^\w@$€£¢(|+!]+")
PLAIN = re.compile(r"[^\W\d_]+$")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
INNER = re.compile(r"[^\W\d_][\d@$!|+€£¢(.\-_*~'’·]|[\d@$!|+€£¢(][^\W\d_]")
#: Keys in hexadecimal, told by their make-up once runs of a sign are one; they stay as they are.
HEX = re.compile(r"(?:0x)?(?=[a-f]*\d[a-f]*\d)[0-9a-f]{32,}$")
PIECE = re.compile(f"[^{re.escape(SEPARATORS)}]+")
RUN = re.compile(r"(.)\1+", re.DOTALL)
#: One sign again and again, or separators of any kinds: a spot of the lattice.
RUNS = re.compile(rf"[{re.escape(SEPARATORS)}]+|(.)\1*", re.DOTALL)

#: Symbols of the character model: an edge of a word, a to z, any other letter.
SIZE = 28
#: Tokens a task remembers at once.
CACHE = 200_000

#: log10 costs of the channel.
SUBSTITUTE, DROP, COLLAPSE, BREAK = -0.3, -0.3, -0.2, -1.0
#: A separator is dropped at this cost where three signs or more stand on either side: it more likely parts words.
JOIN = -3.0
#: Spots at which words may part.
PARTING = ([("", DROP)], [("", JOIN)])


def code(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else SIZE - 1


def trigram_counts(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of three characters running, words apart, over all texts.

    A table of SIZE ** 3 cells, whatever the corpus.
    """
    small_batches(df.sparkSession)
    fold = np.zeros(256, np.uint8)
    for b in range(256):
        fold[b] = b - 64 if 65 <= b <= 90 else b - 96 if 97 <= b <= 122 else 0 if b < 128 else SIZE - 1 if b >= 192 else 255

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if (t := text.as_py()) is None:
                    continue
                c = fold[np.frombuffer(f" {t} ".encode("utf-8", "replace"), np.uint8)]
                c = c[c != 255].astype(np.int64)
                c = np.insert(c, np.flatnonzero(c == 0), 0)
                key = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
                total += np.bincount(key, minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["key", "n"])

    table = np.zeros(SIZE**3, np.float64)
    rows = df.select(text_col).mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    for key, n in rows.collect():
        table[key] = n
    return table.reshape(SIZE, SIZE, SIZE)


def letter_model(counts: np.ndarray) -> np.ndarray:
    """log10 P(third | first two), trigrams backed by bigrams and single letters."""
    one = counts.sum((0, 1)) + 1
    two = counts.sum(0) + 4 * one / one.sum()
    two /= two.sum(1, keepdims=True)
    three = counts + 4 * two[None]
    return np.log10(three / three.sum(2, keepdims=True))


def _lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one sign: what it may stand for ('' is nothing), and the cost."""
    spots, before, last = [], "", ""
    pieces = {k: m.end() - m.start() for m in PIECE.finditer(token) for k in (m.end(), -m.start())}
    for run in RUNS.finditer(token):
        c, n, behind, last = run[0][0], len(run[0]), last, run[0][-1]
        if c in SEPARATORS:
            whole = min(pieces.get(run.start(), 0), pieces.get(-run.end(), 0)) >= 3
            spots.append([("", JOIN if whole else DROP)])
            continue
        letters = [(x, SUBSTITUTE * n) for x in LEET.get(c, "")] or ([(c, 0.0)] if c.isalpha() else [("", DROP)])
        alone = run.end() < len(token) and behind in SEPARATORS and token[run.end()] in SEPARATORS
        if c in "|!" and (spots or run.end() == len(token)) and not alone:  # spaced out or in front, a sign has a letter's place
            letters.append(("", DROP))
        options = []
        for x, cost in letters:
            options.append((x, cost + COLLAPSE * (n > 1 and x != "")))
            if n > 1 and x:
                options.append((x * 2, cost + COLLAPSE * (n > 2)))
        if c == before:
            options.append(("", COLLAPSE))
        spots.append(options)
        before = c
    return spots


def _ahead(beam: list, spot: list[tuple[str, float]], model: np.ndarray, most: int) -> list:
    """Partial readings (total, letters, last two codes) with one more spot."""
    after: dict[tuple[int, int], list] = defaultdict(list)
    for total, out, a, b in beam:
        for letters, cost in spot:
            x, y, z = total + cost, a, b
            for c in letters:
                k = 0 if c == "\0" else code(c)
                x, y, z = x + model[y, z, k], z, k
            after[y, z].append((x, out + letters.rstrip("\0"), y, z))
    return [r for found in after.values() for r in heapq.nlargest(most, found)]


def restored(token: str, model: np.ndarray, most: int = 8) -> list[tuple[str, float]]:
    """The likeliest readings of a lower-case token, best first.

    Viterbi over the lattice: of the readings that end in the same two
    letters the best `most` go on, so that none of the likeliest is lost.
    """
    beam = [(0.0, "", 0, 0)]
    for spot in [*_lattice(token), [("\0", 0.0)]]:
        beam = _ahead(beam, spot, model, most)
    return [(out, total) for total, out, _, _ in heapq.nlargest(most, beam) if out]


def words_in(token: str, model: np.ndarray, flat: list[float] | None = None) -> str:
    """The likeliest reading as words; a word may end at any separator, at the cost of BREAK.

    Viterbi over the spots in one pass: a state is the last two letters, or a
    word's beginning right behind a break, and of the readings that meet in it
    the best goes on. The time grows as the token does; nothing is left out.
    flat: the model's cells in one list.
    """
    flat = flat or model.ravel().tolist()
    start, fresh = 0, SIZE * SIZE  # keys of states: two codes, or a word that has just begun
    states: dict[int, tuple[float, tuple | None]] = {start: (0.0, None)}
    spots = _lattice(token)
    for i, spot in enumerate(spots):
        after: dict[int, tuple[float, tuple | None]] = {}
        for key, (total, said) in states.items():
            for letters, cost in spot:
                x, at = total + cost, key % (SIZE * SIZE)
                for c in letters:
                    k = code(c)
                    x, at = x + flat[at * SIZE + k], at % SIZE * SIZE + k
                if at not in after or x > after[at][0]:
                    after[at] = x, ((said, letters) if letters else said)
        if i and spot in PARTING:
            ended = [(x + flat[key * SIZE], said) for key, (x, said) in states.items() if key != fresh]
            if ended:
                x, said = max(ended, key=lambda e: e[0])
                after[fresh] = x + BREAK, (said, " ")
        states = after
    _, said = max(((x + flat[key % (SIZE * SIZE) * SIZE], said) for key, (x, said) in states.items()), key=lambda e: e[0])
    letters = []
    while said:
        said, last = said
        letters.append(last)
    return " ".join("".join(reversed(letters)).split())


#: Classes of bytes: letters (and parts of those beyond ASCII), signs that may be letters, those that need one behind, separators, white space.
LETTER, SIGN, WEAK, GAP, SPACE = 1, 2, 3, 4, 5
CLASS = np.zeros(256, np.uint8)
CLASS[97:123] = CLASS[128:] = LETTER
CLASS[48:58] = CLASS[[64, 36]] = SIGN
CLASS[[33, 124, 43, 40]] = WEAK
CLASS[[46, 45, 95, 42, 126, 39]] = GAP
CLASS[[9, 10, 11, 12, 13, 32]] = SPACE


def _hints(raw: np.ndarray) -> tuple[np.ndarray, bool]:
    """Where tokens look suspect, and whether letters may be spaced out."""
    kind = CLASS[raw]
    letter, sign = kind == LETTER, kind == SIGN
    weak = kind == WEAK
    at = np.zeros(len(raw), bool)
    at[:-1] |= letter[:-1] & sign[1:] | (sign | weak)[:-1] & letter[1:]
    at[:-2] |= letter[:-2] & (weak | (kind == GAP))[1:-1] & (letter | sign)[2:]
    at[:-2] |= (raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:]) & letter[:-2] & (raw[:-2] < 128)
    near = kind[(raw & 0xC0) != 0x80]
    gap = (near == SPACE) | (near == GAP)
    full = np.concatenate([[False], (near == LETTER) | (near == SIGN), [False]])
    lone = ~gap & (near > 0) & ~full[2:] & ~(full[:-2] & full[1:-1])
    at_signs = np.flatnonzero(~gap)
    wide = lone[at_signs[:-1]] & lone[at_signs[1:]] & (np.diff(at_signs) > 1)
    return np.flatnonzero(at), bool(wide.any())


def suspects(text: str) -> tuple[list[str], str]:
    """Lower-case tokens that may hide a word, and the text without them."""
    found = []

    def spaced(m: re.Match) -> str:
        found.append("·".join(re.findall(ONE, m[0])))
        return " "

    low = text.lower()
    coded = low.encode("utf-8", "replace")
    raw = np.frombuffer(coded, np.uint8)
    if len(raw) < 3:
        return found, low
    hits, wide = _hints(raw) if len(raw) > 6 else (np.arange(len(raw)), True)
    if wide or any(c in low for c in "·\xa0"):
        low = SPACED.sub(spaced, low)
        coded = low.encode("utf-8", "replace")
        raw = np.frombuffer(coded, np.uint8)
        hits = _hints(raw)[0] if len(raw) > 6 else np.arange(len(raw))
    if any(c in low for c in "€£¢’"):
        hits = np.union1d(hits, [m.start() for m in re.finditer("[€£¢’]".encode(), coded)]).astype(np.int64)
    if not len(hits):
        return found, low
    spaces = np.concatenate([[-1], np.flatnonzero(CLASS[raw] == SPACE), [len(raw)]])
    kept, upto = [], 0
    for k in np.unique(np.searchsorted(spaces, hits)):
        start, stop = int(spaces[k - 1]) + 1, int(spaces[k])
        core = TRAILING.sub("", LEADING.sub("", coded[start:stop].decode("utf-8", "replace")))
        if PLAIN.match(core) and not TRIPLE.search(core) or not (INNER.search(core) or TRIPLE.search(core)) or len(core) >= 32 and HEX.match(RUN.sub(r"\1", core)):
            continue
        found.append(core)
        kept.append(coded[upto:start])
        upto = stop
    kept.append(coded[upto:])
    return found, b" ".join(kept).decode("utf-8", "replace")


def parts(word: str) -> list[str]:
    """A word and its beginnings of 4 to 8 letters, double letters as single ones: a reading cannot tell them apart."""
    word = RUN.sub(r"\1", word)
    return [word, *(f"{word[:k]}*" for k in range(4, min(8, len(word) - 1) + 1))]


@dataclass
class Toxicity:
    letters: np.ndarray
    weights: dict[str, float]
    start: float

    def __post_init__(self) -> None:
        self._readings: dict[str, str] = {}
        self._flat = self.letters.ravel().tolist()
        self._parts: dict[str, list[tuple[str, float]]] = {}

    def reading(self, token: str) -> str:
        """The likeliest reading by channel and letters alone: what a word weighs does not bend it."""
        if token not in self._readings:
            if len(self._readings) > CACHE:
                self._readings.clear()
            self._readings[token] = words_in(token, self.letters, self._flat)
        return self._readings[token]

    def restore(self, text: str) -> str:
        """Lower-cased text with the readings of suspect tokens put at its end."""
        found, rest = suspects(text)
        return f"{rest} {' '.join(map(self.reading, found))}"

    def weigh(self, word: str) -> list[tuple[str, float]]:
        if word not in self._parts:
            if len(self._parts) > CACHE:
                self._parts.clear()
            self._parts[word] = [(p, w) for p in parts(word) if (w := self.weights.get(p))]
        return self._parts[word]

    def margin(self, text: str | None) -> float:
        words = Counter(WORD.findall(self.restore(text or "")))
        held: Counter = Counter()
        known = self._parts
        for word, n in words.items():
            for p, _ in known[word] if word in known else self.weigh(word):
                held[p] += n
        size = max(50, sum(words.values()))
        return self.start + sum(self.weights[p] * float(density(n, size)) for p, n in sorted(held.items()))


def density(n, size):
    return np.log1p(300 * n / size)


def _sampled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, most: int) -> DataFrame:
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")
    return chosen.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def _part_counts(chosen: DataFrame, plain: Toxicity) -> DataFrame:
    """(part, toxic documents, others) over the labelled sample."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, others = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("_text").to_pylist(), batch.column("_label").to_pylist(), strict=True):
                words = set(WORD.findall(plain.restore(text or "")))
                (toxic if label else others).update({p for w in words for p in parts(w)})
        names = list(toxic | others)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in (toxic, others))],
            ["part", "toxic", "others"],
        )

    rows = chosen.select("_text", "_label").mapInArrow(counted, "part string, toxic long, others long")
    return rows.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("others").alias("others"))


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    most: int = 20_000, features: int = 2_000, rounds: int = 300,
) -> Toxicity:
    """Learns the letters from all docs, the words from labelled ones.

    The linear model takes at most `most` labelled documents, in the order of
    a hash of their id, and the `features` parts that speak most for toxicity
    among them; both bound what the driver gathers. Null labels and ids are
    left out; an id with several labels counts as toxic if one says so, and
    one with several texts with the least of them. Without rows of both labels
    every text gets their share (half without rows).
    """
    small_batches(docs.sparkSession)
    plain = Toxicity(letter_model(trigram_counts(docs, text_col)), {}, 0.0)
    chosen = _sampled(docs, labels, label_col, id_col, text_col, most)
    both = chosen.agg(F.sum("_label").alias("toxic"), F.sum(1 - F.col("_label")).alias("others")).first()
    n1, n0 = both.toxic or 0, both.others or 0
    start = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return Toxicity(plain.letters, {}, start)
    share = (F.col("toxic") + F.col("others")) / (n1 + n0)
    z = (F.col("toxic") - n1 * share) / F.sqrt(n1 * share * (1 - share) + 1)
    best = _part_counts(chosen, plain).where("toxic >= 3").orderBy(z.desc(), "part").limit(features).select("part")
    names = [r.part for r in best.collect()]
    model = Toxicity(plain.letters, dict.fromkeys(names, 1.0), start)
    at = {p: i for i, p in enumerate(names)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values = [], []
            for text in batch.column("_text").to_pylist():
                words = Counter(WORD.findall(plain.restore(text or "")))
                own: Counter = Counter()
                for word, n in words.items():
                    for p, _ in model.weigh(word):
                        own[at[p]] += n
                size = max(50, sum(words.values()))
                names.append(sorted(own))
                values.append([float(density(own[k], size)) for k in names[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_label"), pa.array(names, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                ["_id", "_label", "_k", "_x"],
            )

    id_type = chosen.schema["_id"].dataType.simpleString()
    rows = chosen.mapInArrow(held, f"_id {id_type}, _label int, _k array<int>, _x array<double>").toArrow().sort_by("_id").combine_chunks()
    part = lambda c: rows[c].combine_chunks()
    y = part("_label").to_numpy().astype(np.float64)
    row = np.repeat(np.arange(len(y)), part("_k").value_lengths().to_numpy())
    model.weights, model.start = _logistic(row, part("_k").flatten().to_numpy(), part("_x").flatten().to_numpy(), y, names, start, rounds)
    return model


def _logistic(row, k, x, y, names: list[str], start: float, rounds: int) -> tuple[dict[str, float], float]:
    """L2-penalised logistic regression by Adam steps over all rows; x are the values that are not 0."""
    w = np.zeros(len(names) + 1)
    w[-1], m, v = start, np.zeros(len(w)), np.zeros(len(w))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, w[k] * x, len(y)) + w[-1])))
        g = np.append(np.bincount(k, (p - y)[row] * x, len(names)) / len(y) + 1e-4 * w[:-1], (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return {n: float(c) for n, c in zip(names, w[:-1], strict=True)}, float(w[-1])


def with_toxicity(df: DataFrame, model: Toxicity, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """df with the probability of label 1. Null and empty texts get that of a text without any listed word.

    Repeated rows get the same; an empty table stays empty; a column of df
    that is named like `out` gives way.
    """
    small_batches(df.sparkSession)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Toxicity(model.letters, model.weights, model.start)
        for texts in batches:
            m = np.array([own.margin(t) for t in texts.to_pylist()])
            yield pa.array(1 / (1 + np.exp(-np.clip(m, -30, 30))), pa.float64())

    return df.withColumn(out, scored(F.col(text_col)))


def with_restored(df: DataFrame, model: Toxicity, text_col: str = "text", out: str = "restored") -> DataFrame:
    """df with the lower-cased text, readings of suspect tokens at its end; null stays null."""
    small_batches(df.sparkSession)

    @F.arrow_udf("string")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Toxicity(model.letters, model.weights, model.start)
        for texts in batches:
            yield pa.array([None if t is None else own.restore(t) for t in texts.to_pylist()], pa.string())

    return df.withColumn(out, read(F.col(text_col)))
