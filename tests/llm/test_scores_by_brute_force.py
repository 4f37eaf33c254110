"""Features, tables and scores of the quality and toxicity models against plain loops."""

import math
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import gam, queries, toxicity

SF = "/root/testdata/sf0.001"


def plain_features(text):
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(gam.FEATURES)
    n, size = len(words), sum(map(len, words))
    times = Counter(tuple(words[i : i + 8]) for i in range(n - 7))
    repeated = {i + k for i in range(n - 7) if times[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in raw.split(b"\n") if x.split()]
    share = lambda test: sum(map(test, raw))
    upper, lower = share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122)
    odd = sum(len(re.findall(rb"[^\w\s.,;:?\x80-\xff\"')]+$", w)) > 0 for w in words)
    return [
        math.log1p(n), size / n, share(lambda b: b in b"#*$%&|<>") / size, words.count(b"|") / n, share(lambda b: b == 33) / size,
        upper / max(1, upper + lower), share(lambda b: 48 <= b <= 57) / size, share(lambda b: b in b".,;:?") / n, len(set(words)) / n, len(repeated) / n,
        (len(lines) - len(set(lines))) / len(lines), math.log1p(n / len(lines)), max(Counter(words).values()) / n, sum(len(w) <= 3 for w in words) / n,
        odd / n, sum(a == b for a, b in zip(words, words[1:])) / n,
    ]


def plain_margin(model, x):
    total = model.start
    for i, edge in enumerate(model.edges):
        total += model.tables[i][bisect_right(edge.tolist(), x[i])]
    for i, j, table in model.pairs:
        total += table[bisect_right(model.coarse[i].tolist(), x[i])][bisect_right(model.coarse[j].tolist(), x[j])]
    return total


def test_quality_by_brute_force(spark):
    model = queries.quality_model(spark, SF)
    got = {r.doc_id: r for r in queries.op3_quality_gam(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert set(got) == {r.doc_id for r in docs}
    for r in docs:
        x = plain_features(r.text)
        assert gam.features(r.text) == pytest.approx(x)
        score = 1 / (1 + math.exp(-max(-30, min(30, plain_margin(model, x)))))
        assert got[r.doc_id].score == pytest.approx(score) and got[r.doc_id].predicted == (score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_trees_by_brute_force():
    """A tree's cuts are the best of all pairs of cuts taken one after the other; four quarters are the best of all."""
    rnd = np.random.default_rng(4)
    for _ in range(20):
        g, h = rnd.normal(size=9), rnd.random(9) + 0.1
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)  # noqa: B023, E731
        first = max(range(1, 9), key=lambda c: gain(0, c) + gain(c, 9))
        ways = [((0, c), (c, first), (first, 9)) for c in range(1, first)] + [((0, first), (first, c), (c, 9)) for c in range(first + 1, 9)] + [((0, first), (first, 9))]
        if gain(0, first) + gain(first, 9) - gain(0, 9) <= 1e-9:
            ways = [((0, 9),)]
        best = max(ways, key=lambda parts: sum(gain(a, b) for a, b in parts))
        want = np.concatenate([[g[a:b].sum() / (h[a:b].sum() + 1)] * (b - a) for a, b in best])
        assert gam._tree(g, h, 3, 1.0) == pytest.approx(want)
        g, h = rnd.normal(size=(5, 4)), rnd.random((5, 4)) + 0.1
        quarters = lambda x, i, j: [x[:i, :j].sum(), x[:i, j:].sum(), x[i:, :j].sum(), x[i:, j:].sum()]
        won = max(sum(a * a / (b + 1) for a, b in zip(quarters(g, i, j), quarters(h, i, j))) for i in range(1, 5) for j in range(1, 4))
        assert gam._quarters(g, h, 1.0)[0] == pytest.approx(won - g.sum() ** 2 / (h.sum() + 1))


def plain_toxicity(model, text):
    """Each word and beginning of the restored text, by a loop over all weights."""
    words = re.findall(r"[^\W\d_]+", model.restore(text or ""))
    held = Counter()
    for w in words:
        w = re.sub(r"(.)\1+", r"\1", w)
        for p in {w, *(w[:k] + "*" for k in range(4, min(8, len(w) - 1) + 1))}:
            held[p] += 1
    return model.start + sum(c * math.log1p(300 * held[p] / max(50, len(words))) for p, c in model.weights.items())


def test_toxicity_by_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.with_toxicity(docs, model).collect()
    assert rows
    for r in rows:
        m = max(-30, min(30, plain_toxicity(model, r.text)))
        assert r.toxicity == pytest.approx(1 / (1 + math.exp(-m)))


def test_words_hidden_in_long_tokens(spark):
    """Sixty signs and more: what is hidden behind separators, repeats and look-alikes weighs as the word does."""
    letters = toxicity.letter_model(toxicity.trigram_counts(spark.read.parquet(f"{SF}/documents.parquet")))
    model = toxicity.Toxicity(letters, {"idiot": 3.0, "moron": 3.0}, -2.0)
    filler = " ".join(random.Random(1).choices(["the", "and", "there", "in"], k=60))
    clean = model.margin(filler)
    for hidden in ("i" * 25 + "d" * 20 + "1" + "0" * 30 + "t", "_".join("idiot" * 1) + "_" * 60, "m" + "-" * 70 + "0r0n", "x-" * 40 + "m0r0n", "i" + "." * 80 + "d1ot"):
        assert len(hidden) >= 60 and model.margin(f"{filler} {hidden} there") > clean + 3
    assert model.margin(f"{filler} {'3f2a9c0d4e5b6a7f' * 4}") == pytest.approx(clean, abs=0.5)
