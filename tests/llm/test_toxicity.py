"""Spaced-out, joined and long words in the noisy channel."""

import random

import numpy as np
import pytest

from marlstone.llm import toxicity


@pytest.fixture(scope="module")
def letters(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return toxicity.letter_model(toxicity.trigram_counts(docs))


@pytest.fixture(scope="module")
def model(letters):
    return toxicity.Toxicity(letters, dict.fromkeys(["idiot", "trash", "stupid", "moron"], 1.0), 0.0)


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("such a m o r o n", ["moron"]), ("such A M O R O N, really", ["moron"]), ("i d ! o t", ["idiot"]), ("$ t u p i d", ["stupid"]),
        ("what + r @ s h", ["trash"]), ("i d i o t y o u m o r o n", ["idiot", "moron"]), ("you   i    d  -  i\to\n t there", ["idiot"]),
        ('say "m o r o n" now', ["moron"]), ("so-called stup1d-m0r0n", ["stupid", "moron"]),
    ],
)
def test_spaced_words(model, text, wanted):
    assert set(wanted) <= set(model.restore(text).split())


def test_short_spaced_words():
    assert toxicity.suspects("you a s s there")[0] == ["a·s·s"]
    assert toxicity.suspects("one a day, and a word")[0] == []


def test_long_tokens(model):
    for text in ("idi" + "o" * 60 + "t", "-".join(["plain", "words"] * 5 + ["m0r0n", "and", "more"]), "i" * 300 + "d1" + "o" * 300 + "t"):
        assert {"idiot", "moron"} & set(model.restore(text).split())
    assert toxicity.suspects("key 3f2a9c0d4e5b6a7f8091a2b3c4d5e6f708192a3b end")[0] == []


def all_best(token, letters):
    """The score of the best reading: a maximum over all paths, position by position, held by the last two codes alone."""
    states = {(0, 0): 0.0}
    for spot in [*toxicity._lattice(token), [("\0", 0.0)]]:
        after = {}
        for (a, b), total in states.items():
            for word, cost in spot:
                x, y, z = total + cost, a, b
                for k in (0 if c == "\0" else toxicity.code(c) for c in word):
                    x, y, z = x + letters[y, z, k], z, k
                after[y, z] = max(x, after.get((y, z), -np.inf))
        states = after
    return max(states.values())


def brute(token, letters):
    ways = [("", 0.0)]
    for spot in toxicity._lattice(token):
        ways = [(w + x, c + k) for w, c in ways for x, k in spot]
    rated = []
    for word, total in ways:
        a = b = 0
        for k in [*map(toxicity.code, word), 0]:
            total, a, b = total + letters[a, b, k], b, k
        rated.append((total, word))
    return max(rated)


def test_longer_tokens_by_brute_force(letters):
    rnd = random.Random(5)
    for _ in range(12):
        token = "".join(rnd.choice("11!|66aabt0") * rnd.randint(1, 2) for _ in range(8))
        best, word = brute(token, letters)
        got, score = toxicity.restored(token, letters)[0]
        assert (score, got) == (pytest.approx(best), word)
    flat = np.log10(np.random.default_rng(1).dirichlet([0.2] * 28, (28, 28)) + 1e-9)
    for _ in range(40):
        token = "".join(rnd.choice("1!|60ab") * rnd.randint(1, 3) for _ in range(60))
        assert toxicity.restored(token, flat)[0][1] == pytest.approx(all_best(token, flat))
