import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ctw, fertility, gam, ppm, queries, toxicity

EDGES = [(1, None, "en"), (2, "", None), (3, "word", "xx"), (3, "word", "xx"), (None, "a b c " * 20, "en"), (5, "é" * 5000, "fr"), (6, " \n\t", "de")]


@pytest.fixture(scope="module")
def edges(spark):
    clash = [(i, t, g, "s", 1, "x", 2.0) for i, t, g in EDGES]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, n int, kept string, score double")


def words_of(text):
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def base_counts(text):
    words = words_of(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    held = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(held), n < 20 or 100 * len(held) > 30 * n


def test_base_counts_of_all_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op2_tokeniser_fertility(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_fertility_by_the_tokenizer_itself(spark, sf):
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{fertility.TOKENIZERS}/piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").limit(20)
    for r in fertility.with_fertility(docs).collect():
        ids = [t for w in words_of(r.text) for t in pieces.encode(w)]
        counts = Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
        got = r.fertility
        assert got.n_tokens == len(ids)
        assert got.fallback_share == pytest.approx(sum(map(pieces.IsByte, ids)) / len(ids))
        assert got.token_entropy == pytest.approx(entropy)


def test_fertility_of_edge_rows(edges):
    rows = fertility.with_fertility(edges).select("doc_id", "fertility.n_words", "fertility.kept", "fertility.band").collect()
    assert sorted((r.n_words, r.kept) for r in rows) == [(0, False)] * 3 + [(1, False)] * 3 + [(60, False)]
    assert fertility.keep_fertile(edges).columns == edges.columns
    assert fertility.keep_fertile(edges.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op3_quality_gam(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_additive_model_learns_an_interaction():
    rnd = np.random.default_rng(1)
    x = rnd.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.train(x, y, coarse=16)
    assert (0, 1) in [(i, j) for i, j, _ in model.pairs]
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    assert gam.train(x[:0], y[:0]).scores(x).tolist() == [0.5] * 3000
    assert (gam.train(x, np.ones(3000)).scores(x) > 0.9).all()


def test_quality_of_edge_rows(spark, edges):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, 1), (None, 1), (9, None)], "doc_id long, quality int")
    model = gam.fit(edges, labels, "quality")
    assert gam.with_score(edges, model, out="s").where("s between 0 and 1").count() == len(EDGES)
    assert gam.with_score(edges.limit(0), gam.fit(edges.limit(0), labels, "quality"), out="s").count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op5_noisy_channel_toxicity(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    found = [r for r in held if labels[r.doc_id] == 1 and r.predicted]
    assert len(found) > 0.85 * sum(labels[r.doc_id] for r in held)
    assert sum(r.predicted for r in held if not labels[r.doc_id]) < 0.01 * len(held)


@pytest.fixture(scope="module")
def letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counts = toxicity.trigram_counts(docs)
    text = " ".join(r.text for r in docs.collect()).lower()
    assert counts[0].sum() > text.count(" ") // 2
    return toxicity.letter_model(counts)


def test_restoration(letters):
    model = toxicity.Toxicity(letters, dict.fromkeys(["idiot", "trash", "stupid", "moron"], 1.0), 0.0)
    for hidden in ("1d1ot", "!diot", "i.d.i.o.t", "iiidiooot", "i d i o t", "I-D-I-O-T"):
        assert "idiot" in model.restore(f"you {hidden} there").split()
    for hidden in ("tr@sh", "tr4$h", "7rash", "trrrash", "t r a s h"):
        assert "trash" in model.restore(f"what {hidden}, no").split()
    plain = "Plain words, with marks! And so on."
    assert model.restore(plain).split() == plain.lower().split()


def brute_readings(token, letters):
    ways = [("", 0.0)]
    for spot in toxicity._lattice(token):
        ways = [(w + x, c + k) for w, c in ways for x, k in spot]

    def total(word):
        a = b = 0
        out = 0.0
        for c in [*map(toxicity.code, word), 0]:
            out, a, b = out + letters[a, b, c], b, c
        return out

    return max(((c + total(w)), w) for w, c in ways if w)


def test_viterbi_by_brute_force(letters):
    rnd = random.Random(3)
    for _ in range(60):
        token = "".join(rnd.choice("abeilost01345@$!") for _ in range(rnd.randint(2, 6)))
        best, word = brute_readings(token, letters)
        got, score = toxicity.restored(token, letters)[0]
        assert (score, got) == (pytest.approx(best), word)


def test_toxicity_of_edge_rows(spark, edges):
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(edges, labels)
    assert toxicity.with_toxicity(edges, model, out="t").where("t between 0 and 1").count() == len(EDGES)
    assert toxicity.with_restored(edges, model).where("restored is null").count() == 1
    empty = toxicity.fit(edges.limit(0), labels.limit(0))
    assert toxicity.with_toxicity(edges.limit(0), empty).count() == 0


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.op9_ppm_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.97


def plain_code_length(text, training):
    """Method C without exclusions, context by context."""
    counts = {}
    for t in training:
        for w in t.lower().encode().split():
            s = b" " * ppm.ORDER + w + b" "
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    counts.setdefault(s[i - k : i], Counter())[s[i]] += 1
    bits = 0.0
    for w in text.lower().encode().split():
        s = b" " * ppm.ORDER + w + b" "
        for i in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER, -2, -1):
                if k < 0:
                    bits += 8
                    break
                seen = counts.get(s[i - k : i])
                if seen is None:
                    continue
                total = sum(seen.values()) + len(seen)
                if s[i] in seen:
                    bits -= math.log2(seen[s[i]] / total)
                    break
                bits -= math.log2(len(seen) / total)
    return bits


def test_code_lengths_by_brute_force(spark):
    known = [(1, "the cat sat on the mat", "en"), (2, "that thing there", "en"), (3, "der hund und die katze", "de"), (4, None, "de"), (5, "x", None)]
    asked = ["the hat", "und der tag", "zebra quux", "cat", "1 2 3", None, ""]
    docs = spark.createDataFrame(known, "doc_id long, text string, lang string")
    trees = ppm.fit(docs)
    assert trees.languages == ["de", "en"]
    reader = ppm.Reader(trees)
    for text in asked[:5]:
        want = [plain_code_length(text, [t for _, t, g in known if g == lang and t]) for lang in trees.languages]
        assert reader.bits([text])[0].tolist() == pytest.approx(want)
    out = ppm.with_language(spark.createDataFrame([(t,) for t in asked], "text string"), trees).select("language.*").collect()
    assert [r.lang_pred for r in out] == ["en", "de", out[2].lang_pred, "en", "und", "und", "und"]


def test_language_of_edge_rows(edges):
    assert ppm.with_language(edges, ppm.fit(edges)).where("language.lang_pred = 'und'").count() == 3
    assert ppm.with_language(edges, ppm.fit(edges.limit(0))).where("language.lang_pred = 'und'").count() == len(EDGES)


def plain_ctw(texts, trained):
    """Recursive context-tree weighting of every bit of every text."""
    counts = {}

    def bits(raw):
        for i in range(ctw.DEPTH, len(raw)):
            context = raw[i - ctw.DEPTH : i][::-1]
            for j in range(8):
                yield context, (1 << j) | raw[i] >> (8 - j), raw[i] >> (7 - j) & 1

    def stream(text):
        words = (text or "").encode().lower().split()
        return b" " * ctw.DEPTH + b"".join(w + b" " for w in words) + bytes([ctw.END])

    for t in trained:
        for context, node, bit in bits(stream(t)):
            for d in range(ctw.DEPTH + 1):
                counts.setdefault((context[:d], node), [0, 0])[bit] += 1

    def kt(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(n[0] + n[1] + 1)

    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[:-1], node), []).append((context, node))
    memo = {}

    def weighted(k):
        if k not in memo:
            pe = kt(counts.get(k, (0, 0)))
            memo[k] = pe if len(k[0]) == ctw.DEPTH else np.logaddexp(math.log(0.5) + pe, math.log(0.5) + sum(map(weighted, children.get(k, []))))
        return memo[k]

    def one(context, node, d=0):
        k = (context[:d], node)
        n = counts.get(k, (0, 0))
        p = (n[1] + 0.5) / (n[0] + n[1] + 1)
        if d == ctw.DEPTH:
            return p
        own = math.exp(math.log(0.5) + kt(n) - weighted(k))
        return own * p + (1 - own) * one(context, node, d + 1)

    out = []
    for t in texts:
        total = 0.0
        for context, node, bit in bits(stream(t)):
            p = one(context, node)
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


def test_context_tree_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK", 200)
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["the", "Then", "hat", "añ", "x"]) for _ in range(rnd.randint(1, 25))) for _ in range(30)] + [None, "", "new things \n here"]
    rows = [(i, t, i % 3 == 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean").repartition(3)
    got = {r.doc_id: r for r in ctw.score(df, F.col("held")).collect()}
    want = plain_ctw(texts, [t for _, t, h in rows if not h])
    train = Counter(w for _, t, h in rows if not h for w in (t or "").lower().split())
    ends = sum(not h for _, _, h in rows)
    n, v = sum(train.values()) + ends, len(train) + 1
    for (i, t, h), score in zip(rows, want, strict=True):
        words = (t or "").lower().split()
        base = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, len(words) + 1, sum(train[w] > 0 for w in words) + 1, n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_scores_of_edge_rows(edges):
    rows = ctw.score(edges, F.lit(None).cast("boolean")).collect()
    assert len(rows) == len(EDGES) and all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert ctw.score(edges.limit(0), F.lit(True)).count() == 0


def test_model_beats_word_frequencies(spark):
    rows = queries.op6_context_tree_weighting(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
