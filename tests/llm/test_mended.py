"""Readings with breaks, bands from good documents, odd headers, repeated pages and short items, by brute force."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, fertility, queries, toxicity, warc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def letters():
    counts = np.random.default_rng(1).integers(0, 4, (28, 28, 28)).astype(float)
    for word in ("idiot", "moron", "you", "are", "a", "the") * 40:
        k = [0, *(toxicity.code(c) for c in word), 0]
        for a, b, c in zip([0, *k], k, k[1:]):
            counts[a, b, c] += 1
    return toxicity.letter_model(counts)


def best_of_all(token, model):
    """The score of the likeliest reading, by trying every way through the lattice."""
    spots = toxicity._lattice(token)

    def after(i, a, b, fresh):
        if i == len(spots):
            return model[a, b, 0]
        ways = []
        for out, cost in spots[i]:
            x, p, q = cost, a, b
            for c in out:
                x, p, q = x + model[p, q, toxicity.code(c)], q, toxicity.code(c)
            ways.append(x + after(i + 1, p, q, False))
        if i and not fresh and spots[i] in toxicity.PARTING:
            ways.append(model[a, b, 0] + toxicity.BREAK + after(i + 1, 0, 0, True))
        return max(ways)

    return after(0, 0, 0, False)


def score_of(token, reading, model):
    """The best score of one reading: every way through the lattice that gives its words."""
    spots, words = toxicity._lattice(token), f"{reading} "

    def after(i, at, a, b, fresh):
        if i == len(spots):
            return model[a, b, 0] if words[at:].strip() == "" else -math.inf
        ways = [-math.inf]
        for out, cost in spots[i]:
            if words.startswith(out, at):
                x, p, q = cost, a, b
                for c in out:
                    x, p, q = x + model[p, q, toxicity.code(c)], q, toxicity.code(c)
                ways.append(x + after(i + 1, at + len(out), p, q, False))
        if i and not fresh and spots[i] in toxicity.PARTING:
            ways += [model[a, b, 0] + toxicity.BREAK + after(i + 1, k, 0, 0, True) for k in {at, at + (words[at : at + 1] == " ")}]
        return max(ways)

    return after(0, 0, 0, 0, False)


def test_readings_by_every_way(letters):
    rng = random.Random(3)
    for _ in range(150):
        token = "".join(rng.choice(["i", "d", "1", "0", "o", ".", "-", ".-", "t", "mm", "@", "|"]) for _ in range(rng.randint(1, 8)))
        reading = toxicity.words_in(token, letters)
        if reading:
            assert score_of(token, reading, letters) == pytest.approx(best_of_all(token, letters)), token


def test_separators_of_any_length(letters):
    for gap in (1, 10, 45, 400):
        assert toxicity.words_in("i" + ".-" * gap + "diot", letters) == "idiot"
        assert toxicity.words_in((".-" * gap).join("idiot"), letters) == "idiot"
    assert len(toxicity.words_in("·".join("etaoin" * 2000), letters)) >= 12_000


class Cutter:
    def __init__(self):
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def measures(self, text):
        """Both measures of characters, byte fallback and entropy, word by word."""
        words = text.encode().split()
        tokens = [t for w in words for t in self.pieces.encode(w.decode())]
        n_bytes = sum(len(self.bytes.encode_ordinary(" " + w.decode())) for w in words)
        chars = sum(len(w.decode()) for w in words)
        p = [c / len(tokens) for c in Counter(tokens).values()]
        fallback = sum(self.pieces.is_byte(t) for t in tokens) / len(tokens)
        return chars / len(tokens), chars / n_bytes, fallback, -sum(x * math.log2(x) for x in p), len(tokens)


def test_verdicts_by_brute_force(spark):
    cutter = Cutter()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op2_tokeniser_fertility(spark, SF).collect()}
    own = {i: cutter.measures(r.text) for i, r in docs.items() if not got[i].base_failed}
    good = [i for i in own if labels.get(i) == 1 and zlib.crc32(str(i).encode()) % 5]
    default, kept = fertility.Rules(), {}
    for i, m in own.items():
        lang = docs[i].lang
        band = default.languages[lang]
        lows = [band.chars_per_token[0], band.chars_per_byte_token[0], band.entropy[0]]
        peers = [own[j] for j in good if docs[j].lang == lang]
        if len(peers) >= 100:
            lows = [np.percentile([p[k] for p in peers if k < 3 or p[4] >= 60], 0.1) for k in (0, 1, 3)]
        kept[i] = (
            lows[0] - 1e-9 <= m[0] <= band.chars_per_token[1] and lows[1] - 1e-9 <= m[1] <= band.chars_per_byte_token[1]
            and m[2] <= band.fallback_share[1] and (m[4] < 60 or lows[2] - 1e-9 <= m[3] <= band.entropy[1])
        )
        assert (got[i].chars_per_token, got[i].chars_per_byte_token, got[i].fallback_share, got[i].token_entropy) == pytest.approx(m[:4])
    assert {i: r.kept for i, r in got.items()} == {i: kept.get(i, False) for i in docs}
    lost = [i for i in kept if not kept[i]]
    assert sum(labels.get(i) == 0 for i in lost) >= 5 and sum(labels.get(i) == 1 for i in lost) <= 0.02 * len(good)


def test_bands_without_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert fertility.fit(docs, none) == fertility.Rules() and fertility.fit(docs.limit(0), none) == fertility.Rules()


def test_pages_that_repeat(spark):
    """Three times the pages, with other numbers: who answers and who revisits, and the digests, by a plain loop."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()
    rows = [(k * 1000 + r.page_id, f"{r.url}?{k}", r.html) for k in (2, 0, 1) for r in pages] + [(9001, "http://a/", None), (9000, "http://a/", ""), (9002, "http://b/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.mode("overwrite").parquet(f"{(sf := warc_folder(spark))}/pages.parquet")
    first, want = {}, {}
    for i, _, html in sorted(rows):
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        head = first.setdefault(digest, i)
        want[i] = (len(body), digest, "response" if head == i else "revisit", None if head == i else head)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op8_warc_source(spark, sf).collect()}
    assert got == want and sum(w[2] == "revisit" for w in want.values()) > len(pages)


def warc_folder(spark):
    import tempfile

    return tempfile.mkdtemp(prefix="spark-")


def test_a_length_that_is_no_number(spark, tmp_path):
    record = lambda n, size: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:%d>\r\nContent-Type: text/html\r\nContent-Length: %s\r\n\r\nbody!\r\n\r\n" % (n, size)
    import gzip

    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(record(n, size)) for n, size in ((1, b"5"), (2, b"abc"), (3, b"-1"), (4, b"5"))))
    rows = warc.read(spark, str(tmp_path), "record_id string, content_length long, payload_bytes long, payload binary").collect()
    found = {r.record_id[-1]: (r.content_length, r.payload_bytes, r.payload and bytes(r.payload)) for r in rows}
    assert found["1"] == found["4"] == (5, 5, b"body!") and found["2"] == (None, None, None) and found["3"] == (None, None, None)


def test_items_of_few_words(spark):
    items = spark.createDataFrame([(1, "Alpha, beta"), (2, "gamma"), (3, ""), (4, "one two three four five six"), (None, "beta gamma")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma alpha beta"), (2, "beta alpha"), (3, "Gamma!"), (4, None), (5, "alpha x beta"), (None, "gamma"), (6, "zero one two three four five six")], "doc_id int, text string")
    got = sorted((r.doc_id, r.item_id, r.similarity, r.start) for r in decontaminate.found(docs, items).collect())
    assert got == [(1, 1, 1.0, 1), (1, 2, 1.0, 3), (3, 2, 1.0, 0), (6, 4, 1.0, 1)]
    assert sorted(r.doc_id or 0 for r in decontaminate.clean(docs, items).collect()) == [0, 2, 4, 5]
    assert decontaminate.found(docs, items.where(F.col("item_id") == 3)).isEmpty()


def test_bands_come_from_all_good_documents(spark, monkeypatch):
    # 20,600 good documents: the bound is that of them all, not of a sample of 20,000.
    n = 20_600
    rows = spark.range(n).selectExpr("id AS doc_id", "concat('t', id) AS text", "'xx' AS lang")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality")

    def numbered(df, text_col, lang_col, rules, tokenizers, out):
        value = F.substring(F.col(text_col), 2, 9).cast("double")
        return df.withColumn(out, F.struct(F.lit(False).alias("base_failed"), F.lit(100).alias("n_tokens"), *(value.alias(c) for c in ("chars_per_token", "chars_per_byte_token", "token_entropy"))))

    monkeypatch.setattr(fertility, "with_fertility", numbered)
    band = fertility.fit(rows, labels, share=0.001).languages["xx"]
    want = np.percentile(np.arange(n), 0.1)
    assert [round(b[0], 9) for b in (band.chars_per_token, band.chars_per_byte_token, band.entropy)] == [round(want, 9)] * 3


def test_measured_once_as_by_fit(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumn("lang", F.when(F.col("lang") == "en", "xx").otherwise(F.col("lang")))  # a language that the bands given do not know
    rules = fertility.fit(docs, labels, least=20)
    assert rules.languages["xx"] != fertility.Band()
    want = fertility.with_fertility(docs, rules=rules).select("doc_id", "fertility.*")
    got = fertility.with_fitted(docs, labels, least=20).select("doc_id", "fertility.*")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
