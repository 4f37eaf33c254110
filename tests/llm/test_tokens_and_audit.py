"""Filter orders, alignments and byte-level BPE against the public libraries and plain loops."""

import hashlib
import json
import random
from collections import Counter, defaultdict
from itertools import accumulate, permutations

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from marlstone.llm import alignment, audit, bpe, queries

SF = "/root/testdata/sf0.001"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = "the of and,  income's 12,345 don't\n\n naïve Ελλάδα 数据处理 🙂🙂 x=1; \t    |#| '' 'll ▁ ​ \x00".split(" ")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(MULTI), special_tokens={})


def some_text(rng, n):
    kinds = [lambda: rng.choice(WORDS), lambda: " " * rng.randint(0, 4), lambda: chr(rng.choice([10, 32, 97, 8217, 12288, 0x1F600, 0x4E00 + rng.randint(0, 99), rng.randint(33, 0x2FFF)]))]
    return "".join(rng.choice(kinds)() for _ in range(n))


def long_texts(rng):
    run = lambda signs, n: "".join(rng.choices(signs, k=n))
    return [
        some_text(rng, 60_000), run("ab", 90_000), "x" * 70_000 + " y", run("0123456789", 80_000), " " * 100_000 + "end", "a " + "\n" * 75_000, run("'redstmlv ", 100_000),
        run("!?", 40_000) + run("é ", 40_000), "word " * 20_000, run("a'", 66_000), " x" * 31_744 + "don't " * 9_000, "'" * 32_760 + "re'll" * 2_000,
    ]


def test_ids_of_whole_texts(spark, library):
    rng = random.Random(1)
    texts = [None, "", " ", "'", *(some_text(rng, rng.randint(1, 60)) for _ in range(300)), *long_texts(rng)]
    rows = [(i % 90, t, "kept") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "_row int, text string, ids string").repartition(5)
    got = bpe.encoded(df.drop("ids").withColumn("ids", F.lit("gives way")), out="ids").withColumn("bytes", bpe.decoded(F.col("ids"))).collect()
    want = Counter((r[0], r[1], np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    assert Counter((r._row, r.text, bytes(r.ids), bytes(r.bytes)) for r in got) == want


def test_merges_by_heap(library):
    own, rng = bpe.Merges(bpe.ranks(MULTI)), random.Random(2)
    for n in (2, 3, 5, 20, 300, 4000):
        for signs in ("ab", "a", "etaoin", "数据处理é", " \n"):
            word = "".join(rng.choices(signs, k=n))
            assert own.merged(word.encode()) == library._encode_single_piece(word)
    assert len(own.ids("q" * 200_000)) == len(library.encode_ordinary("q" * 200_000))


def test_digests_of_the_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in queries.op13_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(docs[r.doc_id].encode()))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(empty).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and bpe.digests(empty).isEmpty()


class Plain:
    """Both libraries on whole texts, and groups by comparing all ends."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        self.a_bytes = bpe.token_bytes(public_tokenizers.path("byte_bpe_50k.json"))
        names = [self.b.id_to_piece(i) for i in range(32_000)]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if len(x) == 6 and x[:3] == "<0x" else x.replace("▁", " ").encode() for x in names]

    def groups(self, text):
        if not text:
            return [], [], []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join(self.b_bytes[i] for i in b) != (" " + text).encode():
            return [], [], []
        ends = [list(accumulate(len(side[i]) for i in ids)) for side, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        found, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            m, n = ends[0].index(end) + 1, ends[1].index(end) + 1
            found.append((a[i:m], b[j:n]))
            i, j = m, n
        return a, b, found


def test_alignments(spark):
    plain, rng = Plain(), random.Random(3)
    texts = [None, "", " ", "a ", "\n", "▁", "x▁y", "<s> <|endoftext|> <0x41>", *(some_text(rng, rng.randint(1, 80)) for _ in range(400)), "q" * 3000, " " * 500 + "x", "tab\tand\r\n" * 50, "\n \n  a\n b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.alignment for r in alignment.aligned(df).collect()}
    counts, all_groups = Counter(), {}
    for i, t in enumerate(texts):
        a, b, groups = plain.groups(t)
        assert (got[i].a, got[i].b) == (a, b), (i, t)
        assert (got[i].a_sizes, got[i].b_sizes) == ([len(x) for x, _ in groups], [len(y) for _, y in groups])
        all_groups[i] = groups
        counts.update((x[-1], y[-1]) for x, y in groups)
    best = defaultdict(int)
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = alignment.link_statistics(df.unionByName(df)).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        links = [(x[-1], y[-1]) for x, y in all_groups[r.doc_id]]
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in all_groups[r.doc_id])
        assert r.groups_sha256 == (hashlib.sha256(shown.encode()).hexdigest() if links else "")
        assert (r.n_groups, r.n_links, r.n_best, r.count_sum) == (len(links), len(links), sum(counts[x] == best[x[1]] for x in links), 2 * sum(counts[x] for x in links))


def test_stretches_join_to_the_text():
    own, rng = alignment.aligner(*alignment._paths(None, None)), random.Random(4)
    for _ in range(500):
        text = " " + some_text(rng, 30)
        assert "".join(own.pattern.findall(text)) == text


def test_a_mismatch_is_told():
    t = alignment.Transducer({0: b"ab", 1: b"c"}, {0: b"a", 1: b"bc", 2: b"x", 3: b"b"})
    assert t.groups([0, 1], [0, 1]) == [(2, 2)]
    for a, b in (([0], [0]), ([0], [2]), ([0], [0, 3, 3]), ([0, 1], [0, 3]), ([], [0])):
        with pytest.raises(alignment.Mismatch):
            t.groups(a, b)


def test_links_are_bounded_by_the_vocabularies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    linked = alignment.text_links(docs.select("text"))
    a, b = bpe.token_bytes(public_tokenizers.path("byte_bpe_50k.json")), Plain().b_bytes
    for r in alignment.link_counts(linked).collect():
        x, y = a[r.link >> alignment.B_BITS], b[r.link & ((1 << alignment.B_BITS) - 1)]
        assert x.endswith(y) or y.endswith(x)


def test_orders_of_the_query(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(audit.oracle()).df()
    got = queries.op11_filter_interaction(spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def walked(rows, letters):
    """Every order applied row by row."""
    found = {}
    for part in {r["part"] or "" for r in rows}:
        own = [r for r in rows if (r["part"] or "") == part]
        for order in permutations(letters):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[f]]
                left = [r for r in left if not r[f]]
                alone = sum(r[f] and not any(r[g] for g in letters if g != f) for r in own)
                found[part, "".join(order), step] = (len(left), len(gone), sum(r[f] for r in own) - len(gone), alone, sum(r["m"] for r in gone))
    return found


def test_audit_by_walking_every_order(spark):
    rng = random.Random(5)
    rows = [{"part": rng.choice(["x", None, "", "y"]), "m": rng.random() < 0.3, **{f: rng.random() < 0.35 for f in "PQRS"}} for _ in range(200)]
    df = spark.createDataFrame(rows, "part string, m boolean, P boolean, Q boolean, R boolean, S boolean").withColumn("fail0", F.lit("clash"))
    out = audit.audit(df, {f: F.when(F.col(f), True) for f in "PQRS"}, F.col("part"), {"marked": F.col("m")}).collect()
    want = walked(rows, "PQRS")
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.marked) for r in out} == want and len(out) == len(want)
    shapley = defaultdict(int)
    for (part, order, step), v in want.items():
        shapley[part, order[step - 1]] += v[1]
    assert all(r.shapley == shapley[r.part, r.filter] and r.filter == r.filter_order[r.step - 1] for r in out)
    assert audit.audit(df.limit(0), {"P": F.col("P")}, F.col("part")).isEmpty()
    with pytest.raises(ValueError):
        audit.audit(df, {"long": F.col("P")}, F.col("part"))


def test_rules_on_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(150))
    docs = [(1, None, "en"), (2, "", "en"), (3, long, None), (4, long, "en"), (4, long, "en"), (None, long, "en"), (5, "A" * 10, ""), (6, "a | b " * 60, "fr")]
    df = spark.createDataFrame(docs, "doc_id int, text string, lang string").withColumn("part", F.lit("clash"))
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (None, 1, 1)], "doc_id int, quality int, toxic int")
    got = sorted((r.part or "", r.A, r.B, r.C, r.D, r.E, bool(r.good), bool(r.toxic)) for r in audit.text_rules(df, labels).collect())
    assert got == sorted([
        ("en", True, False, False, False, False, False, False), ("en", True, False, False, False, True, False, False), ("", False, False, False, False, False, True, True),
        ("en", False, False, False, False, True, False, False), ("en", False, False, False, False, True, False, False), ("en", False, False, False, False, False, False, False),
        ("", True, False, True, False, False, False, False), ("fr", False, True, False, True, False, False, False),
    ])


def test_hot_copies(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(4000)], "id int, k string")
    out = audit.later_copies(rows.withColumnRenamed("k", "_key"), "id").collect()
    first = {}
    for r in sorted(out, key=lambda r: r.id):
        first.setdefault("hot" if r.id % 3 else f"k{r.id % 40}", r.id)
    assert len(out) == 4000 and all(r.later == (r.id != first["hot" if r.id % 3 else f"k{r.id % 40}"]) for r in out)


def test_vocabulary_files():
    multi = bpe.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = bpe.ranks(public_tokenizers.path("byte_bpe_50k.json"))
    assert {k: v for k, v in own.items() if v < 50_256} == multi
    assert json.load(open(public_tokenizers.path("byte_bpe_50k.json")))["model"]["vocab"]["Ġthe"] == own[b" the"]
