import random

import numpy as np
import xxhash

from marlstone.llm import simhash
from marlstone.llm.components import components

WHITE = " \t\n\v\f\r"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=3):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                up[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(ids))]


def test_all_documents_as_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_edge_rows(spark):
    data = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, " \n", "x"), (5, "One", "x"), (6, "one", "x"), (7, "é É", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    zero = "0" * 16
    one, e = f"{plain_fingerprint('one'):016x}", f"{plain_fingerprint('é É'):016x}"
    assert got == [(0, zero, 1), (1, zero, 1), (2, zero, 1), (2, zero, 1), (5, one, 5), (6, one, 5), (7, e, 7)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    left = simhash.one_of_each(df)
    assert left.columns == df.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 5, 7]


def test_dense_fingerprints_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rnd = random.Random(1)
    fps = set()
    for _ in range(6):
        base = rnd.getrandbits(64)
        for _ in range(120):
            x = base
            for _ in range(rnd.randrange(5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    for radius in (1, 3):
        roots = {r.node: r.root for r in components(simhash.links(df, radius)).collect()}
        signed = [int(np.uint64(f).view(np.int64)) for f in fps]
        want = plain_components(signed, fps, radius)
        assert [roots.get(s, s) for s in signed] == want


def test_exploded_keys_are_never_sent_to_every_task(spark):
    fps = spark.range(2000).selectExpr("xxhash64(id) AS fp")
    plan = simhash.links(fps)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
