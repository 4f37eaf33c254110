import math
from hashlib import md5

import corpus_pipeline
from marlstone.llm import queries
import pytest
from marlstone.llm.common import staged
from test_relational_operators import plain_leaks
from test_simhash import plain_components, plain_fingerprint
from test_text_operators import base_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), name))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_keep_whole_documents(steps):
    docs = {r.doc_id: tuple(r) for r in steps[0].collect()}
    for before, after in zip(steps, steps[1:-1], strict=False):
        assert after.columns == before.columns
        assert set(ids(after)) <= set(ids(before)) and len(set(ids(after))) == after.count()
        assert all(docs[r.doc_id] == tuple(r) for r in after.collect())


def test_quality_stages(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(steps[1]))
    known = [(i, q) for i, q in labels.items() if i in ids(steps[0])]
    assert sum((i in kept) == bool(q) for i, q in known) > 0.95 * len(known)
    good = {r.doc_id for r in steps[1].collect() if not base_counts(r.text)[-1]}
    # The query's verdicts, which are held against brute force by themselves.
    fertile = {r.doc_id for r in queries.op2_tokeniser_fertility(spark, SF).where("kept").collect()}
    assert set(ids(steps[2])) == good & fertile and len(good) - steps[2].count() < 0.03 * len(good)


def test_dedup_and_decontamination_by_brute_force(spark, steps):
    rows = steps[2].collect()
    names = [r.doc_id for r in rows]
    heads = plain_components(names, [plain_fingerprint(r.text) for r in rows])
    assert ids(steps[3]) == sorted(set(heads))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, _ in plain_leaks([(r.doc_id, r.text) for r in steps[3].collect()], items)}
    assert ids(steps[4]) == sorted(set(ids(steps[3])) - leaks)


def test_mixture_by_brute_force(steps):
    rows = steps[4].collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    weight = sum(math.sqrt(n) for n in sizes.values())
    want = []
    for r in rows:
        mean = len(rows) * math.sqrt(sizes[r.source]) / weight / sizes[r.source]
        u = int(md5(f"mixture:{r.doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52
        p, total, n = math.exp(-mean), math.exp(-mean), 0
        while total <= u:
            n += 1
            p *= mean / n
            total += p
        want += [(r.doc_id, k) for k in range(1, n + 1)]
    assert sorted((r.doc_id, r["copy"]) for r in steps[5].collect()) == sorted(want)


def test_run_gives_the_last_stage(spark, steps):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r) for r in steps[5].collect())
