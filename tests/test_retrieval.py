"""Whole texts in the retrieval queries, against brute force."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from marlstone import queries
from marlstone.operators import retrieval


def documents(spark, path):
    rows = [
        (1, "The quick fox and the fox", 25), (2, "Zebra " * 400 + "then omega", 2410), (3, "no length given", None), (4, None, None), (5, "", 0),
        (6, " ".join(f"word{i % 90}" for i in range(500)), 3400),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars int").write.parquet(f"{path}/documents.parquet")
    return rows


def test_terms_of_all_documents(spark, tmp_path):
    want = {}
    for i, text, _ in documents(spark, tmp_path):
        words = [w for w in re.findall(r"\w+", (text or "").lower()) if len(w) >= 3 and w not in ("the", "and", "der", "die")]
        want[i] = None if text is None else " ".join(list(dict.fromkeys(words))[:80])
    assert {r.doc_id: r.terms for r in queries.QUERIES["text_terms_whole"](spark, str(tmp_path)).collect()} == want


OPENING = "please compare the yearly revenue and operating margin growth of "
TALKS = {
    1: [OPENING + "copper mines in Chile", OPENING + "paper mills near Oslo with their debts", OPENING + "copper mines in Chile"],
    2: ["AAPL revenue margin growth quarter report 2023", "AAPL revenue margin growth quarter filing 2023", "revenue margin growth quarter filing outlook", "a ! ?", "", "见 https://x.io/AAPL 苹果公司 收入 2024-05-01, $AAPL"],
    3: ["MSFT cash flow in 2021", "cash flow MSFT 2021", "cash flow of MSFT in 2021 and capital spending", "Étion dans BRK.B çouelle un 2020/1"],
}


#: Written by hand: the cluster of each query, and whether it tells it something new.
PLACED = {
    1: [(0, True), (1, True), (0, False)],
    2: [(0, True), (0, True), (1, True), (None, False), (None, False), (2, True)],
    3: [(0, True), (0, False), (0, True), (1, True)],
}


def test_signatures_by_hand(spark):
    rows = [TALKS[2][0], TALKS[2][5], TALKS[3][3], "The latest data from the official website", "A-1 and F/X 10% $5"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(rows)], "i int, q string").withColumn("t", retrieval.query_terms(F.col("q")))
    got = {r.i: (r.t, r.a) for r in df.withColumn("a", retrieval.query_anchors(F.col("q"), F.col("t"))).collect()}
    assert got == {
        0: (["2023", "aapl", "growth", "margin", "quarter", "report", "revenue"], ["2023", "aapl"]),
        1: (["2024-05-01", "aapl", "收入", "苹果公司"], ["2024-05-01", "aapl"]),
        2: (["2020", "brk.b", "dans", "ouelle", "tion", "un"], ["2020", "2020/1", "brk.b"]),
        3: ([], []),
        4: (["10", "a-1"], ["10", "a-1", "f", "x"]),
    }


def test_clusters_by_hand(spark, tmp_path):
    rows = [(c, 2 * i, "user", q) for c, talk in TALKS.items() for i, q in enumerate(talk)] + [(1, 1, "assistant", "copper mines")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.task, r.step): (r.cluster, r.novel) for r in queries.query_clusters(spark, str(tmp_path)).collect()}
    assert got == {(str(c), 2 * i): x for c, talk in PLACED.items() for i, x in enumerate(talk)}


def checked(rows):
    """Whether each choice was right, given those before it. rows: (words, anchors, cluster, novel, alike) in order."""
    known, openings = {}, {}
    for words, anchors, cluster, novel, alike in rows:
        if not words:
            assert (cluster, novel) == (None, False)
            continue
        likeness = {i: len(words & w) / len(words | w) for i, (w, _) in known.items()}
        open_to = {i for i, s in likeness.items() if s >= alike or s >= retrieval.ANCHORED and anchors & known[i][1]}
        if openings.get(frozenset(words)) is not None:
            assert cluster == openings[frozenset(words)]
        elif cluster in known:
            assert cluster in open_to and all((likeness[i], -i) <= (likeness[cluster], -cluster) for i in open_to)
        else:
            assert not open_to and cluster == len(known) and novel
            openings[frozenset(words)] = cluster
        before = known.get(cluster, (set(), set()))
        assert novel == (cluster not in known or bool(words - before[0]))
        known[cluster] = before[0] | words, before[1] | anchors


def test_every_choice_of_all_conversations(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'").withColumn("w", retrieval.query_terms(F.col("text")))
    turns = turns.withColumn("a", retrieval.query_anchors(F.col("text"), F.col("w"))).collect()
    placed = {(r.task, r.step): r for r in queries.query_clusters(spark, sf).collect()}
    assert len(placed) == len(turns)
    talks = {}
    for r in sorted(turns, key=lambda r: r.turn):
        p = placed[str(r.conv_id), r.turn]
        talks.setdefault(r.conv_id, []).append((set(r.w or ()), set(r.a or ()), p.cluster, p.novel, retrieval.ALIKE))
    for talk in talks.values():
        checked(talk)


def test_fuses_by_a_loop(spark, sf):
    events = {(str(r.user_id), r.event_id): r for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    rows = sorted(queries.QUERIES["query_clusters_fused"](spark, sf).collect(), key=lambda r: r.step)
    assert len(rows) == len(events)
    talks, runs = {}, {}
    for r in rows:
        e = events[r.task, r.step]
        k = json.loads(e.props)["k"]
        talks.setdefault(r.task, []).append(({f"topic{k % 5}", f"kind{k % 2}", e.event_type, "shared"}, set(), r.cluster, r.novel, 0.6))
        runs[r.task, r.cluster] = 0 if r.novel else runs.get((r.task, r.cluster), 0) + 1
        assert (r.no_gain_run, r.fused) == (runs[r.task, r.cluster], runs[r.task, r.cluster] >= 2)
    for talk in talks.values():
        checked(talk)
    assert any(r.fused for r in rows)


def test_signature_of_whole_texts(spark, tmp_path):
    license = "Licensed under the terms of the public license, version 2. "
    rows = [(1, license + "alpha beta", 70), (2, license + "gamma", 65), (3, license + "beta\nalpha", 70), (4, "", 0), (5, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: t if t is None else hashlib.sha1(" ".join(sorted(set(re.findall(r"\w+", t.lower())))).encode()).hexdigest() for i, t, _ in rows}
    got = {r.doc_id: r.signature for r in queries.QUERIES["text_shown_and_signed_whole"](spark, str(tmp_path)).collect()}
    assert got == want and got[1] == got[3] != got[2]
