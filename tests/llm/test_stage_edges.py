"""Stages on odd rows, on empty tables and on columns with clashing names; archives with damage."""

import gzip

import corpus_pipeline
import pytest

from marlstone.llm import common, warc
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
GOOD = " ".join(f"{a}{b}" for a in ("the", "rain", "in", "stone", "walls") for b in ("", "ing", "er", "ly", "est"))
ROWS = [
    (1, GOOD + ".", "en", "web", 100), (1, GOOD + ".", "en", "web", 100), (2, None, None, None, None), (3, "", "en", "web", 0), (None, GOOD + " more", "en", None, 9),
    (5, "word " * 60_000, "xx", "web", 300_000), (6, GOOD.upper(), None, "book", 1), (7, "ⅷ ½ ²", "", "", 5),
]
CLASHING = "_quality string, _fertility string, _id string, _leak string, _source string, _sums string, _lang string, _head string, _root string, doc string, fp string, hs string"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    kinds = "doc_id long, text string, lang string, source string, n_chars int"
    extra = [x.split()[0] for x in CLASHING.split(", ")]
    df = spark.createDataFrame([(*r, *("e" for _ in extra)) for r in ROWS], f"{kinds}, {CLASHING}")
    out = stage(spark, df, SF)
    rows = out.collect()
    assert out.columns[: len(df.columns)] == df.columns and (name == "mixture" or out.columns == df.columns)
    assert all(r["_quality"] == r["fp"] == "e" for r in rows)
    ids = [r.doc_id for r in rows]
    if name == "quality_rules":
        assert set(ids) <= {1, 6, None} and 1 in ids
    if name == "near_dedup":
        known = {r[0]: plain_fingerprint(r[1]) for r in ROWS if r[0]}
        heads = plain_components(list(known), list(known.values()))
        assert sorted(i or 0 for i in ids) == [0, *sorted(set(heads))]
    if name == "decontamination":
        assert len(ids) == len(ROWS)
    empty = stage(spark, df.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_damaged_archives(spark, tmp_path):
    head = lambda i, kind, block: f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x-page:{i}>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    records = [head(i, "response", b"no header " * (i + 1)) for i in range(4)]
    members = [warc.member(r) for r in records]
    members[1] = members[1][:26] + b"\xff" * 20 + members[1][46:]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(members))
    rows = {r.record_id: r for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert {f"urn:x-page:{i}" for i in (0, 2, 3)} <= set(rows)
    for i in (0, 2, 3):
        r = rows[f"urn:x-page:{i}"]
        assert (r.payload_bytes, r.payload) == (10 * (i + 1), b"no header " * (i + 1))
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "plain.warc.gz").write_bytes(gzip.compress(records[0]) + b"junk" * 9 + gzip.compress(records[3]))
    assert {r.record_id for r in warc.read(spark, f"file://{tmp_path}/y").collect()} == {"urn:x-page:0", "urn:x-page:3"}
