"""Every registered query against its SQL, in DuckDB over the same files."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from marlstone import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
        return "~"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, int | float | np.number):
        return f"{float(v):.9g}"
    return str(v).removesuffix(" 00:00:00")


def rows(frame):
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_best_fit_by_a_loop(spark):
    docs = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        docs.setdefault(r.source, []).append((r.doc_id, r.n_chars))
    want = set()
    for source, own in docs.items():
        used, kept = 0, []
        for i, n in own:
            if used + n <= 12_000:
                used += n
                kept.append(i)
        want |= {(source, used, i) for i in kept}
    assert {(r.source, r.used, r.doc_id) for r in queries.ledger_best_fit(spark, SF).collect()} == want
