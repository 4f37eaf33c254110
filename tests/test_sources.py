"""Spreadsheets, filing tables and JSON files against plain readers and hand-made files."""

import json
import random
import zipfile
from html import escape

from pyspark.sql import functions as F

from marlstone.sources import filings, lines, sheets

HEAD = '<?xml version="1.0"?><office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:spreadsheet>'
TAIL = "</office:spreadsheet></office:body></office:document-content>"


def book(path, body):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("content.xml", HEAD + body + TAIL)


def cell(kind=None, value=None, text=None, times=1, name="value"):
    own = (f' office:value-type="{kind}"' if kind else "") + (f' office:{name}="{value}"' if value is not None else "") + (f' table:number-columns-repeated="{times}"' if times > 1 else "")
    return f"<table:table-cell{own}>{''.join(f'<text:p>{t}</text:p>' for t in (text or []))}</table:table-cell>"


def row(*cells, times=1):
    return f'<table:table-row table:number-rows-repeated="{times}">{"".join(cells)}</table:table-row>'


def test_cells_of_all_kinds(spark, tmp_path):
    typed = [
        cell("float", "1.5", ["1,50"]), cell("date", "2024-01-02", ["2 Jan"], name="date-value"), cell("boolean", "true", name="boolean-value"), cell(times=2),
        cell("string", text=["a &amp; b", "", "c"]), "<table:covered-table-cell/>", cell("percentage", "0.2", times=3), cell(times=900),
    ]
    one = "".join([row(cell(), times=5), row(*typed), "<table:table-header-rows>" + row(cell("string", text=["x"]), times=3) + "</table:table-header-rows>", row(cell(times=1024), times=1_048_000)])
    book(tmp_path / "a.ods", f'<table:table table:name="One">{one}</table:table><table:table>{row(cell("float", "7"))}</table:table>')
    book(tmp_path / "b.ods", '<table:table table:name="Empty"></table:table>')
    got = [tuple(r) for r in sheets.read_sheets(spark, str(tmp_path)).orderBy("file", "sheet_index", "row_index", "column_index").collect()]
    want = [("float", "1.5", 0), ("date", "2024-01-02", 1), ("boolean", "true", 2), ("string", "a & b\nc", 5), ("percentage", "0.2", 7), ("percentage", "0.2", 8), ("percentage", "0.2", 9)]
    assert got == [("a.ods", 0, "One", 0, c, k, v) for k, v, c in want] + [("a.ods", 0, "One", r, 0, "string", "x") for r in (1, 2, 3)] + [("a.ods", 1, "sheet_1", 0, 0, "float", "7")]


def test_a_million_repeats_and_chosen_sheets(spark, tmp_path):
    body = "".join(f'<table:table table:name="s{i}">{row(cell("float", i), cell("string", text=["t"]), times=1_000_000 if i == 1 else 2)}</table:table>' for i in range(3))
    book(tmp_path / "m.ods", body)
    df = sheets.read_sheets(spark, str(tmp_path), "sheet string, row_index long, value string")
    big = df.where("sheet = 's1'").agg(F.count("*").alias("n"), F.max("row_index").alias("last")).first()
    assert (big.n, big.last) == (2_000_000, 999_999)
    assert sorted(tuple(r) for r in df.where("sheet in ('s0', 's2') and row_index = 1").collect()) == [("s0", 1, "0"), ("s0", 1, "t"), ("s2", 1, "2"), ("s2", 1, "t")]
    reader = sheets.SheetReader(str(tmp_path / "m.ods"), ["value"])
    left = list(reader.pushFilters([sheets.EqualTo(("sheet",), "s2"), sheets.EqualTo(("value",), "t"), sheets.In(("sheet_index",), (1, 2))]))
    assert [f.attribute for f in left] == [("value",)] and [p.index for p in reader.partitions()] == [2]


def test_sheets_come_back(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice(["f/1", "f 2", None]), rng.choice(["s<1>", '"s2"']), i, rng.choice([None, "", "a\nb", "<&>"]), rng.choice([None, 1, 2]), rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "file string, _s string, n int, text string, number int, flag boolean")
    told = {r.file: (r.sheets, r.rows) for r in sheets.write_sheets(df, str(tmp_path / "out"), "file", "_s", ["n"], ["text", "number", "flag"]).collect()}
    assert {k: v[1] for k, v in told.items()} == {f: sum(r[0] == f for r in rows) for f in ("f/1", "f 2")}
    got = {(r.file, r.sheet, r.row_index, r.column_index): r.value for r in sheets.read_sheets(spark, str(tmp_path / "out")).collect()}
    want, count = {}, {}
    for f, s, _, *values in rows:
        if f is None:
            continue
        place = count.get((f, s), 0)
        count[f, s] = place + 1
        for c, v in enumerate(values):
            if v not in (None, ""):
                want[f.replace("/", "_").replace(" ", "_") + ".ods", s, place, c] = str(v).lower() if isinstance(v, bool) else str(v)
    assert got == want
    assert sheets.read_sheets(spark, str(tmp_path / "none")).isEmpty()


def test_filing_tables_by_hand(spark):
    html = """<p>in millions</p><table><caption>Sales, in <b>thousands</b></caption><tr><th></th><th>2001 </th><th>EUR</th></tr><tr></tr>
      <tr><td>Net income</td><td>1,2<script>x</script></td></tr><tr><td>Deep<table><tr><td>1 999</td><td>(5)%</td></tr></table></td></tr></table>
      <table><tr><td>  </td></tr></table><table><tr><td>3<td>4<tr><td>Net income 2001"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "no table")], "id int, html string")
    got = filings.filing_tables(pages, "id", "html", "net income of 2001").orderBy("table_index").collect()
    assert [r.table_index for r in got] == [0, 1, 3]
    assert got[0].rows == [["", "2001", "EUR"], ["Net income", "1,2", ""], ["Deep 1 999 (5)%", "1 999", "(5)%"], ["1 999", "(5)%", ""]]
    assert (got[0].columns, got[0].unit, got[0].periods, got[0].matches) == (["col_1", "2001", "EUR"], "in thousands; EUR", ["2001"], 1)
    assert (got[1].rows, got[1].columns, got[1].periods) == ([["1 999", "(5)%"]], ["col_1", "col_2"], [])
    assert (got[2].rows, got[2].columns, got[2].matches) == ([["3", "4"], ["Net income 2001", ""]], ["col_1", "col_2"], 1)
    best = filings.best_tables(filings.filing_tables(pages, "id", "html", "net income of 2001"), "id", 2).orderBy("place").collect()
    assert [(r.table_index, r.place) for r in best] == [(0, 1), (3, 2)]


def test_tables_come_back_from_html(spark):
    rows = [(t, i, rng_text) for t in (1, 2) for i, rng_text in enumerate(["a & b", "<i>", None, "1 > 0"])]
    df = spark.createDataFrame(rows, "t int, n int, text string")
    pages = filings.html_table(df, "t", "n", ["n", "text"], F.lit("of <t>"))
    assert escape("<i>") in pages.first().html
    for r in filings.filing_tables(pages, "t", "html").collect():
        assert r.caption == "of <t>" and r.rows == [["n", "text"], *([str(i), v or ""] for t, i, v in rows if t == r.t)]


def test_json_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    files = ['[{"a": 1}, {"a": 2, "b": "x"}]', '{"data": [{"a": 3}]}', '{"rows": [{"a": 4}, {"a": 5', '{"a": 6, "b": "only"}', "```json\n[{'a': 7},]\n```", "", "nothing", "[]", "7"]
    for i, text in enumerate(files):
        (folder / f"{i}.json").write_text(text)
    assert sorted(tuple(r) for r in lines.json_rows(spark, str(folder), "a int, b string").collect()) == [(1, None), (2, "x"), (3, None), (4, None), (5, None), (6, "only"), (7, None)]


def test_json_sequences(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2, "b": "x"}]\x1e{"data": [{"a": 3}]}\x1e{"rows": [{"a": 4}, {"a": 5\x1e\x1e\n{"a": 6, "b": "two\\nlines"}\x1enothing\x1e')
    rows = lines.json_rows(spark, str(tmp_path), "a int, b string", sequence=True).collect()
    assert sorted(tuple(r) for r in rows) == [(1, None), (2, "x"), (3, None), (4, None), (5, None), (6, "two\nlines")]


def test_conversations_are_not_a_file_each(spark, tmp_path):
    from pathlib import Path

    from marlstone import queries
    from marlstone.shared import shared_dir

    talks = [(c, t, "user", f"\x1e {c}\n{t}") for c in range(300) for t in range(2)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    count = lambda: sum(1 for _ in Path(shared_dir(spark)).glob("json-*/**/part-*"))
    before = count()
    rows = queries.QUERIES["json_rows_read"](spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.turn, r.signs) for r in rows) == [(c, t, len(f"\x1e {c}\n{t}")) for c in range(300) for t in range(2) if c % 3 < 2 or t == 0]
    assert count() - before <= 16


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "a int, b string")
    for append in (False, True, True):
        lines.write_json_lines(df, str(tmp_path / "out"), append)
    rows = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(rows) == 6 and {"a": 1, "b": None} in rows
    counts = spark.createDataFrame([("kept", 5), ("lost", 1)], "name string, n long")
    lines.write_manifest(spark, str(tmp_path / "m"), {"source": "x", "parts": [1, 2]}, counts)
    assert json.loads(spark.read.text(str(tmp_path / "m")).first().value) == {"source": "x", "parts": [1, 2], "counts": {"kept": 5, "lost": 1}}


def test_supplier_keys_are_no_years(spark, tmp_path):
    import duckdb

    from marlstone import queries

    rows = [(k, f"Supplier#{k:09d}", k % 2, float(k)) for k in (1, 2, 1990, 1995, 2001, 2002, 2003)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    got = queries.QUERIES["filing_tables"](spark, str(tmp_path)).select("page", "table_index", "matches", "periods").collect()
    want = con.execute(f"SELECT page, table_index, matches, periods FROM ({queries.SQL['filing_tables']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
