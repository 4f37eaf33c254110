"""Tables of filings as a table function: a page in, its tables out, and what their headings say."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators.actions import row_terms
from ..operators.rules import periods_in, unit_hint

FOUND = "table_index int, caption string, rows array<array<string>>"


class _Tables(HTMLParser):
    """Rows of cells of each table. A table within a cell is one of its own, and its rows and texts count for those around it too."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[dict] = []
        self.open: list[dict] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "table":
            table = {"caption": [], "rows": [], "own": None, "cell": None, "in_caption": False}
            self.done.append(table)
            self.open.append(table)
        elif not self.open:
            return
        elif tag == "caption":
            self.open[-1]["in_caption"] = True
        elif tag == "tr":
            self.open[-1]["cell"] = None
            self.open[-1]["own"] = row = []
            for table in self.open:
                table["rows"].append(row)
        elif tag in ("td", "th") and self.open[-1]["own"] is not None:
            self.open[-1]["cell"] = cell = []
            # A cell belongs to its row, and to the open rows of the tables around.
            for table in self.open:
                if table["own"] is not None:
                    table["own"].append(cell)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif not self.open:
            return
        elif tag == "caption":
            self.open[-1]["in_caption"] = False
        elif tag in ("td", "th"):
            self.open[-1]["cell"] = None
        elif tag == "tr":
            self.open[-1]["cell"] = self.open[-1]["own"] = None
        elif tag == "table":
            self.open.pop()

    def handle_data(self, data):
        if self.hidden or not (text := " ".join(data.split())):
            return
        for table in self.open:
            if table["cell"] is not None:
                table["cell"].append(text)
            if table["in_caption"]:
                table["caption"].append(text)


@udtf(returnType=FOUND)
class FilingTables:
    """The tables of a page, one row each: caption, and the rows that have a text, brought to one width. Tables without any are left out, but counted."""

    def eval(self, html: str) -> Iterator[tuple]:
        parser = _Tables()
        parser.feed(html or "")
        parser.close()
        for place, table in enumerate(parser.done):
            rows = [cells for row in table["rows"] if any(cells := [" ".join(c) for c in row])]
            width = max(map(len, rows), default=0)
            if rows:
                yield place, " ".join(table["caption"]), [r + [""] * (width - len(r)) for r in rows]


def _columns(rows: Column) -> Column:
    """The first row as names where one of its cells is no number; others are numbered."""
    head = F.element_at(rows, 1)
    named = F.exists(head, lambda c: (c != "") & ~c.rlike(r"^[-+]?[$%(),.\d\s]+$"))
    return F.transform(head, lambda c, i: F.when(named & (c != ""), c).otherwise(F.concat(F.lit("col_"), (i + 1).cast("string"))))


def _row_matches(rows: Column, query: str) -> Column:
    """How many rows hold two of the query's terms, or its only one; numbers as whole words."""
    terms = row_terms(query)
    if not terms:
        return F.lit(0)

    def match(row: Column) -> Column:
        text = F.lower(F.array_join(row, " "))
        words = F.regexp_extract_all(text, F.lit("([a-z0-9一-鿿]+)"))
        hits = sum((F.array_contains(words, t).cast("int") if t.isdigit() else text.contains(t).cast("int") for t in terms), F.lit(0))
        return hits >= min(2, len(terms))

    return F.size(F.filter(rows, match))


def filing_tables(pages: DataFrame, id_col: str, html_col: str, query: str = "") -> DataFrame:
    """(id_col, table_index, caption, columns, unit, periods, row_count, column_count, rows, matches): each table of each page.

    unit and periods are what the caption and the first four rows say: scale
    and currency; a phrase "... ended" and years (of the rows alone). matches:
    rows that match the query. Null and empty pages have no tables; rows of a
    repeated id stay apart only by their place, so name an id that is unique.
    """
    found = pages.select(id_col, F.col(html_col).alias("_html")).lateralJoin(FilingTables(F.col("_html").outer())).drop("_html")
    head = F.array_join(F.transform(F.slice("rows", 1, 4), lambda r: F.array_join(F.filter(r, lambda c: c != ""), " ")), " ")
    heading = F.trim(F.concat_ws(" ", "caption", head))
    return found.select(
        id_col, "table_index", "caption", _columns(F.col("rows")).alias("columns"), unit_hint(heading).alias("unit"), periods_in(heading, head).alias("periods"),
        F.size("rows").alias("row_count"), F.size(F.element_at("rows", 1)).alias("column_count"), "rows", _row_matches(F.col("rows"), query).alias("matches"),
    )


def best_tables(tables: DataFrame, id_col: str, most: int) -> DataFrame:
    """tables with place: of each page the `most` that match best: most matches, then most rows, then the first."""
    least = F.struct((-F.col("matches")).alias("m"), (-F.col("row_count")).alias("n"), "table_index")
    rows = F.struct(least.alias("o"), F.struct(*tables.columns).alias("t"))
    # A page's tables are as long as the page is.
    kept = tables.groupBy(F.col(id_col).alias("_id")).agg(F.slice(F.array_sort(F.collect_list(rows)), 1, most).alias("k"))
    return kept.select(F.posexplode("k").alias("_p", "_k")).select("_k.t.*", (F.col("_p") + 1).alias("place"))


def html_table(df: DataFrame, table: str, order: str, columns: list[str], caption: Column | None = None) -> DataFrame:
    """(table, html): each small table as HTML, with a caption, its columns' names as header, and what HTML reads as signs escaped; nulls are empty."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = [F.concat(F.lit("<td>"), safe(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    line = F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda s: s["l"]), "")
    head = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<th>"), safe(F.lit(c)), F.lit("</th>")) for c in columns), F.lit("</tr>"))
    title = F.concat(F.lit("<caption>"), safe(F.first(caption)), F.lit("</caption>")) if caption is not None else F.lit("")
    return df.groupBy(table).agg(F.concat(F.lit("<table>"), title, head, rows, F.lit("</table>")).alias("html"))
