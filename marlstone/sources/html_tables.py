"""Tables in HTML pages, as rows of cells."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = "table_index int, row_index int, column_index int, is_header boolean, text string"


class _Cells(HTMLParser):
    """Cells with their place in the grid, spans filled in; nested tables count after their parents."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[tuple] = []
        self.tables: list[dict] = []
        self.count = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append({"index": self.count, "row": -1, "filled": {}, "cell": None})
            self.count += 1
        elif self.tables and tag == "tr":
            self._close()
            self.tables[-1]["row"] += 1
        elif self.tables and tag in ("td", "th"):
            self._close()
            span = {k: min(1000, int(v)) for k, v in attrs if k in ("rowspan", "colspan") and (v or "").isdigit()}
            self.tables[-1]["cell"] = [tag == "th", span.get("rowspan") or 1, span.get("colspan") or 1, []]

    def handle_endtag(self, tag):
        if self.tables and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.tables.pop()

    def handle_data(self, data):
        if self.tables and self.tables[-1]["cell"]:
            self.tables[-1]["cell"][3].append(data)

    def _close(self):
        t = self.tables[-1]
        if t["cell"] is None:
            return
        header, down, across, parts = t["cell"]
        t["cell"], row, text = None, max(0, t["row"]), " ".join("".join(parts).split())
        column = 0
        while (row, column) in t["filled"]:
            column += 1
        for r in range(row, row + down):
            for c in range(column, column + across):
                t["filled"][r, c] = True
                self.done.append((t["index"], r, c, header, text))


def cells(html: str | None) -> list[tuple]:
    parser = _Cells()
    parser.feed(html or "")
    parser.close()
    return sorted(parser.done)


def html_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, table_index, row_index, column_index, is_header, text): each cell of each table."""
    names = [x.split()[0] for x in CELLS.split(", ")]

    @F.arrow_udf(f"array<struct<{CELLS.replace(' ', ':').replace(',:', ',')}>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()), strict=True))))
        for batch in batches:
            yield pa.array([[dict(zip(names, c, strict=True)) for c in cells(h)] for h in batch.to_pylist()], kind)

    return pages.select(id_col, F.inline(found(html_col)))


def table_scores(grid: DataFrame, id_col: str, terms: list[str]) -> DataFrame:
    """(id_col, table_index, score, n_cells): a term in a header counts 4, in the first column 3, elsewhere 1; numbers up to 5 by their share."""
    low = F.lower("text")
    worth = F.when(F.col("is_header"), 4).when(F.col("column_index") == 0, 3).otherwise(1)
    hits = sum((F.max(F.when(low.contains(t.lower()), worth).otherwise(0)) for t in terms), F.lit(0))
    share = F.avg(F.col("text").rlike(r"^[-+(]?[$€£]?\d[\d,.]*[%)]?$").cast("double"))
    return grid.groupBy(id_col, "table_index").agg((hits + 5 * share).alias("score"), F.count("*").alias("n_cells"))
