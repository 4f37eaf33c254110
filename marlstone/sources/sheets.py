"""OpenDocument spreadsheets as a data source of cells, and a sink that writes them.

A sheet's XML is read by a pull parser, a row at a time: what a row says it
repeats is repeated as rows are asked for, so memory holds one row, whatever
the sheet counts. Sheets are partitions; tests on the file's sheets are taken
over by the source, and a schema with some of the columns reads those.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: A cell: kind is float, percentage, currency, date, time, boolean or string; value its text.
SCHEMA = "file string, sheet_index int, sheet string, row_index long, column_index int, kind string, value string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

#: Fixed value: columns of a row that are read.
MOST_COLUMNS = 500
#: Files whose sheets are looked up to plan a partition for each; of more files each is one partition.
FEW = 64

TABLE, OFFICE, TEXT = (f"{{urn:oasis:names:tc:opendocument:xmlns:{n}:1.0}}" for n in ("table", "office", "text"))
VALUES = [f"{OFFICE}{n}" for n in ("value", "date-value", "time-value", "string-value", "boolean-value")]


def store_of(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path) if path.startswith("file:") else path)


@dataclass
class Sheet(InputPartition):
    """A sheet of a file, by its place; -1 is all of them."""

    file: str
    index: int


def _number(text: str | None) -> int:
    return max(1, int(text)) if text and text.isdigit() else 1


def _value(cell) -> str:
    for name in VALUES:
        if name in cell.attrib:
            return cell.attrib[name]
    lines = ("".join(p.itertext()).strip() for p in cell.iter(f"{TEXT}p"))
    return "\n".join(x for x in lines if x)


def _row(row) -> list[tuple[str, str]]:
    """Kind and value of a row's cells, without the empty ones at its end."""
    out: list[tuple[str, str]] = []
    for cell in row:
        if not cell.tag.endswith("table-cell"):
            continue
        times = min(_number(cell.get(f"{TABLE}number-columns-repeated")), MOST_COLUMNS - len(out))
        out += [(cell.get(f"{OFFICE}value-type") or "string", _value(cell))] * times
        if len(out) >= MOST_COLUMNS:
            break
    while out and not out[-1][1].strip():
        out.pop()
    return out


def sheet_rows(content, wanted) -> Iterator[tuple[int, str, int, list[tuple[str, str]]]]:
    """(sheet's place, its name, row, cells) of the sheets that wanted(place, name) chooses, from content.xml as it is read.

    Rows without anything are not counted; a repeated row comes as often as it says.
    """
    place, name, chosen, count, above = -1, "", False, 0, []
    for event, node in iterparse(content, ("start", "end")):
        if event == "start":
            above.append(node)
            if node.tag == f"{TABLE}table":
                place, count = place + 1, 0
                name = node.get(f"{TABLE}name") or f"sheet_{place}"
                chosen = wanted(place, name)
            continue
        above.pop()
        if node.tag == f"{TABLE}table-row":
            times = _number(node.get(f"{TABLE}number-rows-repeated"))
            if chosen and (cells := _row(node)):
                for _ in range(times):
                    yield place, name, count, cells
                    count += 1
            above[-1].clear()
        elif not chosen or node.tag == f"{TABLE}table":
            node.clear()


class SheetReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns
        self.names: set | None = None
        self.places: set | None = None

    def pushFilters(self, filters) -> Iterator:
        """Takes over which sheets are read."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "sheet" and values is not None:
                self.names = values if self.names is None else self.names & values
            elif column == "sheet_index" and values is not None:
                self.places = values if self.places is None else self.places & values
            else:
                yield f

    def _wanted(self, place: int, name: str) -> bool:
        return (self.names is None or name in self.names) and (self.places is None or place in self.places)

    def partitions(self) -> list[Sheet]:
        from pyarrow import fs

        store, root = store_of(self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted(f.path for f in found if f.path.endswith(".ods") and not re.search(r"/[._]", f.path[len(root) :]))
        if len(files) > FEW:
            return [Sheet(f, -1) for f in files]
        parts = [Sheet(f, i) for f in files for i in self._places(store, f)]
        return parts or [Sheet("", -1)]

    def _places(self, store, file: str) -> list[int]:
        found: list[int] = []

        def look(place: int, name: str) -> bool:
            found.extend([place] if self._wanted(place, name) else [])
            return False

        with store.open_input_file(file) as raw, zipfile.ZipFile(raw) as archive, archive.open("content.xml") as content:
            for _ in sheet_rows(content, look):
                pass
        return found

    def read(self, partition: Sheet) -> Iterator[tuple]:
        if not partition.file:
            return
        store, _ = store_of(self.path)
        name = partition.file.rsplit("/", 1)[-1]
        with store.open_input_file(partition.file) as raw, zipfile.ZipFile(raw) as archive, archive.open("content.xml") as content:
            wanted = lambda place, sheet: self._wanted(place, sheet) and partition.index in (-1, place)
            for place, sheet, row, cells in sheet_rows(content, wanted):
                for column, (kind, value) in enumerate(cells):
                    if value.strip():
                        have = dict(zip(NAMES, (name, place, sheet, row, column, kind, value), strict=True))
                        yield tuple(have[c] for c in self.columns)


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SheetReader:
        unknown = [c for c in schema.names if c not in NAMES]
        if unknown:
            raise ValueError(f"no such column: {', '.join(unknown)}")
        return SheetReader(self.options["path"], schema.names)


def read_sheets(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """Cells that are not empty, of all .ods files of a folder (or of one file). schema: some of SCHEMA's columns.

    A file without content fails the job; a folder without files gives no rows.
    Rows without anything do not count; those in groups and headers do.
    """
    spark.dataSource.register(SheetSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sheets").schema(schema).option("path", path).load()


def _cell(value) -> str:
    if value is None:
        return "<table:table-cell/>"
    if isinstance(value, bool):
        return f'<table:table-cell office:value-type="boolean" office:boolean-value="{str(value).lower()}"/>'
    if isinstance(value, int | float):
        return f'<table:table-cell office:value-type="float" office:value="{value}"/>'
    lines = "".join(f"<text:p>{escape(x)}</text:p>" for x in str(value).split("\n"))
    return f'<table:table-cell office:value-type="string">{lines}</table:table-cell>'


def write_sheets(df: DataFrame, path: str, file: str, sheet: str, order: list[str], columns: list[str]) -> DataFrame:
    """Writes a file for each value of `file` with a sheet for each of `sheet`; returns (file, sheets, rows) of what was written.

    Rows are in order; equal ones running are written once with their number.
    A file is written as a stream by one task and moved to its name when it is
    whole, so a repeated task writes the same file again. Signs that file names
    do not take become _.
    """
    # The file's and the sheet's names come first in each row; the columns follow, whatever they are called.
    rows = df.select(F.col(file).cast("string").alias("_f"), F.col(sheet).cast("string").alias("_s"), F.struct(*order).alias("_o"), F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(columns))).alias("_r"))
    rows = rows.where("_f is not null and _s is not null").repartition("_f").sortWithinPartitions("_f", "_s", "_o").select("_f", "_s", "_r.*")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        store.create_dir(root)
        book: _Book | None = None
        for batch in batches:
            for name, part, *cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if book is None or book.name != name:
                    if book:
                        yield book.close()
                    book = _Book(store, root, name)
                book.add(part, "".join(map(_cell, cells)))
        if book:
            yield book.close()

    return rows.mapInArrow(write, "file string, sheets int, rows long")


class _Book:
    """A file that is being written."""

    def __init__(self, store, root: str, name: str):
        self.store, self.name, self.sheets, self.rows = store, name, 0, 0
        self.file = f"{root}/{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}.ods"
        self.aside = f"{root}/_{uuid.uuid4().hex}"
        self.raw = store.open_output_stream(self.aside, compression=None)
        self.archive = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_DEFLATED)
        self.archive.writestr("mimetype", "application/vnd.oasis.opendocument.spreadsheet", zipfile.ZIP_STORED)
        self.out = self.archive.open("content.xml", "w", force_zip64=True)
        spaces = "".join(f' xmlns:{p}="{ns[1:-1]}"' for p, ns in (("table", TABLE), ("office", OFFICE), ("text", TEXT)))
        self._put(f'<?xml version="1.0" encoding="UTF-8"?><office:document-content{spaces}><office:body><office:spreadsheet>')
        self.sheet: str | None = None
        self.row, self.times = "", 0

    def _put(self, text: str) -> None:
        self.out.write(text.encode())

    def add(self, sheet: str, row: str) -> None:
        if sheet != self.sheet:
            self._end()
            self.sheet, self.sheets = sheet, self.sheets + 1
            self._put(f"<table:table table:name={quoteattr(sheet)}>")
        if row != self.row:
            self._flush()
            self.row = row
        self.times += 1
        self.rows += 1

    def _flush(self) -> None:
        if self.times:
            self._put(f'<table:table-row table:number-rows-repeated="{self.times}">{self.row}</table:table-row>')
        self.row, self.times = "", 0

    def _end(self) -> None:
        self._flush()
        if self.sheet is not None:
            self._put("</table:table>")

    def close(self) -> pa.RecordBatch:
        self._end()
        self._put("</office:spreadsheet></office:body></office:document-content>")
        self.out.close()
        self.archive.close()
        self.raw.close()
        self.store.move(self.aside, self.file)
        told = [pa.array([self.name]), pa.array([self.sheets], pa.int32()), pa.array([self.rows], pa.int64())]
        return pa.RecordBatch.from_arrays(told, ["file", "sheets", "rows"])
