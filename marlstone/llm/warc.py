"""WARC archives as a PySpark data source.

Archives hold one gzip member for each record. The member's header carries its
compressed length (an `sl` field), so a reader that has seen a record's headers
can step over the payload without decoding it. Other archives, gzipped or
plain, are read as well.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

#: Columns of the source; a schema with some of them reads only those.
SCHEMA = (
    "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, "
    "content_length long, payload_bytes long, headers map<string,string>, payload binary"
)
HEADER_OF = {
    "record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
MEMBER = b"\x1f\x8b\x08\x04"
CHUNK = 64 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, warc_type string, target_uri string, payload_sha1 string, refers_to string, payload_bytes long, payload binary"


def _files(path: str):
    """The file system of a path that Spark understands, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path) if path.startswith("file:") else path)


def member(record: bytes, level: int = 4) -> bytes:
    """A record as a gzip member that says how long it is."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    size = 10 + 2 + 12 + len(body) + len(tail)
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return MEMBER + b"\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def record(row: dict, date: str) -> bytes:
    """A response, or a revisit without its payload, as the bytes of a WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] or b"") if row["warc_type"] == "response" else http
    head = {
        "WARC-Type": row["warc_type"],
        "WARC-Record-ID": f"<{row['record_id']}>",
        "WARC-Date": date,
        "WARC-Target-URI": row["target_uri"],
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row["payload_sha1"])).decode(),
    }
    if row["warc_type"] == "revisit":
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": f"<{row['refers_to']}>"}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Part(InputPartition):
    file: str
    start: int
    stop: int


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcSource(DataSource):
    """Options: path; split_bytes (gzipped archives are cut there, 128 MB); date, level (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.fieldNames(), int(self.options.get("split_bytes", 128 << 20)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, self.options.get("date", "1970-01-01T00:00:00Z"), int(self.options.get("level", 4)))


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file aside; the driver moves those of the tasks that counted."""

    def __init__(self, path: str, overwrite: bool, date: str, level: int):
        self.path, self.overwrite, self.date, self.level = path, overwrite, date, level
        self.aside = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _files(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        store.create_dir(f"{root}/{self.aside}")
        empty = True
        with store.open_output_stream(f"{root}/{self.aside}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(member(record(row, self.date), self.level))
                    empty = False
        return Written([] if empty else [name])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _files(self.path)
        store.create_dir(root)
        if self.overwrite:
            for old in _archives(store, root):
                store.delete_file(old.path)
        for message in messages:
            for name in message.files if message else []:
                store.move(f"{root}/{self.aside}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _files(self.path)
        if store.get_file_info(f"{root}/{self.aside}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.aside}")


def _archives(store, root: str) -> list:
    from pyarrow import fs

    if store.get_file_info(root).type == fs.FileType.File:
        return [store.get_file_info(root)]
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda path: any(p[:1] in "_." for p in path[len(root) :].strip("/").split("/"))
    kept = [f for f in found if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path) and not hidden(f.path)]
    return sorted(kept, key=lambda f: f.path)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], split_bytes: int):
        self.path, self.columns, self.split_bytes = path, columns, split_bytes
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters) -> Iterator:
        """Takes over tests on the record type and other header columns."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADER_OF and isinstance(f, In):
                self.tests.append((column, "in", tuple(v for v in f.value if v is not None)))
            elif column in HEADER_OF and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            elif column in HEADER_OF and isinstance(f, IsNotNull):
                self.tests.append((column, "known", ()))
            else:
                yield f

    def partitions(self) -> list[Part]:
        store, root = _files(self.path)
        parts = []
        for f in _archives(store, root):
            step = self.split_bytes if f.path.endswith(".gz") else max(1, f.size)
            parts += [Part(f.path, a, min(f.size, a + step)) for a in range(0, f.size, step)]
        return parts or [Part("", 0, 0)]

    def _wanted(self, row: dict) -> bool:
        for column, kind, values in self.tests:
            have = row[column]
            if have is None or kind == "in" and have not in values or kind == "starts" and not have.startswith(values[0]):
                return False
        return True

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.file:
            return
        store, _ = _files(self.path)
        with store.open_input_file(partition.file) as f:
            records = _members if partition.file.endswith(".gz") else _plain
            for head, body in records(f, partition.start, partition.stop):
                row = _row(head)
                if not self._wanted(row):
                    continue
                if "payload" in self.columns or "payload_bytes" in self.columns:
                    row |= _payload(row, body, "payload" in self.columns)
                yield tuple(row.get(c) for c in self.columns)


def _row(head: bytes) -> dict:
    """A record's columns from its header lines."""
    headers: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            headers[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
    row = {c: headers.get(h) for c, h in HEADER_OF.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c].strip("<>") if row[c] else None
    size = headers.get("content-length") or "0"
    # A length that is no number says nothing of the payload; the record's other headers stand.
    row["content_length"] = int(size) if size.isascii() and size.isdigit() else None
    row["headers"] = headers
    return row


def _payload(row: dict, body, whole: bool) -> dict:
    """The payload's length as its HTTP headers give it, and on demand the payload."""
    size = row["content_length"]
    if size is None:
        return {"payload_bytes": None, "payload": None}
    if not row["headers"].get("content-type", "").startswith("application/http"):
        return {"payload_bytes": size, "payload": body(size) if whole else None}
    take = min(size, 1024)
    start = body(take)
    while (end := start.find(b"\r\n\r\n")) < 0 and take < size:
        take = min(size, 4 * take)
        start = body(take)
    if end < 0:  # no HTTP headers: what is there is the payload
        revisit = row["warc_type"] == "revisit"
        return {"payload_bytes": size, "payload": body(size) if whole and not revisit else None}
    http = start[:end]
    said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    content = body(size)[end + 4 :] if whole else None
    length = int(said[1]) if said else size - end - 4
    return {"payload_bytes": length, "payload": None if row["warc_type"] == "revisit" else content}


def _plain(f, start: int, stop: int) -> Iterator[tuple[bytes, object]]:
    """Records of an archive that is not compressed: headers are read, blocks are stepped over."""
    at = start
    while at < stop:
        f.seek(at)
        head = f.read(CHUNK)
        if not head.strip():
            return
        skip = len(head) - len(head.lstrip(b"\r\n"))
        while (end := head.find(b"\r\n\r\n", skip)) < 0:
            more = f.read(CHUNK)
            if not more:
                return
            head += more
        base = at + end + 4
        length = int(m[1]) if (m := re.search(rb"(?im)^content-length:\s*(\d+)", head[skip:end])) else 0

        def body(n: int, base=base) -> bytes:
            f.seek(base)
            return f.read(n)

        yield head[skip:end], body
        at = base + length + 4


class Member:
    """A gzip member that is decoded as far as is asked for."""

    def __init__(self, f, at: int):
        self.f, self.next = f, at
        self.plain, self.zip = bytearray(), zlib.decompressobj(31)
        self.spare = b""

    def upto(self, n: int) -> bool:
        """Decodes until there are n bytes; false where the member ends before."""
        while len(self.plain) < n and not self.zip.eof:
            raw = self.zip.unconsumed_tail
            if not raw:
                self.f.seek(self.next)
                raw = self.f.read(CHUNK if len(self.plain) else 2048)
                if not raw:
                    break
                self.next += len(raw)
            self.plain += self.zip.decompress(raw, max(1024, n - len(self.plain)))
        return len(self.plain) >= n

    def head(self) -> tuple[bytes, int] | None:
        n = 512
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.upto(n):
                end = self.plain.find(b"\r\n\r\n")
                break
            n = 2 * len(self.plain)
        return (bytes(self.plain[:end]), end + 4) if end >= 0 else None

    def finish(self) -> int:
        """Where the next member starts, for members that do not say it."""
        while not self.zip.eof and self.upto(len(self.plain) + (1 << 20)):
            pass
        return self.next - len(self.zip.unused_data)


def _starts(f, start: int, stop: int) -> int | None:
    """The first member that starts in the range: one whose text starts a WARC record."""
    at, tail = start, b""
    f.seek(at)
    while at - len(tail) < stop:
        raw = f.read(CHUNK)
        if not raw:
            return None
        data, base, look = tail + raw, at - len(tail), 0
        while (hit := data.find(b"\x1f\x8b\x08", look)) >= 0:
            if base + hit >= stop:
                return None
            try:
                probe = Member(f, base + hit)
                probe.upto(7)
                if probe.plain.startswith(b"WARC/1."):
                    return base + hit
            except zlib.error:
                pass
            look = hit + 1
        at += len(raw)
        tail = data[-2:]
        f.seek(at)
    return None


def _members(f, start: int, stop: int) -> Iterator[tuple[bytes, object]]:
    """Records whose members start in the range.

    A damaged member is left out, and reading goes on at the next that starts
    a record; the records behind it are not lost.
    """
    at = _starts(f, start, stop)
    size = f.size()
    while at is not None and at < min(stop, size):
        f.seek(at)
        front = f.read(24)
        said = front[:4] == MEMBER and front[12:14] == b"sl" and struct.unpack("<I", front[16:20])[0]
        one = Member(f, at)
        try:
            got = one.head()
        except zlib.error:
            got = None
        if got is None:
            at = _starts(f, at + 1, stop)
            continue
        head, base = got

        def body(n: int, one=one, base=base) -> bytes:
            """The block's first n bytes; of a damaged one, those before the damage."""
            try:
                one.upto(base + n)
            except zlib.error:
                pass
            return bytes(one.plain[base : base + n])

        yield head, body
        try:
            at = at + said if said else one.finish()
        except zlib.error:
            at = _starts(f, at + 1, stop)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """RECORDS for pages: the first of equal payloads is a response, the others revisit it.

    Equal payloads of at least least_bytes bytes are found by SHA-1; the
    smallest id is the response. A null text is an empty payload. Rows that
    repeat an id and a payload are responses alike if they hold the smallest
    id. Null ids come after all others and share the record id that ends in
    "null". A null address gives way to the record id; other columns are left
    out; an empty table has no records.
    """
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("payload"))
    rows = rows.withColumn("_sha", F.sha1("payload")).withColumn("payload_bytes", F.length("payload").cast("long"))
    narrow = rows.drop("payload")
    groups = narrow.where(F.col("payload_bytes") >= least_bytes).groupBy("_sha").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    groups = groups.where("_n > 1 and _first is not null").drop("_n")
    again = narrow.join(groups, "_sha").where(~F.col("_id").eqNullSafe(F.col("_first")))
    gone = again.select(F.col("_id").alias("_gone"), F.col("_sha").alias("_gone_sha")).distinct()
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_sha") == F.col("_gone_sha"))
    first = rows.join(gone, same, "left_anti").withColumn("_first", F.lit(None)).withColumn("warc_type", F.lit("response"))
    again = again.withColumn("payload", F.lit(None).cast("binary")).withColumn("warc_type", F.lit("revisit"))
    named = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    both = first.unionByName(again)
    address = F.regexp_replace(F.coalesce("_url", named("_id")), r"[\x00-\x20\x7f]", "%20")
    return both.select(
        named("_id").alias("record_id"), "warc_type", address.alias("target_uri"), F.col("_sha").alias("payload_sha1"),
        F.when(F.col("warc_type") == "revisit", named("_first")).alias("refers_to"), "payload_bytes", "payload",
    )


def write(pages: DataFrame, path: str, **columns) -> None:
    """Writes records() of pages as archives under path."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    records(pages, **columns).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """The records under path with some columns of SCHEMA; filters on header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).load(path)
