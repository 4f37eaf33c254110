"""Byte-level BPE of whole texts by public ranks, and back.

A text up to CHUNK signs is one chunk. A longer one is cut into chunks that
overlap, dealt out over the tasks, and each is pre-tokenised as if its first
sign began a match. Matching has no memory: where two neighbours have a
boundary in common, all that follows is common too, and the later chunk is
right from there on. A boundary close to a chunk's end may still move with the
signs behind it and does not count. Neighbours without a common boundary (one
match longer than the overlap, or a phase that never meets) become one chunk,
which is matched again, until all neighbours meet. Then the pieces between the
meeting places are encoded in parallel and strung together in order. Decoding
joins the tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spare, staged

#: Signs of a chunk, and those that it shares with the next.
CHUNK, OVERLAP = 32_768, 1_024
#: Signs behind a match that may change it: an apostrophe looks at two.
AHEAD = 2
#: Pre-tokens remembered by a task, and their longest; those over LONG signs are joined here, not by the library.
MEMO, SHORT, LONG = 1 << 17, 40, 10_000


def public(name: str) -> str:
    """The place of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids, lower ones merged first, from a file of ranks or a byte-level JSON vocabulary."""
    if not path.endswith(".json"):
        with open(path, "rb") as lines:
            return {base64.b64decode(token): int(n) for token, n in map(bytes.split, lines)}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    signs, ids = _byte_signs(), model["vocab"]
    merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"{path}: ids are not in the order of the merges")
    return {bytes(map(signs.__getitem__, token)): n for token, n in ids.items()}


@cache
def pattern() -> regex.Pattern:
    import public_tokenizers

    return regex.compile(public_tokenizers.PATTERN)


class Merges:
    """Encodes pre-tokens by ranks and remembers short ones: up to MEMO of late, and as many of those before.

    The library joins the bytes of a pre-token; its stack does not hold the
    longest runs of white space and its time grows faster there, so those are
    joined here.
    """

    def __init__(self, own: dict[bytes, int]):
        import tiktoken

        self.ranks = own
        self.library = tiktoken.Encoding("own", pat_str=pattern().pattern, mergeable_ranks=own, special_tokens={})
        self.late: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        """Ids of a text that begins and ends at pre-token boundaries, as little-endian unsigned 32-bit numbers."""
        late, out = self.late, []
        for piece in pattern().findall(text):
            ids = late.get(piece)
            out.append(self.piece(piece) if ids is None else ids)
        if len(late) >= MEMO:
            self.late, self.before = {}, late
        return b"".join(out)

    def piece(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = np.array(self.ids(piece), "<u4").tobytes()
        if len(piece) <= SHORT:
            self.late[piece] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        """Ids of a text; only one of over LONG signs need be a single pre-token."""
        return self.library.encode_ordinary(text) if len(text) <= LONG else self.merged(text.encode("utf-8", "replace"))

    def merged(self, raw: bytes) -> list[int]:
        """Joins the pair of the lowest rank, the leftmost of equals, until none has a rank; by a heap, in n log n."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        n, rank = len(raw), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            # Stale where either part has grown or gone since.
            if end[i] >= stop or end[end[i]] != stop:
                continue
            gone = end[i]
            end[i], end[gone] = stop, n + 1
            if stop < n:
                before[stop] = i
                if (r := rank(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := rank(raw[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[raw[i : end[i]]])
            i = end[i]
        return out


@cache
def merges(path: str) -> Merges:
    return Merges(ranks(path))


@cache
def token_bytes(path: str) -> dict[int, bytes]:
    return {n: token for token, n in ranks(path).items()}


def _encoder(path: str):
    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = merges(path)
        for texts in batches:
            yield pa.array([own.packed(t.as_py() or "") for t in texts], pa.binary())

    return encode


def _boundaries(pieces: DataFrame) -> DataFrame:
    """(_row, _from, _to, _left, _right): boundaries shared with the chunk before and with the next.

    pieces: (_row, _from, _to, _end, _text), _end being the text's length.
    """

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                begin, stop, sure = r["_from"], r["_to"], r["_to"] - (AHEAD if r["_to"] < r["_end"] else 0)
                found = [begin, *(begin + m.end() for m in pattern().finditer(r["_text"]))]
                left = [p for p in found if p <= min(begin + OVERLAP, sure)]
                rows.append((r["_row"], begin, stop, left, [p for p in found if stop - OVERLAP <= p <= sure]))
            names = ("_row", "_from", "_to", "_left", "_right")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names)

    return pieces.mapInArrow(matched, "_row long, _from long, _to long, _left array<long>, _right array<long>")


def _cut(long: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """Pieces of the long texts, dealt out over all tasks: those of spans (_row, _from, _to), or else overlapping chunks."""
    if spans is None:
        starts = F.sequence(F.lit(0).cast("long"), F.col("_end") - OVERLAP - 1, F.lit(CHUNK - OVERLAP).cast("long"))
        own = F.transform(starts, lambda s: F.struct(s.alias("_from"), F.least(s + CHUNK, F.col("_end")).alias("_to")))
        rows = long.withColumn("_spans", own)
    else:
        lists = spans.groupBy("_row").agg(F.collect_list(F.struct("_from", "_to")).alias("_spans"))
        rows = long.join(lists, "_row")
    rows = rows.select("_row", "_end", "_text", F.inline("_spans"))
    text = F.expr("substring(_text, cast(_from + 1 AS int), cast(_to - _from AS int))")
    return rows.select("_row", "_from", "_to", "_end", text.alias("_text")).repartition("_row", "_from")


def _stitched(long: DataFrame) -> DataFrame:
    """(_row, _from, _to): pieces that begin and end at boundaries of the whole text, end to end."""
    chunks = staged(_boundaries(_cut(long)), "chunks")
    while True:
        meeting = f"""
            SELECT *, _before IS NULL OR _at IS NOT NULL AS _met FROM (
              SELECT *, array_min(array_intersect(_left, _before)) AS _at FROM (
                SELECT *, lag(_right) OVER (PARTITION BY _row ORDER BY _from) AS _before FROM {{chunks}}))"""
        met = long.sparkSession.sql(meeting, chunks=chunks)
        if met.where("not _met").isEmpty():
            ends = "SELECT _row, coalesce(_at, _from) AS _from, coalesce(lead(_at) OVER (PARTITION BY _row ORDER BY _from), _to) AS _to FROM {met}"
            return long.sparkSession.sql(ends, met=met)
        runs = long.sparkSession.sql(
            """SELECT _row, min(_from) AS _from, max(_to) AS _to, count(*) AS _n, any_value(_left) AS _left, any_value(_right) AS _right FROM (
                 SELECT *, count_if(_met) OVER (PARTITION BY _row ORDER BY _from) AS _run FROM {met})
               GROUP BY _row, _run""",
            met=met,
        )
        runs = staged(runs, "runs")
        again = _boundaries(_cut(long, runs.where("_n > 1").select("_row", "_from", "_to")))
        chunks = staged(runs.where("_n = 1").drop("_n").unionByName(again), "chunks")


def encoded(df: DataFrame, text_col: str = "text", out: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """df with a binary column: the text's ids as little-endian unsigned 32-bit numbers.

    vocabulary: the place of a file of ranks or a byte-level JSON vocabulary, on
    every machine. Strings of special tokens are plain text. A null or empty
    text has no ids (an empty value). Repeated rows stay; an empty table gives
    an empty one; a column of df named like `out` gives way. df is read twice,
    the second time for the texts of over CHUNK signs.
    """
    path = vocabulary or public("byte_bpe_multi_50k.tiktoken")
    small_batches(df.sparkSession)
    size, encode = F.coalesce(F.length(text_col), F.lit(0)), _encoder(path)
    plain = df.drop(out)
    short = plain.where(size <= CHUNK).withColumn(out, encode(F.col(text_col)))
    row = spare("_row", df)
    long = staged(plain.where(size > CHUNK).withColumn(row, F.monotonically_increasing_id()), "long-texts")
    if long.isEmpty():
        return short
    texts = long.select(F.col(row).alias("_row"), F.col(text_col).alias("_text"), F.length(text_col).cast("long").alias("_end"))
    pieces = _cut(texts, _stitched(texts)).select("_row", "_from", encode("_text").alias("_ids"))
    whole = _strung(staged(pieces, "encoded-pieces")).toDF(row, out)
    return short.unionByName(long.join(whole, row).drop(row))


def _strung(pieces: DataFrame) -> DataFrame:
    """(_row, _ids): the pieces of each row, joined in order."""
    dealt = pieces.repartition("_row").sortWithinPartitions("_row", "_from")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(row: int, parts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([b"".join(parts)], pa.binary())], ["_row", "_ids"])

        at, parts = None, []
        for batch in batches:
            for row, ids in zip(batch.column("_row").to_pylist(), batch.column("_ids").to_pylist(), strict=True):
                if row != at:
                    if parts:
                        yield whole(at, parts)
                    at, parts = row, []
                parts.append(ids)
        if parts:
            yield whole(at, parts)

    return dealt.mapInArrow(joined, "_row long, _ids binary")


def decoded(ids: Column, vocabulary: str | None = None) -> Column:
    """The bytes that ids, as encoded() packs them, stand for; null gives null, an unknown id fails.

    Cutting a text's ids may cut a sign of several bytes: the result is binary,
    for the caller to read as UTF-8.
    """
    path = vocabulary or public("byte_bpe_multi_50k.tiktoken")

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = token_bytes(path)
        for packed in batches:
            yield pa.array([None if (raw := x.as_py()) is None else b"".join(map(own.__getitem__, np.frombuffer(raw, "<u4").tolist())) for x in packed], pa.binary())

    return decode(ids)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of every text; the two digests are lowercase hex.

    A null or empty text has no tokens and the digests of no bytes. Null and
    repeated ids stay as they are; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    ids = encoded(rows, "_text", "_ids", vocabulary)
    both = ids.withColumn("_bytes", decoded(F.col("_ids"), vocabulary))
    return both.select(
        F.col("_id").alias(id_col), (F.octet_length("_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"),
    )
