"""SimHash near-duplicates with pigeonring candidate pruning.

A fingerprint is cut into a ring of m segments. If two fingerprints differ in
at most r bits, some segment starts a chain whose first l segments together
differ in at most floor(l * r / m) bits, for every l. The longest chain with a
budget of nought must agree in full, and the segments up to the next budget
of one agree in one of their two halves: those bits make the index keys. The
longer chains then prune candidates, the last of them being the Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, split_off, staged
from .components import components

#: Fingerprints of one key compared in one place; fuller keys are dealt out in pairs of blocks.
BLOCK = 2048


def fingerprint(text: str | None, width: int) -> int:
    """64 bits as a signed number; text without words: 0."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    rows = zip(*(words[i:] for i in range(min(width, len(words)))), strict=False)
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, rows), repeat(42)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """Adds the SimHash of lower-cased (A-Z) words in shingles of `width`."""
    small_batches(df.sparkSession)

    @F.arrow_udf("long")
    def fp(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(t.as_py(), width) for t in texts], pa.int64())

    return df.withColumn(out, fp(F.col(text_col)))


def _plan(radius: int, segments: int) -> tuple[int, int, int]:
    """Bits of a segment, segments with budget 0, and those with budget 1 at most.

    No more of them than a key has room for.
    """
    size = 64 // segments
    free = min(-(-segments // radius) - 1, 40 // size)
    return size, free, min(segments, -(-2 * segments // radius) - 1, free + 20 // size)


def _keys(fp, radius: int, segments: int):
    """The index keys: chain start, half, the agreeing segments, the agreeing half."""
    size, free, one = _plan(radius, segments)
    first = (one - free) * size // 2
    halves = [(0, first), (first, (one - free) * size)] if one > free else [(0, 0)]
    longest = max(e - b for b, e in halves)
    keys = []
    for start in range(segments):
        r = F.shiftleft(fp, start * size).bitwiseOR(F.shiftrightunsigned(fp, 64 - start * size)) if start else fp
        head = F.shiftrightunsigned(r, 64 - free * size)
        for k, (b, e) in enumerate(halves):
            key = F.lit(start * 2 + k).cast("long")
            key = F.shiftleft(key, free * size).bitwiseOR(head)
            tail = F.shiftrightunsigned(r, 64 - free * size - e).bitwiseAND(F.lit((1 << (e - b)) - 1).cast("long"))
            keys.append(F.shiftleft(key, longest).bitwiseOR(tail))
    return F.array(*keys), free * size + longest + 1


def _chain(x: np.ndarray, start: np.ndarray, radius: int, segments: int) -> np.ndarray:
    """Which differences keep within every chain's budget from their start."""
    size, free, _ = _plan(radius, segments)
    turn = (start * size).astype(np.uint64)
    ring = (x << turn) | (x >> ((np.uint64(64) - turn) & np.uint64(63)))
    ok = np.arange(len(x))
    for n in range(free, segments + 1):
        top = ring[ok] >> np.uint64(64 - n * size)
        ok = ok[np.bitwise_count(top) <= n * radius // segments]
    return ok


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links that join something not yet joined."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def links(fps: DataFrame, radius: int = 3, segments: int = 16) -> DataFrame:
    """Links (a, b) that join all distinct values of column fp within `radius` bits.

    Enough links for the connected components, not every pair. radius: 1 to 6
    with 16 segments. Nulls are ignored.
    """
    if not 1 <= radius <= 6 or 64 % segments:
        raise ValueError("radius must be from 1 to 6, and 64 a multiple of segments")
    keys, shift = _keys(F.col("fp"), radius, segments)
    keyed = fps.where("fp is not null").select("fp").distinct().select("fp", F.explode(keys).alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    full = full.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(F.col("own"), o).alias("r"), F.greatest(F.col("own"), o).alias("s")),
    )
    # Spark takes the exploded keys for no larger than the fingerprints and would send all of them to every task.
    cells = keyed.hint("merge").join(full, "key").withColumn("own", own)
    cells = cells.select("key", "fp", F.inline(pairs)).repartition("key", "r", "s").sortWithinPartitions("key", "r", "s", "fp")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            at, found = np.arange(len(fp)), []
            for o in range(1, len(fp)):
                at = at[: np.searchsorted(at, len(fp) - o)]
                at = at[(cell[at] == cell[at + o]).all(axis=1)]
                if not len(at):
                    break
                ok = at[_chain(fp[at] ^ fp[at + o], cell[at, 0] >> shift, radius, segments)]
                found += [(fp[ok], fp[ok + o])] if len(ok) else []
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
            kept = _forest(a, b)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

        rest = np.empty((0, 3), np.int64), np.empty(0, np.uint64)
        for batch in batches:
            cell = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "r", "s")], axis=1)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cell, fp = np.concatenate([rest[0], cell]), np.concatenate([rest[1], fp])
            same = (cell == cell[-1]).all(axis=1) if len(cell) else np.empty(0, bool)
            cut = int(np.argmax(same)) if len(same) else 0
            rest = cell[cut:], fp[cut:]
            if cut:
                yield joined(cell[:cut], fp[:cut])
        if len(rest[1]):
            yield joined(*rest)

    return cells.mapInArrow(within, "a long, b long").distinct()


def _grouped(df: DataFrame, id_col: str, text_col: str, width: int, radius: int) -> DataFrame:
    """(_id, fp, _root, component_id): one row per row of df; _root is a fingerprint that stands for the group."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fps = staged(with_fingerprint(rows, "_text", width).select("_id", "fp"), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("_id").alias("first"))
    roots = components(links(first, radius))
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "first", F.coalesce("root", "fp").alias("_root"))
    heads = rooted.groupBy("_root").agg(F.min("first").alias("component_id"))
    return fps.join(rooted.join(heads, "_root").select("fp", "_root", "component_id"), "fp")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3
) -> DataFrame:
    """One row per row of df: id_col, fp (long), component_id, fingerprint (hex).

    component_id is the smallest id among the documents reachable by links of
    at most `radius` differing bits. Null and empty texts have fingerprint 0
    and are linked like any other; null ids get a component but never name
    one, unless no other id is there (then null). Repeated rows stay. Other
    columns of df are ignored; an empty table gives an empty table.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    found = _grouped(df, id_col, text_col, width, radius)
    return found.select(F.col("_id").alias(id_col), "fp", "component_id", hexed.alias("fingerprint"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """df without all but one document, that of the smallest id, of each group.

    Rows that repeat an id and a fingerprint count as copies, and one of them
    stays, by the order of text and other columns (maps aside); an id whose
    texts head several groups stays once for each. Rows with a null id stay,
    for nothing else could name them.
    """
    found = _grouped(df, id_col, text_col, width, radius).where("_id is not null")
    head = F.when(F.col("_id") == F.col("component_id"), F.col("_root"))
    named = found.groupBy("_id").agg(F.count("*").alias("_n"), (F.min("fp") != F.max("fp")).alias("_mixed"), F.max(head).alias("_root"))
    named = staged(named.where("_n > 1 or _root is null"), "left-out")
    # Rows of an id that comes once stay as they are or go; only repeated ids are looked at row by row.
    kept = split_off(df, id_col, named.select("_id"), "left_anti")
    again = staged(named.where("_n > 1 and _root is not null").select("_id", "_mixed", "_root"), "repeated")
    if again.isEmpty():
        return kept
    few = split_off(df, id_col, again.select("_id"), "left_semi")
    rows = few.select(F.col(id_col).alias("_id"), F.struct(*df.columns).alias("_row")).join(again, "_id")
    # Only ids with several fingerprints need those of their rows once more.
    heads = found.where("_id = component_id").select("_id", "fp", "_root").distinct()
    mixed = with_fingerprint(rows.where("_mixed").select("_id", "_row", F.col("_row")[text_col].alias("_text")), "_text", width)
    both = rows.where("not _mixed").select("_root", "_row").unionByName(mixed.join(heads, ["_id", "fp"]).select("_root", "_row"))
    ordered = [text_col, *(f.name for f in df.schema if f.name not in (text_col, id_col) and "map<" not in f.dataType.simpleString())]
    least = F.min_by("_row", F.struct(*(F.col("_row")[c].alias(c) for c in ordered)))
    return kept.unionByName(both.groupBy("_root").agg(least.alias("_row")).select("_row.*"))
