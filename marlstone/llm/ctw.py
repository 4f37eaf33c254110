"""Scoring by context-tree weighting.

A text is the bytes of its words, each followed by one space, and an end;
every byte is eight binary decisions. A decision's contexts are the up to DEPTH
bytes before it; before the text are spaces.
Krichevsky-Trofimov estimates of all depths are mixed by the weights of the
tree, which stay frozen while texts are scored.

Texts are read once, in blocks of some MB. A block asks for the counts of its
words and the code lengths of its contexts; it does so in runs of sorted
numbers, one for each group (two bytes of context, or the first bits of a
word's hash), so a shuffle moves arrays and no task ever holds the corpus's
vocabulary or its tree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

DEPTH = 6
#: Bytes of text in a block, about; in what is worked on at once.
BLOCK, SLICE = 16 << 20, 1 << 20
#: Numbers in one row; entries of a tree that are worked on at once.
PIECE, CHUNK = 4096, 1 << 16
#: Blocks whose numbers of one group meet in one task; more are dealt out by salt.
FAN = 2048
#: The symbol that ends a text; no word holds it.
END = 10
#: Kinds of rows: documents, words and contexts that are asked for, decisions above the groups, sums over words.
DOC, WORD, CONTEXT, TOP, TOTAL = range(5)
WORD_BITS = 10
#: What a block is told; 24 bits are enough for a code length, of which millions are summed as doubles.
TOLD = {WORD: np.int64, CONTEXT: np.float32}

HALF = np.log(0.5)


def positions(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the DEPTH bytes before, the last of them first, and the byte, as one number; texts' starts.

    raws: words with single spaces between. A text is led in by spaces; its
    last word is followed by a space and END.
    """
    full = [b" " * DEPTH + r + (b" " if r else b"") + bytes([END]) for r in raws]
    stream = np.frombuffer(b"".join(full), np.uint8).astype(np.int64)
    key = stream.copy()
    for back in range(1, DEPTH + 1):
        key[back:] |= stream[:-back] << 8 * (DEPTH + 1 - back)
    lengths = np.fromiter(map(len, full), np.int64, len(full))
    lead = ((np.cumsum(lengths) - lengths)[:, None] + np.arange(DEPTH)).ravel()
    own = lengths - DEPTH
    return np.delete(key, lead), np.cumsum(own) - own


def words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, each word's place among them, and the number of words of each text.

    64 bits tell words apart: among a billion words two meet with a chance of 3 %.
    """
    data = b"".join(r + b" " for r in raws if r)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    every = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    names = every.dictionary.to_pylist()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    return own, every.indices.to_numpy(zero_copy_only=False), np.fromiter((r.count(b" ") + 1 if r else 0 for r in raws), np.int64, len(raws))


def slices(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of SLICE bytes about, or of one text that is longer."""
    a, size = 0, 0
    for b, raw in enumerate(raws):
        if size and size + len(raw) > SLICE:
            yield a, b
            a, size = b, 0
        size += len(raw)
    if a < len(raws):
        yield a, len(raws)


def packed(x: np.ndarray) -> bytes:
    """Numbers, like bytes side by side, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(x: np.ndarray) -> bytes:
    """Sorted numbers, as steps."""
    return packed(np.diff(x.astype(np.uint64), prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


class Sums:
    """Sums of counts by number, kept sorted; parts are merged when they have grown."""

    def __init__(self):
        self.parts, self.size, self.last = [], 0, 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key.astype(np.uint64), n.astype(np.int64)))
        self.size += len(key)
        if self.size > 2 * self.last + 2_000_000:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.size:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(self.parts) > 1:
            key = np.concatenate([k for k, _ in self.parts])
            order = np.argsort(key)
            key, n = key[order], np.concatenate([n for _, n in self.parts])[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            self.parts = [(key[head], np.add.reduceat(n, head))]
        self.size = self.last = len(self.parts[0][0])
        return self.parts[0]


def counted(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct positions, sorted, with how often training texts have them."""
    both = np.sort(key << 1 | train)
    head = np.flatnonzero(np.append(True, both[1:] >> 1 != both[:-1] >> 1))
    return both[head] >> 1, np.add.reduceat(both & 1, head)


def pieces(key: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(group, start, stop) of runs of sorted numbers; a group has several where it is long."""
    if not len(key):
        return
    group = key.astype(np.uint64) >> np.uint64(shift)
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
        for start in range(a, b, PIECE):
            yield int(group[a]), start, min(b, start + PIECE)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0, by Stirling's series at x + 8."""
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - sum(np.log(x + i) for i in range(8))


SMALL = 1 << 14
GAMMA = {c: _log_gamma(np.arange(SMALL) + c) for c in (0.5, 1.0)}


def log_gamma(n: np.ndarray, c: float) -> np.ndarray:
    """ln gamma(n + c) of whole numbers."""
    out = GAMMA[c][np.minimum(n, SMALL - 1)]
    big = np.flatnonzero(n >= SMALL)
    out[big] = _log_gamma(n[big] + c)
    return out


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 noughts and n1 ones."""
    return log_gamma(n0, 0.5) + log_gamma(n1, 0.5) - np.log(np.pi) - log_gamma(n0 + n1, 1.0)


def weighted(pe: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.logaddexp(HALF + pe, HALF + below)


def mixed(acc, rem, n0, n1, pe, pw):
    """The probability of a one so far and the weight that is left, after one more depth."""
    own = np.exp(HALF + pe - pw)
    return acc + rem * own * (n1 + 0.5) / (n0 + n1 + 1), rem * (1 - own)


def above(own: np.ndarray) -> np.ndarray:
    """Contexts with nodes, or with symbols, of one depth less."""
    return (own >> 16) << 8 | own & 255


class Subtree:
    """The levels of a context tree from depth `top` on.

    A level has the distinct contexts of its depth with their symbols, sorted,
    so each decision's node is a run of them.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, top: int):
        """key: as of positions(), distinct and sorted; n: training counts, 0 for those that are only asked for."""
        self.top, self.levels = top, {}
        bit = np.arange(8)[:, None]
        lower = None
        for d in range(DEPTH, top - 1, -1):
            if lower is None:
                place = None
            else:
                key, place = np.unique(above(lower[0]), return_inverse=True)
                n = np.bincount(place, n, len(key)).astype(np.int64)
            prefix = key >> (8 - bit)
            head = np.ones(prefix.shape, bool)
            head[:, 1:] = prefix[:, 1:] != prefix[:, :-1]
            starts = np.flatnonzero(head)
            run = (np.cumsum(head.ravel()) - 1).reshape(head.shape)
            one = (key >> (7 - bit)) & 1
            n1 = np.add.reduceat((one * n).ravel(), starts)
            n0 = np.add.reduceat(np.broadcast_to(n, one.shape).ravel(), starts) - n1
            pe = kt_block(n0, n1)
            if lower is None:
                up, pw = None, pe
            else:
                row, at = np.divmod(lower[3], len(lower[0]))
                up = run[row, place[at]]
                pw = weighted(pe, np.bincount(up, lower[4], len(starts)))
                self.levels[d + 1]["up"] = up
            self.levels[d] = {"key": key, "starts": starts, "run": run, "one": one, "n0": n0, "n1": n1, "pe": pe, "pw": pw}
            lower = key, place, n, starts, pw

    def summary(self) -> tuple[np.ndarray, ...]:
        """Of the top level: contexts with nodes, noughts, ones, estimates, weighted; sorted."""
        top = self.levels[self.top]
        row, at = np.divmod(top["starts"], len(top["key"]))
        key = top["key"][at]
        own = key >> 8 << 8 | 1 << row | (key & 255) >> (8 - row)
        order = np.argsort(own)
        return own[order], *(top[c][order] for c in ("n0", "n1", "pe", "pw"))

    def log10(self, own: np.ndarray, acc: np.ndarray, rem: np.ndarray) -> np.ndarray:
        """log10 P of each key; acc and rem are the mix down to the top level, by `own` as summary() has it."""
        top = self.levels[self.top]
        row, at = np.divmod(top["starts"], len(top["key"]))
        key = top["key"][at]
        where = np.searchsorted(own, key >> 8 << 8 | 1 << row | (key & 255) >> (8 - row))
        acc, rem = acc[where], rem[where]
        for d in range(self.top + 1, DEPTH + 1):
            level = self.levels[d]
            n0, n1, up = level["n0"], level["n1"], level["up"]
            if d < DEPTH:
                acc, rem = mixed(acc[up], rem[up], n0, n1, level["pe"], level["pw"])
            else:
                acc = acc[up] + rem[up] * (n1 + 0.5) / (n0 + n1 + 1)
        leaf = self.levels[DEPTH]
        p = acc[leaf["run"]]
        return np.log10(np.where(leaf["one"] == 1, p, 1 - p)).sum(axis=0)


def _chunks(key: np.ndarray, d: int) -> Iterator[slice]:
    """Runs of whole contexts of d bytes, of CHUNK entries about."""
    cuts = np.append(np.flatnonzero(np.diff(key >> 8 * (DEPTH + 1 - d))) + 1, len(key))
    start = 0
    while start < len(key):
        stop = int(cuts[max(np.searchsorted(cuts, start + CHUNK, "right") - 1, np.searchsorted(cuts, start, "right"))])
        yield slice(start, stop)
        start = stop


def summary(key: np.ndarray, n: np.ndarray, d: int) -> tuple[np.ndarray, ...]:
    """Depth d of a tree: contexts with nodes, noughts, ones, estimates, weighted; never more than CHUNK entries, or one deepest context, at once."""
    if len(key) <= CHUNK:
        return Subtree(key, n, d).summary()
    parts = [summary(key[s], n[s], d + 1) for s in _chunks(key, d + 1)]
    below = [np.concatenate(x) for x in zip(*parts, strict=True)]
    own, place = np.unique(above(below[0]), return_inverse=True)
    n0, n1 = (np.bincount(place, below[i], len(own)).astype(np.int64) for i in (1, 2))
    pe = kt_block(n0, n1)
    return own, n0, n1, pe, weighted(pe, np.bincount(place, below[4], len(own)))


def log10(key: np.ndarray, n: np.ndarray, d: int, own: np.ndarray, acc: np.ndarray, rem: np.ndarray) -> np.ndarray:
    """log10 P of each key; acc and rem by own are the mix above depth d."""
    tree = Subtree(key, n, d) if len(key) <= CHUNK else None
    mine, n0, n1, pe, pw = tree.summary() if tree else summary(key, n, d)
    at = np.searchsorted(own, above(mine))
    acc, rem = mixed(acc[at], rem[at], n0, n1, pe, pw)
    if tree:
        return tree.log10(mine, acc, rem)
    return np.concatenate([log10(key[s], n[s], d + 1, mine, acc, rem) for s in _chunks(key, d + 1)])


KINDS = {
    "block": pa.int64(), "kind": pa.int8(), "g": pa.int32(), "id": None, "held_out": pa.bool_(), "raw": pa.binary(), "keys": pa.binary(),
    "n": pa.binary(), "own": pa.int64(), "n0": pa.float64(), "n1": pa.float64(), "pw": pa.float64(),
}
SCHEMA = "block long, kind byte, g int, {}keys binary, n binary, own long, n0 double, n1 double, pw double"


def _batch(kinds: dict, rows: int, **columns) -> pa.RecordBatch:
    fill = lambda x, k: x if isinstance(x, pa.Array) else pa.array([x] * rows if isinstance(x, int) else x, k)
    return pa.RecordBatch.from_arrays([fill(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in kinds.items()], list(kinds))


def _asked(kinds: dict, block: int, kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the sorted numbers of a block, some at a time."""
    runs = list(pieces(key, 8 * (DEPTH - 1) if kind == CONTEXT else 64 - WORD_BITS))
    for i in range(0, len(runs), 500):
        part = runs[i : i + 500]
        yield _batch(kinds, len(part), block=block, kind=kind, g=[g for g, _, _ in part], keys=[packed_keys(key[a:b]) for _, a, b in part], n=[packed(n[a:b]) for _, a, b in part])


def _blocks(docs: DataFrame, id_type: str) -> DataFrame:
    """Rows of three kinds for each block: its documents, the words and the contexts that it asks for, with training counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        names, contexts, size, pending = Sums(), Sums(), 0, False
        squeeze = zstandard.ZstdCompressor(level=1)

        def closed() -> Iterator[pa.RecordBatch]:
            yield from _asked(kinds, block, WORD, *names.total())
            yield from _asked(kinds, block, CONTEXT, *contexts.total())

        for got in batches:
            kinds = KINDS | {"id": got.column(0).type}
            train = ~got.column(2).to_numpy(zero_copy_only=False).astype(bool)
            raws = [b" ".join((t.as_py() or "").encode("utf-8", "replace").lower().split()) for t in got.column(1)]
            for a, b in slices(raws):
                key, starts = positions(raws[a:b])
                contexts.add(*counted(key, np.repeat(train[a:b], np.diff(np.append(starts, len(key))))))
                own, at, lengths = words(raws[a:b])
                names.add(own, np.bincount(at, np.repeat(train[a:b], lengths), len(own)))
                yield _batch(kinds, b - a, block=block, kind=DOC, id=got.column(0).slice(a, b - a), held_out=got.column(2).slice(a, b - a), raw=[squeeze.compress(r) for r in raws[a:b]])
                size, pending = size + sum(map(len, raws[a:b])), True
                if size > BLOCK:
                    yield from closed()
                    block += 1
                    names, contexts, size, pending = Sums(), Sums(), 0, False
        if pending:
            yield from closed()

    return docs.mapInArrow(rows, SCHEMA.format(f"id {id_type}, held_out boolean, raw binary, "))


def _by_group(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that come sorted, by group."""
    every = (row for batch in batches for row in batch.to_pylist())
    return groupby(every, key=lambda row: tuple(row[c] for c in names))


def _dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows of a group in one partition, in order. The number is fixed: small compressed rows take long to work on."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *by)


def _summed(asked: DataFrame, blocks: int) -> DataFrame:
    """The numbers of all blocks with their counts, by group; decisions of two bytes' context; sums over words.

    Up to FAN blocks meet in a task at a time, in as many rounds as it takes.
    """
    kinds = {c: k for c, k in KINDS.items() if c not in ("id", "held_out", "raw")}

    def folded(last: bool):
        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (kind, g, block), rows in _by_group(batches, "kind", "g", "block"):
                sums = Sums()
                for row in rows:
                    sums.add(unpacked_keys(row["keys"]), unpacked(row["n"], np.int64))
                key, n = sums.total()
                yield from _asked(kinds, -1 if last else block, kind, key, n)
                if last and kind == WORD:
                    yield _batch(kinds, 1, block=-1, kind=TOTAL, g=g, own=[int(n.sum())], n0=[float((n > 0).sum())])
                elif last:
                    own, n0, n1, _, pw = summary(key.astype(np.int64), n, 2)
                    yield _batch(kinds, len(own), block=-1, kind=TOP, g=g, own=pa.array(above(own)), n0=pa.array(n0.astype(float)), n1=pa.array(n1.astype(float)), pw=pa.array(pw))

        return fold

    while True:
        last = blocks <= FAN
        blocks = 1 if last else -(-blocks // FAN)
        rows = asked.select("kind", "g", "keys", "n", F.pmod(F.xxhash64("block"), F.lit(blocks)).alias("block"))
        rows = _dealt(rows, "kind", "g", "block").sortWithinPartitions("kind", "g", "block")
        asked = staged(rows.mapInArrow(folded(last), SCHEMA.format("")), "sums")
        if last:
            return asked


def _mix(tops: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The mix of depths 0 and 1, by the last byte and node: at most 2 ** 16 decisions, which the driver mixes."""
    rows = tops.groupBy("own").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "pw"))).toPandas()
    one = np.zeros((3, 1 << 16))
    one[:, rows["own"].to_numpy()] = rows[["n0", "n1", "pw"]].to_numpy().T
    n0, n1 = one[:2].astype(np.int64).reshape(2, 256, 256)
    pe = kt_block(n0.ravel(), n1.ravel()).reshape(256, 256)
    pw = weighted(pe, one[2].reshape(256, 256))
    zero0, zero1 = n0.sum(0), n1.sum(0)
    zero_pe = kt_block(zero0, zero1)
    acc, rem = mixed(0.0, 1.0, zero0, zero1, zero_pe, weighted(zero_pe, pw.sum(0)))
    acc, rem = mixed(acc[None], rem[None], n0, n1, pe, pw)
    return acc.ravel(), rem.ravel()


def _answers(asked: DataFrame, sums: DataFrame, blocks: int) -> DataFrame:
    """(block, kind, keys, n): for each row of numbers that a block asks for, what TOLD says: the words' counts or the contexts' log10 P."""
    acc, rem = _mix(sums.where(F.col("kind") == TOP))
    salts = -(-blocks // FAN)
    known = sums.where(F.col("kind").isin(WORD, CONTEXT)).select("block", "kind", "g", "keys", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    wanted = asked.select("block", "kind", "g", "keys", F.lit(None).cast("binary").alias("n"), F.pmod(F.xxhash64("block"), F.lit(salts)).cast("long").alias("salt"))
    rows = _dealt(known.unionByName(wanted), "kind", "g", "salt").sortWithinPartitions("kind", "g", "salt", "block")
    every = np.arange(1 << 16)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, _, _), own in _by_group(batches, "kind", "g", "salt"):
            sums, ready, out = Sums(), None, []
            for row in own:
                key = unpacked_keys(row["keys"])
                if row["block"] < 0:
                    sums.add(key, unpacked(row["n"], np.int64))
                    continue
                if ready is None:
                    ready, n = sums.total()
                    value = (n if kind == WORD else log10(ready.astype(np.int64), n, 2, every, acc, rem)).astype(TOLD[kind])
                out.append((row["block"], row["keys"], packed(value[np.searchsorted(ready, key)])))
                if len(out) == 500:
                    yield _answer(kind, out)
                    out = []
            if out:
                yield _answer(kind, out)

    return rows.mapInArrow(answered, "block long, kind byte, keys binary, n binary")


def _answer(kind: int, rows: list[tuple]) -> pa.RecordBatch:
    block, keys, n = zip(*rows, strict=True)
    columns = [pa.array(block, pa.int64()), pa.array([kind] * len(rows), pa.int8()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["block", "kind", "keys", "n"])


class Table:
    """What a block was told, by number."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        key = np.concatenate([k for k, _ in rows]) if rows else np.empty(0, np.uint64)
        value = np.concatenate([v for _, v in rows]) if rows else np.empty(0)
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]

    def of(self, key: np.ndarray) -> np.ndarray:
        """Sorted numbers are found faster: near ones lie near."""
        key = key.astype(np.uint64)
        order = np.argsort(key)
        out = np.empty(len(key))
        out[order] = self.value[np.searchsorted(self.key, key[order])]
        return out


def score(df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where the column held_out is false (null counts as
    false). Tokens are words of bytes other than white space, A-Z lower-cased,
    and one end for each text. base_score: word frequencies with half a count
    added. score: log10 of the model's probability. A null text is an empty
    one, with the end alone; repeated rows each count; an empty table gives an
    empty one; other columns are ignored.
    """
    spark = df.sparkSession
    small_batches(spark)
    id_type = df.schema[id_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    rows = staged(_blocks(docs, id_type), "blocks")
    texts, asked = rows.where(F.col("kind") == DOC), rows.where(F.col("kind") != DOC)
    size = texts.agg(F.count_distinct("block"), F.count(F.when(~F.col("held_out"), 1))).first()
    blocks, n_ends = max(1, size[0]), size[1]
    sums = _summed(asked, blocks)
    seen = sums.where(F.col("kind") == TOTAL).agg(F.coalesce(F.sum("own"), F.lit(0)), F.coalesce(F.sum("n0"), F.lit(0.0))).first()
    n_all, n_kinds = seen[0] + n_ends, int(seen[1]) + (n_ends > 0)
    total = float(np.log10(n_all + 0.5 * (n_kinds + 1)))
    told = _answers(asked, sums, blocks)
    parts = texts.select("block", "kind", "id", "held_out", "raw").unionByName(told, allowMissingColumns=True)
    parts = _dealt(parts, "block").sortWithinPartitions("block", F.col("kind").desc())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        at, told, tables, id_kind = None, {}, None, None

        def result(rows: list[dict]) -> pa.RecordBatch:
            raws = [r["text"] for r in rows]
            key, starts = positions(raws)
            own, place, lengths = words(raws)
            n = tables[WORD].of(own)[place]
            doc = np.repeat(np.arange(len(raws)), lengths)
            columns = {
                "id": pa.array([r["id"] for r in rows], id_kind),
                "held_out": pa.array([r["held_out"] for r in rows], pa.bool_()),
                "n_tokens": pa.array(lengths + 1),
                "n_known": pa.array(np.bincount(doc, n > 0, len(raws)).astype(np.int64) + (n_ends > 0)),
                "train_tokens": pa.array([n_all] * len(raws), pa.int64()),
                "base_score": pa.array(np.bincount(doc, np.log10(n + 0.5) - total, len(raws)) + np.log10(n_ends + 0.5) - total),
                "score": pa.array(np.add.reduceat(tables[CONTEXT].of(key), starts)),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            id_kind = batch.schema.field("id").type
            pending, size = [], 0
            for row in batch.to_pylist():
                if row["block"] != at:
                    if pending:
                        yield result(pending)
                    at, told, tables, pending, size = row["block"], {WORD: [], CONTEXT: []}, None, [], 0
                if row["kind"] != DOC:
                    told[row["kind"]].append((unpacked_keys(row["keys"]), unpacked(row["n"], TOLD[row["kind"]]).astype(np.float64)))
                    continue
                if tables is None:
                    tables, told = {k: Table(v) for k, v in told.items()}, {}
                row["text"] = opened.decompress(row.pop("raw"))
                if size and size + len(row["text"]) > SLICE:
                    yield result(pending)
                    pending, size = [], 0
                pending.append(row)
                size += len(row["text"])
            if pending:
                yield result(pending)

    schema = f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.mapInArrow(scored, schema).withColumnRenamed("id", id_col)
