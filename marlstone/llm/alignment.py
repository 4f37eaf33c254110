"""Tokens of two vocabularies for one text, cut into the smallest groups that cover the same bytes.

A transducer reads the two token sequences side by side. Its state is the side
that leads and the bytes by which it leads; the other side's next token either
eats into them, or uses them up and closes a group, or takes the lead. What a
state does with a token is worked out once and remembered, as there are few
residuals among the suffixes of tokens. Texts are read in stretches between
places that no token of either side crosses: both sides end there, and the state
is empty. Short stretches are remembered as a whole.

The links of all texts are counted together. Of two tokens that end together
one is a suffix of the other, so there are no more different links than
suffixes of tokens: their table is bounded by the vocabularies, whatever the
corpus holds, and is sent to every task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LONG, Merges, public, ranks
from .common import small_batches, staged

#: Transitions and stretches remembered by a task (twice as many stretches: those of late and those before), and a stretch's longest.
TRANSITIONS, MEMO, SHORT = 1 << 18, 1 << 17, 48
#: A link is one number: A's id, and B's in the lowest bits.
B_BITS = 20

#: Signs before which a word may end, if no piece joins them to a letter.
SIGNS = ",.;:!?)\"'-"


def stretch_pattern(signs: str) -> regex.Pattern:
    """Stretches end before a space or line end behind any other sign, between a letter and one of signs, and behind a lone line end.

    White space goes with what follows it: how a run of it is cut depends on that.
    """
    own = regex.escape(signs)
    word = rf"\s*+\p{{L}}++(?=[ \n{own}]|\Z)"
    marks = rf"|\s*+[{own}]++(?=[ \n]|\Z)" if signs else ""
    return regex.compile(rf"(?<!\s)\n(?=\S)|{word}{marks}|\s*+\S++(?:[^\S \n]\s*+\S++)*+(?:[^\S \n]\s*+\Z)?|\s+")


class Mismatch(Exception):
    """The two sides do not spell the same bytes."""


class State:
    """Bytes by which one side leads, and what the tokens of the other do to them."""

    __slots__ = ("residual", "b_leads", "after")

    def __init__(self, residual: bytes, b_leads: bool):
        self.residual, self.b_leads, self.after = residual, b_leads, {}


class Transducer:
    """Reads two sequences of token ids whose bytes are a and b."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes]):
        self.a, self.b = a, b
        self.clear()

    def clear(self) -> None:
        #: The empty state: A reads first and leads by its token.
        self.empty = State(b"", True)
        self.states, self.known = {}, 0

    def step(self, state: State, token: int) -> State:
        """The state after the side behind reads a token, worked out and remembered."""
        spelt, residual = (self.a if state.b_leads else self.b)[token], state.residual
        if residual.startswith(spelt):
            rest, b_leads = residual[len(spelt) :], state.b_leads
        elif spelt.startswith(residual):
            rest, b_leads = spelt[len(residual) :], not state.b_leads
        else:
            raise Mismatch
        after = self.states.setdefault((rest, b_leads), State(rest, b_leads)) if rest else self.empty
        state.after[token] = after
        self.known += 1
        return after

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """Where the groups of two whole sequences end, in tokens of a and b; Mismatch if they spell different bytes."""
        if self.known >= TRANSITIONS:
            self.clear()
        i = j = 0
        empty, step, ends, n = self.empty, self.step, [], len(a)
        try:
            while i < n:
                token = a[i]
                i += 1
                state = empty.after.get(token) or step(empty, token)
                while state is not empty:
                    if state.b_leads:
                        token = a[i]
                        i += 1
                    else:
                        token = b[j]
                        j += 1
                    state = state.after.get(token) or step(state, token)
                ends.append((i, j))
        except IndexError:
            raise Mismatch from None
        if j < len(b):
            raise Mismatch
        return ends


class Stretch(NamedTuple):
    """Counts of tokens, the groups as text (`a1,a2|b1;a3|b2`), and their links."""

    n_a: int
    n_b: int
    text: str
    links: tuple[int, ...]


class Aligner:
    """Encodes texts by both vocabularies and groups the tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        own = ranks(a_path)
        self.merges = Merges(own)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        spelt = {i: bytes([int(x[3:5], 16)]) if self.pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)}
        plain = [x for i, x in enumerate(names) if not (self.pieces.is_byte(i) or self.pieces.is_control(i) or self.pieces.is_unknown(i))]
        self.transducer = Transducer({n: token for token, n in own.items()}, spelt)
        # Pieces that hold a space behind another sign, or a line end, would cross stretches: then texts stay whole.
        self.line = self.pieces.piece_to_id("<0x0A>")
        self.cut = self.pieces.is_byte(self.line) and not any("▁" in x.lstrip("▁") or "\n" in x for x in plain)
        joined = {y for x in plain for p, y in zip(x, x[1:]) if regex.match(r"\p{L}", p)}
        self.pattern = stretch_pattern("".join(c for c in SIGNS if c not in joined))
        self.late: dict[str, Stretch] = {}
        self.before: dict[str, Stretch] = {}

    def a_ids(self, text: str) -> list[int]:
        return self.merges.ids(text) if len(text) <= LONG else np.frombuffer(self.merges.packed(text), "<u4").tolist()

    def b_ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of stretches, in one call: they are lines of one text, for nothing is joined to a line end."""
        line = self.line
        if not self.cut:
            return self.pieces.encode([p[1:] for p in parts], num_threads=1)
        # A line end within a stretch would be taken for one between two: those are called one by one, behind a line end of their own.
        own = [p for p in parts if "\n" not in p]
        ids, found = self.pieces.encode("\n" + "\n".join(own) + "\n") if own else [], {}
        at = ids.index(line) + 1 if own else 0
        for p in own:
            end = ids.index(line, at)
            found[p] = ids[at:end]
            at = end + 1
        return [found[p] if p in found else self.pieces.encode("\n" + p)[2:] for p in parts]

    def stretch(self, a: list[int], b: list[int]) -> Stretch:
        texts, links, i, j = [], [], 0, 0
        for m, n in self.transducer.groups(a, b):
            x, y = a[m - 1], b[n - 1]
            links.append(x << B_BITS | y)
            texts.append(f"{x}|{y}" if m - i == 1 == n - j else f"{','.join(map(str, a[i:m]))}|{','.join(map(str, b[j:n]))}")
            i, j = m, n
        return Stretch(len(a), len(b), ";".join(texts), tuple(links))

    def stretches(self, text: str | None) -> tuple[list[str], dict[str, Stretch]]:
        """A text's stretches in order, and what each comes to; none for a text without tokens."""
        if not text:
            return [], {}
        parts = self.pattern.findall(" " + text) if self.cut else [" " + text]
        if len(self.late) >= MEMO:
            self.late, self.before = {}, self.late
        late, before, found, unknown = self.late, self.before, {}, []
        for p in set(parts):
            known = late.get(p)
            if known is None and (known := before.get(p)) is not None:
                late[p] = known
            if known is None:
                unknown.append(p)
            else:
                found[p] = known
        try:
            for p, b in zip(unknown, self.b_ids(unknown), strict=True):
                found[p] = known = self.stretch(self.a_ids(p), b)
                if len(p) <= SHORT:
                    late[p] = known
        except Mismatch:
            return [], {}
        return parts, found


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public("byte_bpe_50k.json"), b_path or public("piece_bpe_32k.model")


def aligned(df: DataFrame, text_col: str = "text", out: str = "alignment", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """df with a struct: a and b (token ids), a_sizes and b_sizes (tokens of each group, in order).

    a_path: a byte-level JSON vocabulary or a file of ranks, which reads the
    text behind a space; b_path: a sentencepiece model that puts that space
    itself; both on every machine. Null and empty texts, and texts which the
    model does not spell as they are (those with U+2581), have empty arrays.
    Repeated rows stay; an empty table gives an empty one; a column of df named
    like `out` gives way.
    """
    paths = _paths(a_path, b_path)
    small_batches(df.sparkSession)
    kind = pa.struct([(c, pa.list_(pa.int32())) for c in ("a", "b", "a_sizes", "b_sizes")])

    @F.arrow_udf("struct<a:array<int>,b:array<int>,a_sizes:array<int>,b_sizes:array<int>>")
    def align(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = aligner(*paths)
        for texts in batches:
            yield pa.array([groups(*own.stretches(t.as_py())) for t in texts], kind)

    def groups(parts: list[str], known: dict[str, Stretch]) -> dict[str, list[int]]:
        found = {"a": [], "b": [], "a_sizes": [], "b_sizes": []}
        for group in chain.from_iterable(known[p].text.split(";") for p in parts):
            for side, ids in zip("ab", group.split("|"), strict=True):
                own = list(map(int, ids.split(",")))
                found[side] += own
                found[f"{side}_sizes"].append(len(own))
        return found

    return df.withColumn(out, align(F.col(text_col)))


def text_links(df: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """df without text_col, with n_a, n_b, n_groups, groups_sha256, links and times: the text's different links and how often it has them.

    A link joins tokens of both sides that end at one byte: the last ones of a
    group, for no token is empty. It is A's id shifted by B_BITS, and B's. The
    digest is that of `a1,a2|b1;a3|b2`, the groups' ids in order; texts without
    tokens have zeros, '' and no links.
    """
    paths = _paths(a_path, b_path)
    small_batches(df.sparkSession)
    kinds = {"n_a": "long", "n_b": "long", "n_groups": "long", "groups_sha256": "string", "links": "array<long>", "times": "array<int>"}
    arrow = dict(zip(kinds, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True))

    @F.arrow_udf(f"struct<{','.join(f'{c}:{k}' for c, k in kinds.items())}>")
    def link(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = aligner(*paths)
        for texts in batches:
            rows = []
            for t in texts:
                parts, known = own.stretches(t.as_py())
                n_a = n_b = 0
                links: Counter[int] = Counter()
                for p, times in Counter(parts).items():
                    x = known[p]
                    n_a += times * x.n_a
                    n_b += times * x.n_b
                    for i in x.links:
                        links[i] += times
                shown = {p: x.text for p, x in known.items()}
                digest = sha256(";".join(map(shown.__getitem__, parts)).encode()).hexdigest() if parts else ""
                rows.append((n_a, n_b, links.total(), digest, list(links.keys()), list(links.values())))
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, arrow.values(), strict=True)], list(kinds))

    held = df.withColumn("_linked", link(F.col(text_col))).drop(text_col)
    return held.select(*(c for c in held.columns if c != "_linked"), "_linked.*")


def link_counts(linked: DataFrame) -> DataFrame:
    """(link, n, best): how often a corpus has each link; best: no link of the same B id is more frequent.

    linked: rows of text_links.
    """
    each = linked.select(F.inline(F.arrays_zip("links", "times")).alias("link", "times"))
    counted = staged(each.groupBy("link").agg(F.sum(F.col("times").cast("long")).alias("n")), "links")
    of_b = F.col("link").bitwiseAND(F.lit((1 << B_BITS) - 1))
    highest = counted.groupBy(of_b.alias("_b")).agg(F.max("n").alias("_most"))
    return counted.join(highest, of_b == F.col("_b")).select("link", "n", (F.col("n") == F.col("_most")).alias("best"))


def link_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per row of docs: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best: links of the text that no link of the same B id outnumbers in the
    corpus; count_sum: the corpus' counts of all its links. Null and empty texts
    and those the sides spell differently have zeros and ''; they add nothing to
    the corpus. Null and repeated ids stay as they are, repeated rows count each
    time; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = text_links(rows, "_text", a_path, b_path).withColumn("_row", F.monotonically_increasing_id())
    found = staged(found, "text-links")
    counts = staged(link_counts(found), "link-counts")
    plain = ("_row", "_id", "n_a", "n_b", "n_groups", "groups_sha256")
    each = found.select(*plain, F.inline_outer(F.arrays_zip("links", "times")).alias("link", "times"))
    # No more links than suffixes of tokens of the two vocabularies.
    met = each.join(F.broadcast(counts), "link", "left")
    times = F.col("times").cast("long")
    sums = met.groupBy(*plain).agg(
        F.coalesce(F.sum(F.when(F.col("best"), times)), F.lit(0)).alias("n_best"), F.coalesce(F.sum(times * F.col("n")), F.lit(0)).alias("count_sum"),
    )
    return sums.select(
        F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256"
    )
