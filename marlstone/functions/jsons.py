"""JSON texts: quoting, and mending of broken ones in one pass."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """A text as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


#: What stands for a value without quotes, and quotes that open a text with those that close it.
WORDS = {"true": "true", "True": "true", "TRUE": "true", "false": "false", "False": "false", "FALSE": "false", "null": "null", "None": "null", "NULL": "null", "undefined": "null", "NaN": "null"}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
SOUND = re.compile(r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"(?=\s*(?:[,:}\]]|\Z|/[/*]|\"\w[\w .-]{0,80}\"\s*:))')
NAME = re.compile(r"[\"'“‘`]\w[\w .-]{0,80}[\"'”’`]\s*[:=]")
SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|#[^\n]*)+", re.S)
WORD = re.compile(r"(?:(?!//|/\*)[^\s,:{}\[\]\"#])+")
BARE = re.compile(rf"{WORD.pattern}(?:[ \t]+{WORD.pattern})*")
KEY = re.compile(r"[^\s,:={}\[\]\"]+(?:[ \t]+[^\s,:={}\[\]\"]+)*")
FENCE = re.compile(r"```(?:json)?\s*(.*?)(?:```|\Z)", re.S | re.I)
ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


class _Mender:
    """Reads a text from an opening bracket on and writes sound JSON; a stack of open brackets is all it remembers."""

    def __init__(self, text: str, at: int):
        self.text, self.at, self.out, self.open = text, at, [], []

    def run(self) -> str:
        # What is looked for next: a value, a key or its colon, or (after a value) a comma or a bracket.
        want = "value"
        while True:
            if (m := SKIP.match(self.text, self.at)) is not None:
                self.at = m.end()
            if self.at >= len(self.text):
                break
            sign = self.text[self.at]
            if sign in "}]":
                self.at += 1
                if self._close(sign, want):
                    want = "comma"
                    if not self.open:
                        return "".join(self.out)
            elif sign == ",":
                self.at += 1
                if want == "set":
                    self.out.append("null")
                    want = "comma"
                if want == "comma":
                    want = "key" if self.open[-1] == "{" else "value"
            elif want == "colon" and sign in ":=":
                self.at += 1
                want = "set"
            elif sign == ":":
                self.at += 1
            elif want in ("key", "comma") and self.open[-1] == "{":
                if sign in "{[":
                    # A value without a name: it has no place in an object.
                    self.at += 1
                    continue
                self._part()
                self.out.append(self._text(key=True) + ":")
                want = "colon"
            else:
                if want == "colon":
                    want = "set"
                if want != "set":
                    self._part()
                want = self._value(sign)
        if want in ("colon", "set"):
            self.out.append("null")
        while self.open:
            self.out.append("}" if self.open.pop() == "{" else "]")
        return "".join(self.out)

    def _part(self) -> None:
        """A comma, unless what is next is the first of its bracket."""
        if self.out and self.out[-1] not in ("{", "["):
            self.out.append(",")

    def _value(self, sign: str) -> str:
        if sign in "{[":
            self.at += 1
            self.open.append(sign)
            self.out.append(sign)
            return "key" if sign == "{" else "value"
        self.out.append(self._text(key=False))
        return "comma"

    def _close(self, sign: str, want: str) -> bool:
        own = "{" if sign == "}" else "["
        if own not in self.open:
            return False
        if want in ("colon", "set"):
            self.out.append("null")
        while True:
            last = self.open.pop()
            self.out.append("}" if last == "{" else "]")
            if last == own:
                return True

    def _text(self, key: bool) -> str:
        text, at = self.text, self.at
        if text[at] == '"' and (m := SOUND.match(text, at)):
            self.at = m.end()
            return m.group()
        if text[at] in QUOTES:
            return self._quoted(QUOTES[text[at]], key)
        first = None if key else WORD.match(text, at)
        if first and (first.group() in WORDS or NUMBER.fullmatch(first.group())):
            self.at = first.end()
            return WORDS.get(first.group(), first.group())
        m = (KEY if key else BARE).match(text, at)
        self.at = m.end() if m else at + 1
        return json.dumps(m.group().strip("'`’”") if m else "", ensure_ascii=False)

    def _quoted(self, closing: str, key: bool) -> str:
        """A text in any quotes; a closing quote counts where something that may follow a text comes next."""
        text, at, out = self.text, self.at + 1, ['"']
        while at < len(text):
            sign = text[at]
            if sign == "\\" and at + 1 < len(text):
                after = text[at + 1]
                good = after in '"\\/bfnrt' or after == "u" and re.match(r"[0-9a-fA-F]{4}", text[at + 2 : at + 6])
                out.append(sign + after if good else after if after in "'`" else "\\\\" + ESCAPES.get(after, after))
                at += 2
                continue
            if sign == closing and self._ends(at + 1, key):
                at += 1
                break
            out.append("\\" + sign if sign in '"\\' else ESCAPES.get(sign) or (f"\\u{ord(sign):04x}" if sign < " " else sign))
            at += 1
        self.at = at
        return "".join(out) + '"'

    def _ends(self, at: int, key: bool) -> bool:
        m = SKIP.match(self.text, at)
        after = m.end() if m else at
        if after >= len(self.text) or self.text[after] in (":=" if key else ",}]"):
            return True
        # A comma may be missing: in front of a name, or between the texts of a list.
        if key or self.text[after] not in QUOTES:
            return False
        return after > at if self.open[-1] == "[" else NAME.match(self.text, after) is not None


def mended(text: str | None) -> str | None:
    """The JSON of a reply: sound JSON as it is, else the first object or list in it (that of a fence first), mended.

    Put right: text around it, brackets not closed or closed wrongly, names and
    words without quotes, other quotes, quotes and line ends inside texts,
    commas missing or too many, comments, missing values (null), True, None and
    the like. Null, and a text without a bracket, give null. Linear in the text.
    """
    if text is None:
        return None
    fence = FENCE.search(text)
    for part in (text, fence.group(1) if fence else None):
        if part is not None:
            try:
                json.loads(part)
                return part
            except (ValueError, RecursionError):
                pass
    body = fence.group(1) if fence and re.search(r"[{\[]", fence.group(1)) else text
    at = re.search(r"[{\[]", body)
    return _Mender(body, at.start()).run() if at else None


def json_mended(c: Column) -> Column:
    """mended() for a column: only texts that Spark's parser refuses are sent to Python."""

    @F.arrow_udf("string")
    def mend(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([mended(t.as_py()) for t in texts], pa.string())

    sound = F.try_parse_json(c).isNotNull()
    return F.coalesce(F.when(sound, c), mend(F.when(~sound, c)))
