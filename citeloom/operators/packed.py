"""Several values packed in one field.

A parsing expression grammar; alternatives are tried in order, the first that
fits is taken, and a quoted value that doesn't end before a delimiter is undone
and read again as a bare one::

    field   <- list / items
    list    <- ws '[' items ']' ws end
    items   <- item (delim item)*
    item    <- ws (quoted / bare) ws
    quoted  <- open (close close / !close any)* close &(ws (delim / end))
    bare    <- (whole / bracketed / !delim any)*
    bracketed <- '(' (bracketed / !')' any)* ')'      also [] and {}
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Opening quotes with their closing ones, opening brackets with their closing ones.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“"}
BRACKETS = {"(": ")", "[": "]", "{": "}"}
# Delimiters of free lists, and of identifiers without inner blanks.
LIST_DELIMITER = r"[;,|\n\t\r•；，、]"
ID_DELIMITER = r"[;,|\n\t\r•；，、]|(?:\s/\s)|(?:\s+and\s+)|(?:\s+&\s+)|\s+"
# An iD typed in groups with a blank between them.
SPACED_ID = r"(?<![0-9A-Za-z‐-―-])\d{4} \d{4} \d{4} \d{3}[\dXx](?![0-9A-Za-z‐-―-])"

OK, UNCLOSED_QUOTE, UNCLOSED_BRACKET, BLANK = "", "unclosed_quote", "unclosed_bracket", "blank"
_BRACKET = re.compile(r"[()\[\]{}]")
SCHEMA = "row_key string, pos int, value string, error string"


@dataclass(frozen=True)
class Item:
    """A value as read: ``error`` says what was wrong, empty if nothing."""

    value: str
    error: str


class PackedGrammar:
    """The grammar above with given delimiters. ``opens_list``: whether brackets round the whole field are a list's; ``whole``: what no delimiter inside it cuts."""

    def __init__(self, delimiter: str = LIST_DELIMITER, opens_list: bool = False, whole: str = ""):
        self.delimiter = re.compile(delimiter)
        self.opens_list = opens_list
        self.bare_end = re.compile((f"(?P<whole>{whole})|" if whole else "") + rf"(?:{delimiter})|[()\[\]{{}}]")

    def parse(self, text: str) -> list[Item]:
        """Every item in order, blank ones too; never fails. Time grows with the length of the text."""
        inner = self._list(text) if self.opens_list else None
        return self._items(text if inner is None else inner)

    def _list(self, text: str) -> str | None:
        s = text.strip()
        return s[1:-1] if len(s) > 1 and s[0] == "[" and s[-1] == "]" else None

    def _items(self, s: str) -> list[Item]:
        out, i, n = [], 0, len(s)
        last = {close: s.rfind(close) for close in QUOTES.values()}  # beyond it no quote of that kind can end
        ends: dict[int, int | None] = {}  # where the bracket at a place closes, as far as that is known
        while True:
            i = self._blank(s, i)
            got = self._quoted(s, i, last)
            error = OK
            if got is None:
                if i < n and s[i] in QUOTES and s[i] != "'":
                    error = UNCLOSED_QUOTE
                value, i, bad = self._bare(s, i, ends)
                error = error or bad
            else:
                value, i = got
            value = value.strip()
            out.append(Item(value, error or (OK if value else BLANK)))
            m = self.delimiter.match(s, i)
            if not m:
                return out
            i = m.end() if m.end() > i else i + 1

    def _blank(self, s: str, i: int) -> int:
        """Past white space that is no delimiter."""
        while i < len(s) and s[i].isspace() and not self.delimiter.match(s, i):
            i += 1
        return i

    def _quoted(self, s: str, i: int, last: dict[str, int]) -> tuple[str, int] | None:
        if i >= len(s) or s[i] not in QUOTES:
            return None
        close = QUOTES[s[i]]
        parts, at = [], i + 1
        while True:
            end = s.find(close, at) if last[close] >= at else -1
            if end < 0:
                return None
            if s.startswith(close, end + 1):  # doubled: one quote
                parts.append(s[at : end + 1])
                at = end + 2
                continue
            after = end + 1
            while after < len(s) and s[after].isspace() and not self.delimiter.match(s, after):
                after += 1
            if after < len(s) and not self.delimiter.match(s, after):
                if close == "'" and s[end + 1].isalnum():  # an apostrophe inside the value
                    parts.append(s[at : end + 1])
                    at = end + 1
                    continue
                return None
            return "".join([*parts, s[at:end]]), after

    def _bare(self, s: str, i: int, ends: dict[int, int | None]) -> tuple[str, int, str]:
        start, error = i, OK
        while True:
            m = self.bare_end.search(s, i)
            if not m:
                return s[start:], len(s), error
            ch = m.group()
            if m.lastgroup == "whole":
                i = m.end()
            elif ch in BRACKETS:
                end = self._bracketed(s, m.start(), ends)
                if end is None:
                    error, i = UNCLOSED_BRACKET, m.start() + 1
                else:
                    i = end
            elif ch in BRACKETS.values():
                error, i = UNCLOSED_BRACKET, m.start() + 1
            else:
                return s[start : m.start()], m.start(), error

    def _bracketed(self, s: str, i: int, ends: dict[int, int | None]) -> int | None:
        """The end of the bracket that opens at ``i``; None if it is never closed.

        A scan that comes to the end of the text has seen all later brackets too;
        what it finds of them is kept in ``ends``, so a text is scanned twice at most.
        """
        if i in ends:
            return ends[i]
        stack = [(i, BRACKETS[s[i]])]
        for m in _BRACKET.finditer(s, i + 1):
            ch = m.group()
            if ch in BRACKETS:
                stack.append((m.start(), BRACKETS[ch]))
            elif any(ch == close for _, close in stack):  # inner brackets that were never closed end with the outer one
                at, close = stack.pop()
                while close != ch:
                    at, close = stack.pop()
                ends[at] = m.end()
                if not stack:
                    return m.end()
        ends |= {at: None for at, _ in stack}
        return None


_ORCID = re.compile(r"(?<![0-9A-Za-z])(\d{4})[-‐-― ]?(\d{4})[-‐-― ]?(\d{4})[-‐-― ]?(\d{3}[\dXx])(?![0-9A-Za-z])")


def orcid_value(text: str) -> str | None:
    """An iD as 0000-0000-0000-000X, whatever it is prefixed with; None if ``text`` holds none."""
    m = _ORCID.search(text)
    return "-".join(m.groups()).upper() if m else None


def orcid_values(text: str) -> list[str]:
    """Every iD in ``text``, in order."""
    return ["-".join(m.groups()).upper() for m in _ORCID.finditer(text)]


def split_packed(df: DataFrame, key: str, column: str, kind: str = "list") -> DataFrame:
    """One row per value of ``column``: ``row_key, pos, value, error``.

    ``pos`` counts the non-blank values from 1. ``kind`` is ``list`` (values as
    written) or ``orcid`` (every iD of a piece; one that holds none comes out with a
    null pos and the error ``no_id``). Null, empty and blank fields give no rows; a
    malformed quote or bracket is read as plain text and flagged in ``error``.
    Equal (key, text) rows are read once.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = PackedGrammar(ID_DELIMITER, opens_list=True, whole=SPACED_ID) if kind == "orcid" else PackedGrammar()
        schema = pa.schema([("row_key", pa.string()), ("pos", pa.int32()), ("value", pa.string()), ("error", pa.string())])
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pos = 0
                for item in grammar.parse(text):
                    if not item.value:
                        continue
                    values = orcid_values(item.value) if kind == "orcid" else [item.value]
                    if not values:
                        rows.append((k, None, item.value, "no_id"))
                    for value in values:
                        pos += 1
                        rows.append((k, pos, value, item.error))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    text = F.col(f"`{column}`").cast("string")
    rows = df.where(text.isNotNull() & (F.trim(text) != "")).select(F.col(f"`{key}`").cast("string").alias("row_key"), text.alias("text"))
    return rows.distinct().mapInArrow(parse, SCHEMA)
