"""String similarity: the two ratios that tables of names are compared by."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def indel_ratio_of(a: str | None, b: str | None) -> float:
    """STR28: 100 (1 - insertions and deletions / both lengths); 100 for two empty texts, 0 for null."""
    if a is None or b is None:
        return 0.0
    if not a and not b:
        return 100.0
    # longest common subsequence by bit rows (one machine word is enough for names; Python's ints have no bound)
    if len(a) < len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(b) - row.bit_count()
    return 200.0 * common / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def _indel(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio_of(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def _blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def indel_ratio(a: Column, b: Column) -> Column:
    """STR28 over columns."""
    return _indel(a, b)


def block_ratio(a: Column, b: Column) -> Column:
    """STR29 over columns: twice the matching blocks by both lengths; null counts as empty."""
    return _blocks(a, b)


def may_reach(a: Column, b: Column, ratio: float) -> Column:
    """A bound by lengths alone: false if the indel ratio can't reach ``ratio`` (0 to 100). In the JVM, before any Python."""
    la, lb = F.length(a), F.length(b)
    return F.least(la, lb) * 200.0 >= F.lit(ratio) * (la + lb)
