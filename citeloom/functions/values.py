"""Times, ids, hashes and maps as column functions."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def iso_time(c: Column) -> Column:
    """DAT02: an ISO time, Z included, as a timestamp; null for anything else."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))


def iso_text(c: Column) -> Column:
    """DAT01: a time as ISO text in UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def seconds_between(a: Column, b: Column) -> Column:
    """DAT03: seconds from ``a`` to ``b``, with their fraction."""
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def group_id(name: Column) -> Column:
    """HSH02: the hash of a group's name."""
    return F.sha2(name, 256)


def stable_id(*parts: Column) -> Column:
    """HSH03: an id made from what it names, the same in every run; nulls and empty texts differ."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def counts_map(values: Column) -> Column:
    """MAP01: how often each distinct value of an array occurs, nulls left out."""
    kept = F.filter(values, lambda v: v.isNotNull())
    keys = F.array_sort(F.array_distinct(kept))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(kept, lambda v: v == k))))


def map_value(m: Column, key: str, default: object) -> Column:
    """MAP01: a map's value or a default."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def plain_numbers(df: DataFrame) -> DataFrame:
    """JSN09: NaN and infinities as nulls, so that rows can go into JSON."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return df.select(*[finite(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema])


def backoff(attempt: int, base: float = 1.0, most: float = 60.0, jitter: float = 0.1, rng: random.Random | None = None) -> float:
    """MTH11: seconds to wait before an attempt (from 0): doubled each time up to ``most``, and up to a tenth more."""
    wait = min(base * 2**attempt, most)
    return wait + (rng or random).random() * jitter * wait
