"""Valid versions of keyed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest_version(df: DataFrame, key: Column, version: Column, keep: list[str]) -> DataFrame:
    """One row per ``key``: the one with the greatest ``version``.

    An aggregate, not a window: versions of a key are combined before the
    shuffle, so a key that holds a third of all rows is no hot task. Null
    versions rank lowest, equal versions are settled by a hash of the row (equal
    rows are one). Null keys are dropped. Result: ``_key`` and the columns of
    ``keep``. An empty table gives an empty result.
    """
    # maps can't be hashed; none of the tables has them, but callers' tables may
    hashed = [F.to_json(c) if isinstance(df.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in keep]
    rows = df.select(key.alias("_key"), version.alias("_version"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.xxhash64(*hashed).alias("_tie"))
    rows = rows.where(F.col("_key").isNotNull())
    best = rows.groupBy("_key").agg(F.max_by("_row", F.struct(F.coalesce(F.col("_version").cast("timestamp"), F.timestamp_seconds(F.lit(-62135596800))).alias("v"), "_tie")).alias("_row"))
    return best.select("_key", *[F.col("_row").getField(c).alias(c) for c in keep])
