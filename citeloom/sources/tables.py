"""Table readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale folder. ``timestamp_ntz`` columns stay as they are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim_space(c: Column) -> Column:
    """Trim Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_key(c: Column) -> Column:
    """A key without surrounding white space, in lower case; null where blank."""
    k = F.lower(trim_space(c))
    return F.when(k != "", k)
