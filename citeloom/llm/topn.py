"""Top N items within every group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.sources.session import materialise


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, heavy_share: float = 0.001, salts: int = 64, salt_by: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group by ``order``.

    Exact group counts split the groups. Light ones go through an ordinary window.
    Heavy ones (more than ``n`` rows and at least ``heavy_share`` of all rows, at
    every size of the table) are range-sorted in salted pieces, each of which keeps
    its first ``n``, and the pieces' survivors are ranked again; no task ever holds
    a whole heavy group. At most 1 / ``heavy_share`` groups can be heavy, so the
    list of them that is broadcast has a proven bound. ``df`` is read once for the
    counts and once or twice after: give a table that is cheap to read.

    ``order`` must settle every tie (give a unique last column); equal rows are
    then copies and are all kept up to ``n``. Null group values form a group of
    their own. An empty table gives an empty result. ``salt_by`` names the column
    whose hash salts; by default all columns. A column ``rank`` of ``df`` is replaced.
    """
    df = df.drop("rank")
    if n < 1:
        return df.limit(0).withColumn("rank", F.lit(0))
    name = "__topn_n"
    counts = materialise(df.groupBy(*group).agg(F.count(F.lit(1)).alias(name)), "group-counts")
    total = counts.agg(F.sum(name).alias("n")).first()["n"] or 0
    least = max(n + 1, math.ceil(total * heavy_share))
    heavy = counts.where(F.col(name) >= least).select(*[F.col(g).alias(f"__topn_h_{g}") for g in group])
    w = Window.partitionBy(*group).orderBy(*order)
    if heavy.isEmpty():
        return df.withColumn("__topn_rank", F.row_number().over(w)).where(F.col("__topn_rank") <= n).withColumnRenamed("__topn_rank", "rank")

    def same() -> Column:
        c = F.lit(True)
        for g in group:
            c = c & F.col(g).eqNullSafe(F.col(f"__topn_h_{g}"))
        return c

    hot = df.join(F.broadcast(heavy), same(), "left_semi")
    cold = df.join(F.broadcast(heavy), same(), "left_anti")
    light = cold.withColumn("__topn_rank", F.row_number().over(w)).where(F.col("__topn_rank") <= n)

    salt = F.pmod(F.xxhash64(F.col(salt_by) if salt_by else F.struct(*df.columns)), F.lit(salts))
    pieces = hot.withColumn("__topn_salt", salt).repartitionByRange(*[F.col(g) for g in group], F.col("__topn_salt"))
    ws = Window.partitionBy(*group, "__topn_salt").orderBy(*order)
    kept = pieces.withColumn("__topn_rank", F.row_number().over(ws)).where(F.col("__topn_rank") <= n).drop("__topn_rank", "__topn_salt")
    ranked = kept.withColumn("__topn_rank", F.row_number().over(w)).where(F.col("__topn_rank") <= n)
    return light.unionByName(ranked).withColumnRenamed("__topn_rank", "rank")
