"""Relationships between datasets that publications join, and greedy de-duplication of discoveries."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import scores


def well_formed(joins: DataFrame, least: float = 0.0) -> DataFrame:
    """FIL08, FIL09: both names there and different, confidence at least ``least``."""
    a, b = F.trim("dataset1"), F.trim("dataset2")
    return joins.where((a != "") & (b != "") & (a != b) & (F.col("confidence_score") >= least))


def distinct_pairs(joins: DataFrame, key: str = "publication_id") -> DataFrame:
    """DED07, SRT08: of each unordered pair of a publication, regardless of case, the most confident join, then the one with the least id."""
    pair = F.array_sort(F.array(F.lower(F.trim("dataset1")), F.lower(F.trim("dataset2"))))
    cols = joins.columns
    best = joins.groupBy(F.col(key).alias("_key"), pair.alias("_pair")).agg(F.min_by(F.struct(*cols), F.struct((-F.coalesce("confidence_score", F.lit(0.0))).alias("c"), "join_id")).alias("j"))
    return best.select("j.*")


def relationships(joins: DataFrame, severities: Column | None = None, data_loss: Column | None = None) -> DataFrame:
    """PRJ28, MTH01, MTH02, STR26: joins as relationships, with class, strength, complexity and a key made from what they join."""
    none = F.array().cast("array<string>")
    c = F.coalesce("confidence_score", F.lit(0.0))
    ident = F.sha2(F.concat_ws("|", "publication_id", F.lower(F.trim("dataset1")), F.lower(F.trim("dataset2"))), 256)
    return joins.select(
        ident.alias("relationship_id"), "publication_id", F.trim("dataset1").alias("source"), F.trim("dataset2").alias("target"), scores.relation(F.coalesce("join_type", F.lit(""))).alias("relationship_type"),
        c.alias("confidence"), scores.strength(c).alias("strength"), scores.complexity(c, none if severities is None else severities, F.lit("0%") if data_loss is None else data_loss).alias("complexity"),
        F.coalesce("join_keys", none).alias("join_keys"), F.col("methodology"),
    )


def issues(rel: DataFrame) -> DataFrame:
    """DQC12: relationships with what is wrong with them; sound ones have an empty list."""
    found = F.array_compact(F.array(
        F.when(F.coalesce(F.col("source"), F.lit("")) == "", "no source"), F.when(F.coalesce(F.col("target"), F.lit("")) == "", "no target"),
        F.when(~F.col("confidence").between(0, 10), "confidence out of range"), F.when(F.lower("source") == F.lower("target"), "joins itself")))
    return rel.withColumn("issues", found)


def statistics(rel: DataFrame) -> DataFrame:
    """AGG14, FIL22: counts by type, by complexity, and in all with the mean confidence (0.0 for none)."""
    sets = rel.groupingSets([["relationship_type"], ["complexity"], []], "relationship_type", "complexity").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean"), F.grouping("relationship_type").alias("_t"), F.grouping("complexity").alias("_c"))
    by = F.when(F.col("_t") == 0, "type").when(F.col("_c") == 0, "complexity").otherwise("total")
    rows = sets.select(by.alias("by"), F.coalesce(F.when(F.col("_t") == 0, F.col("relationship_type")), F.when(F.col("_c") == 0, F.col("complexity"))).alias("value"), "n", F.round("mean", 6).alias("mean_confidence"))
    none = rel.sparkSession.createDataFrame([("total", None, 0, 0.0)], "by string, value string, n long, mean_confidence double")
    return rows.unionByName(none).groupBy("by", "value").agg(F.sum("n").alias("n"), F.max("mean_confidence").alias("mean_confidence"))


def keep_greedily(names: list[str], ratio: float = 0.8) -> list[bool]:
    """DED08, WIN05 for names in order: dropped if one holds the other or their block ratio with one kept is above ``ratio``."""
    kept: list[str] = []
    out = []
    for n in names:
        low = (n or "").lower()
        m = difflib.SequenceMatcher(None, b=low)
        ok = True
        for k in kept:
            if k in low or low in k:
                ok = False
                break
            m.set_seq1(k)
            if m.real_quick_ratio() > ratio and m.quick_ratio() > ratio and m.ratio() > ratio:
                ok = False
                break
        if ok:
            kept.append(low)
        out.append(ok)
    return out


def distinct_discoveries(found: DataFrame, key: str = "publication_id", name: str = "name", confidence: str = "confidence") -> DataFrame:
    """DED08: per publication, discoveries by confidence, then name, without those like one kept before.

    What is kept depends on what was kept before, so a publication's discoveries are
    gone through in one place; equal names are one before that, which bounds a group
    by the distinct names of one publication.
    """
    one = found.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.max(confidence).alias(confidence))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([confidence, name], ascending=[False, True], kind="stable")
        return pdf[keep_greedily(pdf[name].tolist())]

    return one.groupBy(key).applyInPandas(greedy, one.schema)
