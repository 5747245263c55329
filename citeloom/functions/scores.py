"""Scores and classes as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of relationships by words in a join's type, in this order.
RELATIONS = [("merge", "merge"), ("fusion", "fusion"), ("join", "join"), ("link", "linkage"), ("integration", "integration"), ("concat", "concatenation"), ("aggregat", "aggregation"), ("transform", "transformation")]
# What a challenge adds by its severity.
SEVERITY = {"critical": 2.0, "high": 1.5, "medium": 1.0}
# Words that triage counts.
ANALYSIS_WORDS = ["statistical analysis", "regression", "correlation", "significance", "p-value", "confidence interval", "hypothesis test", "anova", "chi-square", "t-test", "modeling", "predictive", "classification", "clustering", "machine learning", "data mining", "visualization"]
DATASET_WORDS = ["dataset", "data set", "database", "survey data", "cohort", "sample size", "participants", "observations", "records"]
METHOD_WORDS = ["methodology", "approach", "algorithm", "procedure", "technique", "framework", "model", "analysis"]
NUMBER = r"\d+\.?\d*\s*[%]?"
STATISTICS = [r"p\s*[<>=]\s*0\.\d+", r"r\s*=\s*0\.\d+", r"β\s*=\s*\d+\.?\d*", r"\(.*\d+.*\)"]


def bounded(score: Column, low: float = 0.0, high: float = 10.0) -> Column:
    return F.least(F.greatest(score, F.lit(low)), F.lit(high))


def relation(join_type: Column) -> Column:
    """STR26: the class of the first word that occurs; ``other`` if none, also for null."""
    c = F.lit("other")
    for word, name in reversed(RELATIONS):
        c = F.when(F.contains(F.lower(join_type), F.lit(word)), name).otherwise(c)
    return c


def one_of(value: Column, allowed: list[str], otherwise: str = "other") -> Column:
    """STR27: the value in lower case if it is allowed."""
    return F.coalesce(F.when(F.lower(value).isin(*allowed), F.lower(value)), F.lit(otherwise))


def strength(confidence: Column) -> Column:
    """MTH01."""
    return F.when(confidence >= 9, "very_strong").when(confidence >= 7, "strong").when(confidence >= 5, "moderate").otherwise("weak")


def complexity(confidence: Column, severities: Column, data_loss: Column) -> Column:
    """MTH02: from lacking confidence, the severities (array) and the share of lost data ('12%')."""
    weights = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    from_challenges = F.aggregate(F.coalesce(severities, F.array().cast("array<string>")), F.lit(0.0), lambda a, s: a + F.coalesce(F.try_element_at(weights, s), F.lit(0.5)))
    loss = F.replace(data_loss, F.lit("%"), F.lit("")).try_cast("double")
    total = (10 - confidence) * 0.3 + from_challenges + F.when(loss > 10, 1.0).when(loss > 5, 0.5).otherwise(0.0)
    return F.when(total >= 6, "critical").when(total >= 4, "high").when(total >= 2, "medium").otherwise("low")


def evidence_confidence(use: Column, mention: Column) -> Column:
    """MTH03: the greater of both; null only if both are."""
    return F.greatest(use, mention)


def triage_adjusted(base: Column, analysis: Column, statistics: Column, both_sections: Column, indicators: Column) -> Column:
    """MTH04, within 0 and 10, to two decimals."""
    add = F.when(analysis >= 3, 0.5).otherwise(0.0) + F.when(statistics >= 2, 0.5).otherwise(0.0) + F.when(both_sections, 0.3).otherwise(0.0) - F.when(indicators < 2, 1.0).otherwise(0.0)
    return F.bround(bounded(base + add), 2)


def alignment_score(matches: Column, model: Column | None = None) -> Column:
    """MTH09: 0.8 a distinct match, 10 at most; halved with the model's where there is one."""
    own = F.least(F.lit(10.0), matches * 0.8)
    return F.bround(own if model is None else F.when(model.isNotNull(), F.least(F.lit(10.0), own * 0.5 + model * 0.5)).otherwise(own), 2)


def progress(completed: Column, steps: int = 7) -> Column:
    """MTH10: per cent of the steps."""
    return completed / F.lit(float(steps)) * 100
