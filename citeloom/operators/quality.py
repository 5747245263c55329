"""Rules on analyses: issues as rows of an array, scores from them.

A rule is a condition with a type, a severity and a message; all rules of a record
are one array column, so a table is gone through once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.analyses import DATASETS, LINK, REPO, SNIPPET, opened

ISSUE = "array<struct<type:string,severity:string,field:string>>"
# What an issue costs by its severity, where each section's completeness counts, and cuts of the level.
CONSISTENCY_COST = {"critical": 20.0, "error": 10.0, "warning": 5.0, "info": 1.0}
LOGICAL_COST = {"critical": 25.0, "error": 15.0, "warning": 8.0, "info": 2.0}
SECTION_WEIGHT = {"publication": 0.25, "dataset": 0.25, "code": 0.20, "link": 0.15, "workflow": 0.15}
LEVELS = [(90, "excellent"), (75, "good"), (50, "fair")]


def rule(bad: Column, kind: str, severity: str, field: str) -> Column:
    """An issue where ``bad`` is true; null otherwise, also for a null condition."""
    return F.when(bad, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))


def collected(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def completeness_issues() -> Column:
    """DQC03, DQC04, DQC14: what an analysis lacks."""
    m, d = F.col("publication_metadata"), F.col("_d")
    none = (F.coalesce(F.size(d["validated_datasets"]), F.lit(0)) <= 0) & (F.coalesce(F.size(d["newly_discovered_datasets"]), F.lit(0)) <= 0)
    return collected(
        rule(blank(F.col("publication_id")), "missing_field", "critical", "publication_id"), rule(blank(F.col("workflow_id")), "missing_field", "critical", "workflow_id"),
        rule(blank(F.col("analysis_timestamp")), "missing_field", "critical", "analysis_timestamp"), rule(m.isNull(), "missing_field", "critical", "publication_metadata"),
        rule(blank(F.col("dataset_analysis")), "missing_field", "critical", "dataset_analysis"), rule(blank(m["title"]), "missing_field", "warning", "title"),
        rule(F.coalesce(F.size(m["authors"]), F.lit(0)) <= 0, "missing_field", "warning", "authors"), rule(none, "no_datasets", "info", "dataset_analysis"),
    )


def consistency_issues() -> Column:
    """DQC02, DQC05: parts that contradict each other."""
    d = F.col("_d")
    total = F.get_json_object("_plain", "$.summary.total_validated_datasets").try_cast("int")
    return collected(
        rule(F.col("publication_id") != F.col("publication_metadata.publication_id"), "publication_mismatch", "error", "publication_id"),
        rule((total != F.size(d["validated_datasets"])) & (F.size(d["validated_datasets"]) >= 0), "dataset_count_mismatch", "warning", "summary"),
        rule((F.col("workflow_status") == "completed") & F.col("dataset_analysis").isNull(), "inconsistent_workflow_status", "error", "workflow_status"),
    )


def logical_issues() -> Column:
    """DQC01, DQC06: values that can't be."""
    d = F.col("_d")
    out = lambda c: F.coalesce(F.exists(c, lambda x: ~x["confidence"].between(0.0, 1.0)), F.lit(False))
    itself = F.coalesce(F.exists(d["dataset_joins"], lambda j: F.lower(F.trim(j["dataset1"])) == F.lower(F.trim(j["dataset2"]))), F.lit(False))
    return collected(
        rule(out(d["validated_datasets"]), "logical_range", "error", "validated_datasets"), rule(out(d["newly_discovered_datasets"]), "logical_range", "error", "newly_discovered_datasets"),
        rule(itself, "logical_inconsistency", "warning", "dataset_joins"), rule(~F.col("workflow_status").isin("pending", "in_progress", "completed", "failed"), "unknown_status", "error", "workflow_status"),
        rule(F.col("analysis_timestamp").isNotNull() & F.try_to_timestamp(F.replace("analysis_timestamp", F.lit("Z"), F.lit("+00:00"))).isNull(), "bad_timestamp", "error", "analysis_timestamp"),
    )


def snippet_issues(snippets: Column) -> Column:
    """DQC07, DQC10: of an array of snippets ``content, language, relevance_score``."""
    per = F.transform(snippets, lambda s: F.array_compact(F.array(
        rule(F.length(F.trim(F.coalesce(s["content"], F.lit("")))) < 10, "short_code", "warning", "content"), rule(blank(s["language"]), "missing_language", "warning", "language"),
        rule(~s["relevance_score"].between(0, 10), "score_range", "error", "relevance_score"))))
    return F.coalesce(F.flatten(per), F.array().cast(ISSUE))


def link_issues(links: Column, repos: Column) -> Column:
    """DQC08, DQC11: of arrays of links ``url, relevance_score`` and repositories ``url, owner, repository``."""
    a = F.transform(links, lambda x: F.array_compact(F.array(rule(~F.coalesce(x["url"].rlike("^https?://"), F.lit(False)), "bad_url", "error", "url"), rule(~x["relevance_score"].between(0, 10), "score_range", "error", "relevance_score"))))
    b = F.transform(repos, lambda x: F.array_compact(F.array(rule(~F.coalesce(F.contains(x["url"], F.lit("github.com")), F.lit(False)), "bad_repository", "error", "url"), rule(blank(x["owner"]) | blank(x["repository"]), "missing_field", "warning", "owner"))))
    none = F.array().cast(ISSUE)
    return F.concat(F.coalesce(F.flatten(a), none), F.coalesce(F.flatten(b), none))


def reference_issues(analyses: DataFrame, catalogue: DataFrame) -> DataFrame:
    """JOI23: ``analysis_id, name`` of validated datasets that the catalogue's names lack."""
    d = F.col("_d")
    names = opened(analyses).select("analysis_id", F.explode(F.transform(d["validated_datasets"], lambda x: x["name"])).alias("name")).where("name is not null").distinct()
    known = catalogue.select(F.lower("dataset_name").alias("known")).distinct()
    return names.join(known, F.lower("name") == F.col("known"), "left_anti")


def score(issues: Column, costs: dict[str, float], words: list[str]) -> Column:
    """MTH06, MTH07: 100 less the cost of issues whose type has one of ``words``, 0 at least."""
    table = F.create_map(*[F.lit(x) for kv in costs.items() for x in kv])
    lost = F.aggregate(F.filter(issues, lambda i: i["type"].rlike("|".join(words))), F.lit(0.0), lambda a, i: a + F.coalesce(F.try_element_at(table, i["severity"]), F.lit(0.0)))
    return F.greatest(F.lit(0.0), 100.0 - lost)


def filled(fields: list[Column]) -> Column:
    """The per cent of fields that hold something."""
    n = F.lit(0)
    for f in fields:
        n = n + F.when(f.isNotNull() & (f.cast("string") != ""), 1).otherwise(0)
    return n * 100.0 / len(fields)


def completeness(sections: dict[str, Column]) -> Column:
    """MTH05: the sections' completeness by their weights; sections not given count 0."""
    total = F.lit(0.0)
    for name, value in sections.items():
        total = total + F.coalesce(value, F.lit(0.0)) * SECTION_WEIGHT[name]
    return total


def level(total: Column, issues: Column) -> Column:
    """MTH08: by the worst issue first, then by completeness."""
    has = lambda s: F.exists(issues, lambda i: i["severity"] == s)
    by_score = F.lit("poor")
    for cut, name in reversed(LEVELS):
        by_score = F.when(total >= cut, name).otherwise(by_score)
    return F.when(has("critical"), "critical").when(has("error"), "poor").when(has("warning"), F.when(total >= 75, "good").otherwise("fair")).otherwise(by_score)


def assessed(analyses: DataFrame) -> DataFrame:
    """DQC09, PRJ32: ``analysis_id``, counts of issues by severity, three scores and the level.

    Snippets, links and repositories are judged where ``analyses`` has columns ``code_snippets``,
    ``external_links`` or ``repositories`` (arrays of objects as in :mod:`analyses`); a section without any counts 0.
    """
    has = {c: F.col(c) if c in analyses.columns else F.lit(None).cast(kind) for c, kind in (("code_snippets", SNIPPET), ("external_links", LINK), ("repositories", REPO))}
    issues = F.concat(completeness_issues(), consistency_issues(), logical_issues(), snippet_issues(has["code_snippets"]), link_issues(has["external_links"], has["repositories"]))
    m = F.col("publication_metadata")
    total = completeness({
        "publication": filled([m["publication_id"], m["title"], m["authors"], m["abstract"], m["publication_date"], m["journal"], m["doi"]]),
        "code": filled([has["code_snippets"]]), "link": filled([has["external_links"], has["repositories"]]),
        "dataset": filled([F.col("_d")[p] for p in ("validated_datasets", "newly_discovered_datasets", "dataset_joins")]),
        "workflow": filled([F.col("workflow_id"), F.col("workflow_status"), F.col("analysis_timestamp")]),
    })
    rows = opened(analyses).withColumn("issues", issues).withColumn("completeness", F.round(total, 6))
    count = lambda s: F.size(F.filter("issues", lambda i: i["severity"] == s)).alias(f"n_{s}")
    return rows.select("analysis_id", *[count(s) for s in CONSISTENCY_COST], "completeness", score(F.col("issues"), CONSISTENCY_COST, ["consistency", "mismatch"]).alias("consistency"), score(F.col("issues"), LOGICAL_COST, ["logical", "inconsistency"]).alias("logic"), level(F.col("completeness"), F.col("issues")).alias("level"))


__all__ = ["DATASETS", "assessed", "collected", "completeness", "level", "link_issues", "reference_issues", "rule", "score", "snippet_issues"]
