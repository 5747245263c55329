"""What texts refer to: repositories, links and code, checked against tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import scores
from citeloom.functions.code import is_read, language_by_patterns, snippets
from citeloom.functions.links import bare_url, find_links, find_repos, is_repo_host, link_class

# Terms that speak for a repository that holds a paper's analysis.
BONUS_TERMS = ["method", "methods", "result", "results", "experiment", "experiments", "evaluation", "reproduc", "pipeline", "benchmark"]
TERM = r"[a-zA-Z][a-zA-Z\-]{4,}"


def repositories(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """UDT01: a row per repository address of a text."""
    return docs.where(F.col(text).rlike("(?i)github")).select(key, F.inline(find_repos(F.col(text))))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """UDT03, UDT06, STR14, FIL12: a row per other address, with its class; none of the code host's."""
    found = docs.where(F.col(text).isNotNull()).select(key, F.inline(find_links(F.col(text))))
    return found.where(~is_repo_host(F.col("url"))).withColumn("link_type", link_class(F.col("url")))


def code(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """UDT07, STR15: a row per snippet, with its language."""
    found = docs.where(F.col(text).isNotNull()).select(key, F.inline(snippets(F.col(text))))
    return found.withColumn("language", language_by_patterns(F.col("content"), F.col("language")))


def checked(found: DataFrame, results: DataFrame, url: str = "url") -> DataFrame:
    """JOI14-16, SRC17, SRC18, UDT08, UDT09: addresses with the result of fetching them (``url, status, title, default_branch``).

    Addresses are asked once each; ones without a result are not accessible.
    """
    r = results.select(bare_url(F.col("url")).alias("_url"), "status", F.col("title").alias("page_title"), "default_branch").groupBy("_url").agg(F.max_by(F.struct("status", "page_title", "default_branch"), "status").alias("r"))
    got = found.withColumn("_url", bare_url(F.col(url))).join(r, "_url", "left").drop("_url")
    return got.select("*", F.col("r.page_title").alias("page_title"), F.coalesce(F.col("r.status") == 200, F.lit(False)).alias("is_accessible"), F.coalesce(F.col("r.default_branch"), F.lit("main")).alias("default_branch")).drop("r")


def combined(found: DataFrame, rejected: DataFrame, extra: DataFrame, key: list[str], least: float = 0.7) -> DataFrame:
    """JOI17, FIL10: findings less the rejected, with confident extra ones that aren't there yet."""
    kept = found.join(rejected.select(*key).distinct(), key, "left_anti")
    more = extra.where(F.col("confidence") >= least).drop("confidence").dropDuplicates(key).join(kept.select(*key).distinct(), key, "left_anti")
    return kept.unionByName(more, allowMissingColumns=True)


def judged(found: DataFrame, judgements: DataFrame, key: list[str], order: str = "pos", last: bool = False) -> DataFrame:
    """JOI12, JOI13: findings with the first (or last) judgement of their key; null fields where there is none."""
    fields = [c for c in judgements.columns if c not in (*key, order)]
    pick = F.max_by if last else F.min_by
    one = judgements.groupBy(*key).agg(pick(F.struct(*fields), order).alias("_j"))
    return found.join(one, key, "left").select(*[F.col(c) for c in found.columns], *[F.col(f"_j.{f}").alias(f"judged_{f}" if f in found.columns else f) for f in fields])


def read_files(files: DataFrame, most: int = 100, size: int = 256 * 1024, keep: int = 8000) -> DataFrame:
    """SRC19, FIL24: of each ``repo``, the first ``most`` files (``path, length, content``) by path that are looked at, cut to ``keep`` characters."""
    ok = files.where(is_read(F.col("path")) & (F.col("length") <= size))
    one = ok.groupBy("repo").agg(F.slice(F.array_sort(F.collect_list("path")), 1, most).alias("paths")).select("repo", F.explode("paths").alias("path"))
    return ok.join(one, ["repo", "path"]).withColumn("content", F.substring(F.col("content").cast("string"), 1, keep))


def text_terms(text: Column, most: int = 50) -> Column:
    """The first ``most`` distinct terms of a text, in lower case."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))), 1, most)


def aligned(pairs: DataFrame) -> DataFrame:
    """JOI20, MTH09: how much of a publication (``publication_text``, ``datasets``) its repository's text (``repo_text``) has: ``matches, score, passes``."""
    low = F.lower(F.coalesce(F.col("repo_text"), F.lit("")))
    words = F.concat(F.transform(F.coalesce("datasets", F.array().cast("array<string>")), lambda d: F.lower(d)), text_terms(F.col("publication_text")), F.array(*[F.lit(b) for b in BONUS_TERMS]))
    n = F.size(F.filter(F.array_distinct(words), lambda w: F.contains(low, w)))
    s = scores.alignment_score(n)
    return pairs.withColumn("matches", n).withColumn("score", s).withColumn("passes", s >= 6)
