"""Collections as tables: lookups, counts, storage form, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.code import code_blocks
from citeloom.functions.links import find_links, find_repos
from citeloom.functions.similarity import indel_ratio, may_reach


def by_id(df: DataFrame, value: object, key: str = "id") -> DataFrame:
    """SRC14: the row of a key; the condition reaches the scan. No row for none, one of equal ones."""
    return df.where(F.col(key) == value).limit(1)


def by_keys(df: DataFrame, **values: object) -> DataFrame:
    """SRC15: rows by several keys at once."""
    for k, v in values.items():
        df = df.where(F.col(k) == v)
    return df


def catalogue(df: DataFrame, domains: list[str] | None = None, column: str = "domain", with_references: bool = True) -> DataFrame:
    """SRC16: all entries, or those of some domains, with or without their references."""
    out = df if domains is None else df.where(F.col(column).isin(*domains))
    return out if with_references else out.drop("publication_references")


def parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """SRC08: records of a JSON column as columns; ones that aren't JSON are left out."""
    got = df.where(F.try_parse_json(column).isNotNull()).withColumn("_r", F.from_json(column, schema))
    return got.where("_r is not null").select(*[c for c in df.columns if c != column], "_r.*")


def find_authors(authors: DataFrame, *, orcid: str | None = None, name: str | None = None, least: float = 0.8, limit: int = 100) -> DataFrame:
    """FIL18, SRT08: by iD, or by similar names, the most similar first."""
    if orcid is not None:
        return authors.where(F.col("orcid") == orcid).withColumn("score", F.lit(1.0)).orderBy("author_id").limit(limit)
    n = F.lit((name or "").lower())
    scored = authors.where(may_reach(F.lower("name"), n, least * 100)).withColumn("score", indel_ratio(F.lower("name"), n) / 100)
    return scored.where(F.col("score") >= least).orderBy(F.desc("score"), "author_id").limit(limit)


def to_flatten(work: DataFrame, pubs: DataFrame, key: str = "id") -> DataFrame:
    """FIL25: work in progress whose publication is there and not known to have failed."""
    ok = pubs.where(F.coalesce("sync_elastic", F.lit(True))).select(key)
    return work.where(F.col("status") == "PROCESSING").join(ok, key, "left_semi")


def stored_form(df: DataFrame, key: str = "id") -> DataFrame:
    """PRJ34, PRJ37: as a document store has it: ``_id`` as text, rows without one left out."""
    return df.where(F.col(key).isNotNull()).withColumn("_id", F.col(key).cast("string")).drop(key)


def loaded_form(df: DataFrame, key: str = "id") -> DataFrame:
    """PRJ37: the way back."""
    return df.withColumnRenamed("_id", key)


def serialised(df: DataFrame, key: str) -> DataFrame:
    """PRJ29, PRJ35, PRJ36: ``key, document``: each row as JSON, times as ISO text, nulls left out."""
    return df.select(key, F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}).alias("document"))


def section_counts(df: DataFrame, arrays: list[str]) -> DataFrame:
    """PRJ31, AGG17: the size of each array, 0 for null."""
    return df.withColumns({f"n_{a}": F.greatest(F.coalesce(F.size(a), F.lit(0)), F.lit(0)) for a in arrays})


def add_references(stored: Column, new: Column) -> Column:
    """DED11: references (with ``publication_id``), new ones only where their publication isn't there."""
    return F.concat(stored, F.filter(new, lambda n: ~F.exists(stored, lambda s: s["publication_id"] == n["publication_id"])))


def progress_by_step(log: DataFrame, key: str = "workflow_id", at: str = "step", steps: int = 7) -> DataFrame:
    """WIN04, CTL15: after each step of a workflow, its number of completed steps and per cent of all."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    done = F.count(F.when(F.col("completed"), 1)).over(w)
    return log.withColumn("n_completed", done).withColumn("percentage", F.round(done * 100.0 / steps, 6))


def code_summary(results: DataFrame) -> DataFrame:
    """AGG15: counts by language, purpose and kind, and in all with means and the share of high relevance."""
    sets = results.groupingSets([["language"], ["purpose"], ["implementation_type"], []], "language", "purpose", "implementation_type").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg("relevance_score"), 2).alias("mean_relevance"), F.bround(F.count_if(F.col("relevance_score") >= 7) * 100.0 / F.count(F.lit(1)), 1).alias("high_relevance"),
        F.grouping_id("language", "purpose", "implementation_type").alias("_g"))
    by = F.when(F.col("_g") == 3, "language").when(F.col("_g") == 5, "purpose").when(F.col("_g") == 6, "implementation_type").otherwise("total")
    return sets.select(by.alias("by"), F.coalesce("language", "purpose", "implementation_type").alias("value"), "n", "mean_relevance", "high_relevance")


def all_patterns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """UDT04, AGG24: repositories, code blocks and links of each text, and how many there are."""
    got = docs.select(key, find_repos(F.col(text)).alias("repositories"), code_blocks(F.col(text)).alias("code_blocks"), find_links(F.col(text)).alias("links"))
    return section_counts(got, ["repositories", "code_blocks", "links"])


def known_counts(found: DataFrame, column: str = "dataset_id") -> DataFrame:
    """AGG26: how many findings are known and how many aren't."""
    return found.agg(F.count(column).alias("n_known"), F.count_if(F.col(column).isNull()).alias("n_unknown"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG29, SNK12: rows of each table. Counts come from file footers where the format has them."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """SNK21: keys that occur more than once; what a unique index would have refused."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def write_clustered(df: DataFrame, path: str, by: list[str], files: int) -> None:
    """SNK21: files ranged and sorted by ``by``, so that a reader's condition on it skips most of them."""
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.parquet(path)


def asked_at_once(queries: DataFrame, datasets: DataFrame) -> DataFrame:
    """CTL10: many lookups (``query_id, alias``) as one join: ``query_id, dataset_id``."""
    from citeloom.operators.registry import lookup_exact

    return queries.join(lookup_exact(queries, datasets), "alias").select("query_id", "dataset_id").distinct()
