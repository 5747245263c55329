"""Roll-ups of citations, publications and analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.sources.session import materialise
from citeloom.sources.tables import norm_key

#: The parts of a publication that citations are summed by, and where their names are.
PARTS = ["journals", "topics", "authors", "institutions", "category_for"]


def named_parts(pubs: DataFrame, part: str, key: str = "id") -> DataFrame:
    """``key, citation_count, name``, a row for each distinct name of a publication. Made in the row: no shuffle."""
    if part == "institutions":
        all_ = F.flatten(F.transform(F.filter("authors", lambda a: a.isNotNull() & a["institutions"].isNotNull()), lambda a: F.filter(a["institutions"], lambda i: i.isNotNull())))
    else:
        all_ = F.filter(part, lambda x: x.isNotNull())
    names = F.array_distinct(F.filter(F.transform(all_, lambda x: x["name"]), lambda n: n.isNotNull()))
    return pubs.select(F.col(key), "citation_count", F.explode(names).alias("name"))


def citations_by(pubs: DataFrame, part: str) -> DataFrame:
    """AGG01-05: ``name, n_publications, total_citations``. ``pubs`` has one row per publication.

    A publication counts once for a name. Partial sums are made before the shuffle.
    """
    rows = named_parts(pubs, part)
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n_publications"), F.coalesce(F.sum("citation_count"), F.lit(0)).alias("total_citations"))


def ranked(rolled: DataFrame) -> DataFrame:
    """SRT01: the greatest first, equal ones by name."""
    return rolled.orderBy(F.desc("total_citations"), "name")


def about_dataset(pubs: DataFrame, dataset_id: str) -> DataFrame:
    """Publications that mention a dataset."""
    return pubs.where(F.exists("mentioned_datasets", lambda m: norm_key(m["id"]) == dataset_id.lower()))


def dataset_counts(pubs: DataFrame) -> DataFrame:
    """AGG06-08: per mentioned dataset: publications, synced, failed, and distinct authors, institutions and journals.

    A null sync flag is in neither count. Distinct counts go by ids.
    """
    one = pubs.select("id", "sync_elastic", F.array_distinct(F.filter(F.transform("mentioned_datasets", lambda m: norm_key(m["id"])), lambda k: k.isNotNull())).alias("keys"), _ids("authors"), _inst_ids(), _ids("journals"))
    one = materialise(one, "entities")  # ids only, read twice
    rows = one.select("id", "sync_elastic", F.explode("keys").alias("dataset_id"), "authors", "institutions", "journals")
    base = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_publications"), F.count_if(F.col("sync_elastic")).alias("n_processed"), F.count_if(~F.col("sync_elastic")).alias("n_failed"))
    # one kind of entity after another: distinct pairs shuffle once, their counts hardly at all
    kinds = rows.select("dataset_id", F.explode(F.flatten(F.array(*[_tagged(k) for k in ("authors", "institutions", "journals")]))).alias("e")).select("dataset_id", "e.kind", "e.entity").distinct()
    per = kinds.groupBy("dataset_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("authors", "institutions", "journals")])
    return base.join(per, "dataset_id", "left").fillna(0, ["n_authors", "n_institutions", "n_journals"])


def _tagged(kind: str) -> Column:
    return F.transform(F.col(kind), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("entity")))


def _ids(part: str) -> Column:
    return F.coalesce(F.array_distinct(F.filter(F.transform(part, lambda x: x["id"]), lambda i: i.isNotNull())), F.array().cast("array<string>")).alias(part)


def _inst_ids() -> Column:
    all_ = F.flatten(F.transform(F.filter("authors", lambda a: a.isNotNull() & a["institutions"].isNotNull()), lambda a: F.transform(F.filter(a["institutions"], lambda i: i.isNotNull()), lambda i: i["id"])))
    return F.coalesce(F.array_distinct(F.filter(all_, lambda i: i.isNotNull())), F.array().cast("array<string>")).alias("institutions")


def is_done(total: Column, processed: Column, failed: Column) -> Column:
    """AGG09: DONE once everything is either processed or failed."""
    return F.when(processed + failed == total, "DONE").otherwise("PROCESSING")


def by_type_and_status(analyses: DataFrame, first: str, second: str) -> DataFrame:
    """AGG10, AGG13: counts by one column, by the other, and in all, in one pass."""
    sets = analyses.groupingSets([[first], [second], []], first, second).agg(F.count(F.lit(1)).alias("n"), F.grouping(first).alias("_a"), F.grouping(second).alias("_b"))
    kind = F.when(F.col("_a") == 0, first).when(F.col("_b") == 0, second).otherwise("total")
    rows = sets.select(kind.alias("by"), F.when(F.col("_a") == 0, F.col(first)).when(F.col("_b") == 0, F.col(second)).cast("string").alias("value"), "n")
    # an empty table has no grouping sets, but a total
    none = analyses.sparkSession.createDataFrame([("total", None, 0)], "by string, value string, n long")
    return rows.unionByName(none).groupBy("by", "value").agg(F.sum("n").alias("n"))


def time_stats(rows: DataFrame, value: Column) -> DataFrame:
    """AGG11, AGG25: mean, least and greatest where there is a value; no row for none."""
    return rows.select(value.alias("v")).where("v is not null").agg(F.avg("v").alias("avg_value"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.count("v").alias("n")).where("n > 0")


def recent(rows: DataFrame, at: str, as_of: Column, days: int = 7) -> DataFrame:
    """AGG12, DAT04: how many rows are of the last days before ``as_of``."""
    return rows.agg(F.count_if(F.col(at) >= as_of - F.make_dt_interval(F.lit(days))).alias("n_recent"))


def dataset_years(rows: DataFrame, dataset: str, year: str, key: str) -> DataFrame:
    """AGG21: distinct publications by dataset and year; the two-step distinct keeps a hot dataset spread."""
    pairs = rows.where(F.col(dataset).isNotNull() & F.col(year).isNotNull() & F.col(key).isNotNull()).select(dataset, year, key).distinct()
    return pairs.groupBy(dataset, year).agg(F.count(F.lit(1)).alias("n_publications"))


def year_jobs(requests: DataFrame, start: str, end: str) -> DataFrame:
    """PRJ33, STM06: a row per year from start to end; none where the end comes first."""
    return requests.where(F.col(start) <= F.col(end)).withColumn("year", F.explode(F.sequence(F.col(start), F.col(end))))
