"""Catalogue documents: reviews of datasets in publications, one document per dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import alias_list, clean_doi, slug
from citeloom.sources.session import materialise

# What a publication's page begins with, the documents' vocabulary, and the order of reviews.
PUBLICATION_PAGE = "https://app.dimensions.ai/details/publication/"
VOCABULARY = "https://schema.org/"
ASPECTS = {"validation": 0, "discovery": 1}


def citation(title: Column, doi: Column, publication_id: Column) -> Column:
    """PRJ05: an article; identifier and address only where there are any."""
    return F.struct(F.lit("ScholarlyArticle").alias("@type"), title.alias("name"), F.when(F.trim(doi) != "", F.trim(doi)).alias("identifier"), F.when(F.trim(publication_id) != "", F.concat(F.lit(PUBLICATION_PAGE), F.trim(publication_id))).alias("url"))


def rating(name: str, value: Column) -> Column:
    """PRJ06: null unless the value is a number."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.struct(F.lit("Rating").alias("@type"), F.lit(name).alias("name"), number.alias("ratingValue")))


def reviews(rows: DataFrame, aspect: str) -> DataFrame:
    """PRJ07: ``dataset_id, aspect, doi, seq, review`` of rows with ``dataset_id, title, doi, publication_id, body, mention, use, seq``."""
    ratings = F.filter(F.array(rating("mention", F.col("mention")), rating("use", F.col("use"))), lambda r: r.isNotNull())
    review = F.struct(F.lit("Review").alias("@type"), F.lit(aspect).alias("reviewAspect"), F.col("body").alias("reviewBody"), citation(F.col("title"), F.col("doi"), F.col("publication_id")).alias("citation"), ratings.alias("reviewRating"))
    return rows.where("dataset_id is not null").select("dataset_id", F.lit(aspect).alias("aspect"), F.coalesce(clean_doi(F.col("doi")), F.lit("")).alias("doi"), "seq", review.alias("review"))


def ordered_reviews(parts: list[DataFrame]) -> DataFrame:
    """JOI21, SRT03: with ``place``: reviews of a dataset by aspect, DOI and ``seq``.

    Reviews are range-partitioned by that order, so a dataset that a third of all
    rows name lies in many partitions; places are counted in each of them, after
    what the ones before it hold.
    """
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    order = F.coalesce(*[F.when(F.col("aspect") == a, i) for a, i in ASPECTS.items()], F.lit(9))
    ranged = all_.withColumn("_o", order).repartitionByRange("dataset_id", "_o", "doi", "seq").withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "reviews")
    held = ranged.groupBy("dataset_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("dataset_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition that a dataset lies in
    held = held.select("dataset_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    w = Window.partitionBy("dataset_id", "_part").orderBy("_o", "doi", "seq")
    placed = ranged.withColumn("_at", F.row_number().over(w) - 1).join(held, ["dataset_id", "_part"])
    return placed.select("dataset_id", "aspect", "doi", "seq", "review", (F.col("_first") + F.col("_at")).cast("int").alias("place"))


def documents(registry: DataFrame, reviewed: DataFrame, creators: DataFrame | None = None, subjects: DataFrame | None = None, part_size: int = 10_000) -> DataFrame:
    """PRJ08: ``dataset_id, part, slug, document`` (JSON, absent parts left out) of every entry.

    An entry with more than ``part_size`` reviews comes out in parts, each of them a
    document with so many of its reviews, so that no row grows with the data; the
    slugs of parts after the first end with their number.
    """
    got = reviewed.groupBy("dataset_id", F.expr(f"place div {part_size}").cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "review"))).alias("r"))
    rows = registry.select("dataset_id", "dataset_name", "aliases").join(got, "dataset_id", "left")
    for extra, name in ((creators, "creator_name"), (subjects, "about")):
        rows = rows.join(extra.select("dataset_id", F.col("value").alias(name)), "dataset_id", "left") if extra is not None else rows.withColumn(name, F.lit(None).cast("string"))
    other = alias_list(F.col("aliases"))
    doc = F.struct(
        F.struct(F.lit(VOCABULARY).alias("@vocab")).alias("@context"), F.lit("Dataset").alias("@type"), F.col("dataset_name").alias("name"), F.col("dataset_id").alias("identifier"),
        F.when(F.size(other) > 0, other).alias("alternateName"), F.when(F.col("creator_name").isNotNull(), F.struct(F.lit("Organization").alias("@type"), F.col("creator_name").alias("name"))).alias("creator"),
        F.col("about"), F.when(F.size("r") > 0, F.col("r.review")).alias("review"),
    )
    part = F.coalesce("part", F.lit(0))
    name = slug(F.col("dataset_name"))
    return rows.select("dataset_id", part.alias("part"), F.when(part > 0, F.concat_ws("-", name, part.cast("string"))).otherwise(name).alias("slug"), F.to_json(doc).alias("document"))


def catalog(registry: DataFrame, reviewed: DataFrame) -> DataFrame:
    """SRT04: ``name, identifier, slug, n_reviews`` of entries with reviews; the writer orders by name."""
    n = reviewed.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    return registry.join(n, "dataset_id").select(F.col("dataset_name").alias("name"), F.col("dataset_id").alias("identifier"), slug(F.col("dataset_name")).alias("slug"), "n_reviews")


def most_common(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """AGG19: ``group, value``: the most frequent non-empty value, the first seen of equal ones.

    Values are counted before anything is ranked, so a hot group is no hot task.
    """
    counts = rows.where(F.trim(F.col(value)) != "").groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counts.groupBy(group).agg(F.max_by(F.col(value), F.struct(F.col("n"), -F.col("first"))).alias("value"))


def match_counts(rows: DataFrame, aspect: str) -> DataFrame:
    """AGG20: rows, and those with a dataset, of one aspect."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("dataset_id").isNotNull()).alias("matched")).select(F.lit(aspect).alias("aspect"), "matched", "total")


def slug_clashes(docs: DataFrame) -> DataFrame:
    """Slugs of more than one entry; a writer that names files by slug needs this to be empty."""
    return docs.groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
