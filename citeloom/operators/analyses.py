"""Consolidated analyses: assembly, search documents, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.shred import plain_json_column

ITEM = "array<struct<name:string,confidence:double,context:string,section:string,page_number:int>>"
JOIN = "array<struct<dataset1:string,dataset2:string,join_type:string,confidence:double,description:string>>"
DATASETS = f"struct<validated_datasets:{ITEM},newly_discovered_datasets:{ITEM},dataset_joins:{JOIN}>"
SNIPPET = "array<struct<content:string,language:string,context:string,relevance_score:double>>"
LINK = "array<struct<url:string,link_type:string,title:string,is_accessible:boolean,relevance_score:double>>"
REPO = "array<struct<url:string,owner:string,repository:string,is_valid:boolean,stars:int>>"


def some(c: Column, kind: str) -> Column:
    """An empty array for null, and no null elements."""
    return F.filter(F.coalesce(c, F.array().cast(kind)), lambda x: x.isNotNull())


def distinct_texts(c: Column) -> Column:
    """DED04: distinct non-empty texts in order of the texts themselves."""
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != ""))))


def opened(analyses: DataFrame) -> DataFrame:
    """With ``_plain``: the object in ``dataset_analysis``, however it is wrapped or encoded, and ``_d``: its
    arrays of objects, of which a lone one counts as one; nulls where there is none."""
    plain = analyses.withColumn("_plain", plain_json_column("dataset_analysis", ["validated_datasets", "newly_discovered_datasets", "dataset_joins"]))
    return plain.withColumn("_d", F.from_json("_plain", DATASETS))


def dataset_part(a: Column) -> Column:
    """PRJ18, AGG17: names, contexts and counts of an analysis's datasets."""
    valid, new, joined = some(a["validated_datasets"], ITEM), some(a["newly_discovered_datasets"], ITEM), some(a["dataset_joins"], JOIN)
    names = F.concat(F.transform(valid, lambda d: d["name"]), F.transform(new, lambda d: d["name"]), F.transform(joined, lambda j: j["dataset1"]), F.transform(joined, lambda j: j["dataset2"]))
    contexts = F.concat(F.transform(valid, lambda d: d["context"]), F.transform(new, lambda d: d["context"]))
    all_names = distinct_texts(names)
    return F.struct(
        F.transform(valid, lambda d: d["name"]).alias("validated"), F.transform(new, lambda d: d["name"]).alias("discovered"), all_names.alias("dataset_names"), F.array_join(distinct_texts(contexts), " ").alias("contexts_text"),
        F.size(valid).alias("n_validated"), F.size(new).alias("n_discovered"), F.size(joined).alias("n_joins"), F.size(all_names).alias("n_datasets"),
    )


def code_part(snippets: Column) -> Column:
    """PRJ19: languages, text and mean relevance (0.0 for none) of snippets."""
    s = some(snippets, SNIPPET)
    scored = F.filter(F.transform(s, lambda x: x["relevance_score"]), lambda x: x.isNotNull())
    return F.struct(F.size(s).alias("n_snippets"), distinct_texts(F.transform(s, lambda x: x["language"])).alias("languages"), F.array_join(F.transform(s, lambda x: x["content"]), " ").alias("content_text"), mean(scored).alias("mean_relevance"))


def link_part(links: Column, repos: Column) -> Column:
    """PRJ20, AGG16: hosts, kinds and counts of links and repositories."""
    l, r = some(links, LINK), some(repos, REPO)
    urls = F.concat(F.transform(l, lambda x: x["url"]), F.transform(r, lambda x: x["url"]))
    kinds = F.concat(F.transform(l, lambda x: x["link_type"]), F.when(F.size(r) > 0, F.array(F.lit("github"))).otherwise(F.array().cast("array<string>")))
    return F.struct(
        urls.alias("urls"), distinct_texts(F.transform(urls, lambda u: F.try_parse_url(u, F.lit("AUTHORITY")))).alias("domains"), distinct_texts(kinds).alias("link_types"), F.size(urls).alias("n_links"),
        F.size(F.filter(l, lambda x: x["is_accessible"])).alias("n_accessible"), F.size(F.filter(r, lambda x: x["is_valid"])).alias("n_valid"), F.aggregate(r, F.lit(0), lambda a, x: a + F.coalesce(x["stars"], F.lit(0))).alias("stars"),
    )


def mean(scores: Column) -> Column:
    """Mean of an array's numbers; 0.0 for none."""
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(F.lit(0.0))


def overall_confidence(datasets: Column, joins: Column, relevances: Column) -> Column:
    """AGG18: mean of the confidences and of the relevances by ten; 0.0 for none."""
    return mean(F.filter(F.concat(datasets, joins, F.transform(relevances, lambda r: r / 10)), lambda x: x.isNotNull()))


def denormalised(analyses: DataFrame) -> DataFrame:
    """PRJ15-18, PRJ21, PRJ22: one flat search row per analysis with ``analysis_id, publication_metadata, dataset_analysis`` (JSON)."""
    m = F.col("publication_metadata")
    rows = opened(analyses)
    rows = rows.withColumn("_d", dataset_part(F.col("_d")))
    text = lambda c: F.coalesce(c, F.lit(""))
    people = F.array_join(F.coalesce(m["authors"], F.array().cast("array<string>")), ", ")
    rows = rows.select(
        "analysis_id", F.coalesce(m["publication_id"], F.col("publication_id")).alias("publication_id"), "workflow_status", text(m["title"]).alias("title"), text(m["abstract"]).alias("abstract"), text(m["journal"]).alias("journal"),
        people.alias("authors_text"), F.trim(F.concat_ws(" ", m["title"], m["abstract"])).alias("publication_text"), F.col("_d.dataset_names").alias("dataset_names"), F.col("_d.contexts_text").alias("contexts_text"),
        F.col("_d.n_validated").alias("n_validated"), F.col("_d.n_discovered").alias("n_discovered"), F.col("_d.n_joins").alias("n_joins"), F.col("_d.n_datasets").alias("n_datasets"),
    )
    search = F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (F.col("publication_text"), F.col("authors_text"), F.col("journal"), F.array_join("dataset_names", " "), F.col("contexts_text"))])
    rows = rows.withColumn("search_text", search).withColumn("autocomplete_text", F.array_join(F.slice("dataset_names", 1, 10), " "))
    return rows.withColumn("content_length", F.length("search_text")).withColumn("has_content", F.length("search_text") > 0)


def split_valid(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PRJ23, DQC13, FIL21: (rows that can be served, rows that can't with ``error``)."""
    error = F.when(F.coalesce(F.col("publication_id"), F.lit("")) == "", "no publication_id").when(F.col("workflow_status").isNull(), "no workflow_status")
    checked = docs.withColumn("error", error)
    return checked.where("error is null").drop("error"), checked.where("error is not null")


def assembled(publications: DataFrame, mentions: DataFrame, joins: DataFrame) -> DataFrame:
    """PRJ24-27, PRJ30: per publication one JSON of all its parts, confidences from 0 to 1.

    ``mentions`` has ``publication_id, name, confidence, context, is_known`` and
    ``joins`` ``publication_id, dataset1, dataset2, join_type, confidence``, both
    from 0 to 10. A publication's parts are gathered in one row, as its document is.
    """
    part = F.struct("name", (F.col("confidence") / 10).alias("confidence"), "context")
    m = mentions.groupBy("publication_id").agg(F.array_sort(F.collect_list(F.when(F.col("is_known"), part))).alias("validated_datasets"), F.array_sort(F.collect_list(F.when(~F.col("is_known"), part))).alias("newly_discovered_datasets"))
    j = joins.groupBy("publication_id").agg(F.array_sort(F.collect_list(F.struct("dataset1", "dataset2", "join_type", (F.col("confidence") / 10).alias("confidence")))).alias("dataset_joins"))
    rows = publications.join(m, "publication_id", "left").join(j, "publication_id", "left")
    none = {c: F.coalesce(F.size(c), F.lit(0)) for c in ("validated_datasets", "newly_discovered_datasets", "dataset_joins")}
    rows = rows.withColumns({f"n_{c}": F.greatest(n, F.lit(0)) for c, n in none.items()})
    return rows.select("publication_id", F.to_json(F.struct("validated_datasets", "newly_discovered_datasets", "dataset_joins")).alias("dataset_analysis"), *[f"n_{c}" for c in none])
