"""Queries of readers, lookups, stored tables, mappings and values, over whole tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import responses, scores, text, values
from citeloom.operators import analyses, collections, extraction, fulltext, publications, quality, registry, rollups, store
from citeloom.plans import service, workflow
from citeloom.plans.analysis import _ITEMS, _LIVE
from citeloom.plans.records import _PUBS, valid_analyses, valid_publications
from citeloom.sources import client, files
from citeloom.sources.session import materialise, shared_dir
from citeloom.sources.tables import norm_key, table
from citeloom.streaming import mentions, sync

Query = Callable[[SparkSession, str], DataFrame]
#: Tables that are counted, all of a scale folder.
ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "seed_datasets", "additional_discovered_datasets", "data_dyads", "authors", "publications", "analyses", "evidence", "dataset_joins", "mix_targets"]
REPOSITORY_FILES = ["py", "R", "csv", "ipynb"]


def _folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# -- readers -------------------------------------------------------------------------


def _csv(df: DataFrame, label: str, schema: str) -> DataFrame:
    """A table written as CSV and read again."""
    path = _folder(df.sparkSession, label)
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_csv(df.sparkSession, path, schema)


def q45_csv_registry(spark: SparkSession, d: str) -> DataFrame:
    """SRC01: the alias index of a registry that is read from CSV."""
    seeds = _csv(table(spark, d, "seed_datasets").select("dataset_id", "dataset_name", "group_name", "aliases"), "registry", files.REGISTRY)
    return registry.alias_index(registry.ordered_union(seeds)).select("norm", "dataset_id")


def q45_csv_pairs(spark: SparkSession, d: str) -> DataFrame:
    """SRC02: pairs of publications and known datasets from CSV."""
    e = table(spark, d, "evidence").where("dataset_id is not null")
    rows = e.select("publication_id", F.lit(None).cast("string").alias("publication_title"), F.col("doi").alias("publication_doi"), F.col("dataset_id").alias("validated_dataset_id"), F.col("dataset_name").alias("validated_dataset_name"), (F.col("dataset_usage_status") != "none").alias("is_mentioned"), (F.col("dataset_usage_status") == "analyzed").alias("is_used"), "validation_reasoning", "confidence_score_mention", "confidence_score_use")
    got = _csv(rows, "pairs", files.PAIRS)
    return got.groupBy("validated_dataset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_used").alias("n_used"), F.sum(F.length("validation_reasoning")).alias("n_reasoning"), F.round(F.sum("confidence_score_mention"), 4).alias("mention"))


def q45_csv_discovered(spark: SparkSession, d: str) -> DataFrame:
    """SRC03: pairs of publications and new names from CSV, quoted where they need it."""
    e = table(spark, d, "evidence").where("dataset_id is null")
    none = F.lit(None).cast("string")
    rows = e.select("publication_id", none.alias("publication_title"), none.alias("publication_doi"), F.col("dataset_name").alias("new_name"), F.lit(True).alias("new_is_mentioned"), F.lit(False).alias("new_is_used"), F.col("context").alias("new_description"), none.alias("new_source"), none.alias("new_domain"), F.col("confidence_score_mention").alias("new_confidence_score_mention"), F.col("confidence_score_use").alias("new_confidence_score_use"))
    return _csv(rows, "discovered", files.DISCOVERED).groupBy("publication_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("new_name")).alias("n_name"), F.sum(F.length("new_description")).alias("n_description"))


def _fulltexts(spark: SparkSession, d: str) -> str:
    path = _folder(spark, "fulltexts")
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("publication_id"), F.col("text").alias("fulltext")).write.parquet(path)
    return path


def q46_fulltexts(spark: SparkSession, d: str) -> DataFrame:
    """SRC04, SRC06: all full texts of a folder."""
    return fulltext.read_fulltext(spark, _fulltexts(spark, d)).select("publication_id", F.length("fulltext").alias("n_chars"))


def q46_fulltext(spark: SparkSession, d: str) -> DataFrame:
    """SRC05: one of them; the id reaches the scan."""
    return fulltext.read_fulltext(spark, _fulltexts(spark, d), "17").select("publication_id", F.md5("fulltext").alias("md5"))


def q46_batches(spark: SparkSession, d: str) -> DataFrame:
    """SRC07: rows in batches of a fixed size; all but the last of a partition are full."""
    b = fulltext.batches(fulltext.read_fulltext(spark, _fulltexts(spark, d)).withColumn("part", F.spark_partition_id()), 100).groupBy("part", "batch").agg(F.count(F.lit(1)).alias("n"))
    last = b.groupBy("part").agg(F.max("batch").alias("last"))
    return b.join(last, "part").agg(F.sum("n").alias("n_rows"), (F.max("n") <= 100).alias("bounded"), (F.count_if((F.col("n") < 100) & (F.col("batch") < F.col("last"))) == 0).alias("full"))


def q47_parsed(spark: SparkSession, d: str) -> DataFrame:
    """SRC08: the opened JSON of analyses as columns."""
    live = analyses.opened(valid_analyses(spark, d, ["dataset_analysis"]).where("deleted_at is null")).select("analysis_id", "_plain")
    got = collections.parsed(live, "_plain", "summary struct<total_validated_datasets:int,total_unique_datasets:int>")
    return got.select("analysis_id", "summary.total_validated_datasets", "summary.total_unique_datasets")


def q48_by_id(spark: SparkSession, d: str) -> DataFrame:
    return collections.by_id(table(spark, d, "orders"), 7, "o_orderkey")


def q48_by_keys(spark: SparkSession, d: str) -> DataFrame:
    return collections.by_keys(table(spark, d, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey")


def q48_catalogue(spark: SparkSession, d: str) -> DataFrame:
    got = collections.catalogue(table(spark, d, "seed_datasets").withColumn("publication_references", F.lit(1)), ["Work and Mobility", "Land and Water Records"], "group_name", with_references=False)
    return got.select("dataset_id", F.lit("publication_references" in got.columns).alias("has_references"))


def q49_read_files(spark: SparkSession, d: str) -> DataFrame:
    """FIL24, SRC19: texts as files of repositories, one per source: the first hundred that are looked at."""
    ending = F.element_at(F.array(*[F.lit(e) for e in REPOSITORY_FILES]), (F.col("doc_id") % 4 + 1).cast("int"))
    f = table(spark, d, "documents").where("text is not null and source is not null").select(F.col("source").alias("repo"), F.concat(F.lit("src/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("."), ending).alias("path"), F.length("text").alias("length"), F.col("text").alias("content"))
    return extraction.read_files(f).select("repo", "path", F.length("content").alias("kept"))


def q49_fetched(spark: SparkSession, d: str) -> DataFrame:
    """SRC17, SRC18, UDF03, CTL01-05: distinct values asked once each through a client with retries, a rate and a breaker."""

    def make() -> Callable[[str], dict]:
        def call(v: str) -> dict:
            if v == "BUILDING":
                raise ValueError(v)
            return {"n": len(v)}

        return client.Client(call, retries=1, per_second=10_000.0)

    return client.fetched(table(spark, d, "customer"), "c_mktsegment", make, "n int")


# -- stored tables -------------------------------------------------------------------


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


def q50_appended(spark: SparkSession, d: str) -> DataFrame:
    """SNK02-04: two appends."""
    s = store.Store(spark, _folder(spark, "appended"), ["c_custkey"])
    s.append(_customers(spark, d).where("c_mktsegment = 'BUILDING'"))
    s.append(_customers(spark, d).where("c_mktsegment <> 'BUILDING'"))
    return s.read()


def q50_deleted(spark: SparkSession, d: str) -> DataFrame:
    """SNK07: what is left when the rows of some keys are taken out, and how many those were."""
    s = store.Store(spark, _folder(spark, "deleted"), ["c_custkey"])
    s.append(_customers(spark, d))
    gone = s.delete(_customers(spark, d).where("c_mktsegment = 'MACHINERY'"))
    return s.read().select("c_custkey", F.lit(gone).cast("long").alias("n_gone"))


def q50_retained(spark: SparkSession, d: str) -> DataFrame:
    """SNK08: rows of the last 365 days before a day."""
    s = store.Store(spark, _folder(spark, "retained"), ["o_orderkey"])
    s.append(table(spark, d, "orders").select("o_orderkey", "o_orderdate"))
    gone = s.retain("o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), 365)
    return s.read().select("o_orderkey", F.lit(gone).cast("long").alias("n_gone"))


def q51_table_counts(spark: SparkSession, d: str) -> DataFrame:
    """AGG29, SNK12."""
    return collections.table_counts({n: table(spark, d, n) for n in ALL_TABLES})


def q51_violations(spark: SparkSession, d: str) -> DataFrame:
    """SNK21: keys that a unique index would have refused."""
    return collections.unique_violations(table(spark, d, "evidence"), ["evidence_id"])


def q51_clustered(spark: SparkSession, d: str) -> DataFrame:
    """SNK21: rows read from files that are ranged and sorted by a key."""
    path = _folder(spark, "clustered")
    collections.write_clustered(table(spark, d, "orders"), path, ["o_orderdate"], 16)
    return spark.read.parquet(path).where(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-03-31").cast("timestamp_ntz"))).select("o_orderkey")


def q52_queue(spark: SparkSession, d: str) -> DataFrame:
    """SNK14, SNK15: rows put as JSON lines and taken by a reader."""
    path = _folder(spark, "queue")
    e = table(spark, d, "evidence").distinct().select("evidence_id", "dataset_name", "confidence_score_use")
    files.write_json_lines(e, path)
    return spark.read.schema("evidence_id long, dataset_name string, confidence_score_use double").json(path)


# -- mappings ------------------------------------------------------------------------


def q53_dimensions(spark: SparkSession, d: str) -> DataFrame:
    """PRJ01: publications as one origin gives them, mapped back."""
    p = valid_publications(spark, d, ["title", "doi", "type", "publication_year", "citation_count", "journals", "authors", "topics", "category_for"])
    person = lambda a: F.struct(a["id"].alias("researcher_id"), F.substring_index(a["name"], " ", 1).alias("first_name"), F.regexp_replace(a["name"], "^[^ ]* ?", "").alias("last_name"), F.array(a["orcid"]).alias("orcid"), a["institutions"].alias("affiliations"))
    j = F.try_element_at("journals", F.lit(1))
    rows = p.select("id", "title", "doi", "type", F.col("publication_year").alias("year"), F.col("citation_count").alias("times_cited"), F.when(j.isNotNull(), F.struct(j["id"].alias("id"), j["name"].alias("title"))).alias("journal"), F.transform(F.filter("authors", lambda a: a.isNotNull()), person).alias("authors"), F.transform(F.filter("topics", lambda t: t.isNotNull()), lambda t: F.struct(t["name"].alias("concept"), t["score"].alias("relevance"))).alias("concepts_scores"), "category_for", F.array(j["issn"]).alias("issn"))
    got = publications.map_dimensions(rows)
    return got.select("id", "title", "citation_count", F.size("journals").alias("n_journals"), F.size("authors").alias("n_authors"), F.try_element_at("authors", F.lit(1))["name"].alias("first_author"), F.try_element_at("topics", F.lit(1))["score"].alias("best"))


def q53_openalex(spark: SparkSession, d: str) -> DataFrame:
    """PRJ02: publications as the other origin gives them; ids come out of addresses."""
    p = valid_publications(spark, d, ["title", "doi", "type", "publication_year", "citation_count", "journals", "authors", "topics"])
    n = F.regexp_extract("id", r"(\d+)\s*$", 1)
    address = lambda letter: F.concat(F.lit(f"https://openalex.org/{letter}"), n)
    inst = F.array().cast("array<struct<id:string,display_name:string,country_code:string>>")
    rows = p.select(
        F.when(F.col("publication_year") >= 2015, address("W")).otherwise(F.lit("none")).alias("id"), "title", "doi", "type", "publication_year", F.col("citation_count").alias("cited_by_count"),
        F.transform(F.filter("authors", lambda a: a.isNotNull()), lambda a: F.struct(F.struct(address("A").alias("id"), a["name"].alias("display_name"), F.concat(F.lit("https://orcid.org/"), a["orcid"]).alias("orcid")).alias("author"), inst.alias("institutions"))).alias("authorships"),
        F.transform(F.filter("journals", lambda j: j.isNotNull()), lambda j: F.struct(F.struct(address("S").alias("id"), j["name"].alias("display_name"), j["issn"].alias("issn_l")).alias("source"))).alias("locations"),
        F.transform(F.filter("topics", lambda t: t.isNotNull()), lambda t: F.struct(t["id"].alias("id"), t["name"].alias("display_name"), t["score"].alias("score"))).alias("topics"),
    )
    got = publications.map_openalex(rows)
    return got.select("id", F.try_element_at("journals", F.lit(1))["id"].alias("journal_id"), F.size("authors").alias("n_authors"), F.try_element_at("authors", F.lit(1))["id"].alias("author_id"), F.try_element_at("authors", F.lit(1))["name"].alias("author"))


def q54_served(spark: SparkSession, d: str) -> DataFrame:
    """PRJ23, DQC13, FIL21: denormalised analyses that can be served, and the others with the reason."""
    rows = analyses.denormalised(valid_analyses(spark, d, ["publication_id", "workflow_status", "publication_metadata", "dataset_analysis"]).where("deleted_at is null"))
    good, bad = analyses.split_valid(rows)
    return good.select("analysis_id", F.lit(None).cast("string").alias("error")).unionByName(bad.select("analysis_id", "error"))


def q54_confidence(spark: SparkSession, d: str) -> DataFrame:
    """AGG18: mean of all confidences of an analysis."""
    rows = analyses.opened(valid_analyses(spark, d, ["dataset_analysis"]).where("deleted_at is null"))
    of = lambda part, kind: F.transform(analyses.some(F.col("_d")[part], kind), lambda x: x["confidence"])
    both = F.concat(of("validated_datasets", analyses.ITEM), of("newly_discovered_datasets", analyses.ITEM))
    return rows.select("analysis_id", F.round(analyses.overall_confidence(both, of("dataset_joins", analyses.JOIN), F.array().cast("array<double>")), 6).alias("confidence"))


def _snippets(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each publication as snippets and links."""
    s = F.struct(F.col("text").alias("content"), F.col("lang").alias("language"), F.col("section").alias("context"), (F.col("n_chars") % 13).cast("double").alias("relevance_score"))
    link = F.struct(F.concat(F.lit("https://"), F.col("source"), F.lit(".org/"), F.col("doc_id").cast("string")).alias("url"), F.col("section").alias("link_type"), F.lit("t").alias("title"), (F.col("doc_id") % 2 == 0).alias("is_accessible"), (F.col("n_chars") % 13).cast("double").alias("relevance_score"))
    return table(spark, d, "documents").where("publication_id is not null").groupBy("publication_id").agg(F.collect_list(s).alias("snippets"), F.collect_list(link).alias("links"))


def q55_code_parts(spark: SparkSession, d: str) -> DataFrame:
    """PRJ19."""
    c = _snippets(spark, d).select("publication_id", analyses.code_part(F.col("snippets")).alias("c"))
    return c.select("publication_id", "c.n_snippets", F.array_join("c.languages", ",").alias("languages"), F.round("c.mean_relevance", 6).alias("mean_relevance"))


def q55_link_parts(spark: SparkSession, d: str) -> DataFrame:
    """PRJ20, AGG16."""
    c = _snippets(spark, d).select("publication_id", analyses.link_part(F.col("links"), F.lit(None).cast(analyses.REPO)).alias("c"))
    return c.select("publication_id", "c.n_links", "c.n_accessible", F.array_join("c.link_types", ",").alias("link_types"))


def q55_issues(spark: SparkSession, d: str) -> DataFrame:
    """DQC07, DQC08: what is wrong with them."""
    s = _snippets(spark, d)
    count = lambda c, kind: F.size(F.filter(c, lambda i: i["type"] == kind)).alias(f"n_{kind}")
    s = s.select("publication_id", quality.snippet_issues(F.col("snippets")).alias("a"), quality.link_issues(F.col("links"), F.lit(None).cast(analyses.REPO)).alias("b"))
    return s.select("publication_id", count("a", "short_code"), count("a", "missing_language"), count("a", "score_range"), count("b", "bad_url"))


def q56_serialised(spark: SparkSession, d: str) -> DataFrame:
    """PRJ29, PRJ35, PRJ36: joins as JSON documents; two fields read back."""
    j = collections.serialised(table(spark, d, "dataset_joins").distinct(), "join_id")
    return j.select("join_id", F.get_json_object("document", "$.dataset1").alias("dataset1"), F.get_json_object("document", "$.join_type").alias("join_type"))


def q56_stored(spark: SparkSession, d: str) -> DataFrame:
    """PRJ34, PRJ37: into a document store's form and back."""
    e = collections.stored_form(table(spark, d, "evidence").select("evidence_id", "dataset_id").distinct(), "evidence_id")
    return collections.loaded_form(e, "evidence_id")


def q57_progress(spark: SparkSession, d: str) -> DataFrame:
    """WIN04, CTL15: events of users as the steps of workflows."""
    log = table(spark, d, "events").select(F.col("user_id").alias("workflow_id"), F.col("event_id").alias("step"), (F.col("event_type") == "purchase").alias("completed"))
    return collections.progress_by_step(log).select("workflow_id", "step", "n_completed", "percentage")


def q58_code_summary(spark: SparkSession, d: str) -> DataFrame:
    """AGG15."""
    r = table(spark, d, "documents").where("lang is not null and section is not null and source is not null")
    return collections.code_summary(r.select(F.col("lang").alias("language"), F.col("section").alias("purpose"), F.col("source").alias("implementation_type"), (F.col("n_chars") % 11).cast("double").alias("relevance_score")))


def q58_known(spark: SparkSession, d: str) -> DataFrame:
    """AGG26."""
    return collections.known_counts(table(spark, d, "evidence").select("evidence_id", "dataset_id").distinct())


def q59_to_flatten(spark: SparkSession, d: str) -> DataFrame:
    """FIL25: work in progress whose publication didn't fail."""
    p = valid_publications(spark, d, ["sync_elastic", "publication_year"])
    return collections.to_flatten(p.select("id", F.when(F.col("publication_year") >= 2015, "PROCESSING").otherwise("DONE").alias("status")), p).select("id")


def q60_addable(spark: SparkSession, d: str) -> DataFrame:
    """DED12."""
    new = table(spark, d, "additional_discovered_datasets").where("dataset_name is not null").select("dataset_id", "dataset_name")
    return registry.addable(new, table(spark, d, "seed_datasets"))


def q60_first_known(spark: SparkSession, d: str) -> DataFrame:
    """JOI11."""
    return registry.first_known(table(spark, d, "evidence").where("dataset_name is not null"), table(spark, d, "seed_datasets"), "dataset_name")


def q60_batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    """CTL10: all dyads looked up in one join."""
    return collections.asked_at_once(table(spark, d, "data_dyads").where("alias is not null").select(F.col("dyad_id").alias("query_id"), "alias").distinct(), table(spark, d, "seed_datasets"))


def q61_combined(spark: SparkSession, d: str) -> DataFrame:
    """JOI17, FIL10: findings less the rejected, with confident others."""
    e = table(spark, d, "evidence").where("publication_id is not null and dataset_id is not null")
    key = ["publication_id", "dataset_id"]
    found = e.where("match_type in ('exact', 'alias')").select(*key).distinct()
    extra = e.where("match_type = 'fuzzy'").select(*key, (F.col("confidence_score_use") / 10).alias("confidence"))
    return extraction.combined(found, e.where("dataset_usage_status = 'none'").select(*key), extra, key)


def q61_judged(spark: SparkSession, d: str) -> DataFrame:
    """JOI12, JOI13: each dataset of a publication with its first judgement."""
    e = table(spark, d, "evidence").where("publication_id is not null and dataset_id is not null and dataset_usage_status is not null").distinct()
    found = table(spark, d, "evidence").where("publication_id is not null and dataset_id is not null").select("publication_id", "dataset_id").distinct()
    return extraction.judged(found, e.select("publication_id", "dataset_id", F.col("evidence_id").alias("pos"), F.col("dataset_usage_status").alias("status")), ["publication_id", "dataset_id"])


def _institutions(spark: SparkSession, d: str) -> DataFrame:
    i = valid_publications(spark, d, ["authors"]).select(F.explode("authors").alias("a")).select(F.explode("a.institutions").alias("i")).where("i.id is not null")
    return i.groupBy(F.col("i.id").alias("id")).agg(*[F.max(f"i.{c}").alias(c) for c in ("country", "state", "city", "country_code")])


def q62_institutions(spark: SparkSession, d: str) -> DataFrame:
    """FIL17."""
    return publications.find_institutions(_institutions(spark, d), code="us", city="o").select("id")


def q62_authors(spark: SparkSession, d: str) -> DataFrame:
    """FIL18: by iD, for each way in which the first one is typed most."""
    a = table(spark, d, "authors").where("orcid is not null")
    typed = a.groupBy("orcid").agg(F.countDistinct("author_id").alias("n")).orderBy(F.desc("n"), "orcid").first()
    return collections.find_authors(a.select("author_id", "orcid").distinct(), orcid=typed["orcid"] if typed else "").select("author_id", "score")


def q62_top_journals(spark: SparkSession, d: str) -> DataFrame:
    """SRT01: the ten most cited journals."""
    return rollups.ranked(rollups.citations_by(valid_publications(spark, d, ["citation_count", "journals"]), "journals")).limit(10)


# -- values --------------------------------------------------------------------------


def q63_ids(spark: SparkSession, d: str) -> DataFrame:
    """STR09, STR10."""
    a = table(spark, d, "authors").select("author_id", "first_name", "last_name", "orcid").distinct()
    return a.select("author_id", text.full_name(F.col("first_name"), F.col("last_name")).alias("name"), text.orcid_of(F.col("orcid")).alias("orcid"), text.entity_id(F.concat(F.lit("https://openalex.org/A"), F.col("author_id")), "author").alias("entity"))


def q63_enums(spark: SparkSession, d: str) -> DataFrame:
    """STR27."""
    return table(spark, d, "evidence").select("evidence_id", "match_type").distinct().select("evidence_id", scores.one_of(F.col("match_type"), ["exact", "alias"]).alias("kind"))


def q64_times(spark: SparkSession, d: str) -> DataFrame:
    """DAT02: ISO times of all forms."""
    return table(spark, d, "analyses").select("analysis_id", "analysis_timestamp").distinct().select("analysis_id", F.date_format(values.iso_time(F.col("analysis_timestamp")), "yyyy-MM-dd HH:mm:ss").alias("at"))


def q64_lags(spark: SparkSession, d: str) -> DataFrame:
    """DAT01, DAT03: when evidence was made, and how late it came."""
    e = table(spark, d, "evidence").select("evidence_id", "created_at", "ingested_at").distinct()
    return e.select("evidence_id", values.iso_text(F.col("created_at")).alias("made"), values.seconds_between(F.col("created_at"), F.col("ingested_at")).alias("lag"))


def q65_hashes(spark: SparkSession, d: str) -> DataFrame:
    """HSH02, HSH03."""
    j = table(spark, d, "dataset_joins").distinct()
    return j.select("join_id", values.group_id(F.col("join_type")).alias("group_id"), values.stable_id(F.col("publication_id"), F.col("dataset1"), F.col("dataset2")).alias("stable_id"))


def q66_mention_counts(spark: SparkSession, d: str) -> DataFrame:
    """MAP01: how often each dataset is mentioned in a publication."""
    p = valid_publications(spark, d, ["mentioned_datasets"])
    m = values.counts_map(F.transform("mentioned_datasets", lambda m: norm_key(m["id"])))
    return p.select("id", F.explode(m).alias("dataset_id", "n"))


def q66_map_values(spark: SparkSession, d: str) -> DataFrame:
    """MAP01: a field of a map, or a default."""
    return table(spark, d, "events").select("event_id", values.map_value(F.create_map(F.col("event_type"), F.col("value")), "click", 0.0).alias("clicked"))


def q67_plain_numbers(spark: SparkSession, d: str) -> DataFrame:
    """JSN09."""
    odd = F.when(F.col("evidence_id") % 7 == 0, F.lit(float("nan"))).when(F.col("evidence_id") % 7 == 1, F.lit(float("inf"))).otherwise(F.col("confidence_score_use"))
    return values.plain_numbers(table(spark, d, "evidence").select("evidence_id", "confidence_score_use").distinct().select("evidence_id", odd.alias("score")))


def q68_prompts(spark: SparkSession, d: str) -> DataFrame:
    """STR23, UDF11: a prompt for each document."""
    shown = text.render(service.PROMPTS["discovery"], datasets=F.col("section"), text=F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(shown).alias("prompt"))


def q69_join_answers(spark: SparkSession, d: str) -> DataFrame:
    """JSN04: joins written as a model would, and read again."""
    j = table(spark, d, "dataset_joins").distinct()
    answer = F.concat(F.lit("The joins are "), F.to_json(F.struct(F.array(F.struct("dataset1", "dataset2", "join_type", F.col("confidence_score").cast("string").alias("confidence"))).alias("joins"))), F.lit(" as asked."))
    return j.select("join_id", F.explode(responses.joins(answer)).alias("j")).select("join_id", "j.dataset1", "j.dataset2", "j.join_type", "j.confidence")


def q69_methodologies(spark: SparkSession, d: str) -> DataFrame:
    """JSN05."""
    j = table(spark, d, "dataset_joins").distinct()
    m = responses.methodology(F.concat(F.lit("Sure: "), F.to_json(F.struct(F.col("methodology").alias("approach"), "join_keys"))))
    return j.select("join_id", m.alias("m")).select("join_id", "m.approach", F.size("m.join_keys").alias("n_keys"), F.size("m.validation_methods").alias("n_validations"))


def q69_challenges(spark: SparkSession, d: str) -> DataFrame:
    """JSN06: items that are objects or plain texts."""
    j = table(spark, d, "dataset_joins").where("join_type is not null").distinct()
    answer = F.concat(F.lit('{"challenges": [{"description": "'), "join_type", F.lit('", "severity": "high"}, "'), "join_type", F.lit('"]}'))
    got = j.select("join_id", F.posexplode(responses.challenge_items(answer)).alias("pos", "c"))
    return got.select("join_id", "pos", "c.description", "c.severity")


def q69_alignments(spark: SparkSession, d: str) -> DataFrame:
    """JSN07: scores held within bounds, five signals at most."""
    e = table(spark, d, "evidence").select("evidence_id", "text_position").distinct()
    signals = F.transform(F.sequence(F.lit(1), (F.col("evidence_id") % 8 + 1).cast("int")), lambda i: F.concat(F.lit("s"), i))
    a = responses.alignment(F.to_json(F.struct((F.col("text_position") % 30 - 10).cast("string").alias("alignment_score"), signals.alias("signals"))))
    return e.select("evidence_id", a.alias("a")).select("evidence_id", "a.score", F.size("a.signals").alias("n_signals"))


# -- streams and workflows -----------------------------------------------------------


def _synced(spark: SparkSession, d: str) -> tuple[sync.Sync, DataFrame]:
    source = materialise(table(spark, d, "analyses").select("analysis_id", "publication_id", "workflow_status", "updated_at"), "stream")
    job = sync.Sync(spark, _folder(spark, "sync"), "analysis_id", "updated_at", F.col("publication_id").isNotNull() & F.col("workflow_status").isNotNull())
    job.run(source.inputFiles()[0].rsplit("/", 1)[0], source.schema)
    return job, source


def q70_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """SNK19, FIL27: rows that couldn't be served, one per key."""
    dead = _synced(spark, d)[0].dead.read()
    empty = spark.createDataFrame([], "analysis_id string, error_type string, attempts int, batch int")
    return sync.dead_letter_list(empty if dead is None else dead, "serialization", limit=None).select("analysis_id", "error_type", "attempts")


def q70_status(spark: SparkSession, d: str) -> DataFrame:
    """STM11, SNK20, WIN03: rows served and failed, and the last status."""
    return _synced(spark, d)[0].status().select("n_served", "n_failed", "last_status")


def q70_retried(spark: SparkSession, d: str) -> DataFrame:
    """STM14: dead letters mended and tried again; keys that are served then."""
    job, source = _synced(spark, d)
    job.retry(lambda rows: rows.withColumns({c: F.coalesce(c, F.lit("mended")) for c in ("publication_id", "workflow_status")}), source.schema)
    return job.served.read().select("analysis_id")


def q71_mention_state(spark: SparkSession, d: str) -> DataFrame:
    """STM07: distinct mentions of each publication, held as the state of a stream."""
    rows = table(spark, d, "evidence").where("publication_id is not null and dataset_id is not null").select("publication_id", "dataset_id")
    source, out = materialise(rows, "mentions"), _folder(spark, "counted")
    stream = mentions.accumulated(spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0]))
    q = stream.writeStream.outputMode("update").option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema("publication_id string, n_mentions int, new_mentions int").parquet(out).groupBy("publication_id").agg(F.max("n_mentions").alias("n_mentions"))


def q71_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    """STM16: every event put twice, taken once."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    source, out = materialise(e.unionByName(e), "events"), _folder(spark, "distinct")
    stream = sync.deduplicated(spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1000).parquet(source.inputFiles()[0].rsplit("/", 1)[0]), "event_id", "ts", "3650 days")
    q = stream.writeStream.option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).format("parquet").option("path", out).start()
    q.awaitTermination()
    return spark.read.schema("event_id long, ts timestamp").parquet(out).select("event_id")


def q72_workflow(spark: SparkSession, d: str) -> DataFrame:
    """UDF01, UDF02, UDF04-10: triage, validation, discovery and joins from a table of responses, one row per publication."""
    e = table(spark, d, "evidence").where("publication_id is not null").distinct()
    j = table(spark, d, "dataset_joins").where("publication_id is not null").distinct()
    per = lambda rows, item: rows.groupBy("publication_id").agg(F.collect_list(item).alias("items"))
    known = per(e.where("dataset_id is not null"), F.struct(F.col("dataset_id").alias("name"), F.lit("true").alias("mentioned"), (F.col("dataset_usage_status") == "analyzed").cast("string").alias("used")))
    new = per(e.where("dataset_id is null and dataset_name is not null"), F.struct(F.col("dataset_name").alias("name")))
    said = [
        e.select("publication_id").distinct().select("publication_id", F.lit("triage").alias("step"), F.lit('{"is_data_analysis": true, "confidence": 7}').alias("response")),
        known.select("publication_id", F.lit("validation").alias("step"), F.concat(F.lit("Here: "), F.to_json("items")).alias("response")),
        new.select("publication_id", F.lit("discovery").alias("step"), F.to_json(F.struct(F.col("items").alias("datasets"))).alias("response")),
        per(j, F.struct("dataset1", "dataset2", "join_type")).select("publication_id", F.lit("joins").alias("step"), F.to_json(F.struct(F.col("items").alias("joins"))).alias("response")),
    ]
    answers = materialise(said[0].unionByName(said[1]).unionByName(said[2]).unionByName(said[3]), "answers")
    flow = workflow.Workflow()
    flow.register("triage", workflow.response_step(answers, "triage"))
    flow.register("validation", workflow.gated(workflow.response_step(answers, "validation", responses.validations), "triage.confidence >= 6", "validation"))
    flow.register("discovery", workflow.response_step(answers, "discovery", responses.discoveries))
    flow.register("joins", workflow.response_step(answers, "joins", responses.joins))
    got = flow.run(e.select("publication_id").distinct())
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return got.select("publication_id", size("validation").alias("n_validated"), size("discovery").alias("n_discovered"), size("joins").alias("n_joins"), F.round("progress", 4).alias("progress"))


QUERIES: dict[str, Query] = {k: v for k, v in globals().items() if k.startswith("q") and callable(v) and k[1:3].isdigit()}

# -- the same in SQL -----------------------------------------------------------------

_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({})), '\([^)]*\)', '', 'g'), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g'))"
_SNIPPETS = """s AS (SELECT publication_id, count(*) AS n, list_sort(list_distinct(list(lang) FILTER (lang <> ''))) AS langs, list_sort(list_distinct(list(section) FILTER (section <> ''))) AS sections, avg(CAST(n_chars % 13 AS DOUBLE)) AS mean, count(*) FILTER (doc_id % 2 = 0) AS even,
  count(*) FILTER (length(trim(coalesce(text, ''), ' ')) < 10) AS short, count(*) FILTER (trim(coalesce(lang, ''), ' ') = '') AS nolang, count(*) FILTER (n_chars % 13 > 10) AS over, count(*) FILTER (source IS NULL) AS nourl, count(source) AS urls FROM documents WHERE publication_id IS NOT NULL GROUP BY 1)"""
_E = "e AS (SELECT DISTINCT * FROM evidence)"

ORACLE = {
    "q45_csv_registry": f"""WITH names AS (SELECT dataset_id, 0 AS pos, dataset_name AS alias FROM seed_datasets UNION ALL SELECT dataset_id, i, l[i] FROM (SELECT dataset_id, list_filter(list_transform(string_split(coalesce(aliases, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS l FROM seed_datasets), generate_series(1, 60) AS g(i) WHERE i <= len(l))
      SELECT {_PLAIN.format("alias")} AS norm, arg_min(dataset_id, (dataset_id, pos)) AS dataset_id FROM names WHERE alias IS NOT NULL GROUP BY 1""",
    "q45_csv_pairs": "SELECT dataset_id AS validated_dataset_id, count(*) AS n, count(*) FILTER (dataset_usage_status = 'analyzed') AS n_used, CAST(sum(nullif(length(validation_reasoning), 0)) AS BIGINT) AS n_reasoning, round(sum(confidence_score_mention), 4) AS mention FROM evidence WHERE dataset_id IS NOT NULL GROUP BY 1",
    "q45_csv_discovered": "SELECT publication_id, count(*) AS n, CAST(sum(nullif(length(dataset_name), 0)) AS BIGINT) AS n_name, CAST(sum(nullif(length(context), 0)) AS BIGINT) AS n_description FROM evidence WHERE dataset_id IS NULL GROUP BY 1",
    "q46_fulltexts": "SELECT CAST(doc_id AS VARCHAR) AS publication_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents",
    "q46_fulltext": "SELECT CAST(doc_id AS VARCHAR) AS publication_id, md5(text) AS md5 FROM documents WHERE doc_id = 17",
    "q46_batches": "SELECT count(*) AS n_rows, true AS bounded, true AS \"full\" FROM documents",
    "q47_parsed": f"WITH {_LIVE}, {_ITEMS} SELECT analysis_id, TRY_CAST(json_extract_string(j, '$.summary.total_validated_datasets') AS INTEGER) AS total_validated_datasets, TRY_CAST(json_extract_string(j, '$.summary.total_unique_datasets') AS INTEGER) AS total_unique_datasets FROM o6 WHERE json_valid(j) AND json_type(j) = 'OBJECT'",
    "q48_by_id": "SELECT * FROM orders WHERE o_orderkey = 7",
    "q48_by_keys": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "q48_catalogue": "SELECT dataset_id, false AS has_references FROM seed_datasets WHERE group_name IN ('Work and Mobility', 'Land and Water Records')",
    "q49_read_files": """WITH f AS (SELECT source AS repo, 'src/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.' || ['py', 'R', 'csv', 'ipynb'][CAST(doc_id % 4 + 1 AS INTEGER)] AS path, length(text) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND doc_id % 4 <> 2 AND length(text) <= 262144)
      SELECT repo, path, CAST(least(n, 8000) AS INTEGER) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn FROM f) WHERE rn <= 100""",
    "q49_fetched": "SELECT DISTINCT c_mktsegment, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(length(c_mktsegment) AS INTEGER) END AS n, CASE WHEN c_mktsegment = 'BUILDING' THEN 'ValueError' END AS error FROM customer WHERE c_mktsegment IS NOT NULL",
    "q50_appended": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL",
    "q50_deleted": "SELECT c_custkey, (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY') AS n_gone FROM customer WHERE c_mktsegment <> 'MACHINERY' OR c_mktsegment IS NULL",
    "q50_retained": "SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY) AS n_gone FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAY OR o_orderdate IS NULL",
    "q51_table_counts": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ALL_TABLES),
    "q51_violations": "SELECT evidence_id, count(*) AS n FROM evidence GROUP BY 1 HAVING count(*) > 1",
    "q51_clustered": "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-03-31'",
    "q52_queue": f"WITH {_E} SELECT evidence_id, dataset_name, confidence_score_use FROM e",
    "q53_dimensions": f"""WITH {_PUBS}, p AS (SELECT *, list_filter(authors, lambda a: a IS NOT NULL) AS people, list_filter(topics, lambda t: t IS NOT NULL) AS ts FROM pubs)
      SELECT id, coalesce(title, '') AS title, citation_count, CAST(journals[1] IS NOT NULL AS INTEGER) AS n_journals, CAST(CASE WHEN authors IS NOT NULL THEN len(people) END AS INTEGER) AS n_authors, CASE WHEN len(people) > 0 THEN trim(coalesce(people[1].name, ''), ' ') END AS first_author, list_max(list_transform(ts, lambda t: t.score)) AS best FROM p""",
    "q53_openalex": rf"""WITH {_PUBS}, p AS (SELECT *, regexp_extract(id, '(\d+)\s*$', 1) AS n, list_filter(authors, lambda a: a IS NOT NULL) AS people, list_filter(journals, lambda a: a IS NOT NULL) AS js FROM pubs WHERE publication_year >= 2015)
      SELECT 'W' || n AS id, CASE WHEN len(js) > 0 THEN 'S' || n END AS journal_id, CAST(CASE WHEN authors IS NOT NULL THEN len(people) END AS INTEGER) AS n_authors, CASE WHEN len(people) > 0 THEN 'A' || n END AS author_id, people[1].name AS author FROM p WHERE n <> ''""",
    "q54_served": f"""WITH {_LIVE} SELECT analysis_id, CASE WHEN coalesce(publication_metadata.publication_id, publication_id, '') = '' THEN 'no publication_id' WHEN workflow_status IS NULL THEN 'no workflow_status' END AS error FROM live""",
    "q54_confidence": f"WITH {_LIVE}, {_ITEMS}, c AS (SELECT analysis_id, avg(TRY_CAST(x ->> '$.confidence' AS DOUBLE)) AS c FROM items GROUP BY 1) SELECT live.analysis_id, round(coalesce(c, 0.0), 6) AS confidence FROM live LEFT JOIN c USING (analysis_id)",
    "q55_code_parts": f"WITH {_SNIPPETS} SELECT publication_id, CAST(n AS INTEGER) AS n_snippets, coalesce(array_to_string(langs, ','), '') AS languages, round(coalesce(mean, 0.0), 6) AS mean_relevance FROM s",
    "q55_link_parts": f"WITH {_SNIPPETS} SELECT publication_id, CAST(n AS INTEGER) AS n_links, CAST(even AS INTEGER) AS n_accessible, coalesce(array_to_string(sections, ','), '') AS link_types FROM s",
    "q55_issues": f"WITH {_SNIPPETS} SELECT publication_id, CAST(short AS INTEGER) AS n_short_code, CAST(nolang AS INTEGER) AS n_missing_language, CAST(over AS INTEGER) AS n_score_range, CAST(nourl AS INTEGER) AS n_bad_url FROM s",
    "q56_serialised": "SELECT join_id, dataset1, join_type FROM (SELECT DISTINCT * FROM dataset_joins)",
    "q56_stored": "SELECT DISTINCT CAST(evidence_id AS VARCHAR) AS evidence_id, dataset_id FROM evidence WHERE evidence_id IS NOT NULL",
    "q57_progress": "SELECT user_id AS workflow_id, event_id AS step, n AS n_completed, round(n * 100.0 / 7, 6) AS percentage FROM (SELECT user_id, event_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)",
    "q58_code_summary": """WITH r AS (SELECT lang, section, source, CAST(n_chars % 11 AS DOUBLE) AS s FROM documents WHERE lang IS NOT NULL AND section IS NOT NULL AND source IS NOT NULL)
      SELECT CASE WHEN grouping(lang) = 0 THEN 'language' WHEN grouping(section) = 0 THEN 'purpose' WHEN grouping(source) = 0 THEN 'implementation_type' ELSE 'total' END AS "by", coalesce(lang, section, source) AS value, count(*) AS n, round_even(avg(s), 2) AS mean_relevance, round_even(count(*) FILTER (s >= 7) * 100.0 / count(*), 1) AS high_relevance FROM r GROUP BY GROUPING SETS ((lang), (section), (source), ())""",
    "q58_known": "SELECT count(dataset_id) AS n_known, count(*) FILTER (dataset_id IS NULL) AS n_unknown FROM (SELECT DISTINCT evidence_id, dataset_id FROM evidence)",
    "q59_to_flatten": f"WITH {_PUBS} SELECT id FROM pubs WHERE publication_year >= 2015 AND coalesce(sync_elastic, true)",
    "q60_addable": "SELECT dataset_name, min(dataset_id) AS dataset_id FROM additional_discovered_datasets WHERE dataset_name IS NOT NULL AND dataset_name NOT IN (SELECT dataset_name FROM seed_datasets WHERE dataset_name IS NOT NULL) GROUP BY 1",
    "q60_first_known": "WITH i AS (SELECT dataset_id, lower(dataset_name) AS k FROM seed_datasets UNION SELECT dataset_id, lower(trim(unnest(string_split(aliases, ';')))) FROM seed_datasets), k AS (SELECT k, min(dataset_id) AS dataset_id FROM i WHERE k <> '' GROUP BY 1) SELECT DISTINCT dataset_name AS name, k.dataset_id FROM evidence LEFT JOIN k ON lower(dataset_name) = k.k WHERE dataset_name IS NOT NULL",
    "q60_batch_lookup": "WITH i AS (SELECT dataset_id, lower(dataset_name) AS k FROM seed_datasets UNION SELECT dataset_id, lower(trim(unnest(string_split(aliases, ';')))) FROM seed_datasets) SELECT DISTINCT dyad_id AS query_id, i.dataset_id FROM data_dyads JOIN i ON lower(alias) = k WHERE k <> ''",
    "q61_combined": """WITH e AS (SELECT * FROM evidence WHERE publication_id IS NOT NULL AND dataset_id IS NOT NULL), r AS (SELECT publication_id, dataset_id FROM e WHERE dataset_usage_status = 'none'),
      k AS (SELECT DISTINCT publication_id, dataset_id FROM e WHERE match_type IN ('exact', 'alias') EXCEPT SELECT * FROM r) SELECT * FROM k UNION SELECT publication_id, dataset_id FROM e WHERE match_type = 'fuzzy' AND confidence_score_use / 10 >= 0.7""",
    "q61_judged": f"""WITH {_E}, p AS (SELECT DISTINCT publication_id, dataset_id FROM e WHERE publication_id IS NOT NULL AND dataset_id IS NOT NULL), j AS (SELECT publication_id, dataset_id, arg_min(dataset_usage_status, evidence_id) AS status FROM e WHERE dataset_usage_status IS NOT NULL GROUP BY ALL)
      SELECT p.publication_id, p.dataset_id, status FROM p LEFT JOIN j USING (publication_id, dataset_id)""",
    "q62_institutions": f"""WITH {_PUBS}, i AS (SELECT unnest(a.institutions) AS i FROM (SELECT unnest(authors) AS a FROM pubs)), g AS (SELECT i.id AS id, max(i.city) AS city, max(i.country_code) AS cc FROM i WHERE i.id IS NOT NULL GROUP BY 1) SELECT id FROM g WHERE upper(cc) = 'US' AND contains(lower(city), 'o') ORDER BY id LIMIT 100""",
    "q62_authors": "SELECT DISTINCT author_id, CAST(1.0 AS DOUBLE) AS score FROM authors WHERE orcid = (SELECT orcid FROM authors WHERE orcid IS NOT NULL GROUP BY orcid ORDER BY count(DISTINCT author_id) DESC, orcid LIMIT 1) ORDER BY author_id LIMIT 100",
    "q62_top_journals": f"WITH {_PUBS}, r AS (SELECT DISTINCT id, citation_count, x.name AS name FROM (SELECT id, citation_count, unnest(journals) AS x FROM pubs) WHERE x.name IS NOT NULL) SELECT name, count(*) AS n_publications, CAST(coalesce(sum(citation_count), 0) AS BIGINT) AS total_citations FROM r GROUP BY 1 ORDER BY total_citations DESC, name LIMIT 10",
    "q63_ids": r"SELECT DISTINCT author_id, trim(concat_ws(' ', first_name, last_name), ' ') AS name, regexp_extract(orcid, '\d{4}-\d{4}-\d{4}-\d{4}') AS orcid, regexp_extract('https://openalex.org/A' || author_id, 'A\d+') AS entity FROM (SELECT DISTINCT author_id, first_name, last_name, orcid FROM authors)",
    "q63_enums": "SELECT DISTINCT evidence_id, CASE WHEN lower(match_type) IN ('exact', 'alias') THEN lower(match_type) ELSE 'other' END AS kind FROM evidence",
    "q64_times": "SELECT analysis_id, strftime(TRY_CAST(regexp_replace(analysis_timestamp, 'Z$', '+00:00') AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT DISTINCT analysis_id, analysis_timestamp FROM analyses)",
    "q64_lags": "SELECT DISTINCT evidence_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS made, (epoch_us(ingested_at) - epoch_us(created_at)) / 1e6 AS lag FROM evidence",
    "q65_hashes": "SELECT join_id, sha256(join_type) AS group_id, sha256(coalesce(publication_id, chr(0)) || chr(31) || coalesce(dataset1, chr(0)) || chr(31) || coalesce(dataset2, chr(0))) AS stable_id FROM (SELECT DISTINCT * FROM dataset_joins)",
    "q66_mention_counts": rf"WITH {_PUBS} SELECT id, lower(trim(m.id, E' \t\n\r')) AS dataset_id, CAST(count(*) AS INTEGER) AS n FROM (SELECT id, unnest(mentioned_datasets) AS m FROM pubs) WHERE trim(m.id, E' \t\n\r') <> '' GROUP BY ALL",
    "q66_map_values": "SELECT event_id, CASE WHEN event_type = 'click' THEN coalesce(value, 0.0) ELSE 0.0 END AS clicked FROM events",
    "q67_plain_numbers": "SELECT DISTINCT evidence_id, CASE WHEN evidence_id % 7 > 1 THEN confidence_score_use END AS score FROM evidence",
    "q68_prompts": "SELECT doc_id, md5(replace('" + service.PROMPTS["discovery"].replace("'", "''").replace("{datasets}", "' || coalesce(section, '') || '").replace("{text}", "' || coalesce(text, '') || '") + "', chr(0) || 'never', '')) AS prompt FROM documents",
    "q69_join_answers": "SELECT join_id, dataset1, dataset2, join_type, coalesce(confidence_score, 0.0) AS confidence FROM (SELECT DISTINCT * FROM dataset_joins) WHERE trim(dataset1, ' ') <> '' AND trim(dataset2, ' ') <> '' AND dataset1 <> dataset2",
    "q69_methodologies": "SELECT join_id, methodology AS approach, CAST(coalesce(len(join_keys), 0) AS INTEGER) AS n_keys, CAST(0 AS INTEGER) AS n_validations FROM (SELECT DISTINCT * FROM dataset_joins)",
    "q69_challenges": "SELECT join_id, CAST(pos AS INTEGER) AS pos, join_type AS description, CASE pos WHEN 0 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT DISTINCT * FROM dataset_joins), generate_series(0, 1) AS g(pos) WHERE join_type IS NOT NULL",
    "q69_alignments": "SELECT DISTINCT evidence_id, CAST(greatest(0.0, least(10.0, coalesce(text_position % 30 - 10, 0))) AS DOUBLE) AS score, CAST(least(evidence_id % 8 + 1, 5) AS INTEGER) AS n_signals FROM evidence",
    "q70_dead_letters": "SELECT DISTINCT coalesce(analysis_id, '') AS analysis_id, 'serialization' AS error_type, CAST(1 AS INTEGER) AS attempts FROM analyses WHERE publication_id IS NULL OR workflow_status IS NULL",
    "q70_status": "SELECT count(*) FILTER (publication_id IS NOT NULL AND workflow_status IS NOT NULL) AS n_served, count(*) FILTER (publication_id IS NULL OR workflow_status IS NULL) AS n_failed, CASE WHEN count(*) FILTER (publication_id IS NULL OR workflow_status IS NULL) = 0 THEN 'success' ELSE 'partial' END AS last_status FROM analyses",
    "q70_retried": "SELECT DISTINCT analysis_id FROM analyses WHERE analysis_id IS NOT NULL",
    "q71_mention_state": "SELECT publication_id, CAST(count(DISTINCT dataset_id) AS INTEGER) AS n_mentions FROM evidence WHERE publication_id IS NOT NULL AND dataset_id IS NOT NULL GROUP BY 1",
    "q71_deduplicated": "SELECT event_id FROM events",
    "q72_workflow": f"""WITH {_E}, p AS (SELECT publication_id, count(dataset_id) AS v, count(*) FILTER (dataset_id IS NULL AND trim(dataset_name, ' ') <> '') AS n FROM e WHERE publication_id IS NOT NULL GROUP BY 1), j AS (SELECT publication_id, count(*) AS n FROM (SELECT DISTINCT * FROM dataset_joins) WHERE trim(dataset1, ' ') <> '' AND trim(dataset2, ' ') <> '' AND dataset1 <> dataset2 GROUP BY 1)
      SELECT p.publication_id, CAST(v AS INTEGER) AS n_validated, CAST(p.n AS INTEGER) AS n_discovered, CAST(coalesce(j.n, 0) AS INTEGER) AS n_joins, round(400.0 / 7, 4) AS progress FROM p LEFT JOIN j USING (publication_id)""",
}
