"""Queries over the registry, publications and evidence, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import clean_doi, edge_ngrams, plain_name, quoted, slug, usage_status
from citeloom.operators import catalog, mentions, publications, registry, relationships, rollups
from citeloom.operators.versions import latest_version
from citeloom.plans.records import valid_publications
from citeloom.sources.tables import norm_key, table

Query = Callable[[SparkSession, str], DataFrame]


def full_registry(spark: SparkSession, d: str) -> DataFrame:
    cols = ["dataset_id", "dataset_name", "aliases"]
    more = table(spark, d, "additional_discovered_datasets").where("deleted_at is null").select(*cols).distinct()
    return registry.ordered_union(table(spark, d, "seed_datasets").select(*cols), more)


def _evidence(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Evidence without repeats of a row, of the columns that are asked for; the scan reads no others."""
    return table(spark, d, "evidence").select("evidence_id", *cols).distinct()


def _joins(spark: SparkSession, d: str) -> DataFrame:
    joins = table(spark, d, "dataset_joins").select("join_id", "publication_id", "dataset1", "dataset2", "join_type", "confidence_score", "join_keys", "methodology").distinct()
    return relationships.distinct_pairs(relationships.well_formed(joins, 2.0))


def q01_alias_index(spark: SparkSession, d: str) -> DataFrame:
    return registry.alias_index(full_registry(spark, d)).select("norm", "dataset_id")


def q02_resolved_names(spark: SparkSession, d: str) -> DataFrame:
    return registry.match_names(table(spark, d, "evidence"), full_registry(spark, d), "dataset_name")


def q02_unregistered(spark: SparkSession, d: str) -> DataFrame:
    return registry.unregistered(table(spark, d, "evidence"), full_registry(spark, d), "dataset_name", "evidence_id")


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d, "dataset_id", "doi", "publication_id", "validation_reasoning", "confidence_score_mention", "confidence_score_use", "dataset_usage_status")
    rows = e.select("dataset_id", F.lit(None).cast("string").alias("title"), "doi", "publication_id", F.col("validation_reasoning").alias("body"), F.col("confidence_score_mention").alias("mention"), F.col("confidence_score_use").alias("use"), F.col("evidence_id").alias("seq"), "dataset_usage_status")
    used, other = rows.where("dataset_usage_status = 'analyzed'"), rows.where("dataset_usage_status is null or dataset_usage_status <> 'analyzed'")
    return catalog.ordered_reviews([catalog.reviews(used, "validation"), catalog.reviews(other, "discovery")])


def q03_reviews(spark: SparkSession, d: str) -> DataFrame:
    r = _reviews(spark, d)
    return r.select("dataset_id", "aspect", "doi", "seq", "place", F.size("review.reviewRating").alias("n_ratings"), F.col("review.citation.url").alias("url"))


def q03_documents(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document per entry and part of its reviews; rows only, since JSON texts differ between engines."""
    return catalog.documents(full_registry(spark, d), _reviews(spark, d))


def q04_most_common(spark: SparkSession, d: str) -> DataFrame:
    return catalog.most_common(_evidence(spark, d, "dataset_id", "match_type").where("dataset_id is not null"), "dataset_id", "match_type", "evidence_id")


def q05_catalog(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog(full_registry(spark, d), _reviews(spark, d))


def q05_match_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d, "dataset_id", "match_type")
    return catalog.match_counts(e.where("match_type = 'fuzzy'"), "fuzzy").unionByName(catalog.match_counts(e.where("match_type <> 'fuzzy'"), "other"))


def _citations(part: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        column = "authors" if part == "institutions" else part
        return rollups.citations_by(valid_publications(spark, d, ["citation_count", column]), part)

    return run


def q11_dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    got = rollups.dataset_counts(valid_publications(spark, d, ["mentioned_datasets", "authors", "journals", "sync_elastic"]))
    return got.withColumn("status", rollups.is_done(F.col("n_publications"), F.col("n_processed"), F.col("n_failed")))


def q12_counts_by(spark: SparkSession, d: str) -> DataFrame:
    return rollups.by_type_and_status(_evidence(spark, d, "match_type", "dataset_usage_status"), "match_type", "dataset_usage_status")


def q12_score_stats(spark: SparkSession, d: str) -> DataFrame:
    got = rollups.time_stats(_evidence(spark, d, "confidence_score_use"), F.col("confidence_score_use"))
    return got.select(F.round("avg_value", 6).alias("avg_value"), "min_value", "max_value", "n")


def q12_recent(spark: SparkSession, d: str) -> DataFrame:
    return rollups.recent(_evidence(spark, d, "created_at"), "created_at", F.lit("2024-01-01").cast("timestamp_ntz"), 90)


def q13_dataset_years(spark: SparkSession, d: str) -> DataFrame:
    narrow = table(spark, d, "publications").select("id", "harvested_at", "publication_year", F.col("mentioned_datasets.id").alias("mentions"))
    pubs = latest_version(narrow, norm_key(F.col("id")), F.col("harvested_at"), ["id", "publication_year", "mentions"])
    rows = pubs.select("id", "publication_year", F.explode("mentions").alias("m")).select("id", "publication_year", norm_key(F.col("m")).alias("dataset_id"))
    return rollups.dataset_years(rows, "dataset_id", "publication_year", "id")


def q14_main_topics(spark: SparkSession, d: str) -> DataFrame:
    pubs = valid_publications(spark, d, ["topics"])
    return pubs.select("id", F.posexplode(publications.main_topics(F.col("topics"))).alias("place", "t")).select("id", "place", F.col("t.score").alias("score"))


def q14_about(spark: SparkSession, d: str) -> DataFrame:
    return valid_publications(spark, d, ["topics"]).where(publications.about(F.col("topics"), ["soil economics", "child measurement"])).select("id")


def q15_flag_terms(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "seed_datasets").withColumn("flag_terms", F.split("dataset_name", " "))
    return registry.flag_terms(seeds, ["Census", " poultry", "seed"]).select("dataset_id", F.round("score", 6).alias("score"))


def q16_phrases(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.where(publications.phrase_query(F.col("text"), ["Watershed Census", "Seed Veteran Cohort"], ["kriging", "grant"], ["patent"])).select("doc_id")


def q16_window(spark: SparkSession, d: str) -> DataFrame:
    pubs = valid_publications(spark, d, ["publication_year", "type", "authors"])
    return publications.search_window(pubs, 2015, 2020, country="US").select("id")


def q17_triage(spark: SparkSession, d: str) -> DataFrame:
    features = mentions.triage_features(table(spark, d, "documents"))
    base = F.lit(5.0) + F.least(F.col("numbers") / 10, F.lit(4.0))
    return mentions.triage(features, base, F.col("analysis_words") > 0)


def q18_terms(spark: SparkSession, d: str) -> DataFrame:
    found = mentions.find_terms(table(spark, d, "documents"), mentions.entry_terms(table(spark, d, "seed_datasets")))
    return found.select("doc_id", "term", "dataset_id").distinct()


def q18_terms_joined(spark: SparkSession, d: str) -> DataFrame:
    return mentions.find_terms_joined(table(spark, d, "documents"), mentions.entry_terms(table(spark, d, "seed_datasets")))


def q18_places(spark: SparkSession, d: str) -> DataFrame:
    """Mentions without near repeats; rows only: SQL has no overlapping occurrences."""
    return mentions.distinct_places(mentions.find_terms(table(spark, d, "documents"), mentions.entry_terms(table(spark, d, "seed_datasets"))))


def q23_relationships(spark: SparkSession, d: str) -> DataFrame:
    rel = relationships.issues(relationships.relationships(_joins(spark, d)))
    return rel.select("relationship_id", "publication_id", "relationship_type", "confidence", "strength", "complexity", F.size("issues").alias("n_issues"))


def q23_statistics(spark: SparkSession, d: str) -> DataFrame:
    return relationships.statistics(relationships.relationships(_joins(spark, d)))


def q30_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Entries similar to typed aliases; tested against brute force."""
    return registry.lookup_fuzzy(table(spark, d, "data_dyads").where("dataset_id is null"), table(spark, d, "seed_datasets"))


def q30_exact(spark: SparkSession, d: str) -> DataFrame:
    return registry.lookup_exact(table(spark, d, "data_dyads").where("alias is not null"), table(spark, d, "seed_datasets"))


def q33_year_jobs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_name", (F.lit(2010) + F.col("n_nationkey") % 5).alias("start_year"), (F.lit(2014) + F.col("n_nationkey") % 3).alias("end_year"))
    return rollups.year_jobs(n, "start_year", "end_year").select("n_name", "year", F.sha2("n_name", 256).alias("group_id"))


def q34_search_documents(spark: SparkSession, d: str) -> DataFrame:
    pubs = valid_publications(spark, d, ["title", "doi", "type", "publication_year", "citation_count", "journals", "authors", "topics", "category_for", "mentioned_datasets"])
    return publications.search_documents(pubs).select("id", "title", "journals", "authors", "institutions", "countries", "categories", "datasets")


def q35_enriched(spark: SparkSession, d: str) -> DataFrame:
    pubs = valid_publications(spark, d, ["authors"])
    all_ = pubs.select(F.explode("authors").alias("a")).select(F.explode("a.institutions").alias("i")).where("i.id is not null and i.country_code is not null")
    known = all_.groupBy(F.col("i.id").alias("id")).agg(F.max("i.country_code").alias("country_code"))
    got = publications.enrich_institutions(pubs, known)
    return got.select("publication_id", "author_pos", "pos", F.col("institution.id").alias("id"), F.col("institution.country_code").alias("country_code"))


def q36_mentioned_entries(spark: SparkSession, d: str) -> DataFrame:
    return registry.mentioned_entries(valid_publications(spark, d, ["mentioned_datasets"]), table(spark, d, "seed_datasets"))


def q37_merged_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Versions of a publication: mentions of the valid one, then those only its first version had."""
    pubs = table(spark, d, "publications")
    new = valid_publications(spark, d, ["mentioned_datasets"])
    first = pubs.groupBy(norm_key(F.col("id")).alias("k")).agg(F.min_by("mentioned_datasets", F.struct("harvested_at", F.xxhash64("mentioned_datasets"))).alias("old"))
    both = new.withColumn("k", norm_key(F.col("id"))).join(first, "k")
    return both.select("k", F.size(publications.merge_mentions(F.col("mentioned_datasets"), F.col("old"))).alias("n"))


def q38_found(spark: SparkSession, d: str) -> DataFrame:
    pubs = valid_publications(spark, d, ["doi", "title", "authors", "journals", "topics", "mentioned_datasets", "publication_year", "citation_count"])
    return publications.find_publications(pubs, title="soil income", years=[2014, 2015, 2016], citations=(1, None)).select("id", "publication_year", "citation_count")


def q39_new_authors(spark: SparkSession, d: str) -> DataFrame:
    pubs = valid_publications(spark, d, ["authors"])
    people = pubs.select(F.explode("authors").alias("a")).select(F.col("a.id").alias("author_id"))
    return publications.absent_from(people, table(spark, d, "authors"), "author_id")


def q40_text_functions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence").select("evidence_id", "dataset_name", "doi", "dataset_usage_status").distinct()
    return e.select("evidence_id", slug(F.col("dataset_name")).alias("slug"), plain_name(F.col("dataset_name")).alias("plain"), clean_doi(F.col("doi")).alias("doi"), usage_status(F.col("dataset_usage_status")).alias("status"))


def q40_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "seed_datasets").select("dataset_id", F.explode(edge_ngrams(F.col("dataset_name"))).alias("gram"))


def q40_quoted(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "seed_datasets").select("dataset_id", quoted(F.col("group_name")).alias("quoted"))


PARTS = {"q06_citations_by_journal": "journals", "q07_citations_by_topic": "topics", "q08_citations_by_author": "authors", "q09_citations_by_institution": "institutions", "q10_citations_by_category": "category_for"}
QUERIES: dict[str, Query] = {k: v for k, v in globals().items() if k.startswith("q") and callable(v) and k[1:3].isdigit()} | {q: _citations(p) for q, p in PARTS.items()}

# -- the same in SQL ---------------------------------------------------------------

_PUBS = r"""
pubs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(trim(id, E' \t\n\r')) ORDER BY harvested_at DESC NULLS LAST) AS rn
    FROM publications WHERE trim(id, E' \t\n\r') <> '') WHERE rn = 1)"""
_EV = "ev AS (SELECT DISTINCT * FROM evidence)"
_REG = """
reg AS (
  SELECT 0 AS file, dataset_id, dataset_name, aliases FROM seed_datasets
  UNION ALL SELECT DISTINCT 1, dataset_id, dataset_name, aliases FROM additional_discovered_datasets WHERE deleted_at IS NULL),
names AS (
  SELECT file, dataset_id, 0 AS pos, dataset_name AS alias FROM reg
  UNION ALL SELECT file, dataset_id, i, l[i] FROM (SELECT file, dataset_id, list_filter(list_transform(string_split(coalesce(aliases, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS l FROM reg), generate_series(1, 60) AS g(i) WHERE i <= len(l))"""


def _plain(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({c})), '\([^)]*\)', '', 'g'), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g'))"


def _slug(c: str) -> str:
    return rf"left(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80)"


_INDEX = f"{_REG}, idx AS (SELECT {_plain('alias')} AS norm, arg_min(dataset_id, (file, dataset_id, pos)) AS dataset_id, min((file, dataset_id, pos)) AS ord FROM names WHERE alias IS NOT NULL GROUP BY 1)"
_REVIEWS = f"""
{_EV},
rv AS (
  SELECT dataset_id, CASE WHEN dataset_usage_status = 'analyzed' THEN 'validation' ELSE 'discovery' END AS aspect, CASE WHEN doi IS NULL OR lower(trim(doi)) IN ('', 'null', 'none', 'n/a') THEN '' ELSE trim(doi) END AS doi, evidence_id AS seq,
    CAST((confidence_score_mention IS NOT NULL) AS INTEGER) + CAST((confidence_score_use IS NOT NULL) AS INTEGER) AS n_ratings, CASE WHEN trim(publication_id) <> '' THEN 'https://app.dimensions.ai/details/publication/' || trim(publication_id) END AS url
  FROM ev WHERE dataset_id IS NOT NULL)"""
_REL = rf"""
j AS (SELECT DISTINCT * FROM dataset_joins),
wf AS (SELECT * FROM j WHERE trim(dataset1) <> '' AND trim(dataset2) <> '' AND trim(dataset1) <> trim(dataset2) AND confidence_score >= 2),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY publication_id, least(lower(trim(dataset1)), lower(trim(dataset2))), greatest(lower(trim(dataset1)), lower(trim(dataset2))) ORDER BY confidence_score DESC, join_id) AS rn FROM wf) WHERE rn = 1),
rel AS (
  SELECT sha256(publication_id || '|' || lower(trim(dataset1)) || '|' || lower(trim(dataset2))) AS relationship_id, publication_id,
    CASE WHEN lower(join_type) LIKE '%merge%' THEN 'merge' WHEN lower(join_type) LIKE '%fusion%' THEN 'fusion' WHEN lower(join_type) LIKE '%join%' THEN 'join' WHEN lower(join_type) LIKE '%link%' THEN 'linkage' WHEN lower(join_type) LIKE '%integration%' THEN 'integration' WHEN lower(join_type) LIKE '%concat%' THEN 'concatenation' WHEN lower(join_type) LIKE '%aggregat%' THEN 'aggregation' WHEN lower(join_type) LIKE '%transform%' THEN 'transformation' ELSE 'other' END AS relationship_type,
    confidence_score AS confidence, CASE WHEN confidence_score >= 9 THEN 'very_strong' WHEN confidence_score >= 7 THEN 'strong' WHEN confidence_score >= 5 THEN 'moderate' ELSE 'weak' END AS strength,
    CASE WHEN (10 - confidence_score) * 0.3 >= 6 THEN 'critical' WHEN (10 - confidence_score) * 0.3 >= 4 THEN 'high' WHEN (10 - confidence_score) * 0.3 >= 2 THEN 'medium' ELSE 'low' END AS complexity,
    CAST((lower(trim(dataset1)) = lower(trim(dataset2))) AS INTEGER) + CAST((confidence_score NOT BETWEEN 0 AND 10) AS INTEGER) AS n_issues
  FROM one)"""


def _citations_sql(part: str) -> str:
    if part == "institutions":
        rows = "SELECT id, citation_count, unnest(a.institutions) AS x FROM (SELECT id, citation_count, unnest(authors) AS a FROM pubs)"
    else:
        rows = f"SELECT id, citation_count, unnest({part}) AS x FROM pubs"
    return f"""WITH {_PUBS}, r AS ({rows}), one AS (SELECT DISTINCT id, citation_count, x.name AS name FROM r WHERE x.name IS NOT NULL)
    SELECT name, count(*) AS n_publications, CAST(coalesce(sum(citation_count), 0) AS BIGINT) AS total_citations FROM one GROUP BY name"""


def _words(words: list[str]) -> str:
    return " + ".join("CAST(contains(low, '{}') AS INTEGER)".format(w.replace("'", "''")) for w in words)


from citeloom.functions import scores as _s  # noqa: E402

_FEATURES = f"""
f AS (SELECT doc_id, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low FROM documents),
g AS (SELECT doc_id, CAST(length(t) AS INTEGER) AS text_length, {_words(_s.ANALYSIS_WORDS)} AS analysis_words, {_words(_s.DATASET_WORDS)} AS dataset_words, {_words(_s.METHOD_WORDS)} AS method_words,
  CAST(len(regexp_extract_all(t, '{_s.NUMBER}')) AS INTEGER) AS numbers, CAST({" + ".join(f"len(regexp_extract_all(low, '{p}'))" for p in _s.STATISTICS)} AS INTEGER) AS statistics, regexp_matches(low, 'methods?:') AS has_methods, regexp_matches(low, 'results?:') AS has_results FROM f)"""
_TERMS = "terms AS (SELECT DISTINCT dataset_id, lower(x) AS term FROM (SELECT dataset_id, dataset_name AS x FROM seed_datasets UNION ALL SELECT dataset_id, trim(unnest(string_split(aliases, ';'))) FROM seed_datasets) WHERE length(x) >= 3)"

ORACLE = {
    "q01_alias_index": f"WITH {_INDEX} SELECT norm, dataset_id FROM idx",
    "q02_resolved_names": f"""WITH {_INDEX},
      n AS (SELECT DISTINCT dataset_name AS name, {_plain('dataset_name')} AS norm FROM evidence WHERE dataset_name IS NOT NULL),
      ex AS (SELECT dataset_name AS name, arg_min(dataset_id, (file, dataset_id)) AS exact_id FROM reg WHERE dataset_name IS NOT NULL GROUP BY 1),
      g AS (SELECT n.name, n.norm, exact_id, idx.dataset_id AS norm_id FROM n LEFT JOIN ex ON ex.name = n.name LEFT JOIN idx ON idx.norm = n.norm),
      p AS (SELECT o.norm, arg_min(idx.dataset_id, idx.ord) AS part_id FROM (SELECT DISTINCT norm FROM g WHERE exact_id IS NULL AND norm_id IS NULL) o JOIN idx ON contains(idx.norm, o.norm) OR contains(o.norm, idx.norm) GROUP BY 1)
      SELECT g.name, coalesce(exact_id, norm_id, part_id) AS dataset_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN norm_id IS NOT NULL THEN 'norm' WHEN part_id IS NOT NULL THEN 'substring' ELSE 'none' END AS how FROM g LEFT JOIN p ON p.norm = g.norm""",
    "q02_unregistered": f"""WITH {_INDEX}, n AS (SELECT dataset_name AS name, evidence_id AS ord, {_plain('dataset_name')} AS norm FROM evidence WHERE dataset_name IS NOT NULL),
      o AS (SELECT * FROM n WHERE name NOT IN (SELECT dataset_name FROM reg WHERE dataset_name IS NOT NULL) AND norm NOT IN (SELECT norm FROM idx)), a AS (SELECT norm, arg_min(name, (ord, name)) AS dataset_name FROM o GROUP BY 1)
      SELECT {_slug('dataset_name')} AS dataset_id, dataset_name, norm FROM a""",
    "q03_reviews": f"WITH {_REVIEWS} SELECT dataset_id, aspect, doi, seq, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY CASE aspect WHEN 'validation' THEN 0 ELSE 1 END, doi, seq) - 1 AS INTEGER) AS place, n_ratings, url FROM rv",
    "q04_most_common": f"""WITH {_EV}, c AS (SELECT dataset_id, match_type, count(*) AS n, min(evidence_id) AS first FROM ev WHERE dataset_id IS NOT NULL AND trim(match_type) <> '' GROUP BY ALL)
      SELECT dataset_id, match_type AS value FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1""",
    "q05_catalog": f"WITH {_REG}, {_REVIEWS}, n AS (SELECT dataset_id, count(*) AS n_reviews FROM rv GROUP BY 1) SELECT dataset_name AS name, dataset_id AS identifier, {_slug('dataset_name')} AS slug, n_reviews FROM reg JOIN n USING (dataset_id)",
    "q05_match_counts": f"WITH {_EV} SELECT CASE match_type WHEN 'fuzzy' THEN 'fuzzy' ELSE 'other' END AS aspect, count(dataset_id) AS matched, count(*) AS total FROM ev WHERE match_type IS NOT NULL GROUP BY 1",
    **{q: _citations_sql(p) for q, p in PARTS.items()},
    "q11_dataset_counts": rf"""WITH {_PUBS}, m AS (SELECT DISTINCT id, sync_elastic, lower(trim(m.id, E' \t\n\r')) AS dataset_id FROM (SELECT id, sync_elastic, unnest(mentioned_datasets) AS m FROM pubs) WHERE trim(m.id, E' \t\n\r') <> ''),
      a AS (SELECT id, unnest(authors) AS a FROM pubs), i AS (SELECT id, unnest(a.institutions) AS i FROM a), j AS (SELECT id, unnest(journals) AS j FROM pubs)
      SELECT m.dataset_id, any_value(b.n_publications) AS n_publications, any_value(b.n_processed) AS n_processed, any_value(b.n_failed) AS n_failed, any_value(coalesce(na.n, 0)) AS n_authors, any_value(coalesce(ni.n, 0)) AS n_institutions, any_value(coalesce(nj.n, 0)) AS n_journals, CASE WHEN any_value(b.n_processed + b.n_failed = b.n_publications) THEN 'DONE' ELSE 'PROCESSING' END AS status
      FROM m JOIN (SELECT dataset_id, count(*) AS n_publications, count(*) FILTER (sync_elastic) AS n_processed, count(*) FILTER (NOT sync_elastic) AS n_failed FROM m GROUP BY 1) b USING (dataset_id)
      LEFT JOIN (SELECT dataset_id, count(DISTINCT a.a.id) AS n FROM m JOIN a ON a.id = m.id GROUP BY 1) na USING (dataset_id)
      LEFT JOIN (SELECT dataset_id, count(DISTINCT i.i.id) AS n FROM m JOIN i ON i.id = m.id GROUP BY 1) ni USING (dataset_id)
      LEFT JOIN (SELECT dataset_id, count(DISTINCT j.j.id) AS n FROM m JOIN j ON j.id = m.id GROUP BY 1) nj USING (dataset_id) GROUP BY m.dataset_id""",
    "q12_counts_by": f"""WITH {_EV} SELECT CASE WHEN grouping(match_type) = 0 THEN 'match_type' WHEN grouping(dataset_usage_status) = 0 THEN 'dataset_usage_status' ELSE 'total' END AS "by",
      CASE WHEN grouping(match_type) = 0 THEN match_type WHEN grouping(dataset_usage_status) = 0 THEN dataset_usage_status END AS value, count(*) AS n FROM ev GROUP BY GROUPING SETS ((match_type), (dataset_usage_status), ())""",
    "q12_score_stats": f"WITH {_EV} SELECT round(avg(confidence_score_use), 6) AS avg_value, min(confidence_score_use) AS min_value, max(confidence_score_use) AS max_value, count(confidence_score_use) AS n FROM ev HAVING count(confidence_score_use) > 0",
    "q12_recent": f"WITH {_EV} SELECT count(*) FILTER (created_at >= TIMESTAMP '2024-01-01' - INTERVAL 90 DAY) AS n_recent FROM ev",
    "q13_dataset_years": rf"WITH {_PUBS}, m AS (SELECT DISTINCT lower(trim(m.id, E' \t\n\r')) AS dataset_id, publication_year, id FROM (SELECT id, publication_year, unnest(mentioned_datasets) AS m FROM pubs) WHERE trim(m.id, E' \t\n\r') <> '' AND publication_year IS NOT NULL) SELECT dataset_id, publication_year, count(*) AS n_publications FROM m GROUP BY ALL",
    "q14_main_topics": f"""WITH {_PUBS}, t AS (SELECT id, unnest(topics) AS t FROM pubs), r AS (SELECT id, t.score AS score, row_number() OVER (PARTITION BY id ORDER BY t.score DESC NULLS LAST) - 1 AS place, max(t.score) OVER (PARTITION BY id) AS best FROM t WHERE t IS NOT NULL)
      SELECT id, CAST(place AS INTEGER) AS place, score FROM r WHERE score > 0.7 OR (coalesce(best, 0) <= 0.7 AND place = 0)""",
    "q14_about": f"WITH {_PUBS}, t AS (SELECT id, unnest(topics) AS t FROM pubs) SELECT DISTINCT id FROM t WHERE lower(t.name) IN ('soil economics', 'child measurement') AND t.score >= 0.6",
    "q15_flag_terms": "WITH w AS (SELECT DISTINCT dataset_id, lower(trim(unnest(string_split(dataset_name, ' ')))) AS w FROM seed_datasets) SELECT dataset_id, round(count(*) / 3.0, 6) AS score FROM w WHERE w IN ('census', 'poultry', 'seed') GROUP BY 1",
    "q16_phrases": "SELECT doc_id FROM documents WHERE (contains(lower(text), 'watershed census') OR contains(lower(text), 'seed veteran cohort')) AND (contains(lower(text), 'kriging') OR contains(lower(text), 'grant')) AND NOT contains(lower(text), 'patent')",
    "q16_window": f"WITH {_PUBS} SELECT DISTINCT id FROM (SELECT id, unnest(a.institutions) AS i FROM (SELECT id, unnest(authors) AS a FROM pubs WHERE publication_year BETWEEN 2015 AND 2020 AND type IN ('article', 'chapter', 'proceeding', 'monograph', 'preprint'))) WHERE i.country_code = 'US'",
    "q17_triage": f"""WITH {_FEATURES}, h AS (SELECT *, 5.0 + least(numbers / 10, 4.0) AS base FROM g)
      SELECT * EXCLUDE (base), round_even(least(greatest(CAST(base AS DOUBLE) + (CASE WHEN analysis_words >= 3 THEN 0.5 ELSE 0 END) + (CASE WHEN statistics >= 2 THEN 0.5 ELSE 0 END) + (CASE WHEN has_methods AND has_results THEN 0.3 ELSE 0 END) - (CASE WHEN analysis_words + dataset_words + method_words < 2 THEN 1.0 ELSE 0 END), 0.0), 10.0), 2) AS confidence, analysis_words > 0 AND base >= 6 AS is_data_analysis FROM h""",
    "q18_terms": f"WITH {_TERMS} SELECT DISTINCT doc_id, term, dataset_id FROM documents JOIN terms ON contains(lower(text), term)",
    "q18_terms_joined": f"WITH {_TERMS} SELECT DISTINCT doc_id, term, dataset_id FROM documents JOIN terms ON contains(lower(text), term)",
    "q23_relationships": f"WITH {_REL} SELECT relationship_id, publication_id, relationship_type, confidence, strength, complexity, n_issues FROM rel",
    "q23_statistics": f"""WITH {_REL} SELECT CASE WHEN grouping(relationship_type) = 0 THEN 'type' WHEN grouping(complexity) = 0 THEN 'complexity' ELSE 'total' END AS "by", coalesce(CASE WHEN grouping(relationship_type) = 0 THEN relationship_type END, CASE WHEN grouping(complexity) = 0 THEN complexity END) AS value, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM rel GROUP BY GROUPING SETS ((relationship_type), (complexity), ())""",
    "q30_exact": """WITH a AS (SELECT DISTINCT alias FROM data_dyads WHERE alias IS NOT NULL), i AS (SELECT dataset_id, dataset_name AS x, 0 AS pos FROM seed_datasets UNION ALL SELECT dataset_id, trim(unnest(string_split(aliases, ';'))), 1 FROM seed_datasets)
      SELECT alias, dataset_id, CASE WHEN min(pos) = 0 THEN 'name' ELSE 'alias' END AS matched_on, CAST(1.0 AS DOUBLE) AS score FROM a JOIN i ON lower(alias) = lower(x) WHERE x <> '' GROUP BY alias, dataset_id""",
    "q33_year_jobs": "SELECT n_name, CAST(y AS INTEGER) AS year, sha256(n_name) AS group_id FROM (SELECT n_name, 2010 + n_nationkey % 5 AS s, 2014 + n_nationkey % 3 AS e FROM nation), generate_series(2010, 2020) AS g(y) WHERE y BETWEEN s AND e",
    "q34_search_documents": f"""WITH {_PUBS}, p AS (SELECT id, title, journals AS j, authors AS a, category_for AS c, mentioned_datasets AS m FROM pubs),
      q AS (SELECT *, flatten(list_transform(list_filter(a, lambda x: x IS NOT NULL AND x.institutions IS NOT NULL), lambda x: list_filter(x.institutions, lambda i: i IS NOT NULL))) AS ins FROM p)
      SELECT id, title, {", ".join(f"coalesce(array_to_string(list_filter(list_transform({c}, lambda x: x.name), lambda n: n IS NOT NULL AND lower(n) <> 'nan'), ', '), '') AS {n}" for c, n in (("j", "journals"), ("a", "authors"), ("c", "categories")))},
      coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(ins, lambda x: x.name), lambda n: n IS NOT NULL))), ', '), '') AS institutions, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(ins, lambda x: x.country), lambda n: n IS NOT NULL))), ', '), '') AS countries,
      coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(m, lambda x: x IS NOT NULL), lambda x: x.name), lambda n: n IS NOT NULL))), ', '), '') AS datasets FROM q""",
    "q35_enriched": f"""WITH {_PUBS}, a AS (SELECT id AS publication_id, unnest(authors) AS a, generate_subscripts(authors, 1) - 1 AS author_pos FROM pubs), i AS (SELECT publication_id, author_pos, unnest(a.institutions) AS i, generate_subscripts(a.institutions, 1) - 1 AS pos FROM a),
      k AS (SELECT i.id AS kid, max(i.country_code) AS cc FROM i WHERE i.id IS NOT NULL AND i.country_code IS NOT NULL GROUP BY 1)
      SELECT publication_id, CAST(author_pos AS INTEGER) AS author_pos, CAST(pos AS INTEGER) AS pos, i.id AS id, coalesce(cc, i.country_code) AS country_code FROM i LEFT JOIN k ON kid = i.id WHERE i IS NOT NULL""",
    "q36_mentioned_entries": f"""WITH {_PUBS}, m AS (SELECT id AS publication_id, unnest(mentioned_datasets) AS m FROM pubs), x AS (SELECT publication_id, m.id AS k FROM m UNION SELECT publication_id, m.name FROM m),
      i AS (SELECT dataset_id, dataset_name AS k FROM seed_datasets UNION SELECT dataset_id, trim(unnest(string_split(aliases, ';'))) FROM seed_datasets UNION SELECT dataset_id, dataset_id FROM seed_datasets)
      SELECT DISTINCT publication_id, dataset_id FROM x JOIN i USING (k) WHERE k <> ''""",
    "q37_merged_mentions": rf"""WITH {_PUBS}, old AS (SELECT * FROM (SELECT lower(trim(id, E' \t\n\r')) AS k, mentioned_datasets AS m, row_number() OVER (PARTITION BY lower(trim(id, E' \t\n\r')) ORDER BY harvested_at) AS rn FROM publications WHERE trim(id, E' \t\n\r') <> '' AND mentioned_datasets IS NOT NULL) WHERE rn = 1),
      b AS (SELECT lower(trim(id, E' \t\n\r')) AS k, mentioned_datasets AS new, old.m AS old FROM pubs LEFT JOIN old ON old.k = lower(trim(id, E' \t\n\r')))
      SELECT k, CAST(coalesce(len(new), 0) + coalesce(len(list_filter(old, lambda o: len(list_filter(coalesce(new, []), lambda n: n.id IS NOT DISTINCT FROM o.id)) = 0)), 0) AS INTEGER) AS n FROM b""",
    "q38_found": f"""WITH {_PUBS} SELECT id, publication_year, citation_count FROM pubs WHERE publication_year IN (2014, 2015, 2016) AND citation_count >= 1 AND list_has_any(string_split_regex(lower(title), '\\W+'), ['soil', 'income']) ORDER BY id LIMIT 100""",
    "q39_new_authors": f"WITH {_PUBS} SELECT DISTINCT a.id AS author_id FROM (SELECT unnest(authors) AS a FROM pubs) WHERE a.id IS NOT NULL AND a.id NOT IN (SELECT author_id FROM authors WHERE author_id IS NOT NULL)",
    "q40_text_functions": f"SELECT DISTINCT evidence_id, {_slug('dataset_name')} AS slug, {_plain('dataset_name')} AS plain, CASE WHEN lower(trim(doi)) NOT IN ('', 'null', 'none', 'n/a') THEN trim(doi) END AS doi, CASE WHEN lower(trim(dataset_usage_status)) IN ('none', 'mentioned', 'analyzed') THEN lower(trim(dataset_usage_status)) END AS status FROM evidence",
    "q40_ngrams": "SELECT dataset_id, left(lower(dataset_name), CAST(n AS INTEGER)) AS gram FROM seed_datasets, generate_series(1, 20) AS g(n) WHERE n <= length(dataset_name)",
    "q40_quoted": "SELECT dataset_id, replace(replace(url_encode(group_name), '+', '%20'), '%2F', '/') AS quoted FROM seed_datasets",
}
