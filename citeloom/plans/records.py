"""Queries of the record operators: nested records, packed fields, orphan references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.orphans import orphan_references, orphan_report
from citeloom.operators.packed import split_packed
from citeloom.operators.shred import flat_table, pivoted, shred_columns, shred_json
from citeloom.operators.versions import latest_version
from citeloom.sources.session import materialise
from citeloom.sources.tables import norm_key, table

PUBLICATION_ARRAYS = ["authors", "journals", "mentioned_datasets"]
ANALYSIS_ARRAYS = ["validated_datasets", "newly_discovered_datasets", "dataset_joins"]


def valid_publications(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    return latest_version(table(spark, d, "publications"), norm_key(F.col("id")), F.col("harvested_at"), ["id", *keep])


def valid_analyses(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    """Valid versions, deleted ones too."""
    return latest_version(table(spark, d, "analyses"), norm_key(F.col("analysis_id")), F.col("updated_at"), ["analysis_id", "deleted_at", *keep])


#: The leaves of each table that publications and analyses are cut into.
TABLES = {
    "authors": ["id", "name", "orcid"], "authors.institutions": ["id", "name", "city", "country_code", "ror_id"], "journals": ["id", "name", "issn"],
    "mentioned_datasets": ["id", "name", "is_validated_mention", "confidence_score", "group_id"],
    "dataset_analysis.validated_datasets": ["name", "confidence", "context"], "dataset_analysis.newly_discovered_datasets": ["name", "confidence", "context"], "dataset_analysis.dataset_joins": ["dataset1", "dataset2", "join_type", "confidence"],
}


def record_groups(spark: SparkSession, d: str) -> DataFrame:
    """Group rows of every nested part of valid publications and live analyses."""
    pubs = shred_columns(valid_publications(spark, d, PUBLICATION_ARRAYS), "id", PUBLICATION_ARRAYS)
    live = valid_analyses(spark, d, ["dataset_analysis"]).where(F.col("deleted_at").isNull())
    return pubs.unionByName(shred_json(live, "analysis_id", "dataset_analysis", ANALYSIS_ARRAYS, [p for p in TABLES if p.startswith("dataset_analysis")]))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The keys of all seven tables."""
    rows = pivoted(record_groups(spark, d).where("kind = 'object'"), TABLES)
    deep = F.size("parent_ords") > 0
    return rows.select("record_key", "path", F.when(deep, F.try_element_at("parent_ords", F.lit(1))).otherwise(F.col("pos")).alias("pos"), F.when(deep, F.col("pos")).otherwise(F.lit(-1)).alias("subpos"))


def _publication_table(path: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return flat_table(shred_columns(valid_publications(spark, d, [path]), "id", [path]), path, TABLES[path]).drop("parent_ords")

    return run


def _analysis_table(path: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        live = valid_analyses(spark, d, ["dataset_analysis"]).where(F.col("deleted_at").isNull())
        rows = flat_table(shred_json(live, "analysis_id", "dataset_analysis", ANALYSIS_ARRAYS, [path]).where("kind = 'object'"), path, TABLES[path])
        return rows.drop("parent_ords").withColumn("confidence", F.round(F.col("confidence").try_cast("double"), 9))

    return run


def p1_institutions(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of institutions, each pointing to its publication and author."""
    pubs = shred_columns(valid_publications(spark, d, ["authors"]), "id", ["authors"])
    t = flat_table(pubs, "authors.institutions", ["id", "name", "country_code"])
    return t.select("record_key", F.col("parent_ords")[0].alias("author_pos"), "pos", "id", "name", "country_code")


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    """All values with their error flags."""
    aliases = split_packed(table(spark, d, "additional_discovered_datasets"), "dataset_id", "aliases")
    orcids = split_packed(table(spark, d, "authors"), "author_id", "orcid", kind="orcid")
    field = F.lit("additional_discovered_datasets.aliases").alias("field")
    return aliases.select(field, "*").unionByName(orcids.select(F.lit("authors.orcid").alias("field"), "*"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_values(spark, d).where(F.col("pos").isNotNull()).select("field", "row_key", "pos", "value").distinct()


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(references, live parents) of all three fields."""
    empty = F.array().cast("array<struct<field:string,ref_key:string>>")
    month = lambda c: F.date_format(c, "yyyy-MM").alias("month")

    def tagged(ids: str, field: str) -> Column:
        got = F.transform(ids, lambda x: F.struct(F.lit(field).alias("field"), norm_key(x).alias("ref_key")))
        return F.coalesce(F.array_distinct(F.filter(got, lambda r: r["ref_key"].isNotNull())), empty)

    # only keys and references are read and shuffled, not the records round them
    narrow = table(spark, d, "publications").select("id", "harvested_at", "llm_analysis_ref_id", F.col("mentioned_datasets.id").alias("mentions"))
    pubs = latest_version(narrow, norm_key(F.col("id")), F.col("harvested_at"), ["id", "harvested_at", "llm_analysis_ref_id", "mentions"])
    all_refs = F.concat(tagged("llm_analysis_ref_id", "publications.llm_analysis_ref_id"), tagged("mentions", "publications.mentioned_datasets"))
    from_pubs = pubs.select(F.col("id").alias("row_key"), month(F.col("harvested_at")), F.explode(all_refs).alias("r")).select("r.field", "row_key", "month", "r.ref_key")
    narrow = table(spark, d, "analyses").select("analysis_id", "updated_at", "deleted_at", F.col("publication_metadata.publication_id").alias("ref"))
    live = materialise(latest_version(narrow, norm_key(F.col("analysis_id")), F.col("updated_at"), ["analysis_id", "updated_at", "deleted_at", "ref"]).where("deleted_at is null").drop("deleted_at"), "live")
    from_analyses = live.select(F.lit("analyses.publication_metadata").alias("field"), F.col("analysis_id").alias("row_key"), month(F.col("updated_at")), norm_key(F.col("ref")).alias("ref_key"))
    refs = materialise(from_pubs.unionByName(from_analyses).where("ref_key is not null"), "references")

    def keys(df: DataFrame, field: str, key: str) -> DataFrame:
        return df.select(F.lit(field).alias("field"), norm_key(F.col(key)).alias("ref_key"))

    more = table(spark, d, "additional_discovered_datasets").where(F.col("deleted_at").isNull())
    parents = (
        keys(live, "publications.llm_analysis_ref_id", "analysis_id")
        .unionByName(keys(table(spark, d, "seed_datasets"), "publications.mentioned_datasets", "dataset_id"))
        .unionByName(keys(more, "publications.mentioned_datasets", "dataset_id"))
        .unionByName(keys(table(spark, d, "publications"), "analyses.publication_metadata", "id"))
    )
    return refs, parents


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    refs, parents = _references(spark, d)
    return orphan_references(refs, parents).select("field", "row_key", "ref_key").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Per field and month of the referring row."""
    refs, parents = _references(spark, d)
    return orphan_report(orphan_references(refs, parents), refs)


QUERIES = {
    "p1_found": p1_found, "p1_institutions": p1_institutions, "p1_authors": _publication_table("authors"), "p1_journals": _publication_table("journals"), "p1_mentions": _publication_table("mentioned_datasets"),
    "p1_validated": _analysis_table("dataset_analysis.validated_datasets"), "p1_discovered": _analysis_table("dataset_analysis.newly_discovered_datasets"), "p1_joins": _analysis_table("dataset_analysis.dataset_joins"),
    "p3_found": p3_found, "p3_values": p3_values, "p6_found": p6_found, "p6_report": p6_report,
}

# -- the same in SQL ---------------------------------------------------------------

_PUBS = r"""
pubs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(trim(id, E' \t\n\r')) ORDER BY harvested_at DESC NULLS LAST) AS rn
    FROM publications WHERE trim(id, E' \t\n\r') <> '') WHERE rn = 1)"""
_ANALYSES = r"""
valid_an AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(trim(analysis_id, E' \t\n\r')) ORDER BY updated_at DESC NULLS LAST) AS rn
    FROM analyses WHERE trim(analysis_id, E' \t\n\r') <> '') WHERE rn = 1),
live AS (SELECT * FROM valid_an WHERE deleted_at IS NULL)"""


def _open(n: int) -> str:
    """One layer of encoding or wrapping less."""
    return f"""o{n} AS (SELECT analysis_id, CASE
    WHEN j IS NULL OR NOT json_valid(j) THEN NULL
    WHEN json_type(j) = 'VARCHAR' THEN j ->> '$'
    WHEN json_type(j) = 'OBJECT' AND json_exists(j, '$.dataset_analysis') AND NOT json_exists(j, '$.validated_datasets') AND NOT json_exists(j, '$.newly_discovered_datasets') AND NOT json_exists(j, '$.dataset_joins') THEN j -> '$.dataset_analysis'
    ELSE j END AS j FROM o{n - 1})"""


#: Elements of the arrays in dataset_analysis, opened.
OPENED = f"""
o0 AS (SELECT analysis_id, dataset_analysis AS j FROM live), {", ".join(_open(n) for n in range(1, 7))},
parts AS (SELECT analysis_id, p.path, json_extract(j, '$.' || p.path) AS v FROM o6, (VALUES ('validated_datasets'), ('newly_discovered_datasets'), ('dataset_joins')) AS p(path) WHERE j IS NOT NULL AND json_valid(j) AND json_type(j) = 'OBJECT'),
opened AS (SELECT analysis_id, path, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v ->> '$') THEN CAST(v ->> '$' AS JSON) ELSE v END AS v FROM parts WHERE v IS NOT NULL),
listed AS (SELECT analysis_id, path, CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE [] END AS l FROM opened)"""

_P1 = f"""
WITH {_PUBS}, {_ANALYSES}, {OPENED},
au AS (SELECT id, unnest(authors) AS a, generate_subscripts(authors, 1) - 1 AS i FROM pubs),
ins AS (SELECT id, i, unnest(a.institutions) AS x, generate_subscripts(a.institutions, 1) - 1 AS k FROM au),
jo AS (SELECT id, unnest(journals) AS x, generate_subscripts(journals, 1) - 1 AS i FROM pubs),
md AS (SELECT id, unnest(mentioned_datasets) AS x, generate_subscripts(mentioned_datasets, 1) - 1 AS i FROM pubs),
el AS (SELECT analysis_id, path, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM listed)
SELECT id AS record_key, 'authors' AS path, CAST(i AS INTEGER) AS pos, CAST(-1 AS INTEGER) AS subpos FROM au WHERE a IS NOT NULL
UNION ALL SELECT id, 'authors.institutions', CAST(i AS INTEGER), CAST(k AS INTEGER) FROM ins WHERE x IS NOT NULL
UNION ALL SELECT id, 'journals', CAST(i AS INTEGER), -1 FROM jo WHERE x IS NOT NULL
UNION ALL SELECT id, 'mentioned_datasets', CAST(i AS INTEGER), -1 FROM md WHERE x IS NOT NULL
UNION ALL SELECT analysis_id, 'dataset_analysis.' || path, CAST(i AS INTEGER), -1 FROM el WHERE json_type(x) = 'OBJECT'
"""

_P1_INST = f"""
WITH {_PUBS},
au AS (SELECT id AS rk, unnest(authors) AS a, generate_subscripts(authors, 1) - 1 AS i FROM pubs),
ins AS (SELECT rk, i, unnest(a.institutions) AS x, generate_subscripts(a.institutions, 1) - 1 AS k FROM au)
SELECT rk AS record_key, CAST(i AS INTEGER) AS author_pos, CAST(k AS INTEGER) AS pos, x.id AS id, x.name AS name, x.country_code AS country_code FROM ins WHERE x IS NOT NULL
"""

_P6_REFS = rf"""
WITH {_PUBS}, {_ANALYSES},
raw_refs AS (
  SELECT 'publications.llm_analysis_ref_id' AS field, id AS row_key, strftime(harvested_at, '%Y-%m') AS month, unnest(llm_analysis_ref_id) AS r FROM pubs
  UNION ALL SELECT 'publications.mentioned_datasets', id, strftime(harvested_at, '%Y-%m'), unnest(mentioned_datasets).id FROM pubs
  UNION ALL SELECT 'analyses.publication_metadata', analysis_id, strftime(updated_at, '%Y-%m'), publication_metadata.publication_id FROM live),
refs AS (SELECT DISTINCT field, row_key, month, lower(trim(r, E' \t\n\r')) AS ref_key FROM raw_refs WHERE trim(r, E' \t\n\r') <> ''),
parents AS (
  SELECT 'publications.llm_analysis_ref_id' AS field, lower(trim(analysis_id, E' \t\n\r')) AS k FROM live
  UNION SELECT 'publications.mentioned_datasets', lower(trim(dataset_id, E' \t\n\r')) FROM seed_datasets
  UNION SELECT 'publications.mentioned_datasets', lower(trim(dataset_id, E' \t\n\r')) FROM additional_discovered_datasets WHERE deleted_at IS NULL
  UNION SELECT 'analyses.publication_metadata', lower(trim(id, E' \t\n\r')) FROM publications),
orphans AS (SELECT * FROM refs WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.field = refs.field AND p.k = refs.ref_key))"""



def _table_sql(path: str, types: dict[str, str]) -> str:
    fields = ", ".join(f"{types.get(x, f'x.{x}')} AS {x}" for x in TABLES[path])
    return f"WITH {_PUBS}, t AS (SELECT id AS record_key, unnest({path}) AS x, generate_subscripts({path}, 1) - 1 AS i FROM pubs) SELECT record_key, CAST(i AS INTEGER) AS pos, {fields} FROM t WHERE x IS NOT NULL"


def _json_table_sql(part: str) -> str:
    fields = ", ".join("round(TRY_CAST(x ->> '$.confidence' AS DOUBLE), 9) AS confidence" if x == "confidence" else f"x ->> '$.{x}' AS {x}" for x in TABLES[f"dataset_analysis.{part}"])
    return f"WITH {_ANALYSES}, {OPENED}, t AS (SELECT analysis_id AS record_key, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM listed WHERE path = '{part}') SELECT record_key, CAST(i AS INTEGER) AS pos, {fields} FROM t WHERE json_type(x) = 'OBJECT'"


ORACLE = {
    "p1_found": _P1,
    "p1_authors": _table_sql("authors", {}), "p1_journals": _table_sql("journals", {}), "p1_mentions": _table_sql("mentioned_datasets", {"is_validated_mention": "CAST(x.is_validated_mention AS VARCHAR)", "confidence_score": "CAST(x.confidence_score AS VARCHAR)"}),
    "p1_validated": _json_table_sql("validated_datasets"), "p1_discovered": _json_table_sql("newly_discovered_datasets"), "p1_joins": _json_table_sql("dataset_joins"),
    "p1_institutions": _P1_INST,
    "p6_found": _P6_REFS + " SELECT DISTINCT field, row_key, ref_key FROM orphans",
    "p6_report": _P6_REFS
    + """, n AS (SELECT field, month, count(*) AS n_refs FROM refs GROUP BY ALL),
    k AS (SELECT field, month, count(*) AS n_orphans, count(DISTINCT ref_key) AS n_orphan_keys FROM orphans GROUP BY ALL)
    SELECT n.field, n.month, n_refs, coalesce(n_orphans, 0) AS n_orphans, coalesce(n_orphan_keys, 0) AS n_orphan_keys, round(coalesce(n_orphans, 0) / n_refs, 6) AS orphan_share
    FROM n LEFT JOIN k ON n.field = k.field AND n.month IS NOT DISTINCT FROM k.month""",
}
