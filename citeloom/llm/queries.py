"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.authors import linked_authors, same_person_pairs, unplaced
from citeloom.llm.bpe import encode_corpus
from citeloom.llm.cooccur import cooccurring_pairs
from citeloom.llm.mixing import Mix
from citeloom.llm.spans import coverage, shared_spans
from citeloom.llm.resolve import resolve_names
from citeloom.llm.topn import top_n
from citeloom.operators.packed import split_packed
from citeloom.operators.versions import latest_version
from citeloom.sources.session import materialise
from citeloom.sources.tables import norm_key, table


def _publications(spark: SparkSession, d: str, keep: list[str]) -> DataFrame:
    """Valid versions with the ids they mention; nothing else of a mention is read or shuffled."""
    rows = table(spark, d, "publications").select("id", "harvested_at", *keep, F.col("mentioned_datasets.id").alias("mentions"))
    return latest_version(rows, norm_key(F.col("id")), F.col("harvested_at"), ["id", *keep, "mentions"])


def _mentioned() -> Column:
    """Distinct dataset keys of one publication."""
    return F.array_distinct(F.filter(F.transform("mentions", lambda m: norm_key(m)), lambda k: k.isNotNull()))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pubs = _publications(spark, d, ["publication_year", "citation_count"]).where("publication_year is not null")
    rows = pubs.select(F.explode(_mentioned()).alias("dataset_id"), "publication_year", F.col("id").alias("publication_id"), "citation_count")
    top = top_n(materialise(rows, "mentions"), ["dataset_id", "publication_year"], [F.desc_nulls_last("citation_count"), F.asc("publication_id")], 3, salt_by="publication_id")
    return top.select("dataset_id", "publication_year", "publication_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    def fields(df: DataFrame, source: str, key: str, columns: list[str]) -> DataFrame:
        return df.select(F.lit(source).alias("source_table"), F.col(key).cast("string").alias("row_key"), F.explode(F.array(*columns)).alias("text"))

    more = table(spark, d, "additional_discovered_datasets")
    aliases = split_packed(more, "dataset_id", "aliases").select(F.lit("additional_discovered_datasets").alias("source_table"), "row_key", F.col("value").alias("text"))
    every = (
        fields(table(spark, d, "evidence").where("dataset_id is null"), "evidence", "evidence_id", ["dataset_name", "matched_text"])
        .unionByName(fields(table(spark, d, "data_dyads").where("dataset_id is null"), "data_dyads", "dyad_id", ["alias"]))
        .unionByName(fields(more, "additional_discovered_datasets", "dataset_id", ["dataset_name"]))
        .unionByName(aliases)
    )
    return resolve_names(every, table(spark, d, "seed_datasets"))


def _squeezed(c: Column) -> Column:
    """Apart from case and white space."""
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def _used_datasets(spark: SparkSession, d: str) -> DataFrame:
    """(record, item): the datasets of each publication, from mentions and joins."""
    pubs = _publications(spark, d, [])
    mentioned = pubs.select(norm_key(F.col("id")).alias("record"), F.explode(_mentioned()).alias("item"))
    seeds = table(spark, d, "seed_datasets").select(norm_key(F.col("dataset_id")).alias("item"), _squeezed(F.col("dataset_name")).alias("name"))
    joins = table(spark, d, "dataset_joins")
    sides = joins.select(norm_key(F.col("publication_id")).alias("record"), F.explode(F.array("dataset1", "dataset2")).alias("name")).where("name is not null and record is not null")
    named = sides.withColumn("name", _squeezed(F.col("name"))).join(seeds, "name").select("record", "item").distinct()
    known = table(spark, d, "publications").select(norm_key(F.col("id")).alias("record"))
    return mentioned.unionByName(named.join(known, "record", "left_semi"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurring_pairs(_used_datasets(spark, d), "record", "item")
    return pairs.select(F.col("item_1").alias("dataset_id_1"), F.col("item_2").alias("dataset_id_2"))


def p5_lift(spark: SparkSession, d: str) -> DataFrame:
    """The pairs with their counts and lift."""
    pairs = cooccurring_pairs(_used_datasets(spark, d), "record", "item")
    return pairs.select(F.col("item_1").alias("dataset_id_1"), F.col("item_2").alias("dataset_id_2"), "n1", "n2", "n12", F.round("lift", 6).alias("lift"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return same_person_pairs(linked_authors(table(spark, d, "authors")))


def p7_people(spark: SparkSession, d: str) -> DataFrame:
    """Every linked record with the least author_id of its person."""
    return linked_authors(table(spark, d, "authors"))


def p7_unplaced(spark: SparkSession, d: str) -> DataFrame:
    """Records that come to no place, so are compared with none."""
    return unplaced(table(spark, d, "authors"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents").select("doc_id", "text"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).records()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return Mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), counts_only=True).shares()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"))


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return coverage(docs, shared_spans(docs))


QUERIES = {
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p5_found": p5_found, "p5_lift": p5_lift,
    "p7_found": p7_found, "p7_people": p7_people, "p7_unplaced": p7_unplaced,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_coverage": p10_coverage,
}

_PUBS = r"""
pubs AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(trim(id, E' \t\n\r')) ORDER BY harvested_at DESC NULLS LAST) AS rn
    FROM publications WHERE trim(id, E' \t\n\r') <> '') WHERE rn = 1),
mentions AS (
  SELECT DISTINCT lower(trim(id, E' \t\n\r')) AS record, id, publication_year, citation_count, lower(trim(m.id, E' \t\n\r')) AS dataset_id
  FROM (SELECT id, publication_year, citation_count, unnest(mentioned_datasets) AS m FROM pubs) WHERE trim(m.id, E' \t\n\r') <> '')"""

_P5 = rf"""
WITH {_PUBS},
sides AS (SELECT publication_id, dataset1 AS name FROM dataset_joins UNION ALL SELECT publication_id, dataset2 FROM dataset_joins),
named AS (
  SELECT lower(trim(publication_id, E' \t\n\r')) AS record, lower(s.dataset_id) AS dataset_id
  FROM sides JOIN seed_datasets s ON regexp_replace(lower(sides.name), '\s+', '', 'g') = regexp_replace(lower(s.dataset_name), '\s+', '', 'g')),
sets AS (
  SELECT record, dataset_id FROM mentions
  UNION SELECT record, dataset_id FROM named WHERE record IN (SELECT lower(trim(id, E' \t\n\r')) FROM publications)),
n AS (SELECT count(DISTINCT record) AS n FROM sets),
c AS (SELECT dataset_id, count(*) AS k FROM sets GROUP BY 1),
p AS (SELECT a.dataset_id AS x, b.dataset_id AS y, count(*) AS n12 FROM sets a JOIN sets b ON a.record = b.record AND a.dataset_id < b.dataset_id GROUP BY ALL),
scored AS (SELECT x AS dataset_id_1, y AS dataset_id_2, a.k AS n1, b.k AS n2, n12, n.n AS n FROM p JOIN c a ON a.dataset_id = x JOIN c b ON b.dataset_id = y, n),
cases AS (SELECT * FROM scored WHERE n12 >= 4 AND n12 >= 0.0005 * n AND n12 * n >= 3 * n1 * n2)
"""

ORACLE = {
    "p2_found": f"""
WITH {_PUBS}
SELECT dataset_id, publication_year, publication_id FROM (
  SELECT dataset_id, publication_year, id AS publication_id, row_number() OVER (PARTITION BY dataset_id, publication_year ORDER BY citation_count DESC NULLS LAST, id) AS rn
  FROM mentions WHERE publication_year IS NOT NULL) WHERE rn <= 3""",
    "p5_found": _P5 + "SELECT dataset_id_1, dataset_id_2 FROM cases",
    "p5_lift": _P5 + "SELECT dataset_id_1, dataset_id_2, n1, n2, n12, round(CAST(n12 AS DOUBLE) * n / (n1 * n2), 6) AS lift FROM cases",
}
