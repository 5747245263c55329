"""Publications: mapping of harvested rows, search documents, mentions, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import entity_id, full_name, orcid_of

# Types of publications that one origin is asked for.
SEARCH_TYPES = ["article", "chapter", "proceeding", "monograph", "preprint"]


def by_score(topics: Column) -> Column:
    """SRT02: by score descending with nulls last, equal ones in their order."""
    placed = F.transform(topics, lambda t, i: F.struct(F.coalesce(-t["score"], F.lit(float("inf"))).alias("k"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(placed), lambda x: x["t"])


def map_dimensions(rows: DataFrame) -> DataFrame:
    """PRJ01: rows of one origin as publications. Columns: ``id, title, doi, type, year, times_cited, journal, authors, concepts_scores, category_for, issn``."""
    people = F.transform("authors", lambda a: F.struct(
        a["researcher_id"].alias("id"), full_name(a["first_name"], a["last_name"]).alias("name"), F.array_join(a["orcid"], ", ").alias("orcid"), a["affiliations"].alias("institutions")))
    topics = by_score(F.transform("concepts_scores", lambda c: F.struct(F.lit(None).cast("string").alias("id"), F.lit("concept").alias("type"), c["concept"].alias("name"), c["relevance"].alias("score"))))
    journal = F.when(F.col("journal").isNotNull(), F.array(F.struct(F.col("journal.id").alias("id"), F.col("journal.title").alias("name"), F.array_join("issn", ", ").alias("issn")))).otherwise(F.array().cast("array<struct<id:string,name:string,issn:string>>"))
    return rows.select(F.lit("dimensions").alias("origin"), "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("doi", F.lit("")).alias("doi"), "type", F.col("year").alias("publication_year"), F.col("times_cited").alias("citation_count"), journal.alias("journals"), people.alias("authors"), topics.alias("topics"), "category_for")


def map_openalex(rows: DataFrame) -> DataFrame:
    """PRJ02: rows of the other origin; ids come out of addresses, rows whose own id has none are left out."""
    people = F.transform("authorships", lambda a: F.struct(
        entity_id(a["author"]["id"], "author").alias("id"), a["author"]["display_name"].alias("name"), orcid_of(a["author"]["orcid"]).alias("orcid"),
        F.transform(a["institutions"], lambda i: F.struct(entity_id(i["id"], "institution").alias("id"), i["display_name"].alias("name"), i["country_code"].alias("country_code"))).alias("institutions")))
    journals = F.transform(F.filter("locations", lambda x: x["source"].isNotNull()), lambda x: F.struct(entity_id(x["source"]["id"], "source").alias("id"), x["source"]["display_name"].alias("name"), x["source"]["issn_l"].alias("issn")))
    topics = F.transform("topics", lambda t: F.struct(t["id"].alias("id"), F.lit("topic").alias("type"), t["display_name"].alias("name"), t["score"].alias("score")))
    mapped = rows.select(F.lit("openalex").alias("origin"), entity_id(F.col("id"), "publication").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("doi", F.lit("")).alias("doi"), "type", "publication_year", F.col("cited_by_count").alias("citation_count"), journals.alias("journals"), people.alias("authors"), topics.alias("topics"))
    return mapped.where("id <> ''")


def main_topics(topics: Column, least: float = 0.7) -> Column:
    """FIL04: topics that score more than ``least``, else the best one alone; empty for none."""
    ranked = by_score(F.filter(topics, lambda t: t.isNotNull()))
    high = F.filter(ranked, lambda t: t["score"] > least)
    return F.when(F.size(high) > 0, high).otherwise(F.slice(ranked, 1, 1))


def search_documents(pubs: DataFrame) -> DataFrame:
    """PRJ03, AGG30, ARR01: one flat row per publication, lists joined by commas, and one text to search."""
    names = lambda c: F.filter(F.transform(c, lambda x: x["name"]), lambda n: n.isNotNull() & (F.lower(n) != "nan"))
    inst = F.flatten(F.transform(F.filter("authors", lambda a: a.isNotNull() & a["institutions"].isNotNull()), lambda a: F.filter(a["institutions"], lambda i: i.isNotNull())))
    distinct = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda n: n.isNotNull())))
    listed = {
        "journals": names(F.col("journals")), "authors": names(F.col("authors")), "institutions": distinct(F.transform(inst, lambda i: i["name"])),
        "countries": distinct(F.transform(inst, lambda i: i["country"])), "topics": names(main_topics(F.col("topics"))), "categories": names(F.col("category_for")), "datasets": distinct(F.transform(F.filter("mentioned_datasets", lambda m: m.isNotNull()), lambda m: m["name"])),
    }
    flat = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ").alias(n) for n, c in listed.items()]
    out = pubs.select("id", "title", "doi", "type", "publication_year", "citation_count", *flat)
    return out.withColumn("all_search_text", F.concat_ws(", ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "doi", *listed)]))


def phrase_query(text: Column, any_of: list[str], flags: list[str] = (), none_of: list[str] = (), strip: bool = False) -> Column:
    """FIL01: one of the phrases, one of the flags if there are any, none of the excluded; regardless of case.

    ``strip`` takes brackets, dots and commas out of the phrases first, as one origin asks.
    """
    import re

    low = F.lower(text)

    def some(words: list[str]) -> Column:
        c = F.lit(False)
        for w in words:
            c = c | F.contains(low, F.lit(w.lower()))
        return c

    found = some([re.sub(r"[().,]", "", a) if strip else a for a in any_of])
    if flags:
        found = found & some(list(flags))
    return F.coalesce(found & ~some(list(none_of)) if none_of else found, F.lit(False))


def search_window(pubs: DataFrame, start: int, end: int, types: list[str] = SEARCH_TYPES, country: str | None = None) -> DataFrame:
    """FIL02: years, types and, if asked, an institution's country; the first two reach the scan."""
    out = pubs.where(F.col("publication_year").between(start, end) & F.col("type").isin(*types))
    return out if country is None else out.where(F.exists("authors", lambda a: F.exists(a["institutions"], lambda i: i["country_code"] == country)))


def about(topics: Column, names: list[str], least: float = 0.6) -> Column:
    """FIL03: a topic of that name with at least that score."""
    return F.coalesce(F.exists(topics, lambda t: F.lower(t["name"]).isin(*[n.lower() for n in names]) & (t["score"] >= least)), F.lit(False))


def find_publications(pubs: DataFrame, *, doi: str | None = None, title: str | None = None, authors: list[str] = (), institutions: list[str] = (), journals: list[str] = (), topics: list[str] = (), datasets: list[str] = (), years: list[int] = (), citations: tuple[int | None, int | None] = (None, None), limit: int = 100) -> DataFrame:
    """FIL15, FIL16, SRT06: all given conditions at once; title by any of its words; the first ``limit`` by id."""

    def named(array: str, wanted: list[str]) -> Column:
        return F.exists(array, lambda x: x["name"].isin(*wanted))

    c = F.lit(True)
    if doi is not None:
        c = c & (F.col("doi") == doi)
    if title:
        c = c & F.arrays_overlap(F.split(F.lower("title"), r"\W+"), F.array(*[F.lit(w) for w in title.lower().split()]))
    for array, wanted in (("authors", authors), ("journals", journals), ("topics", topics), ("mentioned_datasets", datasets)):
        if wanted:
            c = c & named(array, list(wanted))
    if institutions:
        c = c & F.exists("authors", lambda a: F.exists(a["institutions"], lambda i: i["name"].isin(*institutions)))
    if years:
        c = c & F.col("publication_year").isin(*years)
    low, high = citations
    if low is not None:
        c = c & (F.col("citation_count") >= low)
    if high is not None:
        c = c & (F.col("citation_count") <= high)
    return pubs.where(c).orderBy("id").limit(limit)


def find_institutions(inst: DataFrame, *, country: str | None = None, state: str | None = None, city: str | None = None, code: str | None = None, limit: int = 100) -> DataFrame:
    """FIL17: parts of names regardless of case, country codes in upper case."""
    c = F.lit(True)
    for column, part in (("country", country), ("state", state), ("city", city)):
        if part:
            c = c & F.contains(F.lower(column), F.lit(part.lower()))
    if code:
        c = c & (F.upper("country_code") == code.upper())
    return inst.where(c).orderBy("id").limit(limit)


def absent_from(new: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """JOI07, DED03: new rows whose key isn't stored, one per key."""
    return new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def merge_mentions(stored: Column, incoming: Column) -> Column:
    """JOI08, PRJ04: stored mentions, then incoming ones whose id isn't among them; nulls are empty."""
    old = F.coalesce(stored, F.slice(incoming, 1, 0), F.array())
    return F.concat(old, F.filter(F.coalesce(incoming, F.slice(stored, 1, 0), F.array()), lambda n: ~F.exists(old, lambda o: o["id"].eqNullSafe(n["id"]))))


def enrich_institutions(pubs: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """JOI09, SRC10, SRC12, SRC13: ``publication_id, author_pos, pos, institution``: stored data where the id is known, else what the publication says.

    ``known`` has ``id`` and any of the institution's fields; rows without an id stay as they are.
    """
    a = pubs.select(F.col(key).alias("publication_id"), F.posexplode("authors").alias("author_pos", "a"))
    i = a.select("publication_id", "author_pos", F.posexplode("a.institutions").alias("pos", "i")).where("i is not null")
    fields = [f.name for f in i.schema["i"].dataType.fields]
    k = known.where("id is not null").dropDuplicates(["id"]).select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in known.columns if c != "id" and c in fields])
    got = i.join(k, F.col("i.id") == F.col("_id"), "left")
    best = F.struct(*[(F.coalesce(F.col(f"_{f}"), F.col(f"i.{f}")) if f"_{f}" in k.columns and f != "id" else F.col(f"i.{f}")).alias(f) for f in fields])
    return got.select("publication_id", "author_pos", "pos", best.alias("institution"))
