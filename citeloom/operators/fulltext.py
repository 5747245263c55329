"""Full texts of publications: nested sections and sentences as text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.shred import decode

# The parts of a full text in the order they are read, and heading words of kinds of sections.
PARTS = "abstract acknowledgement annex annotations authorships bibliography body funding graphics identifiers keywords content notes tables title".split()
HEADINGS = {
    "method": ["method", "approach", "analysis", "data"], "result": ["result", "finding", "outcome"], "conclusion": ["conclusion", "discussion", "summary"],
    "discovery": ["method", "methodology", "data", "dataset", "materials", "procedure", "experiment", "analysis", "statistical", "sample", "participants"],
    "joins": ["method", "methodology", "approach", "procedure", "experiment", "data processing", "data analysis", "implementation", "setup"],
}


def read_fulltext(spark: SparkSession, path: str, publication_id: str | None = None) -> DataFrame:
    """SRC04, SRC05: full texts of a parquet folder, of one publication if asked; the id reaches the scan.

    Fails where the id or the text column lacks, or the one publication isn't there.
    """
    df = spark.read.parquet(path)
    lacking = {"publication_id", "fulltext"} - set(df.columns)
    if lacking:
        raise ValueError(f"no column {', '.join(sorted(lacking))} in {path}")
    if publication_id is None:
        return df
    one = df.where(F.col("publication_id") == publication_id)
    if one.isEmpty():
        raise LookupError(publication_id)
    return one


def batches(df: DataFrame, size: int = 1000) -> DataFrame:
    """SRC06, SRC07: rows with the number of their batch of at most ``size`` within their partition."""

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in it:
            yield b.append_column("batch", pa.array([(n + i) // size for i in range(b.num_rows)], pa.int32()))
            n += b.num_rows

    return df.mapInArrow(number, T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())]))


def section_text(section: Column) -> Column:
    """PRJ09: a section's sentences joined by blanks."""
    return F.array_join(F.transform(section["sentences"], lambda s: s["text"]), " ")


def content_text(content: Column) -> Column:
    """PRJ09: a content's sections joined by blanks; empty for null."""
    return F.coalesce(F.array_join(F.filter(F.transform(content["sections"], section_text), lambda t: t != ""), " "), F.lit(""))


def text_parts(df: DataFrame) -> DataFrame:
    """PRJ10-12, FIL26: ``publication_id``, the named parts, all text, DOI, keywords and which parts are there.

    Rows without any id are left out; the first of several ids stands in for a missing one.
    """
    parts = {"title": F.coalesce(F.col("fulltext.title.text"), F.lit(""))} | {p: content_text(F.col(f"fulltext.{p}")) for p in ("abstract", "body", "acknowledgement", "availability") if p in df.schema["fulltext"].dataType.fieldNames()}
    ids = F.coalesce("publication_id", F.try_element_at("publication_ids", F.lit(1))) if "publication_ids" in df.columns else F.col("publication_id")
    rows = df.select(ids.alias("publication_id"), *[c.alias(n) for n, c in parts.items()], F.col("fulltext.identifiers.doi").alias("doi"), F.col("fulltext.keywords").alias("keywords"))
    rows = rows.where(F.col("publication_id").isNotNull() & (F.col("publication_id") != ""))
    rows = rows.withColumn("text_content", F.concat_ws(" ", *[F.nullif(F.col(p), F.lit("")) for p in parts]))
    return rows.select("*", *[(F.length(p) > 0).alias(f"has_{p}") for p in parts if p != "title"], (F.length("text_content") > 0).alias("is_valid"))


def sections_about(content: Column, kind: str) -> Column:
    """PRJ14: text of the sections whose heading has a word of ``kind``, joined by line ends."""
    words = "|".join(HEADINGS[kind])
    return F.coalesce(F.array_join(F.transform(F.filter(content["sections"], lambda s: F.lower(F.coalesce(s["title"]["text"], F.lit(""))).rlike(words)), section_text), "\n"), F.lit(""))


def distinct_lines(texts: Column) -> Column:
    """DED05: texts of more than three characters, the first of those that are equal regardless of case."""
    clean = F.filter(F.transform(texts, lambda t: F.trim(F.regexp_replace(t, r"(?U)\s+", " "))), lambda t: F.length(t) > 3)
    # position of the first equal one decides; places are kept
    low = F.transform(clean, lambda t: F.lower(t))
    return F.filter(F.transform(clean, lambda t, i: F.when(F.array_position(low, F.lower(t)) == i + 1, t)), lambda t: t.isNotNull())


def harvest(value: object) -> list[str]:
    """PRJ13 for one JSON value: all its texts, depth first, known parts first, trimmed, once each."""
    seen: set[str] = set()
    out: list[str] = []
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            t = " ".join(v.split())
            if len(t) > 3 and t.lower() not in seen:
                seen.add(t.lower())
                out.append(t)
        elif isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            order = [k for k in PARTS if k in v] + [k for k in v if k not in PARTS]
            stack += [v[k] for k in reversed(order)]
    return out


def harvested(df: DataFrame, key: str, column: str) -> DataFrame:
    """PRJ13: ``key, raw_text``: every text in the JSON of ``column`` on a line of its own; empty for null or no JSON."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["\n".join(harvest(decode(t))) for t in b.column(1).to_pylist()], pa.string())], names=[key, "raw_text"])

    return df.select(F.col(key).cast("string"), F.col(column).cast("string")).mapInArrow(run, f"`{key}` string, raw_text string")
