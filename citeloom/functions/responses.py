"""Reading the JSON in model responses, which is often wrapped, broken or no JSON at all."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that name datasets in prose, and two datasets that are put together.
NAME_PATTERNS = [r'"([^"]{3,50})"', r"\b([A-Z][A-Z0-9\s]{2,30})\b", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+Dataset)\b", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+Database)\b"]
PAIR_PATTERNS = [r"(?i)(\w+(?:\s+\w+)*)\s+(?:and|with|combined with|merged with|joined with)\s+(\w+(?:\s+\w+)*)", r"(?i)(\w+(?:\s+\w+)*)\s+(?:integration|fusion|combination)\s+(?:with|of)\s+(\w+(?:\s+\w+)*)", r"(?i)(\w+(?:\s+\w+)*)\s+plus\s+(\w+(?:\s+\w+)*)"]


def envelope(response: Column) -> Column:
    """JSN08: the message of a chat envelope, its text, or the response itself; empty for null."""
    return F.coalesce(F.get_json_object(response, "$.choices[0].message.content"), F.get_json_object(response, "$.text"), response, F.lit(""))


def outer_object(text: Column) -> Column:
    """From the first opening to the last closing brace; empty if there is none."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def first_list(text: Column) -> Column:
    """JSN02: the first list of objects; empty if there is none."""
    return F.regexp_extract(text, r"(?s)\[\s*\{.*?\}\s*\]", 0)


def repaired(text: Column) -> Column:
    """STR21: outer braces only, no trailing commas, null for absent values, no line ends."""
    c = outer_object(text)
    for pattern, to in ((r",\s*([}\]])", "$1"), (r":\s*([,}])", ": null$1"), (r"\s*\n\s*", " ")):
        c = F.regexp_replace(c, pattern, to)
    return c


@F.pandas_udf(T.StringType())
def escape_inner_lines(texts: pd.Series) -> pd.Series:
    """STR22: line ends inside quoted strings as \\n; the rest as it is."""
    return texts.map(lambda t: None if t is None else re.sub(r'"(?:[^"\\]|\\.)*"', lambda m: m.group().replace("\n", "\\n"), t))


def triage(response: Column) -> Column:
    """JSN01: (is_data_analysis, confidence): the whole response as JSON, else the object in it that
    has the key, else true at 5.0 where it says true or yes; false at 0 otherwise."""
    schema = "is_data_analysis boolean, confidence string"
    whole = F.from_json(response, schema)
    inner = F.from_json(F.regexp_extract(response, r'(?s)\{[^{}]*"is_data_analysis"[^{}]*\}', 0), schema)
    said = F.lower(F.coalesce(response, F.lit(""))).rlike("true|yes")
    use = F.when(whole["is_data_analysis"].isNotNull(), whole).when(inner["is_data_analysis"].isNotNull(), inner)
    return F.struct(
        F.coalesce(use["is_data_analysis"], said).alias("is_data_analysis"),
        F.coalesce(F.try_to_number(use["confidence"], F.lit("99.99")).cast("double"), F.when(use.isNull() & said, 5.0), F.lit(0.0)).alias("confidence"),
    )


def validations(response: Column) -> Column:
    """JSN02: the list of judged datasets, scores as numbers even where quoted; an empty array where nothing parses."""
    rows = F.from_json(first_list(response), "array<struct<name string, mentioned string, used string, confidence_mention string, confidence_use string, reasoning string>>")
    return F.coalesce(
        F.transform(rows, lambda r: F.struct(
            r["name"].alias("name"), (F.lower(r["mentioned"]) == "true").alias("is_mentioned"), (F.lower(r["used"]) == "true").alias("is_used"),
            F.coalesce(r["confidence_mention"].try_cast("double"), F.lit(0.0)).alias("confidence_mention"), F.coalesce(r["confidence_use"].try_cast("double"), F.lit(0.0)).alias("confidence_use"), r["reasoning"].alias("reasoning"))),
        F.array().cast("array<struct<name:string,is_mentioned:boolean,is_used:boolean,confidence_mention:double,confidence_use:double,reasoning:string>>"),
    )


def discoveries(response: Column) -> Column:
    """JSN03: named datasets of the response or of its repaired form; null where it holds no JSON (then see :func:`names_in_prose`)."""
    schema = "struct<datasets array<struct<name string, confidence string, context string, domain string>>>"
    got = F.coalesce(F.from_json(response, schema)["datasets"], F.from_json(repaired(response), schema)["datasets"])
    return F.transform(F.filter(got, lambda d: F.trim(F.coalesce(d["name"], F.lit(""))) != ""), lambda d: F.struct(d["name"].alias("name"), F.coalesce(d["confidence"].try_cast("double"), F.lit(5.0)).alias("confidence"), d["context"].alias("context"), d["domain"].alias("domain")))


def joins(response: Column) -> Column:
    """JSN04: joins with two different names (FIL09); null where it holds no JSON (then see :func:`pairs_in_prose`)."""
    got = F.from_json(outer_object(response), "struct<joins array<struct<dataset1 string, dataset2 string, join_type string, confidence string>>>")["joins"]
    ok = F.filter(got, lambda j: (F.trim(F.coalesce(j["dataset1"], F.lit(""))) != "") & (F.trim(F.coalesce(j["dataset2"], F.lit(""))) != "") & (j["dataset1"] != j["dataset2"]))
    return F.transform(ok, lambda j: F.struct(j["dataset1"].alias("dataset1"), j["dataset2"].alias("dataset2"), j["join_type"].alias("join_type"), F.coalesce(j["confidence"].try_cast("double"), F.lit(0.0)).alias("confidence")))


def methodology(response: Column) -> Column:
    """JSN05: the fields of one methodology, absent lists empty."""
    got = F.from_json(outer_object(response), "struct<approach string, algorithm string, matching_strategy string, join_keys array<string>, preprocessing_steps array<string>, validation_methods array<string>>")
    lists = ["join_keys", "preprocessing_steps", "validation_methods"]
    return F.struct(*[got[f].alias(f) for f in ("approach", "algorithm", "matching_strategy")], *[F.coalesce(got[f], F.array().cast("array<string>")).alias(f) for f in lists])


def challenge_items(response: Column, name: str = "challenges") -> Column:
    """JSN06: items that may be objects or plain texts, as (description, severity)."""
    items = F.try_variant_get(F.try_parse_json(outer_object(response)), f"$.{name}", "array<variant>")
    return F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda v: F.struct(
        F.coalesce(F.try_variant_get(v, "$.description", "string"), F.try_variant_get(v, "$", "string")).alias("description"),
        F.coalesce(F.try_variant_get(v, "$.severity", "string"), F.lit("medium")).alias("severity")))


def alignment(response: Column) -> Column:
    """JSN07: (score held to 0 to 10, first five signals) of a repository's alignment."""
    got = F.from_json(outer_object(response), "struct<alignment_score string, signals array<string>>")
    return F.struct(F.least(F.greatest(F.coalesce(got["alignment_score"].try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(10.0)).alias("score"), F.slice(F.coalesce(got["signals"], F.array().cast("array<string>")), 1, 5).alias("signals"))


def names_in_prose(response: Column, least: int = 3) -> Column:
    """STR25: names by the patterns above, in their order, once each."""
    found = F.concat(*[F.regexp_extract_all(response, F.lit(p), F.lit(1)) for p in NAME_PATTERNS])
    return F.array_distinct(F.filter(F.transform(found, lambda n: F.trim(n)), lambda n: F.length(n) >= least))


def pairs_in_prose(response: Column) -> Column:
    """STR24: (dataset1, dataset2), the first two words of either side; longer than two characters and different regardless of case."""
    two = lambda s: F.array_join(F.slice(F.split(F.trim(s), r"\s+"), 1, 2), " ")
    parts = [F.arrays_zip(F.regexp_extract_all(response, F.lit(p), F.lit(1)).alias("a"), F.regexp_extract_all(response, F.lit(p), F.lit(2)).alias("b")) for p in PAIR_PATTERNS]
    found = F.concat(*[F.transform(p, lambda x: F.struct(two(x["a"]).alias("dataset1"), two(x["b"]).alias("dataset2"))) for p in parts])
    return F.filter(found, lambda x: (F.length(x["dataset1"]) > 2) & (F.length(x["dataset2"]) > 2) & (F.lower(x["dataset1"]) != F.lower(x["dataset2"])))
