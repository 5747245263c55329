"""Mentions of registry entries in text, and the features that triage goes by."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import scores
from citeloom.functions.similarity import indel_ratio, may_reach
from citeloom.functions.text import count_matches, count_present
from citeloom.operators.registry import identifiers

#: The most terms that every task may hold.
MOST_TERMS = 1_000_000


def find_terms(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", window: int = 150, least: int = 3) -> DataFrame:
    """JOI18, SRT09: ``key, term, dataset_id, start, context``: each occurrence of a term regardless of case.

    All terms are looked for at once by one automaton per task, in one pass over the
    text and without a shuffle. ``terms`` has ``dataset_id, identifier``; it is
    checked to be under ``MOST_TERMS``; for longer lists :func:`find_terms_joined`
    finds the same without holding them. Terms under ``least`` characters are left out; null and empty
    texts have none; overlapping occurrences all count.
    """
    rows = terms.where(F.length("identifier") >= least).select("dataset_id", F.lower("identifier").alias("term")).distinct().limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: use find_terms_joined")
    held: dict[str, list[str]] = {}
    for r in rows:
        held.setdefault(r["term"], []).append(r["dataset_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = ahocorasick.Automaton()
        for t in held:
            a.add_word(t, t)
        if held:
            a.make_automaton()
        for b in batches:
            at, ts, ds, starts, contexts = [], [], [], [], []
            for i, body in enumerate(b.column(1).to_pylist()):
                low = body.lower() if body else ""
                if not held or not low:
                    continue
                same = len(low) == len(body)
                for end, t in a.iter(low):
                    start = end + 1 - len(t)
                    for d in held[t]:
                        at.append(i), ts.append(t), ds.append(d), starts.append(start)
                        contexts.append((body if same else low)[max(0, start - window) : end + 1 + window].strip())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.array(at, np.int64))), pa.array(ts, pa.string()), pa.array(ds, pa.string()), pa.array(starts, pa.int32()), pa.array(contexts, pa.string())], names=[key, "term", "dataset_id", "start", "context"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, term string, dataset_id string, start int, context string")


def find_terms_joined(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, shards: int = 64) -> DataFrame:
    """JOI18 for any number of terms: ``key, term, dataset_id`` where a term occurs, as :func:`find_terms` finds it.

    Terms are cut into ``shards`` by their hash. Of each term its first ``least``
    characters, which a text that holds the term holds too, are joined to the
    distinct stretches of that length in each text; a pair is kept where the whole
    term occurs. Only texts and terms that share such a stretch meet; common
    stretches are salted by text, and terms of one stretch go together as an array.
    """
    t = terms.where(F.length("identifier") >= least).select("dataset_id", F.lower("identifier").alias("term")).distinct()
    t = t.withColumn("gram", F.substring("term", 1, least)).withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))
    grouped = t.groupBy("gram", "shard").agg(F.collect_list(F.struct("term", "dataset_id")).alias("held"))
    low = docs.where(F.col(text).isNotNull()).select(key, F.lower(text).alias("low"))
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [sorted({t[i : i + least] for i in range(len(t) - least + 1)}) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.list_(pa.string()))], names=[key, "grams"])

    known = t.select("gram").distinct()
    asked = low.mapInArrow(cut, f"`{key}` {kind}, grams array<string>").select(key, F.explode("grams").alias("gram")).join(known, "gram", "left_semi")
    pairs = asked.join(grouped, "gram").select(key, "held")
    met = pairs.join(low, key).select(key, F.inline(F.filter("held", lambda x: F.contains(F.col("low"), x["term"]))))
    return met.select(key, "term", "dataset_id").distinct()


def fuzzy_words(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", least: int = 80) -> DataFrame:
    """JOI19: ``key, word, term, score``: distinct words whose ratio with a one-word term is ``least`` or more.

    Distinct words of all texts are compared, not words of each text. They meet
    terms by length class and by sharing the prefix filter's letter pairs.
    """
    from citeloom.operators.registry import similar_pairs

    t = terms.where(~F.col("identifier").rlike(r"\s")).select(F.lower("identifier").alias("text")).distinct()
    words = docs.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0)))).alias("word"))
    near = similar_pairs(words.select(F.col("word").alias("text")).distinct(), t, least / 100)
    return words.join(near, words["word"] == near["a"]).select(key, "word", F.col("b").alias("term"), F.round(F.col("score") * 100, 4).alias("score"))


def distinct_places(mentions: DataFrame, key: str = "doc_id", width: int = 10) -> DataFrame:
    """DED06: the first of mentions of one entry whose places lie in the same stretch of ``width`` characters."""
    order = F.struct("start", "term")
    cols = [c for c in mentions.columns if c not in (key, "dataset_id")]
    best = mentions.groupBy(key, "dataset_id", F.floor(F.col("start") / width).alias("_cell")).agg(F.min_by(F.struct(*cols), order).alias("m"))
    return best.select(key, "dataset_id", *[F.col(f"m.{c}").alias(c) for c in cols])


def triage_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """AGG22, AGG23: counts of words, numbers and statistics in each text; nothing leaves the JVM. Null texts count as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    return docs.select(
        key, F.length(t).alias("text_length"), count_present(low, scores.ANALYSIS_WORDS).alias("analysis_words"), count_present(low, scores.DATASET_WORDS).alias("dataset_words"), count_present(low, scores.METHOD_WORDS).alias("method_words"),
        count_matches(t, [scores.NUMBER]).alias("numbers"), count_matches(low, scores.STATISTICS).alias("statistics"), low.rlike(r"methods?:").alias("has_methods"), low.rlike(r"results?:").alias("has_results"),
    )


def triage(features: DataFrame, base: Column, said: Column, least: float = 6.0) -> DataFrame:
    """FIL05, FIL07, MTH04: ``is_data_analysis`` by the base confidence, ``confidence`` as adjusted by the features."""
    indicators = F.col("analysis_words") + F.col("dataset_words") + F.col("method_words")
    adjusted = scores.triage_adjusted(base, F.col("analysis_words"), F.col("statistics"), F.col("has_methods") & F.col("has_results"), indicators)
    return features.withColumn("confidence", adjusted).withColumn("is_data_analysis", F.coalesce(said & (base >= least), F.lit(False)))


def entry_terms(datasets: DataFrame) -> DataFrame:
    """``dataset_id, identifier`` of all names and aliases."""
    return identifiers(datasets).select("dataset_id", "identifier")


def similar_enough(a: Column, b: Column, least: float) -> Column:
    """A ratio test that spares pairs whose lengths rule it out."""
    return F.when(may_reach(a, b, least), indel_ratio(a, b) >= least).otherwise(F.lit(False))
