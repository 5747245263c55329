"""The registry of datasets: alias index, name joins, lookups.

The rule throughout is that the first wins: entries carry ``src_ord`` (file, then
row), aliases their place, and every choice is a ``min_by`` over that order, never
over the order in which rows happen to come.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.similarity import indel_ratio, may_reach
from citeloom.functions.text import alias_list, plain_name, slug
from citeloom.sources.session import materialise

#: The most aliases of a registry that every task may hold.
MOST_ALIASES = 1_000_000


def ordered_union(*parts: DataFrame, order: str = "dataset_id") -> DataFrame:
    """SRC01, DED01: registries one after another. ``src_ord`` is (file, ``order``), which files keep."""
    out = None
    for i, p in enumerate(parts):
        q = p.withColumn("src_ord", F.struct(F.lit(i).alias("file"), F.col(order).alias("row")))
        out = q if out is None else out.unionByName(q, allowMissingColumns=True)
    return out


def alias_index(registry: DataFrame) -> DataFrame:
    """JOI03, WIN01: ``norm, dataset_id, ord``: each plain name or alias with its first entry.

    Names without letters or figures come out as the empty norm, like any other.
    """
    names = F.concat(F.array("dataset_name"), alias_list(F.col("aliases")))
    rows = registry.select("dataset_id", "src_ord", F.posexplode(names).alias("pos", "alias")).where("alias is not null")
    rows = rows.withColumn("ord", F.struct("src_ord", "pos"))
    return rows.groupBy(plain_name(F.col("alias")).alias("norm")).agg(F.min_by("dataset_id", "ord").alias("dataset_id"), F.min("ord").alias("ord"))


def first_overlap(norms: DataFrame, index: DataFrame, most: int = MOST_ALIASES) -> DataFrame:
    """``norm, dataset_id``: for distinct ``norm``, the first alias of ``index`` that holds it or that it holds.

    Aliases inside a norm are found by one automaton per task, in a pass over the
    norms; norms inside an alias by an equi-join with the parts of aliases, each
    with its first alias. Tasks hold the index while it has no more than
    ``MOST_ALIASES``; with a larger one both ways are joins (:func:`contained`).
    """
    ranked = index.select("norm", "dataset_id", "ord").orderBy("ord").limit(most + 1).collect()
    if len(ranked) > most:
        k = index.select(F.col("norm").alias("key"), F.col("dataset_id").alias("first_id"), "ord")
        keys, asked = k.select("key").distinct(), norms.select("norm")
        met = contained(asked.select(F.col("norm").alias("text")), keys.select(F.col("key").alias("part"))).select(F.col("text").alias("norm"), F.col("part").alias("key"))
        met = met.unionByName(contained(keys.select(F.col("key").alias("text")), asked.select(F.col("norm").alias("part"))).select(F.col("part").alias("norm"), F.col("text").alias("key"))).distinct()
        return met.join(k, "key").groupBy("norm").agg(F.min_by("first_id", "ord").alias("dataset_id"))
    spark = norms.sparkSession
    order = [(r["norm"], r["dataset_id"]) for r in ranked]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = ahocorasick.Automaton()
        always = min((i for i, (n, _) in enumerate(order) if not n), default=None)
        for i, (n, _) in enumerate(order):
            if n and n not in a:
                a.add_word(n, i)
        if len(a):
            a.make_automaton()
        for b in batches:
            first = []
            for n in b.column(0).to_pylist():
                best = min((i for _, i in a.iter(n)), default=None) if len(a) else None
                best = min((x for x in (best, always) if x is not None), default=None)
                first.append(0 if not n and order else best)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(first, pa.int64())], names=["norm", "i"])

    ids = spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(order)], "i long, key string, dataset_id string")
    from_norm = norms.mapInArrow(held, "norm string, i long").where("i is not null")
    part = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("key")), lambda s: F.transform(F.sequence(F.lit(1), F.length("key") - s + 1), lambda n: F.substring("key", s, n)))))
    parts = ids.where("key <> ''").select("i", part.alias("norm")).groupBy("norm").agg(F.min("i").alias("i"))
    both = from_norm.unionByName(norms.join(parts, "norm").select("norm", "i")).groupBy("norm").agg(F.min("i").alias("i"))
    return both.join(ids, "i").select("norm", "dataset_id")


def contained(texts: DataFrame, parts: DataFrame, size: int = 3) -> DataFrame:
    """``text, part``: every distinct part that lies in a distinct text; the empty one lies in all.

    An equi-join: a part is looked up by its first ``size`` characters (all of a
    shorter one) among the stretches of a text, so only pairs that share one are compared.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [sorted({"", *(t[i : i + n] for n in range(1, size + 1) for i in range(len(t) - n + 1))}) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.list_(pa.string()))], names=["text", "grams"])

    stretches = texts.select("text").distinct().mapInArrow(cut, "text string, grams array<string>").select("text", F.explode("grams").alias("gram"))
    asked = parts.select("part").distinct().withColumn("gram", F.substring("part", 1, size))
    return stretches.join(asked, "gram").where(F.contains("text", F.col("part"))).select("text", "part")


def match_names(names: DataFrame, registry: DataFrame, name: str = "name") -> DataFrame:
    """JOI01, JOI02: ``name, dataset_id, how`` of every distinct name.

    Exact names first, then equal plain names, then the first alias that contains
    the plain name or is contained in it; an empty plain name is in every alias.
    The last is no theta join: see :func:`first_overlap`. Null names don't come out.
    """
    distinct = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    exact = registry.where("dataset_name is not null").groupBy(F.col("dataset_name").alias("name")).agg(F.min_by("dataset_id", "src_ord").alias("exact_id"))
    index = alias_index(registry)
    got = distinct.join(exact, "name", "left").withColumn("norm", plain_name(F.col("name"))).join(index.select("norm", F.col("dataset_id").alias("norm_id")), "norm", "left")
    got = materialise(got, "names")  # read three times below; the names' table only once
    open_ = got.where("exact_id is null and norm_id is null").select("norm").distinct()
    inside = first_overlap(open_, index).withColumnRenamed("dataset_id", "part_id")
    all_ = got.join(inside, "norm", "left")
    how = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("norm_id").isNotNull(), "norm").when(F.col("part_id").isNotNull(), "substring").otherwise("none")
    return all_.select("name", F.coalesce("exact_id", "norm_id", "part_id").alias("dataset_id"), how.alias("how"))


def unregistered(names: DataFrame, registry: DataFrame, name: str = "name", order: str = "ord") -> DataFrame:
    """JOI04: new entries for names the registry has neither as they are nor as plain names: first of each norm, id by slug."""
    index = alias_index(registry).select("norm")
    known = registry.select(F.col("dataset_name").alias("name"))
    rows = names.select(F.col(name).alias("name"), F.col(order).alias("ord")).where("name is not null").withColumn("norm", plain_name(F.col("name")))
    new = rows.join(known, "name", "left_anti").join(index, "norm", "left_anti")
    first = new.groupBy("norm").agg(F.min_by("name", F.struct("ord", "name")).alias("dataset_name"))
    return first.select(slug(F.col("dataset_name")).alias("dataset_id"), "dataset_name", "norm")


def identifiers(datasets: DataFrame) -> DataFrame:
    """``dataset_id, identifier, pos``: name (0) and aliases of every entry, once each."""
    return datasets.select("dataset_id", F.posexplode(F.array_distinct(F.concat(F.array("dataset_name"), alias_list(F.col("aliases"))))).alias("pos", "identifier")).where("identifier is not null")


def lookup_exact(asked: DataFrame, datasets: DataFrame, alias: str = "alias") -> DataFrame:
    """JOI05: entries that have an asked alias regardless of case: ``alias, dataset_id, score`` (1.0), names before aliases."""
    a = asked.select(F.col(alias).alias("alias")).distinct().withColumn("key", F.lower("alias"))
    ids = identifiers(datasets).withColumn("key", F.lower("identifier"))
    return a.join(ids, "key").groupBy("alias", "dataset_id").agg(F.min("pos").alias("pos")).select("alias", "dataset_id", F.when(F.col("pos") == 0, "name").otherwise("alias").alias("matched_on"), F.lit(1.0).alias("score"))


def similar_pairs(left: DataFrame, right: DataFrame, least: float = 0.8) -> DataFrame:
    """``a, b, score``: all pairs of ``text`` of both sides whose indel ratio is ``least`` or more (0.7 to 1).

    Texts of that ratio keep a part of their letter pairs in common; of each text
    only the rarest pairs are joined, as many as make sure that partners meet.
    Texts of three letters or fewer meet by single letters. Texts are distinct.
    """
    if not 0.7 <= least <= 1:
        raise ValueError("least must lie between 0.7 and 1")
    keep = (1.5 * least - 1) * (1 + least / (2 - least))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side, texts, out, takes = [], [], [], []
            for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                # equal pairs of letters are told apart by how often they came before
                seen: Counter = Counter()
                own = []
                for g in (t[i : i + 2] for i in range(max(len(t) - 1, 1))):
                    own.append(f"{g}#{seen[g]}")
                    seen[g] += 1
                if len(t) < 5:  # short texts keep all they have
                    own += sorted(set(t))
                    take = len(own)
                else:
                    take = max(len(own) - max(math.ceil(len(t) * keep - 1), 1) + 1, 1)
                side += [s] * len(own)
                texts += [t] * len(own)
                takes += [take] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int32()), pa.array(texts, pa.string()), pa.array(takes, pa.int32()), pa.array(out, pa.string())], names=["side", "text", "take", "gram"])

    both = left.select(F.lit(0).alias("side"), "text").unionByName(right.select(F.lit(1).alias("side"), "text")).where("text is not null")
    rows = materialise(both.mapInArrow(grams, "side int, text string, take int, gram string"), "grams")
    df = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("side", "text").orderBy("df", "gram"))
    rarest = rows.join(df, "gram").withColumn("rank", rank).where(F.col("rank") <= F.col("take"))
    l, r = rarest.where("side = 0").select(F.col("text").alias("a"), "gram"), rarest.where("side = 1").select(F.col("text").alias("b"), "gram")
    met = l.join(r, "gram").where(may_reach(F.col("a"), F.col("b"), least * 100)).select("a", "b")
    # few bytes but much work a pair: spread by a fixed number, which also serves the grouping;
    # the count keeps the tests from being pushed below it, where pairs still repeat
    met = met.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    once = F.when(F.col("n") > 0, F.col("a"))
    # edits are never more than insertions and deletions alone: a test in the JVM before any Python
    met = met.where(F.levenshtein(once, F.col("b")) <= F.lit(1 - least + 1e-9) * (F.length("a") + F.length("b")))
    return met.withColumn("score", indel_ratio(once, F.col("b")) / 100).where(F.col("score") >= least).select("a", "b", "score")


def lookup_fuzzy(asked: DataFrame, datasets: DataFrame, alias: str = "alias", least: float = 0.8) -> DataFrame:
    """JOI06, SRT10, WIN02: for aliases without an exact hit, each entry's most similar identifier of ``least`` or more.

    Candidates come from a prefix filter over pairs of letters, which loses none
    (see :func:`similar_pairs`); only those reach Python.
    """
    hit = lookup_exact(asked, datasets, alias).select("alias")
    a = asked.select(F.col(alias).alias("alias")).where("alias is not null").distinct().join(hit, "alias", "left_anti")
    ids = identifiers(datasets)
    near = similar_pairs(a.select(F.lower("alias").alias("text")).distinct(), ids.select(F.lower("identifier").alias("text")).distinct(), least)
    pairs = a.join(near, F.lower("alias") == F.col("a")).join(ids, F.lower("identifier") == F.col("b")).select("alias", "dataset_id", "identifier", "score")
    best = pairs.groupBy("alias", "dataset_id").agg(F.max_by("identifier", F.struct("score", "identifier")).alias("identifier"), F.max("score").alias("score"))
    return best.select("alias", "dataset_id", "identifier", F.round("score", 6).alias("score"))


def first_known(names: DataFrame, datasets: DataFrame, name: str = "name") -> DataFrame:
    """JOI11: ``name, dataset_id``: the first entry one of whose identifiers equals a name regardless of case."""
    ids = identifiers(datasets).withColumn("key", F.lower("identifier")).groupBy("key").agg(F.min("dataset_id").alias("dataset_id"))
    return names.select(F.col(name).alias("name")).distinct().join(ids, F.lower("name") == F.col("key"), "left").select("name", "dataset_id")


def mentioned_entries(pubs: DataFrame, datasets: DataFrame, key: str = "id") -> DataFrame:
    """JOI10: (publication, entry) where an entry's id, name or alias is among the publication's mentions."""
    m = pubs.select(F.col(key).alias("publication_id"), F.explode("mentioned_datasets").alias("m")).select("publication_id", F.explode(F.array("m.id", "m.name")).alias("identifier")).where("identifier is not null")
    ids = identifiers(datasets).select("dataset_id", "identifier").unionByName(datasets.select("dataset_id", F.col("dataset_id").alias("identifier"))).distinct()
    return m.distinct().join(ids, "identifier").select("publication_id", "dataset_id").distinct()


def flag_terms(datasets: DataFrame, asked: list[str], match_all: bool = False, terms: str = "flag_terms") -> DataFrame:
    """FIL19, DED02: entries by flag terms, trimmed and in lower case: share of asked terms, or 1.0 where all must be there."""
    want = F.array(*[F.lit(t.strip().lower()) for t in asked])
    have = F.transform(F.coalesce(F.col(terms), F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    both = F.size(F.array_intersect(have, want))
    n = len({t.strip().lower() for t in asked})
    if match_all:
        return datasets.where(both == n).withColumn("score", F.lit(1.0))
    return datasets.where(both > 0).withColumn("score", both / F.lit(float(n)))


def addable(new: DataFrame, datasets: DataFrame) -> DataFrame:
    """DED12: new entries whose name isn't taken, the first of each name."""
    fresh = new.join(datasets.select("dataset_name"), "dataset_name", "left_anti")
    return fresh.groupBy("dataset_name").agg(F.min("dataset_id").alias("dataset_id"))
