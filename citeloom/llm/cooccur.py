"""Items that appear together."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.sources.session import materialise

MOST_HELD = 2_000_000  # pairs that a task holds before it gives out their counts


def _pair_counts(heavy_codes: int) -> object:
    """A partition's pairs: records in blocks, each with a bit matrix of its frequent items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((heavy_codes, heavy_codes), dtype=np.int64)
        mixed: dict[int, np.ndarray] = {}
        rare: Counter = Counter()
        for batch in batches:
            offsets = batch.column(0).offsets.to_numpy()
            offsets = offsets - offsets[0]
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            rows, n = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), len(offsets) - 1
            is_heavy = flat < heavy_codes
            bits = np.zeros((heavy_codes, n), dtype=bool)
            bits[flat[is_heavy], rows[is_heavy]] = True
            packed = np.packbits(bits, axis=1)
            packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)
            present = np.flatnonzero(packed.any(axis=1))
            for a in present:  # frequent with frequent: AND and popcount
                dense[a, present] += np.bitwise_count(packed[a] & packed[present]).sum(axis=1, dtype=np.int64)
            items, at = flat[~is_heavy], rows[~is_heavy]
            if len(items):
                order = np.argsort(items, kind="stable")
                items, at = items[order], at[order]
                starts = np.flatnonzero(np.r_[True, items[1:] != items[:-1]])
                for s, e in zip(starts, [*starts[1:], len(items)]):  # rare with frequent: its list probes the matrix
                    hits = bits[:, at[s:e]].sum(axis=1, dtype=np.int64)
                    key = int(items[s])
                    mixed[key] = mixed[key] + hits if key in mixed else hits
                back = np.argsort(at, kind="stable")
                items, at = items[back], at[back]
                cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                for s, e in zip(cuts, [*cuts[1:], len(at)]):  # rare with rare: hash counts
                    mine = np.sort(items[s:e])
                    for i in range(len(mine) - 1):  # item by item, so that a wide record is never held as all its pairs
                        rare.update(zip(repeat(int(mine[i])), mine[i + 1 :].tolist()))
                        if len(rare) > MOST_HELD:
                            yield from out(np.zeros((0, 0), dtype=np.int64), {}, rare)
                            rare = Counter()
            if len(mixed) * heavy_codes > 4 * MOST_HELD:
                yield from out(dense, mixed, rare)
                dense[:], mixed, rare = 0, {}, Counter()
        yield from out(dense, mixed, rare)

    def out(dense: np.ndarray, mixed: dict[int, np.ndarray], rare: Counter) -> Iterator[pa.RecordBatch]:
        a, b = np.nonzero(np.triu(dense, 1))
        parts = [(a, b, dense[a, b])]
        for key, hits in mixed.items():
            h = np.flatnonzero(hits)
            parts.append((h, np.full(len(h), key), hits[h]))
        if rare:
            pairs = np.array(list(rare.keys()), dtype=np.int64)
            parts.append((pairs[:, 0], pairs[:, 1], np.fromiter(rare.values(), np.int64, len(rare))))
        cols = [np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(3)]
        for s in range(0, len(cols[0]), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 200_000]) for c in cols], names=["a", "b", "n12"])

    return count


def cooccurring_pairs(members: DataFrame, record: str, item: str, least_count: int = 4, least_share: float = 0.0005, least_lift: float = 3.0, heavy_items: int = 512) -> DataFrame:
    """Pairs of items that lie together in records, with count and lift.

    ``members`` has a row per record and item; repeated rows count once, null
    records and items not at all. With N records, n1, n2 and n12 those with an
    item and with both, a pair comes out if n12 >= ``least_count``, n12 >=
    ``least_share`` N and n12 N >= ``least_lift`` n1 n2.

    Items in fewer records than n12 must reach are left out first: no pair of
    theirs can qualify. At most M / (N ``least_share``) of M members' items remain;
    they stay a table, of which only the ``heavy_items`` most frequent come to the
    driver. Those get rows of a bit matrix, the rest lists and hash counts; pairs
    are counted where the records lie, a bounded number held at a time, and only
    partial counts are shuffled. No members: no pairs.
    """
    sets = materialise(members.select(F.col(record).alias("record"), F.col(item).alias("item")).where("record is not null and item is not null").distinct(), "members")
    total = sets.agg(F.countDistinct("record").alias("n")).first()["n"]
    floor = max(least_count, -(-total * least_share // 1)) if total else least_count
    counts = materialise(sets.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= int(floor)), "items")
    kind = sets.schema["item"].dataType
    # the frequent items, never more than `heavy_items`, are numbered by rank; the others in any order after them
    top = [(i, code) for code, (i,) in enumerate(counts.orderBy(F.desc("n"), "item").select("item").limit(heavy_items).collect())]
    if not top:
        name = kind.simpleString()
        return members.sparkSession.createDataFrame([], f"item_1 {name}, item_2 {name}, n1 long, n2 long, n12 long, lift double")
    ranked = members.sparkSession.createDataFrame(top, T.StructType([T.StructField("item", kind), T.StructField("rank", T.LongType())]))
    codes = materialise(counts.join(F.broadcast(ranked), "item", "left").select("item", "n", F.coalesce("rank", F.monotonically_increasing_id() + heavy_items).alias("code")), "codes")
    coded = sets.join(codes.select("item", "code"), "item").groupBy("record").agg(F.collect_list("code").alias("codes"))
    coded = coded.where(F.size("codes") > 1).select("codes")
    pairs = coded.mapInArrow(_pair_counts(len(top)), "a long, b long, n12 long").groupBy("a", "b").agg(F.sum("n12").alias("n12"))
    one = codes.select(F.col("code").alias("a"), F.col("item").alias("x"), F.col("n").alias("nx"))
    two = codes.select(F.col("code").alias("b"), F.col("item").alias("y"), F.col("n").alias("ny"))
    found = pairs.where(F.col("n12") >= int(floor)).join(one, "a").join(two, "b").where(F.col("n12") * F.lit(total) >= F.lit(least_lift) * F.col("nx") * F.col("ny"))

    def pick(x: Column, y: Column) -> Column:
        return F.when(F.col("x") < F.col("y"), x).otherwise(y)

    return found.select(
        F.least("x", "y").alias("item_1"), F.greatest("x", "y").alias("item_2"), pick(F.col("nx"), F.col("ny")).alias("n1"), pick(F.col("ny"), F.col("nx")).alias("n2"), "n12",
        (F.col("n12") * F.lit(float(total)) / (F.col("nx") * F.col("ny"))).alias("lift"),
    )
