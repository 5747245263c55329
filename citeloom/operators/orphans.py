"""References to records that do not exist.

Keys are range-partitioned; within a range the parents form one sorted array and
the references are probed against it by binary search, a batch at a time.
References are reduced to distinct keys before they are shuffled, so neither a
key that a third of all rows refer to nor one with many parents is a hot task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.sources.session import materialise


def missing_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct (``field``, ``ref_key``) of ``refs`` that ``parents`` (same columns) lacks.

    Null keys are no references. No parents: every key is missing.
    """
    tagged = (
        parents.where(F.col("ref_key").isNotNull()).select("field", "ref_key").distinct().withColumn("is_ref", F.lit(0))
        .unionByName(refs.where(F.col("ref_key").isNotNull()).select("field", "ref_key").distinct().withColumn("is_ref", F.lit(1)))
    )
    ranged = tagged.repartitionByRange(F.col("field"), F.col("ref_key")).sortWithinPartitions("field", "is_ref", "ref_key")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, held, block = None, [], np.array([], dtype=object)
        for batch in batches:
            fields = np.array(batch.column(0).to_pylist(), dtype=object)
            keys = np.array(batch.column(1).to_pylist(), dtype=object)
            is_ref = batch.column(2).to_numpy()
            out_f, out_k = [], []
            cuts = [0, *(np.flatnonzero((fields[1:] != fields[:-1]) | (is_ref[1:] != is_ref[:-1])) + 1), len(keys)] if len(keys) else [0]
            for a, b in zip(cuts, cuts[1:]):
                if fields[a] != field:
                    field, held, block = fields[a], [], np.array([], dtype=object)
                if not is_ref[a]:
                    held.append(keys[a:b])
                    continue
                if held:  # the parents of this range are whole: they sort before its references
                    block, held = np.concatenate([block, *held]), []
                at = np.searchsorted(block, keys[a:b])
                hit = np.zeros(b - a, dtype=bool)
                inside = at < len(block)
                hit[inside] = block[at[inside]] == keys[a:b][inside]
                out_f += [field] * int((~hit).sum())
                out_k += list(keys[a:b][~hit])
            yield pa.RecordBatch.from_arrays([pa.array(out_f, pa.string()), pa.array(out_k, pa.string())], names=["field", "ref_key"])

    return ranged.mapInArrow(probe, "field string, ref_key string")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``refs`` (``field, ref_key`` and any others) whose key has no parent."""
    gone = materialise(missing_keys(refs, parents), "orphans")
    return refs.join(gone, ["field", "ref_key"], "left_semi")


def orphan_report(orphans: DataFrame, refs: DataFrame) -> DataFrame:
    """Per field and month of the referring row: references, orphans and their share."""
    n = refs.groupBy("field", "month").agg(F.count(F.lit(1)).alias("n_refs"))
    k = orphans.groupBy("field", "month").agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("ref_key").alias("n_orphan_keys"))
    both = n.join(k, [n.field == k.field, n.month.eqNullSafe(k.month)], "left").select(n.field, n.month, "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.coalesce("n_orphan_keys", F.lit(0)).alias("n_orphan_keys"))
    return both.withColumn("orphan_share", F.round(F.col("n_orphans") / F.col("n_refs"), 6))
