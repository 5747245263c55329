"""Mixing sources to target weights.

Documents are packed into blocks of a fixed number of tokens, source by source.
Every output shard draws how many of its slots each source fills; a source's slots
map to its blocks through pseudorandom permutations, one per repeat; blocks are
joined by index.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.bpe import TOKENIZER_DIR, encode_corpus
from citeloom.sources.session import materialise
from citeloom.sources.tables import norm_key

BUCKET_ROWS = 50_000  # documents that share a running total
RANGE = 65_536  # slots that are made from one row
_ROUND = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Source:
    """A source's target and what it has: ``tokens`` available in ``blocks``."""

    name: str
    share: float
    repeats: int
    tokens: int
    blocks: int


def quotas(sources: list[Source], block: int, total_tokens: int | None = None) -> dict[str, int]:
    """Slots of each source.

    Without ``total_tokens`` the mix is as large as it can be with every source
    that has text at its share (shares of sources without text are spread over
    the others in proportion); with it, a source that runs out gives its rest to
    the others in proportion.
    """
    live = [s for s in sources if s.blocks and s.share > 0 and s.repeats > 0]
    if not live:
        return {}
    weight = sum(s.share for s in live)
    # in slots; short last blocks make a source's blocks hold a little less than `block` tokens each
    fill = {s.name: s.tokens / s.blocks for s in live}
    room = {s.name: s.blocks * s.repeats for s in live}
    if total_tokens is None:
        total_tokens = min(s.tokens * s.repeats * weight / s.share for s in live)
        want = {s.name: total_tokens * s.share / weight / fill[s.name] for s in live}
    else:
        want, left, open_ = {}, float(total_tokens), list(live)
        while open_ and left > 0:
            over = [s for s in open_ if left * s.share / sum(x.share for x in open_) >= s.tokens * s.repeats]
            if not over:
                want |= {s.name: left * s.share / sum(x.share for x in open_) / fill[s.name] for s in open_}
                break
            for s in over:
                want[s.name] = float(room[s.name])
            left -= sum(s.tokens * s.repeats for s in over)
            open_ = [s for s in open_ if s not in over]
    return {k: min(room[k], max(1, round(v))) for k, v in want.items()}


def draws(quota: dict[str, int], per_shard: int, seed: int) -> list[tuple[int, str, int, int]]:
    """(shard, source, slots, first rank): a multinomial draw for each shard by what is left of each
    source, held to what is left, so totals are exact. A shard has ``per_shard`` slots or a few less."""
    names = sorted(quota)
    left = np.array([quota[n] for n in names], dtype=np.int64)
    rng, used, out, shard = np.random.default_rng(seed), np.zeros(len(names), dtype=np.int64), [], 0
    while left.sum() > 0:
        size = int(min(per_shard, left.sum()))
        got = np.minimum(rng.multinomial(size, left / left.sum()), left)
        out += [(shard, n, int(k), int(u)) for n, k, u in zip(names, got, used) if k]
        left, used, shard = left - got, used + got, shard + 1
    return out


def permute(rank: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed permutation of [0, size): four Feistel rounds, walked until inside."""
    half = np.maximum(1, np.ceil(np.ceil(np.log2(np.maximum(size, 2))) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = rank.astype(np.uint64), np.ones(len(rank), dtype=bool)
    while todo.any():
        lo, hi, h, m, k = x[todo] & mask[todo], x[todo] >> half[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        for r in range(4):
            f = (lo + k + _ROUND[r]) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            lo, hi = hi ^ ((f ^ (f >> np.uint64(32))) & m), lo
        x[todo] = (hi << h) | lo
        todo &= x >= size.astype(np.uint64)
    return x.astype(np.int64)


class Mix:
    """A planned mix of ``docs`` (``doc_id, text, source``) by ``targets`` (``source, target_share, max_repeats``).

    Sources are compared regardless of case and surrounding white space. Documents
    of other sources, with a null source or without tokens take no part. Targets
    without documents reach a share of 0. Empty tables give an empty mix. Equal
    target names are added up, with the larger ``max_repeats``; null shares are 0.
    With ``counts_only`` no ids are kept: enough for :meth:`slots` and :meth:`shares`.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, block: int = 1024, total_tokens: int | None = None, seed: int = 7, vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken", counts_only: bool = False, most_shards: int = 4096):
        self.spark, self.block, self.seed, self.most_shards = docs.sparkSession, block, seed, most_shards
        self.targets = targets.select(norm_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("repeats")).where("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("repeats").alias("repeats"))
        mine = docs.select("doc_id", norm_key(F.col("source")).alias("source"), "text").join(self.targets.select("source"), "source", "left_semi")
        encoded = encode_corpus(mine, vocabulary=vocabulary, counts_only=counts_only)
        encoded = encoded.withColumnRenamed("n_tokens", "n") if counts_only else encoded.withColumn("n", F.size("ids").cast("long"))
        self.encoded = materialise(encoded.where("n > 0").withColumn("row", F.monotonically_increasing_id()), "encoded")
        have = {r["source"]: (r["n"], r["rows"]) for r in self.encoded.groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}  # a row per target
        self.buckets = max(1, -(-max((rows for _, rows in have.values()), default=0) // BUCKET_ROWS))
        self.sources = [Source(r["source"], r["share"], r["repeats"], n := have.get(r["source"], (0, 0))[0], -(-n // block)) for r in self.targets.collect()]
        self.quota = quotas(self.sources, block, total_tokens)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), "doc_id"), F.lit(self.buckets)).cast("int")

    def slots(self) -> DataFrame:
        """``shard, slot, source, repeat, block, n_tokens``: which block stands where.

        The driver draws counts for ``most_shards`` shards or a few more; slots are
        made from them in ranges of fixed length. A slot's place in its shard is a
        pseudorandom permutation too, so nothing is sorted.
        """
        n = sum(self.quota.values())
        per_shard = max(64, -(-n // self.most_shards))
        by_name = {s.name: s for s in self.sources}
        rows, filled = [], Counter()
        for shard, name, k, first in draws(self.quota, per_shard, self.seed):
            rows.append((shard, name, k, first, filled[shard], by_name[name].blocks, by_name[name].tokens))
            filled[shard] += k
        rows = [(*r, filled[r[0]]) for r in rows]
        drawn = self.spark.createDataFrame(rows, "shard int, source string, k long, first long, before long, blocks long, tokens long, size long")
        ranges = drawn.withColumn("from", F.explode(F.expr(f"sequence(0L, k - 1, {RANGE}L)")))
        spread = ranges.select("shard", "source", "first", "before", "blocks", "tokens", "size", F.explode(F.expr(f"sequence(from, least(from + {RANGE} - 1, k - 1))")).alias("i"))
        seed, length = self.seed, self.block

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                col = {c: b.column(c).to_numpy() for c in ("shard", "first", "before", "blocks", "tokens", "size", "i", "salt")}
                rank, blocks = col["first"] + col["i"], col["blocks"]
                repeat = rank // blocks
                block = permute(rank % blocks, blocks, (col["salt"] ^ (repeat * 1_000_003 + seed)) & 0x7FFFFFFFFFFFFFFF)
                slot = permute(col["before"] + col["i"], col["size"], (col["shard"].astype(np.int64) * 0x9E3779B1 + seed) & 0x7FFFFFFFFFFFFFFF)
                n_tokens = np.minimum(length, col["tokens"] - block * length)
                yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(slot.astype(np.int32)), b.column("source"), pa.array(repeat.astype(np.int32)), pa.array(block), pa.array(n_tokens.astype(np.int32))], names=["shard", "slot", "source", "repeat", "block", "n_tokens"])

        return spread.withColumn("salt", F.xxhash64("source")).mapInArrow(place, "shard int, slot int, source string, repeat int, block long, n_tokens int")

    def blocks(self, wanted: DataFrame | None = None) -> DataFrame:
        """``source, block, doc_ids, ids``: the packed blocks, all or those in ``wanted`` (``source, block``).

        Places are found on narrow rows; tokens are shuffled only once it is known
        which documents' are needed, and then only the slices that are.
        """
        L = self.block
        narrow = self.encoded.select("source", self._bucket().alias("bucket"), "doc_id", "row", "n")
        # running totals over the buckets of a source give every bucket's first token
        sums = narrow.groupBy("source", "bucket").agg(F.sum("n").alias("n"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        w = Window.partitionBy("source", "bucket").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
        at = narrow.withColumn("inner", F.coalesce(F.sum("n").over(w), F.lit(0))).join(starts, ["source", "bucket"])
        at = at.select("source", "row", "n", (F.col("start") + F.col("inner")).alias("at"))
        piece = at.withColumn("block", F.explode(F.expr(f"sequence(at div {L}, (at + n - 1) div {L})")))
        if wanted is not None:
            piece = piece.join(wanted.select("source", "block").distinct(), ["source", "block"], "left_semi")
        # a document's pieces, as many as it has blocks
        pieces = piece.groupBy("row").agg(F.collect_list(F.struct("block", "at")).alias("p"))
        whole = self.encoded.select("source", "doc_id", "row", "n", "ids").join(pieces, "row").select("source", "doc_id", "n", "ids", F.inline("p"))

        def cut() -> Column:
            first = F.greatest(F.lit(0).cast("long"), F.col("block") * L - F.col("at"))
            last = F.least(F.col("n"), (F.col("block") + 1) * L - F.col("at"))
            return F.slice("ids", (first + 1).cast("int"), (last - first).cast("int"))

        # a group holds one block's tokens, never more
        got = whole.select("source", "block", "at", "doc_id", cut().alias("ids")).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "ids"))).alias("p"))
        return got.select("source", "block", F.col("p.doc_id").alias("doc_ids"), F.flatten("p.ids").alias("ids"))

    def records(self) -> DataFrame:
        """The mix itself: a row per slot with its tokens."""
        slots = self.slots()
        return slots.join(self.blocks(slots), ["source", "block"]).select("shard", "slot", "source", "repeat", "block", "n_tokens", "doc_ids", "ids")

    def shares(self) -> DataFrame:
        """Per target source: what it has, what it got, its share of the mix, and how many of its tokens stay out of it."""
        first = F.sum(F.when(F.col("repeat") == 0, F.col("n_tokens")))
        got = self.slots().groupBy("source").agg(F.sum("n_tokens").alias("tokens_mixed"), (F.max("repeat") + 1).alias("repeats_used"), first.alias("tokens_used"))
        have = self.spark.createDataFrame([(s.name, s.share, s.repeats, s.tokens) for s in self.sources], "source string, target_share double, max_repeats int, tokens_available long")
        both = have.join(got, "source", "left").fillna(0, ["tokens_mixed", "repeats_used", "tokens_used"])
        # few rows: one per target
        total = F.sum("tokens_mixed").over(Window.partitionBy(F.lit(0)))
        return both.select(
            "source", "target_share", "max_repeats", "tokens_available", "tokens_mixed", "repeats_used", (F.col("tokens_available") - F.col("tokens_used")).alias("tokens_left_out"),
            F.when(total > 0, F.col("tokens_mixed") / total).otherwise(F.lit(0.0)).alias("actual_share"),
        )
