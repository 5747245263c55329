import os

import numpy as np
import pytest

from citeloom.llm.bpe import TOKENIZER_DIR
from citeloom.llm.mixing import Mix, Source, draws, permute, quotas

PATH = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


def test_permutations_are_one_to_one():
    for n in (1, 2, 3, 7, 64, 1000):
        size, key = np.full(n, n), np.full(n, 12345)
        assert sorted(permute(np.arange(n), size, key).tolist()) == list(range(n))


def test_quotas():
    s = [Source("a", 0.5, 1, 10_000, 10), Source("b", 0.25, 2, 1000, 1), Source("none", 0.25, 3, 0, 0)]
    q = quotas(s, 1000)
    assert q == {"a": 4, "b": 2}  # b runs out at 2; a is twice its share
    q = quotas(s, 1000, 9000)  # b is full, a takes the rest
    assert q == {"a": 7, "b": 2}
    assert quotas([], 1000) == {}


def test_draws_add_up():
    d = draws({"a": 1000, "b": 10}, 64, 1)
    assert sum(k for _, n, k, _ in d if n == "a") == 1000 and sum(k for _, n, k, _ in d if n == "b") == 10
    firsts = [(f, k) for _, n, k, f in d if n == "a"]
    assert all(f2 == f1 + k1 for (f1, k1), (f2, _) in zip(firsts, firsts[1:]))


def test_draws_behave_alike_at_any_size():
    quota = {"a": 30_000_000_000, "b": 9_000_000_000, "c": 3}
    d = draws(quota, 10_000_000, 1)
    assert {n: sum(k for _, m, k, _ in d if m == n) for n in quota} == quota
    sizes = {}
    for shard, _, k, _ in d:
        sizes[shard] = sizes.get(shard, 0) + k
    assert max(sizes.values()) == 10_000_000 and len(sizes) < 3905


def test_mix(spark):
    docs = [(i, f"word{i} " * 40, "Big " if i % 2 else "big", 0) for i in range(200)] + [(1000 + i, "small text here " * 20, "SMALL", 0) for i in range(5)]
    docs += [(5000, None, "big", 0), (5001, "", "big", 0), (5002, "x", None, 0), (5003, "x", "elsewhere", 0)]
    targets = [("big", 0.6, 1), (" small", 0.3, 3), ("absent", 0.1, 2), (None, 0.5, 1)]
    mix = Mix(spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), block=32, vocabulary=PATH)
    rows = mix.records().collect()
    assert len(rows) == sum(mix.quota.values())
    assert all(len(r.ids) == r.n_tokens <= 32 for r in rows)
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.block), []).append(r.repeat)
    assert all(len(v) == len(set(v)) <= (1 if k[0] == "big" else 3) for k, v in uses.items())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    share = {r.source: r for r in mix.shares().collect()}
    assert share["absent"].actual_share == 0.0
    assert abs(share["big"].actual_share - 2 / 3) < 0.05 and abs(share["small"].actual_share - 1 / 3) < 0.05
    assert share["big"].tokens_mixed == sum(r.n_tokens for r in rows if r.source == "big")
    used = {(r.source, r.block): r.n_tokens for r in rows}
    assert all(share[x].tokens_left_out == share[x].tokens_available - sum(n for (s, _), n in used.items() if s == x) for x in ("big", "small", "absent"))
    counted = Mix(spark.createDataFrame(docs, "doc_id long, text string, source string, n_tokens int"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"), block=32, vocabulary=PATH, counts_only=True)
    assert sorted(counted.shares().collect()) == sorted(share.values())
    assert all({r.slot for r in rows if r.shard == s} == set(range(sum(r.shard == s for r in rows))) for s in {r.shard for r in rows})
    again = {(r.shard, r.slot): r.ids for r in mix.records().collect()}
    assert again == {(r.shard, r.slot): r.ids for r in rows}


def test_packing_keeps_every_token(spark):
    docs = [(i, f"token{i} and more words {i}", "s") for i in range(50)]
    mix = Mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int"), block=16, vocabulary=PATH)
    packed = {r.block: r.ids for r in mix.blocks().collect()}
    total = sum(len(r.ids) for r in mix.encoded.collect())
    assert sum(map(len, packed.values())) == total and all(len(packed[b]) == 16 for b in range(len(packed) - 1))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("s", 1.0, 1)], "source string, target_share double, max_repeats int")
    mix = Mix(docs, targets, vocabulary=PATH)
    assert mix.records().count() == 0 and [r.actual_share for r in mix.shares().collect()] == [0.0]
    assert Mix(docs, targets.limit(0), vocabulary=PATH).shares().count() == 0
