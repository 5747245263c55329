import random
from collections import Counter
from itertools import combinations

import pyarrow as pa

from citeloom.llm import cooccur
from citeloom.llm.cooccur import cooccurring_pairs


def brute(rows, least_count, share, lift):
    sets = {}
    for r, i in set(rows):
        if r is not None and i is not None:
            sets.setdefault(r, set()).add(i)
    n, one, two = len(sets), Counter(), Counter()
    for s in sets.values():
        one.update(s)
        two.update(combinations(sorted(s), 2))
    return sorted((a, b, one[a], one[b], k) for (a, b), k in two.items() if k >= least_count and k >= share * n and k * n >= lift * one[a] * one[b])


def test_heavy_light_and_mixed_pairs(spark):
    rnd = random.Random(5)
    rows = []
    for r in range(900):
        rows += [(f"r{r}", "hot")] if r % 3 else []
        base = rnd.randrange(40)
        rows += [(f"r{r}", f"i{base}"), (f"r{r}", f"i{(base * 7) % 40}"), (f"r{r}", f"i{rnd.randrange(40)}")]
    rows += rows[:50] + [(None, "i1"), ("r1", None)]
    df = spark.createDataFrame(rows, "record string, item string")
    expect = brute(rows, 4, 0.0005, 3.0)
    assert expect
    for heavy in (1, 5, 500):  # all light, mixed, all heavy
        got = sorted(tuple(x[:5]) for x in cooccurring_pairs(df, "record", "item", heavy_items=heavy).collect())
        assert got == expect


def test_empty_and_lonely(spark):
    assert cooccurring_pairs(spark.createDataFrame([], "record string, item string"), "record", "item").count() == 0
    df = spark.createDataFrame([(str(i), "x") for i in range(9)], "record string, item string")
    assert cooccurring_pairs(df, "record", "item").count() == 0


def test_a_wide_record_is_counted_in_parts(monkeypatch):
    monkeypatch.setattr(cooccur, "MOST_HELD", 100)
    codes = [list(range(1, 60)), list(range(1, 60, 2))]  # all rare but none of the frequent one
    parts = list(cooccur._pair_counts(1)(iter([pa.RecordBatch.from_arrays([pa.array(codes, pa.list_(pa.int64()))], names=["codes"])])))
    assert len(parts) > 5 and max(p.num_rows for p in parts) < 200
    total = Counter()
    for p in parts:
        for a, b, n in zip(*[c.to_pylist() for c in p.columns]):
            total[a, b] += n
    expect = Counter(x for c in codes for x in combinations(c, 2))
    assert total == expect
