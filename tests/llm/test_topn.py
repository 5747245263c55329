from pyspark.sql import functions as F

from citeloom.llm.topn import top_n

SCHEMA = "g string, k long, s long, rank int"


def brute(rows, n):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    key = lambda r: (r[2] is None, -(r[2] or 0), r[1])
    return sorted((g, r[1]) for g, rs in groups.items() for r in sorted(rs, key=key)[:n])


def run(spark, rows, n, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = top_n(df, ["g"], [F.desc_nulls_last("s"), F.asc("k")], n, **kw)
    assert out.columns.count("rank") == 1
    return sorted(((r.g, r.k) for r in out.collect()), key=lambda x: (x[0] is not None, x[0] or "", x[1]))


def test_both_paths_agree_with_brute_force(spark):
    # one group holds half of all rows; ties and null scores everywhere
    rows = [("hot" if i % 2 else f"g{i % 37}", i, None if i % 11 == 0 else i % 5, 9) for i in range(2000)]
    expect = brute(rows, 3)
    assert run(spark, rows, 3) == expect
    assert run(spark, rows, 3, heavy_share=0.02, salts=4) == expect  # the hot group and some others
    assert run(spark, rows, 3, heavy_share=1.0) == expect  # none is heavy
    assert run(spark, rows, 3, heavy_share=0.0) == expect  # all are


def test_heavy_groups_take_the_salted_path(spark):
    rows = [("hot" if i % 2 else f"g{i % 37}", i, i % 5, 9) for i in range(2000)]
    plan = top_n(spark.createDataFrame(rows, SCHEMA), ["g"], [F.desc_nulls_last("s"), F.asc("k")], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "__topn_salt" in plan and "Union" in plan


def test_null_groups_copies_and_empty(spark):
    rows = [(None, 1, 5, None), (None, 1, 5, None), (None, 2, 7, None), ("a", 3, None, None)]
    assert run(spark, rows, 2) == [(None, 1), (None, 2), ("a", 3)]
    assert run(spark, [], 3) == []
    assert run(spark, rows, 0) == []
