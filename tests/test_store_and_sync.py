"""Keyed tables, streams, reindexing, files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from citeloom.operators.store import Store, matching, merge_sql, patched
from citeloom.sources.files import PagedSearch, read_archives, read_csv, write_documents, write_json_lines
from citeloom.streaming import sync
from citeloom.streaming.mentions import accumulated

KIND = "id string, v int, at timestamp"


def t(n):
    return datetime(2024, 1, n)


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), ["id"])
    assert s.read() is None and s.delete(spark.createDataFrame([("a",)], "id string")) == 0
    s.append(spark.createDataFrame([("a", 1, t(1)), ("b", 1, t(1))], KIND))
    with pytest.raises(ValueError):
        s.append(spark.createDataFrame([("a", 9, t(9))], KIND))
    s.upsert(spark.createDataFrame([("a", 2, t(2)), ("a", 3, t(3)), ("c", 1, t(1))], KIND), "at")
    assert sorted((r.id, r.v) for r in s.read().collect()) == [("a", 3), ("b", 1), ("c", 1)]
    assert s.delete(spark.createDataFrame([("b",), ("zz",)], "id string")) == 1
    assert s.retain("at", F.lit("2024-01-04").cast("timestamp"), 2) == 1 and [r.id for r in s.read().collect()] == ["a"]
    with pytest.raises(ValueError):
        s.retain("at", F.current_timestamp(), 0)
    got = patched(s.read(), spark.createDataFrame([("a", None)], "id string, v int"), ["id"]).first()
    assert got.v == 3
    assert "WHEN MATCHED" in merge_sql("t", "s", ["id"])


def test_matching(spark):
    df = spark.createDataFrame([(str(i), i % 3, ["x"] if i % 2 else None) for i in range(20)], "analysis_id string, created_at int, tags array<string>")
    got = matching(df, among={"created_at": [1, 2]}, tags=["x"], skip=1, limit=2)
    assert [r.created_at for r in got.collect()] == [2, 2] and matching(df, equal={"tags": None}).count() == 10
    assert matching(df, between={"created_at": (1, None)}, limit=None).count() == 13


def test_sync_equals_batch_and_survives_repeats(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "sync")
    df = spark.createDataFrame([("a", 1, t(1)), ("b", 1, t(1)), ("c", None, t(1))], KIND)
    df.write.parquet(source)
    job = sync.Sync(spark, folder, "id", "at", F.col("v").isNotNull())
    job.run(source, df.schema)
    spark.createDataFrame([("a", 2, t(5)), ("b", 9, datetime(2023, 1, 1)), ("d", 1, t(2))], KIND).write.mode("append").parquet(source)
    job.run(source, df.schema)
    job.run(source, df.schema)  # nothing new
    assert sorted((r.id, r.v) for r in job.served.read().collect()) == [("a", 2), ("b", 1), ("d", 1)]  # an older row doesn't replace a newer one
    job.apply(spark.createDataFrame([("a", 2, t(5))], KIND), 99)  # the same batch again
    assert job.served.read().count() == 3
    assert [(r.id, r.attempts) for r in job.dead.read().collect()] == [("c", 1)]
    assert job.status().first().last_status == "success" and sync.dead_letter_list(job.dead.read()).count() == 1
    assert job.retry(lambda d: d, df.schema) == (0, 1) and job.dead.read().first().attempts == 2
    assert job.retry(lambda d: d.withColumn("v", F.coalesce("v", F.lit(7))), df.schema) == (1, 0)
    assert {r.id: r.v for r in job.served.read().collect()}["c"] == 7


def test_diff_conflicts_and_checks(spark):
    old = spark.createDataFrame([("a", 1, t(1)), ("b", 1, t(1)), ("c", 1, t(1))], KIND)
    new = spark.createDataFrame([("a", 1, t(1)), ("b", 2, t(1)), ("d", None, t(1))], KIND)
    assert {tuple(r) for r in sync.snapshot_diff(old, new, "id").collect()} == {("b", "updated"), ("c", "deleted"), ("d", "inserted")}
    later = old.withColumn("at", F.when(F.col("id") == "a", F.col("at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("at")))
    assert {tuple(r) for r in sync.resolved(later, old, "id", "at").collect()} == {("a", "source"), ("b", "target"), ("c", "target")}
    assert {r.winner for r in sync.resolved(later, old, "id", "at", manual=True).collect()} == {"unresolved"}
    assert sync.consistency(old, old.limit(0)).first().is_consistent and not sync.consistency(old, old.limit(0), 2).first().is_consistent
    e = {r.error_class: (r.error_type, r.recoverable) for r in sync.classified(spark.createDataFrame([("ConflictError",), ("Odd",), (None,)], "error_class string")).collect()}
    assert e == {"ConflictError": ("indexing", True), "Odd": ("unknown", True), None: ("unknown", True)}


def test_reindex(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, t(1)), ("a", 2, t(2)), ("b", 1, t(1)), (None, 1, t(1))], KIND)
    r = sync.Reindex(spark, "people", str(tmp_path / "r"), least=0.5)
    assert r.run(df, "id", "v1").first().outcome == "swapped" and spark.table("people").count() == 2
    assert sync.Reindex(spark, "people", str(tmp_path / "r")).run(df, "id", "v2").first().outcome == "rolled back" and spark.table("people").count() == 2


def test_mention_state(spark, tmp_path):
    source = str(tmp_path / "m")
    write_json_lines(spark.createDataFrame([("p", "a"), ("p", "a"), ("p", None), ("q", "b")], "publication_id string, dataset_id string"), source)
    stream = spark.readStream.schema("publication_id string, dataset_id string").json(source)
    q = accumulated(stream).writeStream.format("memory").queryName("mention_counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("mention_counts").collect()} == {("p", 1, 1), ("q", 1, 1)}


def test_windows_on_a_table(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 1, 10, 5), "a"), (datetime(2024, 1, 1, 10, 50), "a"), (datetime(2024, 1, 1, 11, 0), "a")], "ts timestamp, kind string")
    assert sorted(r.n for r in sync.windowed_counts(e, "ts", "kind").collect()) == [1, 2]


def test_files(spark, tmp_path):
    csv = tmp_path / "r.csv"
    csv.write_text('dataset_id,dataset_name,group_name,aliases\n1,"A ""b""\nc",g,"x; y"\n')
    assert read_csv(spark, str(csv), "dataset_id string, dataset_name string, group_name string, aliases string").first().dataset_name == 'A "b"\nc'
    assert read_csv(spark, str(tmp_path / "none.csv"), "a string").count() == 0
    out = tmp_path / "docs"
    assert write_documents(spark.createDataFrame([("s-1", '{"a": "é"}')], "slug string, document string"), str(out)) == 1
    assert json.loads((out / "s-1.jsonld").read_text()) == {"a": "é"}
    import zipfile

    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "o_r.zip", "w") as z:
        z.writestr("r/a.py", "print(1)")
        z.writestr("r/sub/", "")
    (tmp_path / "z" / "bad.zip").write_text("no archive")
    assert [(r.repo, r.path, r.content) for r in read_archives(spark, str(tmp_path / "z")).collect()] == [("o_r", "r/a.py", "print(1)")]


def test_paged_search(spark, tmp_path):
    (tmp_path / "2020").mkdir()
    (tmp_path / "2020" / "0.json").write_text(json.dumps({"rows": [{"id": "1", "title": "a"}], "next": "1"}))
    (tmp_path / "2020" / "1.json").write_text(json.dumps({"rows": [{"id": "2", "title": None}], "next": None}))
    spark.dataSource.register(PagedSearch)
    df = spark.read.format("citeloom_search").option("pages", str(tmp_path)).option("start_year", 2019).option("end_year", 2021).load()
    assert sorted((r.id, r.year) for r in df.collect()) == [("1", 2020), ("2", 2020)]
