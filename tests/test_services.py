"""Values, collections, clients, entry points."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from citeloom.functions import values
from citeloom.operators import collections as col
from citeloom.plans import service
from citeloom.sources.client import Client, Unavailable, fetched


def test_values(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00.250Z",), ("2024-01-01T01:00:00+01:00",), ("never",), (None,)], "x string")
    got = [r.t for r in df.select(values.iso_time(F.col("x")).alias("t")).collect()]
    assert got[0] == got[2] == datetime(2024, 1, 1) and got[1].microsecond == 250_000 and got[3:] == [None, None]
    d = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1, 500_000), float("nan"), ["a", "b", "a", None])], "a timestamp, b timestamp, v double, l array<string>")
    r = d.select(values.seconds_between(F.col("a"), F.col("b")).alias("s"), values.iso_text(F.col("a")).alias("i"), values.counts_map(F.col("l")).alias("m"), values.stable_id(F.lit(None), F.lit("")).alias("x"), values.stable_id(F.lit(""), F.lit(None)).alias("y")).first()
    assert (r.s, r.i, r.m) == (1.5, "2024-01-01T00:00:00.000000Z", {"a": 2, "b": 1}) and r.x != r.y
    assert values.plain_numbers(d).first().v is None
    assert d.select(values.map_value(values.counts_map(F.col("l")), "z", 0).alias("z")).first().z == 0
    assert [values.backoff(n, jitter=0) for n in range(8)] == [1, 2, 4, 8, 16, 32, 60, 60] and 1 <= values.backoff(0) <= 1.1


def test_collections(spark):
    df = spark.createDataFrame([("1", "x", "a"), ("2", "y", "a"), (None, "z", "b")], "id string, name string, domain string")
    assert col.by_id(df, "1").count() == 1 and col.by_id(df, "9").count() == 0 and col.by_keys(df, domain="a", name="y").first().id == "2"
    assert col.catalogue(df, ["b"]).count() == 1
    assert sorted(r._id for r in col.stored_form(df).collect()) == ["1", "2"] and col.loaded_form(col.stored_form(df)).columns == ["name", "domain", "id"]
    assert col.serialised(df.where("id = '1'"), "id").first().document == '{"id":"1","name":"x","domain":"a"}'
    j = spark.createDataFrame([("1", '{"a": 1}'), ("2", "broken"), ("3", None)], "id string, j string")
    assert [tuple(r) for r in col.parsed(j, "j", "a int").collect()] == [("1", 1)]
    a = spark.createDataFrame([("1", "Ann Lee", "o"), ("2", "Anne Lee", None), ("3", "Bob", None)], "author_id string, name string, orcid string")
    assert [r.author_id for r in col.find_authors(a, name="ann lee").collect()] == ["1", "2"] and col.find_authors(a, orcid="o").count() == 1
    refs = "array<struct<publication_id:string>>"
    r = spark.createDataFrame([([("1",)], [("1",), ("2",)])], f"a {refs}, b {refs}").select(col.add_references(F.col("a"), F.col("b")).alias("r")).first().r
    assert [x.publication_id for x in r] == ["1", "2"]
    log = spark.createDataFrame([("w", 1, True), ("w", 2, False), ("w", 3, True)], "workflow_id string, step int, completed boolean")
    assert [r.n_completed for r in col.progress_by_step(log).orderBy("step").collect()] == [1, 1, 2]
    code = spark.createDataFrame([("py", "p", "k", 8.0), ("py", "q", "k", 5.0), ("r", "q", "k", None)], "language string, purpose string, implementation_type string, relevance_score double")
    got = {(r.by, r.value): (r.n, r.mean_relevance, r.high_relevance) for r in col.code_summary(code).collect()}
    assert got[("language", "py")] == (2, 6.5, 50.0) and got[("total", None)] == (3, 6.5, 33.3) and got[("purpose", "q")][0] == 2
    p = col.all_patterns(spark.createDataFrame([(1, "see https://github.com/a/b and `some code`"), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_repositories, r.n_code_blocks) for r in p] == [(1, 1), (0, 0)]
    assert tuple(col.known_counts(spark.createDataFrame([("a",), (None,)], "dataset_id string")).first()) == (1, 1)
    assert {tuple(r) for r in col.table_counts({"a": df, "b": df.limit(0)}).collect()} == {("a", 3), ("b", 0)}
    assert col.unique_violations(df, ["domain"]).first().n == 2
    work = spark.createDataFrame([("1", "PROCESSING"), ("2", "PROCESSING"), ("3", "DONE")], "id string, status string")
    pubs = spark.createDataFrame([("1", None), ("2", False), ("3", True)], "id string, sync_elastic boolean")
    assert [r.id for r in col.to_flatten(work, pubs).collect()] == ["1"]
    reg = spark.createDataFrame([("s1", "Farm Census", "FC")], "dataset_id string, dataset_name string, aliases string")
    q = spark.createDataFrame([(1, "fc"), (2, "none"), (3, "farm census")], "query_id int, alias string")
    assert {tuple(r) for r in col.asked_at_once(q, reg).collect()} == {(1, "s1"), (3, "s1")}


def test_clustered_files(spark, tmp_path):
    path = str(tmp_path / "c")
    col.write_clustered(spark.range(1000), path, ["id"], 4)
    assert spark.read.parquet(path).where("id < 10").count() == 10


def test_client_retries_rests_and_paces():
    now, slept, calls = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def call(x):
        calls.append(x)
        if x == "bad" or len(calls) == 1:
            raise OSError
        return {"v": x}

    c = Client(call, per_second=1.0, most_failures=4, rest=30, sleep=sleep, clock=lambda: now[0])
    assert c("a") == {"v": "a"} and len(calls) == 2 and now[0] >= 1
    with pytest.raises(OSError):
        c("bad")
    with pytest.raises(OSError):
        c("bad")
    with pytest.raises(Unavailable):
        c("a")
    now[0] += 31
    assert c("a") == {"v": "a"}


def test_fetched(spark):
    def make():  # inside, so that it is sent by value
        return lambda v: {"n": len(v)} if v != "x" else 1 / 0

    df = spark.createDataFrame([("ab",), ("ab",), ("x",), (None,)], "url string")
    assert {tuple(r) for r in fetched(df, "url", make, "n int").collect()} == {("ab", 2, None), ("x", None, "ZeroDivisionError")}


def test_service(spark, tmp_path, capsys):
    f = tmp_path / "c.json"
    f.write_text('{"fuzzy_least": 0.9}')
    s = service.Settings.load(str(f), {"CITELOOM_RETENTION_DAYS": "7"})
    assert (s.fuzzy_least, s.retention_days, s.validation_least) == (0.9, 7, 6.0)
    f.write_text('{"odd": 1}')
    with pytest.raises(ValueError):
        service.Settings.load(str(f), {})
    jobs = service.start(spark.createDataFrame([("g", 2020, 2022)], "name string, start_year int, end_year int"))
    assert jobs.select("task_id").distinct().count() == 3 and jobs.select("group_id").distinct().count() == 1
    assert service.prompts(spark).count() == 11
    kind = "id string, sync_elastic boolean, mentioned_datasets array<struct<id:string>>, authors array<struct<id:string,institutions:array<struct<id:string>>>>, journals array<struct<id:string>>"
    pubs = spark.createDataFrame([("1", True, [("D ",)], [("a", [("i",)])], None), ("2", None, [("d",)], None, None)], kind)
    assert service.summary(pubs, "D")["n_publications"] == 2 and service.summary(pubs, "D")["status"] == "PROCESSING" and service.summary(pubs, "no") == {"dataset_id": "no", "status": "UNKNOWN"}
    assert service.main(["list"]) == 0 and "p1_found" in capsys.readouterr().out
    assert service.main(["run", "nothing"]) == 1 and service.main(["show"]) == 0
