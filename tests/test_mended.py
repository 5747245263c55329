"""Cases that earlier versions cut away."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from citeloom.functions import code, links, responses
from citeloom.operators import analyses, catalog, mentions, quality, registry
from citeloom.operators.packed import ID_DELIMITER, SPACED_ID, PackedGrammar, orcid_values
from citeloom.operators.shred import json_triples, plain_json, scan, shred_json
from citeloom.operators.store import Store
from citeloom.streaming import sync


@pytest.mark.parametrize(
    ("text", "values"),
    [("a (b; c [d; e] (f; g)", ["a (b", "c [d; e] (f; g)"]), ("(a; (b; c); d", ["(a", "(b; c)", "d"]), ("[x; (y; z); {p; q", ["[x", "(y; z)", "{p", "q"]), ("((((a; b", ["((((a", "b"])],
)
def test_brackets_after_an_unclosed_one_still_hold(text, values):
    assert [i.value for i in PackedGrammar().parse(text)] == values


def test_many_unclosed_brackets_take_linear_time():
    assert len(PackedGrammar().parse("(" * 100_000 + ";a")) == 2


def test_every_id_of_a_piece():
    g = PackedGrammar(ID_DELIMITER, opens_list=True, whole=SPACED_ID)
    for text in ("0000-0002-1825-0097/0000-0001-5109-3700", "0000-0002-1825-0097:0000-0001-5109-3700", "(0000-0002-1825-0097; 0000-0001-5109-3700)"):
        assert [v for i in g.parse(text) for v in orcid_values(i.value)] == ["0000-0002-1825-0097", "0000-0001-5109-3700"]


def test_nothing_of_a_record_is_lost(spark):
    text = '{"e": [{"q": 1, "in": {"w": [5, {"t": null}]}}, "txt", 5, null, [1, [2]]], "other": {"x": true}}'
    got = {(r.path, tuple(r.ords)): (r.kind, r.leaves) for r in shred_json(spark.createDataFrame([("k", text)], "k string, r string"), "k", "r", ["e"]).collect()}
    assert got == {
        ("r", ()): ("object", {"other.x": "true"}), ("r.e", (0,)): ("object", {"q": "1"}), ("r.e.in.w", (0, 0)): ("value", {"": "5"}), ("r.e.in.w", (0, 1)): ("object", {"t": None}), ("r.e", (1,)): ("value", {"": "txt"}), ("r.e", (2,)): ("value", {"": "5"}),
        ("r.e", (4,)): ("array", {}), ("r.e.item", (4, 0)): ("value", {"": "1"}), ("r.e.item", (4, 1)): ("array", {}), ("r.e.item.item", (4, 1, 0)): ("value", {"": "2"}),
    }


@pytest.mark.parametrize("layers", [0, 1, 12])
@pytest.mark.parametrize("wraps", [0, 1, 12])
def test_any_number_of_layers(layers, wraps):
    held = {"e": json.dumps([{"q": 1}, json.dumps({"q": 2})])}
    for _ in range(wraps):
        held = {"r": held}
    text = json.dumps(held)
    for _ in range(layers):
        text = json.dumps(text)
        if len(text) > 100_000:
            break
    got = [(p, o) for p, o, leaf, kind in json_triples(text, "r", frozenset("e")) if leaf is None and kind == "object"]
    assert got == [("r", ()), ("r.e", (0,)), ("r.e", (1,))]
    assert json.loads(plain_json(text, "r", frozenset("e")))["e"] == [{"q": 1}, {"q": 2}]


@pytest.mark.parametrize("text", ["", " ", "{", "[1,]", '{"a" 1}', '{"a":1,}', "1 2", "nul", '"\\x"', '{"a":1}}', "[01]", '["\n"]', "[" * 100_000])
def test_broken_texts_are_no_json(text):
    assert scan(text) is None


def test_the_last_of_equal_names_counts():
    assert scan('{"a": [1], "b": 2, "a": 3}') == [((), False, "{"), (("b",), False, "2"), (("a",), False, "3")]


WRAPPED = [
    ("w", json.dumps({"dataset_analysis": {"validated_datasets": [{"name": "x", "confidence": 0.5}]}})), ("e", json.dumps(json.dumps({"validated_datasets": [{"name": "x", "confidence": 0.5}]}))),
    ("l", json.dumps({"validated_datasets": {"name": "x", "confidence": 0.5}})), ("t", json.dumps({"validated_datasets": json.dumps([{"name": "x", "confidence": 0.5}])})), ("n", "no json"),
]


def test_analyses_are_opened(spark):
    meta = "publication_metadata struct<publication_id string, title string, authors array<string>, abstract string, publication_date string, journal string, doi string>"
    rows = [(k, "p", "w", "2024-01-01T00:00:00Z", "completed", ("p", "t", ["a"], "b", "2024", "j", "d"), t) for k, t in WRAPPED]
    df = spark.createDataFrame(rows, f"analysis_id string, publication_id string, workflow_id string, analysis_timestamp string, workflow_status string, {meta}, dataset_analysis string")
    assert {r.analysis_id: r.n_validated for r in analyses.denormalised(df).collect()} == {"w": 1, "e": 1, "l": 1, "t": 1, "n": 0}
    assert {(r.analysis_id, r.name) for r in quality.reference_issues(df, spark.createDataFrame([("y",)], "dataset_name string")).collect()} == {(k, "x") for k in "welt"}
    full = json.dumps({p: [{"name": "x", "confidence": 0.5}] for p in ("validated_datasets", "newly_discovered_datasets")} | {"dataset_joins": []})
    code_part = F.array(F.struct(F.lit("print(1234567)").alias("content"), F.lit("python").alias("language"), F.lit("c").alias("context"), F.lit(5.0).alias("relevance_score")))
    link = F.array(F.struct(F.lit("https://x.org").alias("url"), F.lit("other").alias("link_type"), F.lit("t").alias("title"), F.lit(True).alias("is_accessible"), F.lit(5.0).alias("relevance_score")))
    repo = F.array(F.struct(F.lit("https://github.com/a/b").alias("url"), F.lit("a").alias("owner"), F.lit("b").alias("repository"), F.lit(True).alias("is_valid"), F.lit(1).alias("stars")))
    whole = df.limit(1).withColumn("dataset_analysis", F.lit(full)).withColumns({"code_snippets": code_part, "external_links": link, "repositories": repo})
    assert [(r.level, r.completeness) for r in quality.assessed(whole).collect()] == [("excellent", 100.0)]
    assert [r.level for r in quality.assessed(whole.drop("repositories")).collect()] == ["excellent"]
    assert [r.level for r in quality.assessed(whole.drop("code_snippets")).collect()] == ["good"]
    short = whole.withColumn("code_snippets", F.transform("code_snippets", lambda s: s.withField("content", F.lit("x"))))
    assert [(r.level, r.n_warning) for r in quality.assessed(short).collect()] == [("good", 1)]


def test_both_term_searches_find_the_same(spark):
    docs = spark.createDataFrame([(1, "prefarm Census, the FARM census's"), (2, "x"), (3, None), (4, ""), (5, "ab?c")], "doc_id int, text string")
    terms = spark.createDataFrame([("d1", "farm census"), ("d2", "census"), ("d3", "b?c"), ("d4", "xy"), ("d5", "'s"), ("d6", None)], "dataset_id string, identifier string")
    got = {(r.doc_id, r.term, r.dataset_id) for r in mentions.find_terms_joined(docs, terms).collect()}
    assert got == {(r.doc_id, r.term, r.dataset_id) for r in mentions.find_terms(docs, terms).collect()} == {(1, "farm census", "d1"), (1, "census", "d2"), (5, "b?c", "d3")}


def test_retry_never_replaces_a_newer_row(spark, tmp_path):
    schema = "key string, at timestamp, v int"
    job = sync.Sync(spark, str(tmp_path), "key", "at", F.col("v") >= 0)
    at = lambda h: datetime(2024, 1, 1, h)
    job.apply(spark.createDataFrame([("a", at(1), -1), ("b", at(1), -1)], schema), 0)
    job.apply(spark.createDataFrame([("a", at(9), 99)], schema), 1)
    good, failed = job.retry(lambda d: d.withColumn("v", F.abs("v")), spark.createDataFrame([], schema).schema)
    assert (good, failed) == (2, 0)
    assert {r.key: (r.at.hour, r.v) for r in job.served.read().collect()} == {"a": (9, 99), "b": (1, 1)}


def test_patterns_as_stated(spark):
    one = spark.range(1)
    said = one.select(responses.pairs_in_prose(F.lit("Dataset A and Dataset B")).alias("a"), responses.pairs_in_prose(F.lit("census data combined with survey data")).alias("b"), responses.pairs_in_prose(F.lit("it plus it")).alias("c")).first()
    assert [tuple(x) for x in said.a] == [("Dataset A", "Dataset B")] and ("census data", "survey data") in [tuple(x) for x in said.b] and said.c == []
    for text, language in (("const a = 1\nconsole.log(a)", "javascript"), ("[1, 2]", "other"), (' {"a": 1} ', "json"), ("chmod x", "other")):
        assert one.select(code.language_by_patterns(F.lit(text))).first()[0] == language
    for url, ok in (("https://x.org/?u=javascript:alert(1)", False), ("https://x.org/a", True), ("https://github.com/u", False), ("https://github.com/u/r", True), ("https://x.org/a.EXE", False), (None, False)):
        assert one.select(links.valid_url(F.lit(url).cast("string"))).first()[0] is ok


def test_an_upsert_touches_only_its_parts(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), ["id"], buckets=4)
    s.append(spark.createDataFrame([(str(i), i) for i in range(40)], "id string, v int"))
    before = s.current()
    s.upsert(spark.createDataFrame([("7", 700), ("7", 700)], "id string, v int"))
    after = s.current()
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert {(r.id, r.v) for r in s.read().collect()} == {(str(i), 700 if i == 7 else i) for i in range(40)}
    assert s.delete(spark.createDataFrame([(str(i),) for i in range(50)], "id string")) == 40 and s.read().count() == 0 and s.read().columns == ["id", "v"]
    s.upsert(spark.createDataFrame([("x", 1)], "id string, v int"))
    assert [tuple(r) for r in s.read().collect()] == [("x", 1)]


def test_parts_of_texts(spark):
    texts = ["abcd", "", "xabcy", "b"]
    parts = ["abc", "b", "", "zz", "abcd"]
    got = {tuple(r) for r in registry.contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in parts], "part string")).collect()}
    assert got == {(t, p) for t in texts for p in parts if p in t}


def test_reviews_are_placed_across_partitions(spark):
    rows = spark.createDataFrame([("d", "t", f"10.{i % 7}", "p", "b", 1.0, None, i) for i in range(500)] + [("e", "t", None, "p", "b", 1.0, None, 1)], "dataset_id string, title string, doi string, publication_id string, body string, mention double, use double, seq int")
    got = catalog.ordered_reviews([catalog.reviews(rows, "validation")])
    placed = sorted((r.place, r.doi, r.seq) for r in got.where("dataset_id = 'd'").collect())
    assert [p for p, _, _ in placed] == list(range(500)) and [x[1:] for x in placed] == sorted(x[1:] for x in placed)
    reg = spark.createDataFrame([("d", "A Thing", None), ("f", "No Review", None)], "dataset_id string, dataset_name string, aliases string")
    docs = {(r.dataset_id, r.part): (r.slug, len(json.loads(r.document).get("review", []))) for r in catalog.documents(reg, got, part_size=200).collect()}
    assert docs == {("d", 0): ("a-thing", 200), ("d", 1): ("a-thing-1", 200), ("d", 2): ("a-thing-2", 100), ("f", 0): ("no-review", 0)}
