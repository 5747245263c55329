"""Registry, catalogue, publications, texts, quality, extraction."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from citeloom.functions.similarity import indel_ratio_of
from citeloom.operators import analyses, catalog, extraction, fulltext, mentions, publications, quality, registry, relationships, rollups
from citeloom.plans.workflow import Workflow, gated, response_step

SEEDS = [("s1", "Food Survey (FS)", "FS; Food Diary"), ("s2", "Farm Census", "FC;Farm Count"), ("s3", "Census", None)]
REG = "dataset_id string, dataset_name string, aliases string"


def reg(spark):
    return registry.ordered_union(spark.createDataFrame(SEEDS, REG), spark.createDataFrame([("a1", "Farm census", "Soil Map"), ("a2", None, "")], REG))


def test_alias_index_and_matches(spark):
    index = {r.norm: r.dataset_id for r in registry.alias_index(reg(spark)).collect()}
    assert index == {"food survey": "s1", "fs": "s1", "food diary": "s1", "farm census": "s2", "fc": "s2", "farm count": "s2", "census": "s3", "soil map": "a1"}
    names = ["Farm census", "FOOD  survey", "the Soil Map of 1990", "diary", "zzz", "??", None]
    got = {r.name: (r.dataset_id, r.how) for r in registry.match_names(spark.createDataFrame([(n,) for n in names], "name string"), reg(spark)).collect()}
    assert got == {"Farm census": ("a1", "exact"), "FOOD  survey": ("s1", "norm"), "the Soil Map of 1990": ("a1", "substring"), "diary": ("s1", "substring"), "zzz": (None, "none"), "??": ("s1", "substring")}
    new = registry.unregistered(spark.createDataFrame([("New Thing", 2), ("new thing!", 1), ("Census", 3)], "name string, ord int"), reg(spark)).collect()
    assert [(r.dataset_id, r.dataset_name) for r in new] == [("new-thing", "new thing!")]


def test_overlap_against_a_loop(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("ab ") for _ in range(rnd.randrange(1, 6))).strip()
    keys = list(dict.fromkeys(w for w in (word() for _ in range(20)) if w))
    norms = list(dict.fromkeys(word() for _ in range(60)))
    index = spark.createDataFrame([(k, f"d{i}", i) for i, k in enumerate(keys)], "norm string, dataset_id string, ord int")
    got = {r.norm: r.dataset_id for r in registry.first_overlap(spark.createDataFrame([(n,) for n in norms], "norm string"), index).collect()}
    expect = {n: f"d{next(i for i, k in enumerate(keys) if k in n or n in k)}" for n in norms if any(k in n or n in k for k in keys)}
    assert got == expect
    joined = registry.first_overlap(spark.createDataFrame([(n,) for n in norms], "norm string"), index, most=3)
    assert {r.norm: r.dataset_id for r in joined.collect()} == expect


@pytest.mark.parametrize("least", [0.8, 0.9, 0.7])
def test_similar_pairs_lose_none(spark, least):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randrange(1, 25))) for _ in range(60)]

    def typo(s):
        s = list(s)
        for _ in range(rnd.randrange(0, 4)):
            i = rnd.randrange(len(s) + 1)
            s[i : i + rnd.randrange(2)] = rnd.choice("abcdez")
        return "".join(s)

    left, right = sorted(set(base)), sorted({typo(b) for b in base} | set(base[:10]))
    got = {(r.a, r.b) for r in registry.similar_pairs(spark.createDataFrame([(x,) for x in left], "text string"), spark.createDataFrame([(x,) for x in right], "text string"), least).collect()}
    assert got == {(a, b) for a in left for b in right if indel_ratio_of(a, b) / 100 >= least}


def test_lookups(spark):
    asked = spark.createDataFrame([("food survey",), ("FS",), ("Farm Cemsus",), ("nothing",), (None,)], "alias string")
    d = spark.createDataFrame([("s1", "Food Survey", "FS"), ("s2", "Farm Census", "FC"), ("s3", "Census", None)], REG)
    assert {(r.alias, r.dataset_id, r.matched_on) for r in registry.lookup_exact(asked, d).collect()} == {("food survey", "s1", "name"), ("FS", "s1", "alias")}
    assert [(r.alias, r.dataset_id, r.identifier) for r in registry.lookup_fuzzy(asked, d).collect()] == [("Farm Cemsus", "s2", "Farm Census")]
    assert {r.name: r.dataset_id for r in registry.first_known(spark.createDataFrame([("fs",), ("x",)], "name string"), d).collect()} == {"fs": "s1", "x": None}
    flags = d.withColumn("flag_terms", F.array(F.lit(" Food"), F.lit("farm")))
    assert {r.score for r in registry.flag_terms(flags, ["food", "x"]).collect()} == {0.5}
    assert registry.flag_terms(flags, ["food", "x"], match_all=True).count() == 0 and registry.flag_terms(flags, ["FOOD", "farm "], match_all=True).count() == 3
    assert [r.dataset_name for r in registry.addable(spark.createDataFrame([("n1", "New"), ("n2", "New"), ("n3", "Census")], "dataset_id string, dataset_name string"), d).collect()] == ["New"]


def test_catalogue(spark):
    rows = spark.createDataFrame([("s1", "T", "10.1/b", "p1", "why", "8.5", "x", 2), ("s1", "U", None, None, None, None, None, 1), (None, "V", "", "p2", "", "1", "2", 3)], "dataset_id string, title string, doi string, publication_id string, body string, mention string, use string, seq long")
    r = catalog.ordered_reviews([catalog.reviews(rows, "validation"), catalog.reviews(rows.where("seq = 2"), "discovery")])
    assert [(x.aspect, x.doi, x.seq, x.place) for x in r.orderBy("place").collect()] == [("validation", "", 1, 0), ("validation", "10.1/b", 2, 1), ("discovery", "10.1/b", 2, 2)]
    docs = {x.dataset_id: json.loads(x.document) for x in catalog.documents(spark.createDataFrame(SEEDS, REG), r).collect()}
    assert [len(v["reviewRating"]) for v in docs["s1"]["review"]] == [0, 1, 1] and "review" not in docs["s2"] and "alternateName" not in docs["s3"]
    assert docs["s1"]["review"][1]["citation"] == {"@type": "ScholarlyArticle", "name": "T", "identifier": "10.1/b", "url": catalog.PUBLICATION_PAGE + "p1"}
    votes = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "a", 3), ("g", "b", 4), ("g", "", 0), ("h", None, 1)], "g string, v string, o int")
    assert [(x.g, x.value) for x in catalog.most_common(votes, "g", "v", "o").collect()] == [("g", "b")]
    assert catalog.slug_clashes(catalog.documents(spark.createDataFrame([("1", "A b", None), ("2", "a-B", None)], REG), r)).count() == 1


TOPIC = "topics array<struct<name:string,score:double>>"


def test_topics_and_queries(spark):
    rows = [([("a", 0.8), ("b", 0.9), ("c", 0.1)],), ([("a", 0.2), ("b", 0.2), None],), ([],), (None,)]
    got = [[t.name for t in r.t] if r.t is not None else None for r in spark.createDataFrame(rows, TOPIC).select(publications.main_topics(F.col("topics")).alias("t")).collect()]
    assert got == [["b", "a"], ["a"], [], None]
    texts = spark.createDataFrame([("the Farm Census and loans",), ("farm census only",), ("a farm census, loans, excluded",), (None,)], "t string")
    assert [r.q for r in texts.select(publications.phrase_query(F.col("t"), ["Farm Census"], ["loan"], ["exclude"]).alias("q")).collect()] == [True, False, False, False]
    ds = "array<struct<id:string>>"
    m = spark.createDataFrame([([("1",)], [("1",), ("2",)]), (None, [("3",)]), ([("4",)], None)], f"a {ds}, b {ds}")
    assert [[x.id for x in r.m] for r in m.select(publications.merge_mentions(F.col("a"), F.col("b")).alias("m")).collect()] == [["1", "2"], ["3"], ["4"]]
    assert [r.id for r in publications.absent_from(spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "id string"), spark.createDataFrame([("1",)], "id string")).collect()] == ["2"]


def test_mapping_of_harvested_rows(spark):
    raw = [("p1", None, "10.1", "article", 2020, 3, ("j", "J"), [("r1", "Ann", "Lee", ["o1", "o2"], [("g", "U")])], [("soil", 0.2), ("food", 0.9)], [("c", "C")], ["1", "2"])]
    d = publications.map_dimensions(spark.createDataFrame(raw, "id string, title string, doi string, type string, year int, times_cited long, journal struct<id:string,title:string>, authors array<struct<researcher_id:string,first_name:string,last_name:string,orcid:array<string>,affiliations:array<struct<id:string,name:string>>>>, concepts_scores array<struct<concept:string,relevance:double>>, category_for array<struct<id:string,name:string>>, issn array<string>")).first()
    assert (d.title, d.authors[0].name, d.authors[0].orcid, [t.name for t in d.topics], d.journals[0].issn) == ("", "Ann Lee", "o1, o2", ["food", "soil"], "1, 2")
    raw = [("https://openalex.org/W7", "T", None, "article", 2020, 1, [(("https://openalex.org/A5", "Ann", "https://orcid.org/0000-0000-0000-0001"), [("https://openalex.org/I9", "U", "US")])], [(("https://openalex.org/S3", "J", "1-2"),), (None,)], [("t", "x", 0.5)]), ("bad", "T", None, "x", 1, 1, None, None, None)]
    o = publications.map_openalex(spark.createDataFrame(raw, "id string, title string, doi string, type string, publication_year int, cited_by_count long, authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<id:string,display_name:string,country_code:string>>>>, locations array<struct<source:struct<id:string,display_name:string,issn_l:string>>>, topics array<struct<id:string,display_name:string,score:double>>")).collect()
    assert len(o) == 1 and (o[0].id, o[0].authors[0].id, o[0].authors[0].institutions[0].id, [j.id for j in o[0].journals]) == ("W7", "A5", "I9", ["S3"])


def test_rollup_counts_a_publication_once(spark):
    kind = "id string, citation_count long, journals array<struct<id:string,name:string>>"
    rows = [("1", 5, [("a", "J"), ("b", "J"), None, ("c", None)]), ("2", None, [("a", "J")]), ("3", 7, None)]
    assert [tuple(r) for r in rollups.citations_by(spark.createDataFrame(rows, kind), "journals").collect()] == [("J", 2, 5)]
    jobs = rollups.year_jobs(spark.createDataFrame([(2020, 2022), (2022, 2020)], "a int, b int"), "a", "b")
    assert [r.year for r in jobs.collect()] == [2020, 2021, 2022]


def test_full_texts(spark, tmp_path):
    s = lambda *t: [(x, 1) for x in t]
    rows = [("p1", (("Title",), ([(("Methods",), s("A b.", "C."))],), ([(None, s("D."))],), ("10.1",), ["k"])), (None, (("X",), None, None, None, None))]
    sec = "struct<sections:array<struct<title:struct<text:string>,sentences:array<struct<text:string,pno:int>>>>>"
    df = spark.createDataFrame(rows, f"publication_id string, fulltext struct<title:struct<text:string>,abstract:{sec},body:{sec},identifiers:struct<doi:string>,keywords:array<string>>")
    got = fulltext.text_parts(df).collect()
    assert [(r.publication_id, r.text_content, r.has_abstract, r.has_body, r.doi, r.is_valid) for r in got] == [("p1", "Title A b. C. D.", True, True, "10.1", True)]
    assert [r.m for r in df.select(fulltext.sections_about(F.col("fulltext.abstract"), "method").alias("m")).collect()] == ["A b. C.", ""]
    path = str(tmp_path / "ft")
    df.write.parquet(path)
    assert fulltext.read_fulltext(spark, path, "p1").count() == 1
    with pytest.raises(LookupError):
        fulltext.read_fulltext(spark, path, "nobody")
    spark.range(1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        fulltext.read_fulltext(spark, str(tmp_path / "bad"))
    assert {r.batch for r in fulltext.batches(spark.range(25).coalesce(1), 10).collect()} == {0, 1, 2}
    assert fulltext.harvest({"z": ["last one"], "title": "A title", "body": {"x": "some  text"}, "n": 5, "abstract": "a TITLE"}) == ["a TITLE", "some text", "last one"]
    h = fulltext.harvested(spark.createDataFrame([("1", '{"body": "long text"}'), ("2", None), ("3", "x")], "k string, v string"), "k", "v")
    assert [r.raw_text for r in h.orderBy("k").collect()] == ["long text", "", ""]
    lines = spark.createDataFrame([(["One line", "one  LINE ", "abc", "Two line"],)], "l array<string>").select(fulltext.distinct_lines(F.col("l")).alias("d")).first().d
    assert lines == ["One line", "Two line"]


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "Farm Census, farm census; FARM CENSUSES"), (2, None), (3, ""), (4, "nothing")], "doc_id long, text string")
    terms = spark.createDataFrame([("s2", "Farm Census"), ("s3", "Census"), ("x", "FC")], "dataset_id string, identifier string")
    found = mentions.find_terms(docs, terms, window=4)
    assert sorted((r.dataset_id, r.start) for r in found.collect()) == [("s2", 0), ("s2", 13), ("s2", 26), ("s3", 5), ("s3", 18), ("s3", 31)]
    assert found.where("start = 13").first().context == "us, farm census; FA"
    assert mentions.distinct_places(found).count() == 6 and mentions.distinct_places(found, width=100).count() == 2
    assert {(r.doc_id, r.term) for r in mentions.find_terms_joined(docs, terms).collect()} == {(1, "farm census"), (1, "census")}
    assert mentions.find_terms(docs, terms.limit(0)).count() == 0
    near = mentions.fuzzy_words(spark.createDataFrame([(1, "a cemsus of farms"), (2, None)], "doc_id long, text string"), terms)
    assert [(r.word, r.term) for r in near.collect()] == [("cemsus", "census")]


def test_relationships(spark):
    rows = [(1, "p", "A", "b ", "merge", 5.0), (2, "p", "B", "a", "merge", 9.5), (3, "p", "a", "A", "x", 9.0), (4, "p", "", "b", "x", 9.0), (5, "q", "A", "c", None, None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "join_id long, publication_id string, dataset1 string, dataset2 string, join_type string, confidence_score double, join_keys array<string>, methodology string")
    one = relationships.distinct_pairs(relationships.well_formed(df))
    assert sorted(r.join_id for r in one.collect()) == [2, 3]
    rel = relationships.issues(relationships.relationships(one))
    assert {r.strength for r in rel.collect()} == {"very_strong"} and sum(len(r.issues) for r in rel.collect()) == 1
    assert relationships.statistics(rel.limit(0)).where("by = 'total'").first().mean_confidence == 0.0
    assert relationships.keep_greedily(["Farm Census", "farm census 2020", "Farm Cansus", "Soil Map"]) == [True, False, False, True]
    d = spark.createDataFrame([("p", "Farm Census", 9.0), ("p", "Farm Cansus", 8.0), ("p", "Soil", 1.0), ("q", "Farm Cansus", 1.0), ("q", None, 2.0)], "publication_id string, name string, confidence double")
    assert sorted((r.publication_id, r.name) for r in relationships.distinct_discoveries(d).collect()) == [("p", "Farm Census"), ("p", "Soil"), ("q", "Farm Cansus")]


ANALYSIS = "analysis_id string, publication_id string, workflow_id string, analysis_timestamp string, workflow_status string, publication_metadata struct<publication_id:string,title:string,authors:array<string>,abstract:string,publication_date:string,journal:string,doi:string>, dataset_analysis string"


def test_quality_and_search_rows(spark):
    meta = ("p", "T", ["A"], "abs", "2020", "J", "d")
    good = '{"validated_datasets": [{"name": "X", "confidence": 0.5, "context": "c"}], "newly_discovered_datasets": [{"name": "Y"}], "dataset_joins": [{"dataset1": "X", "dataset2": "Z"}], "summary": {"total_validated_datasets": 1}}'
    bad = '{"validated_datasets": [{"name": "X", "confidence": 7}], "summary": {"total_validated_datasets": 5}}'
    rows = [("1", "p", "w", "2024-01-01T00:00:00Z", "completed", meta, good), ("2", "q", None, "never", "odd", meta, bad), ("3", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, ANALYSIS)
    got = {r.analysis_id: r for r in quality.assessed(df).collect()}
    assert (got["1"].n_critical, got["1"].n_error, got["1"].completeness, got["1"].level) == (0, 0, 65.0, "fair")
    assert (got["2"].n_critical, got["2"].n_error, got["2"].n_warning, got["2"].consistency, got["2"].logic, got["2"].level) == (1, 4, 1, 85.0, 85.0, "critical")
    assert got["3"].n_critical == 5 and got["3"].level == "critical"
    flat = {r.analysis_id: r for r in analyses.denormalised(df).collect()}
    assert (flat["1"].dataset_names, flat["1"].search_text, flat["1"].n_datasets) == (["X", "Y", "Z"], "T abs A J X Y Z c", 3)
    assert flat["3"].search_text == "" and not flat["3"].has_content
    ok, failed = analyses.split_valid(analyses.denormalised(df))
    assert ok.count() == 2 and failed.first().error == "no publication_id"
    assert [r.name for r in quality.reference_issues(df, spark.createDataFrame([("x",)], "dataset_name string")).collect()] == []


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "Code: https://github.com/o/r and https://zenodo.org/record/5. `print(os.getcwd())`"), (2, None)], "doc_id long, text string")
    assert [(r.owner, r.repository) for r in extraction.repositories(docs).collect()] == [("o", "r")]
    assert {(r.kind, r.link_type) for r in extraction.links(docs).collect()} >= {("general_url", "data_repository")}
    assert [r.content for r in extraction.code(docs).collect()] == ["print(os.getcwd())"]
    found = spark.createDataFrame([("u1",), ("u2",), ("u3.",)], "url string")
    results = spark.createDataFrame([("u1", 200, "t", "dev"), ("u3", 404, None, None)], "url string, status int, title string, default_branch string")
    got = {r.url: (r.is_accessible, r.default_branch) for r in extraction.checked(found, results).collect()}
    assert got == {"u1": (True, "dev"), "u2": (False, "main"), "u3.": (False, "main")}
    both = extraction.combined(found, spark.createDataFrame([("u2",)], "url string"), spark.createDataFrame([("u1", 0.9), ("n1", 0.9), ("n2", 0.1)], "url string, confidence double"), ["url"])
    assert sorted(r.url for r in both.collect()) == ["n1", "u1", "u3."]
    j = extraction.judged(found, spark.createDataFrame([("u1", 1, 5.0), ("u1", 0, 7.0)], "url string, pos int, score double"), ["url"])
    assert {r.url: r.score for r in j.collect()} == {"u1": 7.0, "u2": None, "u3.": None}
    files = spark.createDataFrame([("r", "a.py", 10, "x" * 9000), ("r", "b.exe", 1, ""), ("r", "c.py", 10**9, ""), ("r", "d.R", 3, "y")], "repo string, path string, length long, content string")
    assert sorted((r.path, len(r.content)) for r in extraction.read_files(files).collect()) == [("a.py", 8000), ("d.R", 1)]
    assert extraction.read_files(files, most=1).count() == 1
    a = extraction.aligned(spark.createDataFrame([("soil moisture regression", ["Soil Map"], "our soil map regression pipeline"), (None, None, None)], "publication_text string, datasets array<string>, repo_text string")).collect()
    assert (a[0].matches, a[0].score, a[1].matches) == (3, 2.4, 0)


def test_workflow(spark):
    pubs = spark.createDataFrame([("1", "t"), ("2", "")], "publication_id string, raw_text string")
    answers = spark.createDataFrame([("1", "triage", '{"is_data_analysis": true, "confidence": 9}')], "publication_id string, step string, response string")
    flow = Workflow()
    flow.register("triage", gated(response_step(answers, "triage"), "raw_text <> ''", "triage"))
    flow.register("joins", lambda df: df.select("no_such_column"))
    got = {r.publication_id: r for r in flow.run(pubs).collect()}
    assert got["1"].triage.confidence == 9.0 and got["2"].triage is None and got["1"].error.startswith("joins") and round(got["1"].progress) == 14
    with pytest.raises(ValueError):
        flow.register("other", lambda df: df)
    with pytest.raises(Exception):
        Workflow(recover=False, steps=flow.steps).run(pubs)


def test_evidence_time_stats(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1), 1.0), (datetime(2023, 1, 1), None)], "at timestamp, v double")
    assert rollups.recent(df, "at", F.lit("2024-01-02").cast("timestamp")).first().n_recent == 1
    assert rollups.time_stats(df.where("v is null"), F.col("v")).count() == 0
