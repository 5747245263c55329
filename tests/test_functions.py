"""Column functions against plain Python or fixed expectations."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from citeloom.functions import code, html, links, responses, scores, similarity, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(0,)], [*values] or ["x"]).select(column.alias("v")).first()["v"]


def each(spark, column, values, kind="string"):
    return [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(column.alias("v")).collect()]


def x():
    return F.col("x")


def test_names(spark):
    values = ["Food & Farm (2019) Survey!", "--A--", "", None, "é" * 100]
    assert each(spark, text.slug(x()), values) == ["food-farm-2019-survey", "a", "", None, ""]
    assert each(spark, text.plain_name(x()), values) == ["food farm survey", "a", "", None, ""]
    assert each(spark, text.alias_list(x()), ["a; b ;;c", "", None]) == [["a", "b", "c"], [], []]
    assert len(each(spark, text.slug(x()), ["ab " * 60])[0]) == 80


def test_ids_and_words(spark):
    assert each(spark, text.entity_id(x(), "author"), ["https://openalex.org/A123", "W1", None]) == ["A123", "", None]
    assert each(spark, text.orcid_of(x()), ["https://orcid.org/0000-0001-2345-6789", "x"]) == ["0000-0001-2345-6789", ""]
    assert each(spark, text.clean_doi(x()), [" 10.1/x ", "None", "", None, "n/a"]) == ["10.1/x", None, None, None, None]
    assert each(spark, text.usage_status(x()), [" Analyzed", "used", None]) == ["analyzed", None, None]
    assert each(spark, text.quote_place(x(), F.lit("b")), ["abc", "xyz", None]) == [1, 0, 0]
    assert each(spark, text.quoted(x()), ["a b/c&d"]) == ["a%20b/c%26d"]
    assert each(spark, text.edge_ngrams(x()), ["Ab", "", None]) == [["a", "ab"], [], []]


def test_preprocessing(spark):
    assert each(spark, text.triage_text(x(), 20), ["a  b\n....c http://x.y doi: 10.1/2"]) == ["a b ...c [URL] [DOI]"[:20] + ("..." if len("a b ...c [URL] [DOI]") > 20 else "")]
    assert each(spark, text.join_text(x(), 10), ["abcdefghijkl", "abc"]) == ["abcdefg...", "abc"]
    assert each(spark, text.discovery_text(x(), 5), ["abcdefgh ", " ab "]) == ["abcde...", "ab"]
    assert each(spark, text.code_text(x()), ["a\n\n\n\nb \t c"]) == ["a\n\nb c"]
    assert each(spark, text.around(x(), F.lit(5), F.lit(6), 2), ["0123456789", "012345", "", None]) == ["34567", "345", "", None]
    assert one(spark, text.render("Hi {a} of {b}", a=F.col("p"), b=F.lit(3)), p="x") == "Hi x of 3"
    with pytest.raises(KeyError):
        text.render("{lacking}")


def test_similarity(spark):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(12))) for _ in "ab")
        expect = 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0
        assert abs(similarity.indel_ratio_of(a, b) - expect) < 1e-9
    df = spark.createDataFrame([("abcd", "abxd"), ("", ""), (None, "a")], "a string, b string")
    got = df.select(similarity.indel_ratio(F.col("a"), F.col("b")).alias("i"), similarity.block_ratio(F.col("a"), F.col("b")).alias("s"), similarity.may_reach(F.col("a"), F.col("b"), 80).alias("m")).collect()
    assert [r.i for r in got] == [75.0, 100.0, 0.0] and [r.s for r in got] == [difflib.SequenceMatcher(None, "abcd", "abxd").ratio(), 1.0, 0.0]


def test_urls(spark):
    values = ["https://github.com/a/b", "https://github.com/a", "http://x.y/z.exe", "javascript:1", "x.y/z", "", None, "https://x.y"]
    assert each(spark, links.valid_url(x()), values) == [True, False, False, False, False, False, False, True]
    assert each(spark, links.link_class(x()), ["https://zenodo.org/1", "https://docs.x.y", "https://arxiv.org/abs/1", "https://my.app", "https://x.y", None]) == ["data_repository", "documentation", "academic_resource", "tool", "other", "other"]
    p = one(spark, links.url_parts(F.col("u")), u="https://h.io:8080/p/q?a=1&b=2#f")
    assert (p.scheme, p.netloc, p.path, p.query, p.fragment, p.port, p.is_relative) == ("https", "h.io:8080", "/p/q", {"a": "1", "b": "2"}, "f", "8080", False)
    r = one(spark, links.repo_parts(F.col("u")), u="https://github.com/own/legit.git")
    assert (r.kind, r.owner, r.repository) == ("repository", "own", "legit")
    assert each(spark, links.repo_keys(x()), ["see github.com/a/b.git, github.com/a/b and gist.github.com/u/12ab"])[0] == ["gist-12ab", "a/b"]


def test_repositories_in_text():
    t = "x https://github.com/o/r/blob/main/src/f.py#L10-L15 y https://github.com/o/r/issues/7 https://gist.github.com/u/abc1 https://raw.githubusercontent.com/o/r/main/f.csv https://github.com/search?q=a"
    kinds = {r[0]: r for r in links.find_repos_in(t)}
    assert set(kinds) == {"repository", "issue_pr", "gist", "raw_content", "search"}
    assert kinds["repository"][2:8] == ("o", "r", "main", "src/f.py", 10, 15)
    spans = sorted((r[8], r[9]) for r in kinds.values())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert links.find_repos_in(None) == [] and links.find_links_in("") == []
    assert [r[0] for r in links.find_links_in("https://x.y/a and https://x.y/a and doi.org/10.1/z")] == ["general_url", "doi"]


def test_code(spark):
    t = "```python\nimport os\n```\n`inline` and $x^2$ and <code>abc</code>"
    assert [b["kind"] for b in code.blocks_in("```\nplain block\n```")] == ["fenced_no_lang"]
    assert [(b["kind"], b["language"], b["content"]) for b in code.blocks_in(t)] == [("fenced_with_lang", "python", "import os"), ("inline_backticks", None, "inline"), ("html_code", None, "abc")]
    assert code.blocks_in(None) == [] and code.snippets_in("`short`") == []
    bodies = ["import os\nfrom a import b\nprint(1)", "library(x)\ny <- data.frame()", "SELECT a FROM b WHERE c", "ls -l $HOME", '{"a": 1}', "", None]
    assert each(spark, code.language_by_patterns(x()), bodies) == ["python", "r", "sql", "bash", "json", "other", "other"]
    assert each(spark, code.language_by_patterns(x(), F.lit("Py")), ["?"]) == ["python"]
    assert each(spark, code.language_by_counts(x()), bodies[:4] + [""]) == ["python", "r", "sql", "bash", "unknown"]
    got = each(spark, code.language_by_indicators(x()), ["import pandas\nimport numpy\ndef f(): print(1)", ""])
    assert (got[0].language, got[0].confidence, got[1].language, got[1].confidence) == ("python", 0.8, "unknown", 0.0)
    assert each(spark, code.is_read(x()), ["a/README.md", "x.py", "x.exe", "Dockerfile", "b/c.R"]) == [True, True, False, True, True]


def test_responses(spark):
    said = each(spark, responses.triage(x()), ['{"is_data_analysis": true, "confidence": "8.5"}', 'ok {"is_data_analysis": false, "confidence": 2} so', "Yes indeed", "no", None])
    assert [(r.is_data_analysis, r.confidence) for r in said] == [(True, 8.5), (False, 2.0), (True, 5.0), (False, 0.0), (False, 0.0)]
    assert each(spark, responses.envelope(x()), ['{"choices": [{"message": {"content": "hi"}}]}', '{"text": "t"}', "raw", None]) == ["hi", "t", "raw", ""]
    assert each(spark, F.size(responses.validations(x())), ['x [ {"name": "a"} ]', "none", None]) == [1, 0, 0]
    j = each(spark, responses.joins(x()), ['{"joins": [{"dataset1": "a", "dataset2": "b", "confidence": "7"}, {"dataset1": "a", "dataset2": "a"}, {"dataset1": ""}]}'])[0]
    assert [(x.dataset1, x.dataset2, x.confidence) for x in j] == [("a", "b", 7.0)]
    c = each(spark, responses.challenge_items(x()), ['{"challenges": [{"description": "d", "severity": "high"}, "plain"]}', "x"])
    assert [(x.description, x.severity) for x in c[0]] == [("d", "high"), ("plain", "medium")] and c[1] == []
    a = each(spark, responses.alignment(x()), ['{"alignment_score": 12, "signals": ["1","2","3","4","5","6"]}', "x"])
    assert (a[0].score, len(a[0].signals), a[1].score) == (10.0, 5, 0.0)
    m = each(spark, responses.methodology(x()), ['{"approach": "sql", "join_keys": null}'])[0]
    assert (m.approach, m.join_keys) == ("sql", [])
    assert each(spark, responses.escape_inner_lines(x()), ['{"a": "x\ny"}\n', None]) == ['{"a": "x\\ny"}\n', None]
    assert each(spark, responses.repaired(x()), ['x {"a": ,\n "b": [1,],} y']) == ['{"a": null, "b": [1]}']


def test_scores(spark):
    assert each(spark, scores.strength(x()), [9.0, 7.5, 5.0, 1.0], "double") == ["very_strong", "strong", "moderate", "weak"]
    assert each(spark, scores.relation(x()), ["Data Merge", "left join", "record linkage", "?", None]) == ["merge", "join", "linkage", "other", "other"]
    assert each(spark, scores.one_of(x(), ["a", "b"]), ["A", "c", None]) == ["a", "other", "other"]
    assert one(spark, scores.complexity(F.lit(2.0), F.array(F.lit("critical"), F.lit("high")), F.lit("12%"))) == "critical"
    assert one(spark, scores.complexity(F.lit(10.0), F.lit(None).cast("array<string>"), F.lit("x"))) == "low"
    assert one(spark, scores.triage_adjusted(F.lit(9.8), F.lit(3), F.lit(2), F.lit(True), F.lit(5))) == 10.0
    assert one(spark, scores.triage_adjusted(F.lit(0.2), F.lit(0), F.lit(0), F.lit(False), F.lit(1))) == 0.0
    assert one(spark, scores.alignment_score(F.lit(20))) == 10.0 and one(spark, scores.alignment_score(F.lit(5), F.lit(8.0))) == 6.0


def test_pages():
    p = html.read_page('<html lang="en"><title>A &amp; B</title><meta name="Keywords" content="k"><meta property="og:type" content="w"><a href="/x">x</a><link rel="canonical" href="u">')
    assert dict(p["meta"]) == {"lang": "en", "title": "A & B", "keywords": "k", "og_type": "w", "canonical": "u"} and p["links"] == ["/x"]
    assert html.read_page(None) == {"meta": [], "links": []} and html.read_page("<<<>>") ["links"] == []
