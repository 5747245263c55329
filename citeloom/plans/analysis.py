"""Queries over texts, analyses, stored tables and streams, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import code as code_fn
from citeloom.functions import html, links, responses, scores, text
from citeloom.operators import analyses, extraction, fulltext, quality, relationships, store
from citeloom.operators.versions import latest_version
from citeloom.plans import workflow
from citeloom.plans.records import OPENED, valid_analyses
from citeloom.sources.session import materialise, shared_dir
from citeloom.sources.tables import table
from citeloom.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]


def q19_distinct_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(fulltext.distinct_lines(F.split("text", "\n"))).alias("place", "line"))


def q20_upserted(spark: SparkSession, d: str) -> DataFrame:
    """Older half of the events as the table, the rest as changes, keyed by user."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    old = latest_version(e.where("event_id % 2 = 0"), F.col("user_id").cast("string"), F.col("event_id").cast("timestamp"), e.columns).drop("_key")
    return store.upserted(old, e.where("event_id % 2 = 1"), ["user_id"], "event_id")


def q20_patched(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("!"))).alias("c_name"))
    return store.patched(c, changes, ["c_custkey"])


def q21_matching(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return store.matching(o, equal={"o_orderstatus": "F"}, among={"o_orderpriority": ["1-URGENT", "2-HIGH"]}, between={"o_totalprice": (1000.0, 200000.0)}, sort_by="o_totalprice", skip=10, limit=50, key="o_orderkey").select("o_orderkey", "o_totalprice")


def q22_changed(spark: SparkSession, d: str) -> DataFrame:
    return sync.changed_since(table(spark, d, "analyses"), F.lit("2024-06-01").cast("timestamp_ntz")).select("analysis_id", "updated_at").distinct()


def q24_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.assessed(valid_analyses(spark, d, ["publication_id", "workflow_id", "analysis_timestamp", "workflow_status", "publication_metadata", "dataset_analysis"]).where("deleted_at is null"))


def q24_references(spark: SparkSession, d: str) -> DataFrame:
    return quality.reference_issues(valid_analyses(spark, d, ["dataset_analysis"]).where("deleted_at is null"), table(spark, d, "seed_datasets"))


def q25_denormalised(spark: SparkSession, d: str) -> DataFrame:
    got = analyses.denormalised(valid_analyses(spark, d, ["publication_id", "workflow_status", "publication_metadata", "dataset_analysis"]).where("deleted_at is null"))
    return got.select("analysis_id", "publication_id", "authors_text", "publication_text", "n_validated", "n_discovered", "n_joins", "n_datasets")


def q25_assembled(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence").distinct().where("publication_id is not null")
    m = e.select("publication_id", F.col("dataset_name").alias("name"), scores.evidence_confidence(F.col("confidence_score_use"), F.col("confidence_score_mention")).alias("confidence"), "context", F.col("dataset_id").isNotNull().alias("is_known"))
    j = table(spark, d, "dataset_joins").distinct().select("publication_id", "dataset1", "dataset2", "join_type", F.col("confidence_score").alias("confidence"))
    pubs = e.select("publication_id").distinct()
    return analyses.assembled(pubs, m, j).select("publication_id", "n_validated_datasets", "n_newly_discovered_datasets", "n_dataset_joins")


def _urls(spark: SparkSession, d: str) -> DataFrame:
    """Constructed addresses, a kind for each remainder."""
    k = F.col("c_custkey").cast("string")
    kinds = [F.concat(F.lit("https://github.com/u"), k, F.lit("/r"), k, F.lit(".git")), F.concat(F.lit("https://zenodo.org/record/"), k), F.concat(F.lit("https://docs.site.io/p/"), k, F.lit("?a=1&b="), k, F.lit("#top")), F.concat(F.lit("https://doi.org/10.1/"), k, F.lit("."))]
    kinds += [F.concat(F.lit("https://github.com/u"), k), F.concat(F.lit("http://files.net:8080/f"), k, F.lit(".exe")), F.lit("javascript:void(0)"), F.concat(F.lit("https://gist.github.com/u"), k, F.lit("/abc"), k), F.concat(F.lit("https://github.com/u"), k, F.lit("/r/issues/"), k)]
    url = kinds[-1]
    for i, u in enumerate(kinds[:-1]):
        url = F.when(F.col("c_custkey") % len(kinds) == i, u).otherwise(url)
    return table(spark, d, "customer").select("c_custkey", url.alias("url"))


def q26_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    parts, repo = links.url_parts(u), links.repo_parts(u)
    return _urls(spark, d).select("c_custkey", links.valid_url(u).alias("valid"), links.link_class(u).alias("link_type"), links.bare_url(u).alias("bare"), parts["scheme"].alias("scheme"), parts["netloc"].alias("netloc"), repo["kind"].alias("kind"), repo["repository"].alias("repository"), links.is_repo_host(u).alias("is_repo_host"))


def _noted(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("c_custkey", F.concat(F.lit("See "), F.col("url"), F.lit(" for data.\n```python\nimport os\ndef run(x):\n    return os.getpid()\n```\nand `inline_code_here_long` too.")).alias("text"))


def q26_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Repository addresses found in texts; rows only: SQL's regular expressions lack look-ahead."""
    return extraction.repositories(_noted(spark, d), "c_custkey").select("c_custkey", "kind", "owner", "repository", "start", "end")


def q26_links(spark: SparkSession, d: str) -> DataFrame:
    return extraction.links(_noted(spark, d), "c_custkey").select("c_custkey", "kind", "url", "link_type", "start")


def q26_code(spark: SparkSession, d: str) -> DataFrame:
    return extraction.code(_noted(spark, d), "c_custkey").select("c_custkey", "kind", "language", "content", "start")


def q26_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _noted(spark, d).select("c_custkey", F.inline(code_fn.code_blocks(F.col("text"))))


def q26_checked(spark: SparkSession, d: str) -> DataFrame:
    u = _urls(spark, d)
    results = u.select("url", F.when(F.col("c_custkey") % 4 == 0, 200).otherwise(404).alias("status"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("default_branch"))
    return extraction.checked(u, results).select("c_custkey", "is_accessible", "default_branch")


def q27_html(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_name")
    page = F.concat(F.lit('<html lang="en"><head><title> '), n, F.lit(' </title><meta name="description" content="of '), n, F.lit('"><link rel="canonical" href="https://x.y/'), F.col("c_custkey"), F.lit('"></head><body><a href="/a">a</a><a href="/b">b</a></body></html>'))
    got = table(spark, d, "customer").select("c_custkey", html.page_metadata(page).alias("p"))
    field = lambda f: F.try_element_at("p.meta", F.lit(f))
    return got.select("c_custkey", field("title").alias("title"), field("description").alias("description"), field("canonical").alias("canonical"), field("lang").alias("lang"), F.size("p.links").alias("n_links"))


_SNIPPETS = ["import os\nfrom x import y\nprint(1)", "library(dplyr)\nx <- data.frame(a)", "SELECT a FROM t WHERE b", "#!/bin/bash\nls -l $HOME", "const a = 1; let b = 2; console.log(a)", '{"a": 1}', "nothing here"]


def q28_languages(spark: SparkSession, d: str) -> DataFrame:
    body = F.lit(_SNIPPETS[-1])
    for i, s in enumerate(_SNIPPETS[:-1]):
        body = F.when(F.col("c_custkey") % len(_SNIPPETS) == i, s).otherwise(body)
    return table(spark, d, "customer").select("c_custkey", code_fn.language_by_patterns(body).alias("language"))


def q28_language_counts(spark: SparkSession, d: str) -> DataFrame:
    """The two other detections side by side; rows only."""
    body = F.lit(_SNIPPETS[-1])
    for i, s in enumerate(_SNIPPETS[:-1]):
        body = F.when(F.col("c_custkey") % len(_SNIPPETS) == i, s).otherwise(body)
    got = table(spark, d, "customer").select(code_fn.language_by_counts(body).alias("by_counts"), code_fn.language_by_indicators(body)["language"].alias("by_indicators"))
    return got.groupBy("by_counts", "by_indicators").agg(F.count(F.lit(1)).alias("n"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Constructed model responses, a form for each remainder."""
    k = F.col("o_orderkey")
    yes = F.concat(F.lit('{"is_data_analysis": true, "confidence": '), (k % 10).cast("string"), F.lit("}"))
    forms = [yes, F.concat(F.lit("Sure: "), yes, F.lit(" as asked")), F.lit("yes, it is"), F.lit("no idea"), F.concat(F.lit('{"choices": [{"message": {"content": "'), F.replace(yes, F.lit('"'), F.lit('\\"')), F.lit('"}}]}'))]
    answer = forms[-1]
    for i, f in enumerate(forms[:-1]):
        answer = F.when(k % len(forms) == i, f).otherwise(answer)
    return table(spark, d, "orders").select(k.cast("string").alias("publication_id"), F.lit("triage").alias("step"), answer.alias("response"))


def q29_triage_answers(spark: SparkSession, d: str) -> DataFrame:
    flow = workflow.Workflow()
    answers = _answers(spark, d)
    flow.register("triage", workflow.response_step(answers, "triage", responses.triage))
    got = flow.run(answers.select("publication_id"))
    return got.select("publication_id", F.col("triage.is_data_analysis").alias("is_data_analysis"), F.col("triage.confidence").alias("confidence"))


def q29_validations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    answer = F.concat(F.lit('Here: [{"name": "D'), k, F.lit('", "mentioned": true, "used": false, "confidence_mention": "8.5", "confidence_use": 2, "reasoning": "r"}, {"name": "E", "mentioned": false}] end'))
    got = table(spark, d, "customer").select("c_custkey", F.posexplode(responses.validations(answer)).alias("pos", "v"))
    return got.select("c_custkey", "pos", "v.name", "v.is_mentioned", "v.confidence_mention", "v.confidence_use")


def q29_repaired(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    answer = F.concat(F.lit('x {"datasets": [{"name": "D'), k, F.lit('", "confidence": ,},\n {"name": ""},]} y'))
    got = table(spark, d, "customer").select("c_custkey", F.explode(responses.discoveries(answer)).alias("v"))
    return got.select("c_custkey", "v.name", "v.confidence")


def q29_prose(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit('they used "Set '), F.col("c_custkey"), F.lit('" and the Great Lakes Dataset plus census of farms'))
    return table(spark, d, "customer").select("c_custkey", F.array_join(responses.names_in_prose(said), ";").alias("names"), F.size(responses.pairs_in_prose(said)).alias("n_pairs"))


def q29_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


def q30_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Discoveries without near copies; tested against a plain loop."""
    e = table(spark, d, "evidence").where("dataset_id is null and dataset_name is not null")
    return relationships.distinct_discoveries(e.select("publication_id", F.col("dataset_name").alias("name"), F.col("confidence_score_mention").alias("confidence")).where("publication_id is not null and confidence is not null"))


def q31_snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    new = c.where("c_mktsegment <> 'BUILDING'").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).unionByName(c.where("c_custkey < 10").withColumn("c_custkey", F.col("c_custkey") + 1_000_000))
    return sync.snapshot_diff(c, new, "c_custkey")


def q31_resolved(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts")
    other = e.withColumn("ts", F.when(F.col("event_id") % 4 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("ts") - F.expr("INTERVAL 1 HOUR")))
    return sync.resolved(other, e, "event_id", "ts")


def q31_consistency(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return sync.consistency(c, c.where("c_custkey >= 3"))


def q32_synced(spark: SparkSession, d: str) -> DataFrame:
    """Analyses read as a stream into a served table; the result is what a batch would give."""
    source = materialise(table(spark, d, "analyses").select("analysis_id", "publication_id", "workflow_status", "updated_at"), "stream")
    folder = f"{shared_dir(spark)}/sync-{source.inputFiles()[0].rsplit('/', 2)[1]}"
    job = sync.Sync(spark, folder, "analysis_id", "updated_at", F.col("publication_id").isNotNull() & F.col("workflow_status").isNotNull())
    job.run(source.inputFiles()[0].rsplit("/", 1)[0], source.schema)
    served = job.served.read()
    if served is None:
        served = spark.createDataFrame([], source.schema)
    return served.select("analysis_id", "publication_id", "workflow_status", "updated_at")


def q32_reindexed(spark: SparkSession, d: str) -> DataFrame:
    r = sync.Reindex(spark, "citeloom_customers", f"{shared_dir(spark)}/reindex-{uuid.uuid4().hex}")
    return r.run(table(spark, d, "customer"), "c_custkey", "v1")


def q32_classified(spark: SparkSession, d: str) -> DataFrame:
    names = F.element_at(F.array(*[F.lit(n) for n, *_ in sync.ERROR_CLASSES], F.lit("Other")), (F.col("c_custkey") % 9 + 1).cast("int"))
    return sync.classified(table(spark, d, "customer").select("c_custkey", names.alias("error_class"))).groupBy("error_type", "severity", "recoverable").agg(F.count(F.lit(1)).alias("n"))


def q41_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents as full texts of one section per line and one sentence per full stop."""
    docs = table(spark, d, "documents").where("text is not null")
    sentence = lambda s: F.transform(F.split(s, r"\. "), lambda t: F.struct(t.alias("text"), F.lit(1).alias("pno")))
    section = F.transform(F.split("text", "\n"), lambda s: F.struct(F.struct(F.when(F.contains(s, F.lit("kriging")), "Methods").otherwise("Text").alias("text")).alias("title"), sentence(s).alias("sentences")))
    content = F.struct(section.alias("sections"))
    none = F.lit(None).cast("array<string>")
    full = F.struct(F.struct(F.lit("T").alias("text")).alias("title"), content.alias("body"), F.struct(F.lit(None).cast("string").alias("doi")).alias("identifiers"), none.alias("keywords"))
    rows = docs.select(F.col("doc_id").cast("string").alias("publication_id"), full.alias("fulltext"))
    got = fulltext.text_parts(rows).join(rows.select("publication_id", fulltext.sections_about(F.col("fulltext.body"), "method").alias("methods")), "publication_id")
    return got.select("publication_id", F.length("body").alias("n_body"), F.length("methods").alias("n_methods"), "has_body")


def q42_aligned(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("publication_text"))
    other = table(spark, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("repo_text"))
    pairs = docs.join(other, "doc_id", "left").withColumn("datasets", F.array(F.lit("Watershed"), F.lit("Census")))
    return extraction.aligned(pairs).select("doc_id", "matches", "score", "passes")


def q43_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(text.triage_text(t)).alias("triage"), F.md5(text.join_text(t)).alias("joins"), F.md5(text.discovery_text(t)).alias("discovery"), F.md5(text.code_text(t)).alias("code"), F.md5(text.around(t, F.lit(200), F.lit(220), 50)).alias("around"), text.quote_place(t, F.lit("grant")).alias("place"))


def q44_windows(spark: SparkSession, d: str) -> DataFrame:
    return sync.windowed_counts(table(spark, d, "events"), "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n")


QUERIES: dict[str, Query] = {k: v for k, v in globals().items() if k.startswith("q") and callable(v) and k[1:3].isdigit()}

# -- the same in SQL ---------------------------------------------------------------

_LIVE = r"""
live AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(analysis_id, E' \t\n\r')) ORDER BY updated_at DESC NULLS LAST) AS rn FROM analyses WHERE trim(analysis_id, E' \t\n\r') <> '')
  WHERE rn = 1 AND deleted_at IS NULL)"""
_ITEMS = f"""
{OPENED},
lists AS (SELECT analysis_id, path AS part, CASE json_type(v) WHEN 'ARRAY' THEN list_filter(CAST(v AS JSON[]), lambda e: json_type(e) = 'OBJECT') ELSE [v] END AS l FROM opened WHERE json_type(v) IN ('ARRAY', 'OBJECT')),
items AS (SELECT analysis_id, part, x FROM (SELECT analysis_id, part, unnest(l) AS x FROM lists) WHERE json_type(x) = 'OBJECT')"""
_N = 9
_URLS = f"""
u AS (SELECT c_custkey, CASE c_custkey % {_N} WHEN 0 THEN 'https://github.com/u' || c_custkey || '/r' || c_custkey || '.git' WHEN 1 THEN 'https://zenodo.org/record/' || c_custkey WHEN 2 THEN 'https://docs.site.io/p/' || c_custkey || '?a=1&b=' || c_custkey || '#top'
  WHEN 3 THEN 'https://doi.org/10.1/' || c_custkey || '.' WHEN 4 THEN 'https://github.com/u' || c_custkey WHEN 5 THEN 'http://files.net:8080/f' || c_custkey || '.exe' WHEN 6 THEN 'javascript:void(0)' WHEN 7 THEN 'https://gist.github.com/u' || c_custkey || '/abc' || c_custkey ELSE 'https://github.com/u' || c_custkey || '/r/issues/' || c_custkey END AS url FROM customer)"""
_LINES = r"""
l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS raw, generate_subscripts(string_split(text, E'\n'), 1) AS i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, i, trim(regexp_replace(raw, '[\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}\x{000B}\x{001C}-\x{001F}]+', ' ', 'g')) AS line FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY i) AS rn FROM c WHERE length(line) > 3)"""



def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The constructed snippets, and texts with addresses, as SQL has them.
_BODIES = "b AS (SELECT c_custkey, [" + ", ".join(_sql_text(s) for s in _SNIPPETS) + "][CAST(c_custkey % 7 + 1 AS INTEGER)] AS body FROM customer)"
_NOTES = _URLS + """,
t AS (SELECT c_custkey, 'See ' || url || E' for data.\\n```python\\nimport os\\ndef run(x):\\n    return os.getpid()\\n```\\nand `inline_code_here_long` too.' AS text FROM u)"""


def _matches(patterns: list[str], counted: bool, flag: str = "") -> str:
    """How many of the patterns occur in ``body``, or how often they all do."""
    one = "len(regexp_extract_all(body, {}))" if counted else "CAST(regexp_matches(body, {}) AS INTEGER)"
    return "(" + " + ".join(one.format(_sql_text(flag + p)) for p in patterns) + ")"


def _best(scores: dict[str, str], none: str) -> str:
    """The first name of those with the greatest score."""
    top = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {top} = 0 THEN '{none}' " + " ".join(f"WHEN {s} = {top} THEN '{n}'" for n, s in scores.items()) + " END"


_BY_PATTERNS = "CASE " + " ".join(f"WHEN {_matches(ps, False)} >= 2 THEN '{n}'" for n, ps in code_fn.SHORT_PATTERNS.items()) + r" WHEN json_valid(body) AND regexp_matches(trim(body), '(?s)^\{.*\}$') THEN 'json' ELSE 'other' END"
_BY_COUNTS = _best({n: _matches(ps, True, "(?i)") for n, ps in code_fn.LANGUAGE_PATTERNS.items()}, "unknown")
_BY_INDICATORS = _best({n: "(" + " + ".join(f"CAST(contains(body, {_sql_text(w)}) AS INTEGER)" for w in ws) + ")" for n, ws in code_fn.INDICATORS.items()}, "unknown")
_LINK_CLASS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(url), '{p}')" for p in parts) + f" THEN '{n}'" for n, parts in links.LINK_CLASSES.items()) + " ELSE 'other' END"
_SPACE = r"[\s\x{00A0}\x{0085}\x{000B}\x{001C}-\x{001F}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_LINE = f"trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))"

ORACLE = {
    "q43_texts": rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_LINE}, '\.{{3,}}', '...', 'g'), '-{{3,}}', '---', 'g'), 'https?://\S+', '[URL]', 'g'), 'doi:\s*\S+', '[DOI]', 'gi')) AS triage, md5({_LINE}) AS joins, md5({_LINE}) AS discovery,
      md5(trim(regexp_replace(regexp_replace(text, '\n{{3,}}', E'\n\n', 'g'), '[ \t]+', ' ', 'g'))) AS code, md5(trim(substring(text, 151, greatest(least(270, length(text)) - 150, 0)))) AS around, CAST(greatest(instr(text, 'grant') - 1, 0) AS INTEGER) AS place FROM documents WHERE text IS NOT NULL""",
    "q19_distinct_lines": f"WITH {_LINES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place, line FROM k WHERE rn = 1",
    "q20_upserted": """WITH n AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 2 = 1), o AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_id % 2 = 0)
      SELECT user_id, event_id, ts, value FROM n WHERE rn = 1 UNION ALL SELECT user_id, event_id, ts, value FROM o WHERE rn = 1 AND user_id NOT IN (SELECT user_id FROM n)""",
    "q20_patched": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS c_name, c_acctbal FROM customer",
    "q21_matching": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 200000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10",
    "q22_changed": "SELECT DISTINCT analysis_id, updated_at FROM analyses WHERE updated_at >= TIMESTAMP '2024-06-01'",
    "q24_quality": rf"""WITH {_LIVE}, {_ITEMS},
      z AS (SELECT analysis_id, max(CASE WHEN part = 'validated_datasets' THEN len(l) END) AS nv, max(CASE WHEN part = 'newly_discovered_datasets' THEN len(l) END) AS nn, count(*) AS parts FROM lists GROUP BY 1),
      o AS (SELECT analysis_id, bool_or(part = 'validated_datasets' AND CAST(x ->> '$.confidence' AS DOUBLE) NOT BETWEEN 0 AND 1) AS ov, bool_or(part = 'newly_discovered_datasets' AND CAST(x ->> '$.confidence' AS DOUBLE) NOT BETWEEN 0 AND 1) AS onew,
        bool_or(part = 'dataset_joins' AND lower(trim(x ->> '$.dataset1')) = lower(trim(x ->> '$.dataset2'))) AS itself FROM items GROUP BY 1),
      b AS (SELECT live.*, publication_metadata AS m, nv, nn, coalesce(parts, 0) AS parts, coalesce(ov, false) AS ov, coalesce(onew, false) AS onew, coalesce(itself, false) AS itself,
        CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' THEN TRY_CAST(json_extract_string(j, '$.summary.total_validated_datasets') AS INTEGER) END AS stated FROM live LEFT JOIN z USING (analysis_id) LEFT JOIN o USING (analysis_id) LEFT JOIN o6 USING (analysis_id)),
      r AS (SELECT *, coalesce(publication_id <> m.publication_id, false) AS other, coalesce(stated <> nv, false) AS miscounted, coalesce(workflow_status NOT IN ('pending', 'in_progress', 'completed', 'failed'), false) AS odd,
        analysis_timestamp IS NOT NULL AND TRY_CAST(replace(analysis_timestamp, 'Z', '+00:00') AS TIMESTAMPTZ) IS NULL AS badtime, workflow_status = 'completed' AND dataset_analysis IS NULL AS unfinished FROM b),
      c AS (SELECT analysis_id, CAST(coalesce(trim(publication_id), '') = '' AS INTEGER) + CAST(coalesce(trim(workflow_id), '') = '' AS INTEGER) + CAST(coalesce(trim(analysis_timestamp), '') = '' AS INTEGER) + CAST(m IS NULL AS INTEGER) + CAST(coalesce(trim(dataset_analysis), '') = '' AS INTEGER) AS n_critical,
        CAST(other AS INTEGER) + CAST(coalesce(unfinished, false) AS INTEGER) + CAST(ov AS INTEGER) + CAST(onew AS INTEGER) + CAST(odd AS INTEGER) + CAST(badtime AS INTEGER) AS n_error,
        CAST(coalesce(trim(m.title), '') = '' AS INTEGER) + CAST(coalesce(len(m.authors), 0) = 0 AS INTEGER) + CAST(miscounted AS INTEGER) + CAST(itself AS INTEGER) AS n_warning, CAST(coalesce(nv, 0) = 0 AND coalesce(nn, 0) = 0 AS INTEGER) AS n_info,
        round((CAST(coalesce(m.publication_id, '') <> '' AS INTEGER) + CAST(coalesce(m.title, '') <> '' AS INTEGER) + CAST(m.authors IS NOT NULL AS INTEGER) + CAST(coalesce(m.abstract, '') <> '' AS INTEGER) + CAST(coalesce(m.publication_date, '') <> '' AS INTEGER) + CAST(coalesce(m.journal, '') <> '' AS INTEGER) + CAST(coalesce(m.doi, '') <> '' AS INTEGER)) * 100.0 / 7 * 0.25
          + parts * 100.0 / 3 * 0.25 + (CAST(coalesce(workflow_id, '') <> '' AS INTEGER) + CAST(coalesce(workflow_status, '') <> '' AS INTEGER) + CAST(coalesce(analysis_timestamp, '') <> '' AS INTEGER)) * 100.0 / 3 * 0.15, 6) AS completeness,
        CAST(greatest(0, 100 - 10 * CAST(other AS INTEGER) - 5 * CAST(miscounted AS INTEGER) - 5 * CAST(itself AS INTEGER)) AS DOUBLE) AS consistency, CAST(greatest(0, 100 - 15 * CAST(ov AS INTEGER) - 15 * CAST(onew AS INTEGER) - 8 * CAST(itself AS INTEGER)) AS DOUBLE) AS logic FROM r)
      SELECT *, CASE WHEN n_critical > 0 THEN 'critical' WHEN n_error > 0 THEN 'poor' WHEN n_warning > 0 THEN CASE WHEN completeness >= 75 THEN 'good' ELSE 'fair' END WHEN completeness >= 90 THEN 'excellent' WHEN completeness >= 75 THEN 'good' WHEN completeness >= 50 THEN 'fair' ELSE 'poor' END AS level FROM c""",
    "q24_references": rf"""WITH {_LIVE}, {_ITEMS}
      SELECT DISTINCT analysis_id, x ->> '$.name' AS name FROM items WHERE part = 'validated_datasets' AND x ->> '$.name' IS NOT NULL AND lower(x ->> '$.name') NOT IN (SELECT lower(dataset_name) FROM seed_datasets)""",
    "q25_denormalised": rf"""WITH {_LIVE}, {_ITEMS},
      n AS (SELECT analysis_id, count(*) FILTER (part = 'validated_datasets') AS v, count(*) FILTER (part = 'newly_discovered_datasets') AS w, count(*) FILTER (part = 'dataset_joins') AS j FROM items GROUP BY 1),
      names AS (SELECT analysis_id, x ->> '$.name' AS name FROM items WHERE part <> 'dataset_joins' UNION SELECT analysis_id, x ->> '$.dataset1' FROM items WHERE part = 'dataset_joins' UNION SELECT analysis_id, x ->> '$.dataset2' FROM items WHERE part = 'dataset_joins'),
      k AS (SELECT analysis_id, count(*) AS k FROM names WHERE name IS NOT NULL AND name <> '' GROUP BY 1)
      SELECT live.analysis_id, coalesce(publication_metadata.publication_id, publication_id) AS publication_id, coalesce(array_to_string(publication_metadata.authors, ', '), '') AS authors_text, trim(concat_ws(' ', publication_metadata.title, publication_metadata.abstract)) AS publication_text,
        CAST(coalesce(v, 0) AS INTEGER) AS n_validated, CAST(coalesce(w, 0) AS INTEGER) AS n_discovered, CAST(coalesce(j, 0) AS INTEGER) AS n_joins, CAST(coalesce(k, 0) AS INTEGER) AS n_datasets FROM live LEFT JOIN n USING (analysis_id) LEFT JOIN k USING (analysis_id)""",
    "q25_assembled": """WITH e AS (SELECT DISTINCT * FROM evidence), j AS (SELECT DISTINCT * FROM dataset_joins), n AS (SELECT publication_id, count(*) AS n FROM j GROUP BY 1)
      SELECT e.publication_id, CAST(count(e.dataset_id) AS INTEGER) AS n_validated_datasets, CAST(count(*) - count(e.dataset_id) AS INTEGER) AS n_newly_discovered_datasets, CAST(coalesce(any_value(n.n), 0) AS INTEGER) AS n_dataset_joins FROM e LEFT JOIN n USING (publication_id) WHERE e.publication_id IS NOT NULL GROUP BY e.publication_id""",
    "q26_urls": rf"""WITH {_URLS} SELECT c_custkey, c_custkey % {_N} NOT IN (4, 5, 6) AS valid,
      CASE c_custkey % {_N} WHEN 1 THEN 'data_repository' WHEN 2 THEN 'documentation' WHEN 3 THEN 'academic_resource' ELSE 'other' END AS link_type, regexp_replace(url, '[.,;!?]+$', '') AS bare,
      CASE c_custkey % {_N} WHEN 5 THEN 'http' WHEN 6 THEN 'javascript' ELSE 'https' END AS scheme, nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS netloc,
      CASE c_custkey % {_N} WHEN 0 THEN 'repository' WHEN 7 THEN 'gist' WHEN 8 THEN 'issue_pr' END AS kind, CASE c_custkey % {_N} WHEN 0 THEN 'r' || c_custkey WHEN 7 THEN 'abc' || c_custkey WHEN 8 THEN 'r' END AS repository, contains(url, 'github.com') AS is_repo_host FROM u""",
    "q26_checked": "SELECT c_custkey, c_custkey % 4 = 0 AND c_custkey % 9 <> 6 AS is_accessible, 'main' AS default_branch FROM customer",
    "q27_html": "SELECT c_custkey, c_name AS title, 'of ' || c_name AS description, 'https://x.y/' || c_custkey AS canonical, 'en' AS lang, CAST(2 AS INTEGER) AS n_links FROM customer",
    "q26_links": f"""WITH {_NOTES}, m AS ({" UNION ALL ".join(f"SELECT c_custkey, {i} AS k, '{n}' AS kind, unnest(regexp_extract_all(text, {_sql_text(p)})) AS url FROM t" for i, (n, p) in enumerate(links.LINK_PATTERNS))}),
      f AS (SELECT c_custkey, url, arg_min(kind, k) AS kind FROM m GROUP BY ALL) SELECT c_custkey, kind, url, {_LINK_CLASS} AS link_type, CAST(instr(text, url) - 1 AS INTEGER) AS start FROM f JOIN t USING (c_custkey) WHERE NOT regexp_matches(lower(url), 'github\\.com|githubusercontent\\.com')""",
    "q28_languages": f"WITH {_BODIES} SELECT c_custkey, {_BY_PATTERNS} AS language FROM b",
    "q28_language_counts": f"WITH {_BODIES} SELECT {_BY_COUNTS} AS by_counts, {_BY_INDICATORS} AS by_indicators, count(*) AS n FROM b GROUP BY ALL",
    "q42_aligned": rf"""WITH p AS (SELECT a.doc_id, lower(a.text) AS t, lower(coalesce(b.text, '')) AS r FROM documents a LEFT JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text IS NOT NULL),
      w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{extraction.TERM}') AS l FROM p)), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY ALL), k AS (SELECT doc_id, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f) WHERE rn <= 50),
      every AS (SELECT doc_id, w FROM k UNION SELECT doc_id, x FROM p, (VALUES ('watershed'), ('census'), {", ".join(f"('{b}')" for b in extraction.BONUS_TERMS)}) AS v(x)),
      n AS (SELECT doc_id, CAST(count(*) FILTER (contains(r, w)) AS INTEGER) AS matches FROM every JOIN p USING (doc_id) GROUP BY 1), s AS (SELECT doc_id, matches, round_even(least(10.0, matches * CAST(0.8 AS DOUBLE)), 2) AS score FROM n) SELECT *, score >= 6 AS passes FROM s""",
    "q29_triage_answers": "SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS publication_id, o_orderkey % 5 <> 3 AS is_data_analysis, CASE o_orderkey % 5 WHEN 2 THEN 5.0 WHEN 3 THEN 0.0 ELSE CAST(o_orderkey % 10 AS DOUBLE) END AS confidence FROM orders",
    "q29_validations": "SELECT c_custkey, CAST(0 AS INTEGER) AS pos, 'D' || c_custkey AS name, true AS is_mentioned, CAST(8.5 AS DOUBLE) AS confidence_mention, CAST(2.0 AS DOUBLE) AS confidence_use FROM customer UNION ALL SELECT c_custkey, 1, 'E', false, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE) FROM customer",
    "q29_repaired": "SELECT c_custkey, 'D' || c_custkey AS name, CAST(5.0 AS DOUBLE) AS confidence FROM customer",
    "q29_prose": "SELECT c_custkey, 'Set ' || c_custkey || ';Great Lakes Dataset' AS names, CAST(1 AS INTEGER) AS n_pairs FROM customer",
    "q29_props": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "q31_snapshot_diff": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'deleted' ELSE 'updated' END AS change FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 1000000, 'inserted' FROM customer WHERE c_custkey < 10",
    "q31_resolved": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'source' ELSE 'target' END AS winner FROM events",
    "q31_consistency": "SELECT count(*) AS n_source, count(*) FILTER (c_custkey >= 3) AS n_target, count(*) FILTER (c_custkey < 3) AS difference, count(*) FILTER (c_custkey < 3) <= 5 AS is_consistent FROM customer",
    "q32_synced": "SELECT analysis_id, publication_id, workflow_status, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY updated_at DESC) AS rn FROM analyses WHERE publication_id IS NOT NULL AND workflow_status IS NOT NULL) WHERE rn = 1",
    "q32_reindexed": "SELECT 'v1' AS version, count(*) AS n_source, count(*) AS n_target, CAST(1.0 AS DOUBLE) AS share, 'swapped' AS outcome FROM customer",
    "q32_classified": "WITH t AS (SELECT * FROM (VALUES (0, 'connection', 'high', true), (1, 'timeout', 'medium', true), (2, 'indexing', 'medium', true), (3, 'indexing', 'low', true), (4, 'authentication', 'critical', false), (5, 'authorization', 'critical', false), (6, 'serialization', 'medium', false), (7, 'connection', 'high', true), (8, 'unknown', 'medium', true)) AS v(i, error_type, severity, recoverable)) SELECT error_type, severity, recoverable, count(*) AS n FROM customer JOIN t ON c_custkey % 9 = i GROUP BY ALL",
    "q41_sections": r"""WITH s AS (SELECT doc_id, list_transform(string_split(text, E'\n'), lambda x: struct_pack(t := replace(x, '. ', ' '), m := contains(x, 'kriging'))) AS l FROM documents WHERE text IS NOT NULL),
      p AS (SELECT doc_id, array_to_string(list_filter(list_transform(l, lambda x: x.t), lambda x: x <> ''), ' ') AS body, coalesce(array_to_string(list_transform(list_filter(l, lambda x: x.m), lambda x: x.t), E'\n'), '') AS methods FROM s)
      SELECT CAST(doc_id AS VARCHAR) AS publication_id, CAST(length(coalesce(body, '')) AS INTEGER) AS n_body, CAST(length(methods) AS INTEGER) AS n_methods, length(coalesce(body, '')) > 0 AS has_body FROM p""",
    "q44_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
