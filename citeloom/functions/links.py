"""Web addresses: validation, parts, classes, and finding them in text."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Classes of links by parts of their address, in this order.
LINK_CLASSES = {
    "data_repository": ["zenodo.org", "figshare.com", "dataverse.org", "dryad.org", "osf.io", "kaggle.com/datasets"],
    "documentation": ["docs.", "documentation", "tutorial", "readthedocs.io", "wiki", "guide"],
    "academic_resource": ["doi.org", "arxiv.org", "pubmed.ncbi.nlm.nih.gov", "scholar.google.com", "researchgate.net"],
    "tool": ["api", "tool", "software", "app", "service"],
}
# Patterns of addresses that are refused, wherever they match: bare owner pages, programs, scripts.
REFUSED = [r"(?i)https?://(?:www\.)?github\.com/[^/\s]*$", r"(?i)\.(?:exe|dll|so|dylib|bin|app)$", r"(?i)(?:javascript:|data:|vbscript:)"]
# Kinds of repository addresses, in order of precedence; groups owner, repo, then the kind's own.
REPO_PATTERNS = [
    ("issue_pr", r"(?i)https?://(?:www\.)?github\.com/([a-zA-Z0-9._-]+)/([a-zA-Z0-9._-]+)/(?:issues|pull)/(\d+)"),
    ("wiki", r"(?i)https?://(?:www\.)?github\.com/([a-zA-Z0-9._-]+)/([a-zA-Z0-9._-]+)/wiki/([^#\s]+)"),
    ("release", r"(?i)https?://(?:www\.)?github\.com/([a-zA-Z0-9._-]+)/([a-zA-Z0-9._-]+)/releases/(?:tag|download)/([^#\s]+)"),
    ("commit", r"(?i)https?://(?:www\.)?github\.com/([a-zA-Z0-9._-]+)/([a-zA-Z0-9._-]+)/commit/([a-f0-9]{7,40})"),
    ("raw_content", r"(?i)https?://raw\.githubusercontent\.com/([a-zA-Z0-9._-]+)/([a-zA-Z0-9._-]+)/([a-zA-Z0-9._/-]+)/([^#\s]+)(?:#L(\d+)(?:-L(\d+))?)?"),
    ("gist", r"(?i)https?://gist\.github\.com/([a-zA-Z0-9._-]+)/([a-zA-Z0-9]+)(?:/([a-zA-Z0-9._-]+))?"),
    ("search", r"(?i)https?://(?:www\.)?github\.com/search\?q=([^&\s]+)"),
    ("repository", r"(?i)https?://(?:www\.)?github\.com/([a-zA-Z0-9._-]+)/([a-zA-Z0-9._-]+)(?:/(?:tree|blob)/([a-zA-Z0-9._-]+)/([^#\s]+))?(?:#L(\d+)(?:-L(\d+))?)?(?=[\s.,;!?]|$|/)"),
]
# Kinds of other addresses, in order.
LINK_PATTERNS = [
    ("general_url", r"(?i)https?://(?:[-\w.])+(?:[:\d]+)?(?:/(?:[\w/_.])*(?:\?(?:[\w&=%.])*)?(?:#(?:\w*))?)?"),
    ("doi", r"(?i)(?:https?://)?(?:dx\.)?doi\.org/([^\s]+)"),
    ("arxiv", r"(?i)(?:https?://)?arxiv\.org/(?:abs|pdf)/([^\s]+)"),
    ("pubmed", r"(?i)(?:https?://)?(?:www\.)?ncbi\.nlm\.nih\.gov/pubmed/(\d+)"),
    ("zenodo", r"(?i)(?:https?://)?zenodo\.org/record/(\d+)"),
    ("figshare", r"(?i)(?:https?://)?figshare\.com/articles/(\d+)"),
    ("dryad", r"(?i)(?:https?://)?datadryad\.org/stash/dataset/([^\s]+)"),
    ("kaggle", r"(?i)(?:https?://)?www\.kaggle\.com/([^\s]+)"),
    ("colab", r"(?i)(?:https?://)?colab\.research\.google\.com/([^\s]+)"),
    ("jupyter", r"(?i)(?:https?://)?(?:[^/]+)/notebooks/([^\s]+)"),
    ("documentation", r"(?i)(?:https?://)?(?:docs?\.|documentation\.)([^\s]+)"),
    ("api_docs", r"(?i)(?:https?://)?(?:api\.|developer\.)([^\s]+)"),
]

REPO_ROW = T.ArrayType(
    T.StructType([T.StructField(n, t) for n, t in (("kind", T.StringType()), ("url", T.StringType()), ("owner", T.StringType()), ("repository", T.StringType()), ("branch", T.StringType()), ("path", T.StringType()), ("line_from", T.IntegerType()), ("line_to", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()))])
)
LINK_ROW = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("url", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def valid_url(url: Column) -> Column:
    """FIL23: has a scheme and a host, is no bare owner page, no program file, and holds no script."""
    refused = F.lit(False)
    for pattern in REFUSED:
        refused = refused | url.rlike(pattern)
    return F.coalesce(~refused & F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(url, F.lit("AUTHORITY")).isNotNull(), F.lit(False))


def is_repo_host(url: Column) -> Column:
    """FIL12: whether an address is one of the code host's."""
    return F.lower(url).rlike(r"github\.com|githubusercontent\.com")


def link_class(url: Column) -> Column:
    """STR14: the first class of which a part occurs; ``other`` if none, also for null."""
    c = F.lit("other")
    for name, parts in reversed(LINK_CLASSES.items()):
        c = F.when(F.lower(url).rlike("|".join(re.escape(p) for p in parts)), name).otherwise(c)
    return c


def bare_url(url: Column) -> Column:
    """JOI14: without punctuation at the end."""
    return F.regexp_replace(url, r"[.,;!?]+$", "")


def url_parts(url: Column) -> Column:
    """STR18: scheme, host with port, path, query as a map, fragment, port, whether relative."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    return F.struct(
        part("PROTOCOL").alias("scheme"), part("AUTHORITY").alias("netloc"), part("PATH").alias("path"),
        F.when(part("QUERY") != "", F.str_to_map(part("QUERY"), F.lit("&"), F.lit("="))).alias("query"), part("REF").alias("fragment"),
        F.regexp_extract(F.coalesce(part("AUTHORITY"), F.lit("")), r":(\d+)$", 1).alias("port"),
        F.coalesce(part("PROTOCOL").isNull(), F.lit(True)).alias("is_relative"),
    )


def repo_parts(url: Column) -> Column:
    """STR19: kind, owner and repository (without a final .git) of one address; nulls if it is none."""
    kind, owner, repo = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(REPO_PATTERNS):
        hit = url.rlike(pattern)
        kind = F.when(hit, name).otherwise(kind)
        if name != "search":
            owner = F.when(hit, F.regexp_extract(url, pattern, 1)).otherwise(owner)
            repo = F.when(hit, F.regexp_replace(F.regexp_extract(url, pattern, 2), r"\.git$", "")).otherwise(repo)
        else:
            owner, repo = F.when(hit, F.lit(None)).otherwise(owner), F.when(hit, F.lit(None)).otherwise(repo)
    return F.struct(kind.alias("kind"), owner.alias("owner"), repo.alias("repository"))


#: The groups of each kind that hold branch, path and lines.
_EXTRA = {"repository": (3, 4, 5, 6), "raw_content": (3, 4, 5, 6)}


def free_spans(text: str, patterns: list[tuple[str, str]]) -> list[tuple[str, re.Match]]:
    """DED10: matches of all patterns, earlier patterns first, none overlapping one already taken."""
    out: list[tuple[str, re.Match]] = []
    for kind, pattern in patterns:
        new = [m for m in re.finditer(pattern, text, re.S if kind in ("fenced_with_lang", "fenced_no_lang") else 0) if not any(m.start() < o.end() and o.start() < m.end() for _, o in out)]
        out += [(kind, m) for m in new]
    return out


def find_repos_in(text: str | None) -> list[tuple]:
    """Repository addresses of a text with parts and places; empty for null."""
    rows = []
    for kind, m in free_spans(text or "", REPO_PATTERNS):
        branch, path, low, high = (m.group(g) for g in _EXTRA[kind]) if kind in _EXTRA else (None,) * 4
        owner, repo = (None, None) if kind == "search" else m.group(1, 2)
        lines = (int(low), int(high or low)) if low else (None, None)
        rows.append((kind, m.group(), owner, re.sub(r"\.git$", "", repo.rstrip(".")) if repo else None, branch, path, *lines, m.start(), m.end()))
    return rows


def find_links_in(text: str | None) -> list[tuple]:
    """Other addresses of a text, the first of equal ones by kind, then place (DED09); empty for null."""
    first: dict[str, tuple] = {}
    for kind, pattern in LINK_PATTERNS:
        for m in re.finditer(pattern, text or ""):
            first.setdefault(m.group(), (kind, m.group(), m.start(), m.end()))
    return list(first.values())


def _over(texts: pd.Series, kind: T.ArrayType, find: Callable[[str | None], list[tuple]]) -> pd.Series:
    names = kind.elementType.fieldNames()
    return pd.Series([[dict(zip(names, row)) for row in find(t)] for t in texts], dtype=object)


@F.pandas_udf(REPO_ROW)
def _repos(texts: pd.Series) -> pd.Series:
    return _over(texts, REPO_ROW, find_repos_in)


@F.pandas_udf(LINK_ROW)
def _links(texts: pd.Series) -> pd.Series:
    return _over(texts, LINK_ROW, find_links_in)


def find_repos(text: Column) -> Column:
    """UDT01: all repository addresses with parts and places, by :func:`find_repos_in`."""
    return _repos(text)


def find_links(text: Column) -> Column:
    """UDT03: all other addresses with places, by :func:`find_links_in`."""
    return _links(text)


def repo_keys(text: Column) -> Column:
    """UDT05: ``owner/repo`` of every repository, once each, first place first; gists as ``gist-<id>``. In the JVM."""
    repos = F.transform(F.regexp_extract_all(text, F.lit(r"(?<!gist\.)github\.com/([\w.-]+/[\w.-]+)"), F.lit(1)), lambda r: F.regexp_replace(F.regexp_replace(r, r"[.,;:)]+$", ""), r"\.git$", ""))
    gists = F.transform(F.regexp_extract_all(text, F.lit(r"gist\.github\.com/[\w-]+/([0-9a-f]+)"), F.lit(1)), lambda g: F.concat(F.lit("gist-"), g))
    return F.array_distinct(F.concat(gists, repos))
