"""Code in text: blocks, and the language they are written in."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.links import free_spans

# Kinds of code blocks, in order of precedence. Math is matched, so that
# nothing else is read there, but gives no block.
BLOCK_PATTERNS = [
    ("fenced_with_lang", r"(?ms)```(\w+)\s*\n(.*?)\n\s*```"), ("fenced_no_lang", r"(?ms)```\s*\n(.*?)\n\s*```"), ("inline_backticks", r"`([^`\n]+)`"), ("inline_double_backticks", r"``([^`\n]+)``"),
    ("latex_listing", r"(?s)\\begin\{(?:lstlisting|verbatim|code)\}(.*?)\\end\{(?:lstlisting|verbatim|code)\}"), ("latex_inline", r"\\texttt\{([^}]+)\}"),
    ("latex_math", r"\$([^$\n]+)\$"), ("latex_display_math", r"(?s)\$\$([^$]+)\$\$"), ("html_code", r"(?is)<code[^>]*>(.*?)</code>"), ("html_pre", r"(?is)<pre[^>]*>(.*?)</pre>"),
]
MATH = ("latex_math", "latex_display_math")
# Kinds of snippets for the short search, in order.
SNIPPET_PATTERNS = [
    ("fenced", r"(?ms)```(\w+)?\s*\n(.*?)\n\s*```"), ("indented", r"(?m)^(?: {4,}|\t+)(.+)$"), ("inline", r"`([^`\n]+)`"),
    ("latex", r"(?s)\\begin\{(?:lstlisting|verbatim|code)\}(.*?)\\end\{(?:lstlisting|verbatim|code)\}"),
]
# What code of a language has, ten patterns each.
LANGUAGE_PATTERNS = {
    "python": [r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import", r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+\s*\(", r"print\s*\(", r"\bif\s+__name__\s*==\s*['\"]__main__['\"]", r"\bwith\s+\w+\s+as\s+\w+", r"\btry:\s*\n", r"\bexcept\s+\w+:", r"\bfinally:"],
    "r": [r"\blibrary\s*\(", r"\brequire\s*\(", r"<-", r"\bdata\.frame\s*\(", r"\bggplot\s*\(", r"\bfunction\s*\(", r"\bfor\s*\(", r"\bif\s*\(", r"\belse\s*\{", r"\breturn\s*\("],
    "sql": [r"\bSELECT\s+", r"\bFROM\s+", r"\bWHERE\s+", r"\bJOIN\s+", r"\bGROUP\s+BY\s+", r"\bORDER\s+BY\s+", r"\bHAVING\s+", r"\bINSERT\s+INTO\s+", r"\bUPDATE\s+", r"\bDELETE\s+FROM\s+"],
    "bash": [r"#!/bin/(?:bash|sh)", r"\b(?:ls|cd|mkdir|rm|cp|mv|grep|awk|sed|find|chmod|chown)\s+", r"\$\{?\w+\}?", r"\bif\s+\[", r"\bthen\s*\n", r"\bfi\s*$", r"\bfor\s+\w+\s+in", r"\bdo\s*\n", r"\bdone\s*$", r"\bwhile\s+read"],
    "javascript": [r"\bfunction\s+\w+\s*\(", r"\bconst\s+\w+\s*=", r"\blet\s+\w+\s*=", r"\bvar\s+\w+\s*=", r"console\.log\s*\(", r"\bif\s*\(", r"\belse\s*\{", r"\bfor\s*\(", r"\bwhile\s*\(", r"\breturn\s+"],
    "java": [r"\bpublic\s+class\s+\w+", r"\bpublic\s+static\s+void\s+main", r"\bimport\s+java\.", r"\bSystem\.out\.println\s*\(", r"\bprivate\s+\w+\s+\w+", r"\bprotected\s+\w+\s+\w+", r"\bpublic\s+\w+\s+\w+\s*\(", r"\bthrows\s+\w+", r"\btry\s*\{", r"\bcatch\s*\("],
    "cpp": [r"#include\s*<[^>]+>", r'#include\s*"[^"]+"', r"\bint\s+main\s*\(", r"\bstd::cout\s*<<", r"\bstd::cin\s*>>", r"\busing\s+namespace\s+std", r"\bclass\s+\w+\s*\{", r"\bpublic:", r"\bprivate:", r"\bprotected:"],
    "matlab": [r"\bfunction\s+\w+\s*\(", r"\bend\s*$", r"\bfor\s+\w+\s*=", r"\bif\s+\w+\s*==", r"\belseif\s+\w+\s*==", r"\belse\s*$", r"\bplot\s*\(", r"\bfigure\s*\(", r"\bsubplot\s*\(", r"\bhold\s+on"],
    "julia": [r"\bfunction\s+\w+\s*\(", r"\bend\s*$", r"\busing\s+\w+", r"\bimport\s+\w+", r"\bprintln\s*\(", r"\bfor\s+\w+\s+in", r"\bif\s+\w+\s*==", r"\belseif\s+\w+\s*==", r"\belse\s*$", r"\bstruct\s+\w+"],
}
# The patterns of the short detection, and its names for languages.
SHORT_PATTERNS = {
    "python": [r"(?i)\bimport\s+\w+", r"(?i)\bfrom\s+\w+\s+import", r"(?i)\bdef\s+\w+\s*\(", r"(?i)\bclass\s+\w+\s*\(", r"(?i)print\s*\("],
    "r": [r"(?i)\blibrary\s*\(", r"(?i)\brequire\s*\(", r"(?i)<-", r"(?i)\bdata\.frame\s*\(", r"(?i)\bggplot\s*\("],
    "sql": [r"(?i)\bSELECT\s+", r"(?i)\bFROM\s+", r"(?i)\bWHERE\s+", r"(?i)\bJOIN\s+"],
    "bash": [r"(?i)#!/bin/(?:bash|sh)", r"(?i)\b(?:ls|cd|mkdir|rm|cp|mv|grep|awk|sed)\s+", r"\$\{?\w+\}?"],
    "javascript": [r"(?i)\bfunction\s+\w+\s*\(", r"(?i)\bconst\s+\w+\s*=", r"(?i)\blet\s+\w+\s*=", r"(?i)console\.log\s*\("],
}
HINTS = {"python": "python", "py": "python", "r": "r", "javascript": "javascript", "js": "javascript", "sql": "sql", "bash": "bash", "sh": "bash", "shell": "bash", "yaml": "yaml", "yml": "yaml", "json": "json"}
# Words that indicate a language.
INDICATORS = {
    "python": ["import ", "from ", "def ", "class ", "print(", "__init__", "if __name__", "pandas", "numpy", "matplotlib", "sklearn"],
    "r": ["library(", "require(", "<-", "data.frame", "ggplot", "dplyr", "tibble", "readr", "function("],
    "javascript": ["function", "const ", "let ", "var ", "console.log", "=>", "require(", "import ", "export ", "document."],
    "sql": ["SELECT", "FROM", "WHERE", "JOIN", "INSERT", "UPDATE", "DELETE", "CREATE TABLE", "ALTER TABLE"],
    "bash": ["#!/bin/bash", "#!/bin/sh", "echo ", "grep ", "awk ", "sed ", "$", "export ", "chmod ", "ls "],
    "java": ["public class", "private ", "public ", "static ", "void ", "System.out", "import java", "package "],
    "cpp": ["#include", "std::", "cout", "cin", "namespace", "class ", "private:", "public:", "virtual "],
    "matlab": ["function ", "end", "plot(", "figure", "xlabel", "ylabel", "subplot", "disp(", "clc", "clear"],
}
# Names and endings of files that are read in a repository.
FILE_NAMES = [r"README(?:\.md|\.rst)?", r"requirements\.txt", r"pyproject\.toml", r"setup\.py", r"environment\.yml", "Dockerfile", "Makefile"]
FILE_ENDINGS = [
    "ipynb", "py", "r", "rmd", "rmarkdown", "sas", "sps", "do", "ado", "jl", "m", "sql", "sh", "bash", "c", "cpp", "cc", "h", "hpp", "java", "scala", "f", "f90", "f95", "tex", "md", "yaml", "yml",
]


_PLACES = [("kind", T.StringType()), ("language", T.StringType()), ("content", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType())]
BLOCK_ROW = T.ArrayType(T.StructType([T.StructField(*f) for f in _PLACES]))
SNIPPET_ROW = T.ArrayType(T.StructType([T.StructField(*f) for f in [*_PLACES, ("context", T.StringType())]]))


def best_of(scores: dict[str, Column], none: str) -> Column:
    """SRT11: the name with the greatest score, the first declared of equal ones; ``none`` if all are 0."""
    ranked = F.array_max(F.array(*[F.struct(s.cast("int").alias("score"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores.items())]))
    return F.when(ranked["score"] > 0, ranked["name"]).otherwise(F.lit(none))


def language_by_counts(code: Column, hint: Column | None = None) -> Column:
    """STR16: a known hint, else the language whose patterns match most often; ``unknown`` if none does."""
    scores = {n: sum((F.regexp_count(code, F.lit("(?i)" + p)) for p in ps), F.lit(0)) for n, ps in LANGUAGE_PATTERNS.items()}
    found = best_of(scores, "unknown")
    return found if hint is None else F.when(F.lower(hint).isin(*LANGUAGE_PATTERNS), F.lower(hint)).otherwise(found)


def language_by_patterns(code: Column, hint: Column | None = None) -> Column:
    """STR15: by hint, else the first language of which two patterns occur, else json if it is an object that parses, else other."""
    c = F.when(F.try_parse_json(code).isNotNull() & F.trim(code).rlike(r"(?s)^\{.*\}$"), "json").otherwise(F.lit("other"))
    for name, patterns in reversed(SHORT_PATTERNS.items()):
        hits = sum((F.when(code.rlike(p), 1).otherwise(0) for p in patterns), F.lit(0))
        c = F.when(hits >= 2, name).otherwise(c)
    if hint is not None:
        known = F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv])
        c = F.coalesce(F.try_element_at(known, F.lower(F.coalesce(hint, F.lit("")))), c)
    return c


def language_by_indicators(code: Column) -> Column:
    """STR17: (language, confidence): the one with most indicators; 0.8 from three on, else 0.5, 0 if none."""
    scores = {n: sum((F.when(F.contains(code, F.lit(w)), 1).otherwise(0) for w in ws), F.lit(0)) for n, ws in INDICATORS.items()}
    top = F.greatest(*scores.values())
    return F.struct(best_of(scores, "unknown").alias("language"), F.when(top >= 3, 0.8).when(top > 0, 0.5).otherwise(0.0).alias("confidence"))


def blocks_in(text: str | None) -> list[dict]:
    """UDT02 for one text: kind, language, content, places; math gives none but keeps others out."""
    rows = []
    for kind, m in free_spans(text or "", BLOCK_PATTERNS):
        if kind not in MATH:
            rows.append({"kind": kind, "language": m.group(1).lower() if kind == "fenced_with_lang" else None, "content": m.group(m.re.groups).strip(), "start": m.start(), "end": m.end()})
    return rows


def snippets_in(text: str | None, least: int = 10, most: int = 2000, window: int = 150) -> list[dict]:
    """UDT07 for one text: snippets whose trimmed length lies in the window (FIL11), with what stands round them."""
    rows, t = [], text or ""
    for kind, pattern in SNIPPET_PATTERNS:
        for m in re.finditer(pattern, t):
            body = m.group(m.re.groups).strip()
            if least <= len(body) <= most:
                rows.append({"kind": kind, "language": m.group(1) if kind == "fenced" else None, "content": body, "start": m.start(), "end": m.end(), "context": t[max(0, m.start() - window) : m.end() + window].strip()})
    return rows


@F.pandas_udf(BLOCK_ROW)
def code_blocks(texts: pd.Series) -> pd.Series:
    """UDT02 over a column; an empty array for null."""
    return pd.Series([blocks_in(t) for t in texts], dtype=object)


@F.pandas_udf(SNIPPET_ROW)
def snippets(texts: pd.Series) -> pd.Series:
    """UDT07 over a column; an empty array for null."""
    return pd.Series([snippets_in(t) for t in texts], dtype=object)


def is_read(path: Column) -> Column:
    """FIL24: whether a repository's file is looked at."""
    return path.rlike(rf"(?i)(?:{'|'.join(FILE_NAMES)})$|\.(?:{'|'.join(FILE_ENDINGS)})$")
