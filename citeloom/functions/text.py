"""Text as column functions: names, ids, clean-up and context. All of it runs in the JVM.

Nulls give nulls unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORCID_PATTERN = r"\d{4}-\d{4}-\d{4}-\d{4}"
# How entity ids of one origin begin.
ENTITY_PREFIX = {"publication": "W", "author": "A", "institution": "I", "source": "S"}


def slug(name: Column) -> Column:
    """STR01: lower case, everything else a dash, no dash at either end, 80 characters at most."""
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 80)


def plain_name(name: Column) -> Column:
    """STR02: lower case without what is in parentheses, of letters, figures and single blanks."""
    c = F.regexp_replace(F.trim(F.lower(name)), r"\([^)]*\)", "")
    c = F.regexp_replace(c, "[^a-z0-9 ]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def alias_list(aliases: Column) -> Column:
    """STR03: the trimmed, non-empty parts between semicolons; an empty array for null."""
    parts = F.transform(F.split(F.coalesce(aliases, F.lit("")), ";"), lambda a: F.trim(a))
    return F.filter(parts, lambda a: a != "")


def one_line(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def shorten(text: Column, most: int, room: int = 0) -> Column:
    """``text`` as it is, or its first ``most - room`` characters and three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - room), F.lit("..."))).otherwise(text)


def triage_text(text: Column, most: int = 400_000) -> Column:
    """STR04: one line, dot and dash runs as three, addresses and DOIs as marks, then cut."""
    c = one_line(text)
    for pattern, to in ((r"\.{3,}", "..."), (r"-{3,}", "---"), (r"https?://\S+", "[URL]"), (r"(?i)doi:\s*\S+", "[DOI]")):
        c = F.regexp_replace(c, pattern, to)
    return shorten(c, most)


def join_text(text: Column, most: int = 400_000) -> Column:
    """STR05: one line, cut with the dots inside the bound."""
    return shorten(one_line(text), most, 3)


def discovery_text(text: Column, most: int = 400_000) -> Column:
    """STR06: one line, cut with the dots beyond the bound, trimmed last."""
    return F.trim(shorten(F.regexp_replace(text, r"(?U)\s+", " "), most))


def code_text(text: Column, most: int = 400_000) -> Column:
    """STR07: lines stay; three or more line ends become two, blanks and tabs one blank."""
    c = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), "[ \t]+", " ")
    return shorten(F.trim(c), most)


def around(text: Column, start: Column, end: Column, window: int = 150) -> Column:
    """STR08: what stands within ``window`` characters of [start, end), places from 0, trimmed."""
    first = F.greatest(start - window, F.lit(0))
    last = F.least(end + window, F.length(text))
    return F.trim(F.substring(text, (first + 1).cast("int"), (last - first).cast("int")))


def entity_id(ref: Column, kind: str) -> Column:
    """STR09: the id of ``kind`` inside an address; empty if there is none."""
    return F.regexp_extract(ref, rf"{ENTITY_PREFIX[kind]}\d+", 0)


def orcid_of(ref: Column) -> Column:
    """STR09: the iD inside an address; empty if there is none."""
    return F.regexp_extract(ref, ORCID_PATTERN, 0)


def full_name(first: Column, last: Column) -> Column:
    """STR10: given name and surname, trimmed; empty if both lack."""
    return F.trim(F.concat_ws(" ", first, last))


def quote_place(text: Column, quote: Column) -> Column:
    """STR11: where the quote begins, from 0; 0 if it doesn't occur."""
    return F.greatest(F.coalesce(F.instr(text, quote), F.lit(0)) - 1, F.lit(0))


def clean_doi(doi: Column) -> Column:
    """STR12: trimmed; null for empty and the usual words for none."""
    c = F.trim(doi)
    return F.when(~F.lower(c).isin("", "null", "none", "n/a"), c)


def usage_status(status: Column) -> Column:
    """STR13: one of the three statuses; null for anything else."""
    c = F.lower(F.trim(status))
    return F.when(c.isin("none", "mentioned", "analyzed"), c)


def quoted(name: Column) -> Column:
    """STR30: percent-encoded, blanks as %20 and slashes kept."""
    return F.replace(F.replace(F.url_encode(name), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def edge_ngrams(text: Column, most: int = 20) -> Column:
    """SNK11: all beginnings of up to ``most`` characters; empty for an empty text."""
    t = F.lower(text)
    return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.length(t))), lambda n: F.substring(t, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def render(template: str, **values: Column) -> Column:
    """STR23: a template with ``{name}`` marks filled in; a mark without a value is an error."""
    import re

    parts: list[Column] = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            if piece[1:-1] not in values:
                raise KeyError(f"no value for {piece}")
            parts.append(F.coalesce(values[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def count_present(text: Column, words: list[str]) -> Column:
    """AGG22: how many of ``words`` occur."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(F.contains(text, F.lit(w)), 1).otherwise(0)
    return total


def count_matches(text: Column, patterns: list[str]) -> Column:
    """AGG23: how often the patterns match, all together."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
    return total
