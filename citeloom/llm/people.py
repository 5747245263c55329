"""Names of people and of their institutions in a form that can be compared."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

# Titles and suffixes that are no part of a name.
TITLES = frozenset("dr prof professor mr mrs ms miss sir phd md msc bsc mba jr sr ii iii iv".split())
# Given names in short, by their full form.
NICKNAMES = {
    "alexander": "alex alec sasha", "alexandra": "alex sandra sasha", "andrew": "andy drew", "anthony": "tony", "antonia": "toni tonia", "benjamin": "ben benny benji",
    "catherine": "cathy kate katie", "charles": "charlie chuck", "christopher": "chris kit topher", "christina": "chris tina", "daniel": "dan danny", "daniela": "dani danny ella",
    "david": "dave", "deborah": "deb debbie", "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lisa lizzie bess", "frederick": "fred freddie rick", "gabriela": "gabi gaby gabby",
    "gabriel": "gabe", "gregory": "greg", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn", "john": "jack johnny", "jose": "pepe chepe", "francisco": "paco pancho", "francois": "fran", "ignacio": "nacho", "guillermo": "memo", "enrique": "quique", "jesus": "chuy", "manuel": "manolo manu", "maria": "mari", "ines": "nines", "andres": "andi", "jurgen": "jurg", "ingrid": "inga", "beatriz": "bea", "luis": "lucho", "jonathan": "jon", "joseph": "joe joey", "joshua": "josh",
    "katherine": "kate kathy katie kat kit kay", "katarina": "kat kata kati katja", "kenneth": "ken kenny", "lawrence": "larry", "leopold": "leo", "leonard": "leo len lenny", "margaret": "maggie meg peg peggy greta marge",
    "matthew": "matt", "michael": "mike mick mickey", "miriam": "mimi miri mim", "nathaniel": "nate nat", "nicholas": "nick nicky", "oliver": "ollie", "patricia": "pat patty trish tricia", "patrick": "pat paddy",
    "peter": "pete", "philip": "phil", "rebecca": "becky becca", "richard": "rich rick dick ricky", "robert": "bob rob bobby robbie bert", "ronald": "ron", "rosalind": "ros roz rosa", "samantha": "sam", "samuel": "sam sammy",
    "stephen": "steve", "steven": "steve", "susan": "sue susie", "susanna": "sue susie susan anna", "tamara": "tammy tam", "theodora": "thea dora theo", "theodore": "ted theo", "thomas": "tom tommy", "timothy": "tim", "ulrich": "uli",
    "valeria": "val", "victoria": "vicky vic tori", "vincent": "vince", "wilhelm": "will willi", "william": "bill will billy liam willy", "zachary": "zach",
}
_FULL: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL.setdefault(_s, set()).add(_full)
# Letters that don't come apart into a plain one and a mark.
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "ħ": "h"})
# Short forms in names of institutions.
WORDS = {"univ": "university", "inst": "institute", "tech": "technology", "dept": "department", "center": "centre", "ctr": "centre", "coll": "college", "sch": "school", "agric": "agricultural", "agr": "agricultural", "res": "research", "hosp": "hospital", "natl": "national", "st": "state"}


def fold(text: str) -> str:
    """Lower case without marks."""
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold().replace("\xad", ""))
    return "".join(c for c in s if not unicodedata.combining(c)).translate(_LETTERS)


@dataclass(frozen=True)
class Name:
    """``surname`` parts, ``given`` (a full name, an initial or empty) and middle initials."""

    surname: tuple[str, ...]
    given: str
    middle: str

    @property
    def text(self) -> str:
        return f"{'-'.join(self.surname)}|{self.given}|{self.middle}"

    @classmethod
    def of_text(cls, text: str) -> Name:
        s, g, m = text.split("|")
        return cls(tuple(s.split("-")), g, m)


def _split(part: str) -> list[str]:
    return [t for t in re.findall(r"[^\W\d_]+", fold(part))]


def _given(tokens: list[str], raw: list[str]) -> tuple[str, str]:
    """Given name and middle initials; a short upper-case block is initials."""
    out: list[str] = []
    for t, r in zip(tokens, raw):
        if len(t) <= 3 and len(t) > 1 and r.isupper() and not re.search(r"[aeiouy]", t) or len(t) == 2 and r.isupper():
            out += list(t)
        else:
            out.append(t)
    return (out[0], "".join(t[0] for t in out[1:])) if out else ("", "")


def _without_titles(words: list[str]) -> list[str]:
    """Words that are no titles; two capitals that stand alone are initials, whatever they spell."""
    rest = [w for w in words if fold(re.sub(r"\W", "", w)) not in TITLES]
    return rest if rest or not (len(words) == 1 and len(words[0]) == 2 and words[0].isupper()) else words


def parse_name(name: str | None, first: str | None = None, last: str | None = None) -> Name | None:
    """A typed name, whatever its order; None if it has no letters.

    A comma puts the surname first; so does a surname in capitals or initials at
    the end. ``first`` and ``last``, which are often swapped, only stand in for a missing name.
    """
    if not name or not name.strip():
        name = " ".join(x for x in (first, last) if x and x.strip())
    raw_text = unicodedata.normalize("NFKC", name).strip()
    if "," in raw_text:
        a, _, b = raw_text.partition(",")
        raw = _without_titles(re.findall(r"[^\W\d_]+", b))
        if not raw:
            raw_text = a
        else:
            sur = [t for t in _split(a) if t not in TITLES]
            if sur:
                return Name(tuple(sur), *_given([fold(r) for r in raw], raw))
    words = [w for w in re.split(r"\s+", raw_text) if re.search(r"[^\W\d_]", w)]
    words = words[:1] + _without_titles(words[1:]) if len(words) > 1 and fold(re.sub(r"\W", "", words[0])) not in TITLES else _without_titles(words)
    if not words:
        return None

    def initials(w: str) -> bool:
        plain = re.sub(r"[^\w]", "", w)
        return len(plain) == 1 or "." in w and len(plain) <= 3 or len(plain) <= 2 and plain.isupper() or len(plain) == 3 and plain.isupper() and not re.search(r"[AEIOUY]", plain)

    big = [not initials(w) and w == w.upper() and len(w) > 2 and w != w.lower() for w in words]
    if len(words) == 1:
        return Name(tuple(_split(words[0])), "", "")
    if initials(words[-1]) and not initials(words[0]):
        k = next(i for i, w in enumerate(words) if initials(w))
        sur, rest = words[:k], words[k:]
    elif big[0] and not all(b or initials(w) for b, w in zip(big, words)):
        k = next(i for i, b in enumerate(big) if not b)
        sur, rest = words[:k], words[k:]
    else:
        sur, rest = words[-1:], words[:-1]
    raw = [r for w in rest for r in re.findall(r"[^\W\d_]+", w)]
    surname = tuple(t for w in sur for t in _split(w))
    return Name(surname, *_given([fold(r) for r in raw], raw)) if surname else None


def institution_words(text: str | None) -> tuple[str, ...]:
    """The words of an institution: without department, country and repeats, sorted."""
    if not text:
        return ()
    parts = [p.strip() for p in fold(text).split(",")]
    if len(parts) > 1 and re.match(r"dep(?:artmen)?t\b", parts[0]):
        parts = parts[1:]
    if len(parts) > 1 and re.fullmatch(r"[a-z]{2}", parts[-1]):
        parts = parts[:-1]
    words = [WORDS.get(w, w) for p in parts for w in re.findall(r"\w+", p)]
    return tuple(sorted({w for w in words if w not in ("of", "for", "and", "the")}))


def given_forms(given: str) -> frozenset[str]:
    """A given name with the full forms it may stand for."""
    return frozenset({given, *_FULL.get(given, ())})
