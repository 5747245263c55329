"""Mapping freely entered names to a canonical list.

Token-level repair: every distinct token is joined to the words of the reference
list by edit distance (also as an abbreviation, glued or broken word): tokens and
words meet where they share a form with letters left out, or first letters. The
corrected tokens rank whole entries by soft TF-IDF. An entry is meant if all its
words are found; a name that lacks a word but has no other one may mean it; a name
in which one word is altogether another means none.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.sources.session import materialise

# Words round a name that are no part of it.
FILLERS = frozenset(
    "a an and as at by for from in into of on or our the this to under with"
    " aforementioned authors base data dataset datasets drawn edition extract file files harmonised included licence license main microdata"
    " note notes obtained out own public record records release restricted round sample series source sources tabulations use used using"
    " various version vol volume wave waves weights year years see text table named not unpublished field interviews administrative tbd".split()
)
# Short forms that aren't made by leaving letters out.
SHORT_FORMS = {"vax": "vaccination", "hh": "household", "db": "database", "jrnl": "journal"}
# Figures that scanning puts for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "l", "5": "s", "3": "e", "8": "b", "|": "l", "$": "s"})

NOTHING, OTHER, PARTIAL, FULL = 0, 1, 2, 3
#: Places of parts of glued tokens start here.
_PARTS = 1 << 20
_TOKEN = re.compile(r"[^\W_]+")


def normalise(text: str) -> str:
    """Compatibility form, lower case, no soft hyphens, no possessive s."""
    s = unicodedata.normalize("NFKC", text).replace("\xad", "").replace("​", "").casefold()
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return re.sub(r"['’`]s\b", "", s)


def tokens_of(text: str) -> list[str]:
    """Tokens of a name. Letters standing alone in a row (an acronym with dots) are one token; web addresses have none."""
    if "://" in text:
        return []
    s = normalise(text)
    s = re.sub(r"\b(?:[^\W\d_][.\s]\s?){2,}[^\W\d_]?\b\.?", lambda m: " " + re.sub(r"[.\s]", "", m.group()) + " ", s)
    return _TOKEN.findall(s)


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits with swapped neighbours counted once; ``most`` + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    first, last, n = 0, 0, min(len(a), len(b))
    while first < n and a[first] == b[first]:
        first += 1
    while last < n - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return len(a) + len(b)
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _is_subsequence(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


def neighbourhood(word: str, most: int) -> set[str]:
    """What is left of a word without up to ``most`` of its letters, itself too.

    Two words within ``most`` edits share one at least: a letter put in is left out
    of one word, one replaced or swapped with its neighbour of both.
    """
    out = level = {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out = out | level
    return out


@dataclass
class Vocabulary:
    """The words of the reference names, their entries and weights; as large as the reference list."""

    entries: dict[str, tuple[str, ...]]
    acronyms: dict[str, set[str]]
    fillers: frozenset[str] = FILLERS
    short_forms: dict[str, str] = field(default_factory=lambda: dict(SHORT_FORMS))
    by_word: dict[str, set[str]] = field(default_factory=lambda: defaultdict(set))
    idf: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for e, words in self.entries.items():
            for w in words:
                self.by_word[w].add(e)
        n = max(1, len(self.entries))
        self.idf = {w: math.log(1 + n / len(es)) for w, es in self.by_word.items()}
        # an entry lacks one word at most, so one of its two rarest is found
        self.by_rare: dict[str, list[str]] = defaultdict(list)
        for e, words in self.entries.items():
            for w in sorted(words, key=lambda w: (len(self.by_word[w]), w))[:2]:
                self.by_rare[w].append(e)
        self.words = sorted(self.by_word)
        self.lengths = (min(map(len, self.words), default=0), max(map(len, self.words), default=0))

    @classmethod
    def of(cls, rows: list[tuple[str, str, str | None]], fillers: frozenset[str] = FILLERS, short_forms: dict[str, str] | None = None) -> Vocabulary:
        """From (id, name, '; '-separated aliases)."""
        entries, acronyms = {}, defaultdict(set)
        for e, name, aliases in rows:
            if not e or not name:
                continue
            entries[e] = tuple(dict.fromkeys(t for t in tokens_of(re.sub(r"\([^)]*\)", " ", name)) if t not in fillers))
            for a in [*re.findall(r"\(([^)]*)\)", name), *(aliases or "").split(";")]:
                t = tokens_of(a)
                if len(t) == 1 and t[0] not in entries[e] and len(t[0]) > 2:
                    acronyms[t[0]].add(e)
        return cls(entries, dict(acronyms), fillers, dict(SHORT_FORMS if short_forms is None else short_forms))

    def is_plain(self, token: str) -> bool:
        """Whether a token needs no repair: a reference word, a filler or a number."""
        return token in self.by_word or token in self.fillers or token.isdigit()

    def plain(self, token: str) -> list[tuple[str, float]]:
        """What a token that needs no repair stands for; a filler may still begin a word, or stand for one with its initial."""
        if token in self.by_word:
            return [(token, 1.0)]
        if token.isdigit() or len(token) == 2:
            return []
        first = bisect_left(self.words, token)
        return [(w, 0.5 if len(token) == 1 else 0.6) for w in itertools.takewhile(lambda w: w.startswith(token), itertools.islice(self.words, first, None))]

    def to_repair(self, tokens: list[str]) -> set[str]:
        """The units of a name that have to be joined to the reference words."""
        plain = [self.is_plain(t) for t in tokens]
        return {u for at, u in units(tokens) if not all(plain[i] for i in at)}


# -- the join of units to reference words: what they may share, and what it is worth ------
#
# Keys begin with what they are: E a form with letters left out (edits), S the first
# letters of an abbreviation, W a known short form, P and Q a whole word that begins
# or ends a glued one.


def word_keys(word: str) -> list[str]:
    """The keys by which a unit finds a reference word."""
    starts = {word[0], *(word[0] + a for a in word[1:]), *(word[0] + a + b for i, a in enumerate(word[1:], 1) for b in word[i + 1 :])}
    return ["W" + word, "P" + word, "Q" + word, *("E" + f for f in neighbourhood(word, 2 if len(word) > 4 else 1)), *("S" + x for x in starts)]


def _plain_letters(unit: str) -> str:
    return unit.lstrip("+").translate(LOOKALIKES)


def unit_keys(unit: str, vocab: Vocabulary) -> list[str]:
    """The keys of a unit; only forms are left out that no reference word is long or short enough for."""
    low, high = vocab.lengths
    t = _plain_letters(unit)
    if unit[:1] == "+":  # a word broken in two; anything looser would be chance
        return ["E" + f for f in neighbourhood(t, 1 if len(t) > 2 else 0)] if low - 1 <= len(t) <= high + 1 else []
    if unit in vocab.short_forms and vocab.short_forms[unit] in vocab.by_word:
        return ["W" + vocab.short_forms[unit]]
    keys = _word_like(t, vocab) + (["S" + t[:3]] if t else [])
    if len(t) > 6:
        for n in range(low, min(high, len(t) - 1) + 1):
            keys += ["P" + t[:n], "Q" + t[-n:]]
    return keys


def _word_like(t: str, vocab: Vocabulary) -> list[str]:
    low, high = vocab.lengths
    most = 2 if len(t) > 3 else 1 if len(t) == 3 else 0
    return ["E" + f for f in neighbourhood(t, most)] if low - most <= len(t) <= high + most else []


def rest_keys(rest: str, vocab: Vocabulary) -> list[str]:
    """The keys of what is left of a glued unit."""
    return _word_like(rest, vocab) + (["S" + rest[:3]] if len(rest) > 2 else [])


def _near(t: str, words: Iterable[str], most: int) -> list[tuple[str, float]]:
    """Words within ``most`` edits, fewer for short ones, with similarity."""
    out = []
    for w in words:
        d = min(most, 2 if len(w) > 4 and len(t) > 3 else 1)
        if abs(len(w) - len(t)) <= d and (len(t) > 3 or len(w) == 4):
            n = edit_distance(t, w, d)
            if n <= d:
                out.append((w, 1 - n / (len(w) + 1)))
    return out


def _of_kind(candidates: Iterable[str], kind: str) -> list[str]:
    return [c[1:] for c in candidates if c[0] == kind]


def unit_words(unit: str, candidates: list[str]) -> tuple[list[tuple[str, float]], list[tuple[str, str, bool]]]:
    """Of a unit and the words it shares keys with (each after its kind): what it may stand
    for, with similarity; and (word, what is left, whether the word comes first) if it may be glued."""
    t = _plain_letters(unit)
    near = _of_kind(candidates, "E")
    if unit[:1] == "+":
        return [(t, 1.0)] if t in near else _near(t, near, 1), []
    if known := _of_kind(candidates, "W"):
        return [(w, 0.9) for w in known], []
    short = _of_kind(candidates, "S")
    if len(t) == 1:
        return [(w, 0.5) for w in short if w[0] == t], []
    out = dict(_near(t, near, 2))
    for w in short:
        if t[0] == w[0] and len(t) < len(w):
            if w.startswith(t):
                out[w] = max(out.get(w, 0), 0.72 + 0.2 * len(t) / len(w))
            elif _is_subsequence(t, w) or len(t) > 3 and t[-1] == "s" and _is_subsequence(t[:-1], w):
                out[w] = max(out.get(w, 0), 0.6 + 0.25 * len(t) / len(w))
    glued = []
    if max(out.values(), default=0) < 0.8 and len(t) > 6:
        glued = [(w, t[len(w) :], True) for w in _of_kind(candidates, "P") if t.startswith(w)] + [(w, t[: -len(w)], False) for w in _of_kind(candidates, "Q") if t.endswith(w)]
    return sorted(out.items()), glued


def rest_words(rest: str, candidates: list[str]) -> list[tuple[str, float]]:
    """What the rest of a glued unit stands for, with the similarity of the whole."""
    near = _of_kind(candidates, "E")
    if rest in near:
        return [(rest, 0.98)]
    if got := _near(rest, near, 2):
        return [(v, 0.88) for v, _ in got]
    return [(v, 0.8) for v in _of_kind(candidates, "S") if len(rest) > 2 and v[0] == rest[0] and _is_subsequence(rest, v)]


def repaired_units(wanted: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``unit, words``: what each distinct ``unit`` may stand for, as 'word:similarity' joined by bars; units that stand for nothing don't come out.

    A join in the plan: units meet the reference words they share a key with, and
    only those; what is left of a glued unit is joined once more. No unit is
    compared with all words, so time doesn't grow with the product of both.
    """
    spark = wanted.sparkSession
    held = spark.createDataFrame([(w,) for w in vocab.words], "word string")

    def keyed(df: DataFrame, name: str, keys: Callable[[str], list[str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([keys(x) for x in b.column(0).to_pylist()], pa.list_(pa.string()))], names=[name, "keys"])

        return df.select(name).mapInArrow(run, f"{name} string, keys array<string>").select(name, F.explode("keys").alias("key"))

    index = materialise(keyed(held, "word", word_keys).select("key", "word"), "word-keys")  # so that Spark knows how small it is

    def met(df: DataFrame, name: str, keys: Callable[[str], list[str]]) -> DataFrame:
        found = keyed(df, name, keys).join(index, "key").select(name, F.concat(F.substring("key", 1, 1), "word").alias("c"))
        return found.groupBy(name).agg(F.collect_set("c").alias("candidates"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [unit_words(u, c) for u, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            glued = [[{"word": w, "rest": r, "first": f} for w, r, f in g] for _, g in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_packed(w) for w, _ in got], pa.string()), pa.array(glued, pa.list_(pa.struct([("word", pa.string()), ("rest", pa.string()), ("first", pa.bool_())])))], names=["unit", "words", "glued"])

    one = materialise(met(wanted, "unit", lambda u: unit_keys(u, vocab)).mapInArrow(judged, "unit string, words string, glued array<struct<word:string,rest:string,first:boolean>>"), "units")
    glued = one.select("unit", F.inline("glued"))

    def rests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [rest_words(r, c) for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[{"v": v, "s": s} for v, s in g] for g in got], pa.list_(pa.struct([("v", pa.string()), ("s", pa.float64())])))], names=["rest", "parts"])

    said = met(glued.select("rest").distinct(), "rest", lambda r: rest_keys(r, vocab)).mapInArrow(rests, "rest string, parts array<struct<v:string,s:double>>")
    both = glued.join(said, "rest").select("unit", "word", "first", F.inline("parts"))
    whole = F.when(F.col("first"), F.concat_ws(" ", "word", "v")).otherwise(F.concat_ws(" ", "v", "word"))
    more = both.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_set(F.concat(whole, F.lit(":"), F.col("s").cast("string")))), "|").alias("more"))
    every = one.select("unit", "words").join(more, "unit", "left").select("unit", F.concat_ws("|", F.nullif("words", F.lit("")), "more").alias("words"))
    return every.where("words <> ''")


def _packed(words: list[tuple[str, float]]) -> str:
    return "|".join(f"{w}:{s!r}" for w, s in words)


@dataclass(frozen=True)
class Verdict:
    kind: int
    entries: tuple[str, ...]
    score: float


def _assign(words: tuple[str, ...], found: dict[str, list[tuple[float, frozenset[int]]]]) -> tuple[int, float, frozenset[int], float]:
    """(words found, sum of weights, tokens used, least similarity) of the best use of tokens for an entry."""
    best = (0, 0.0, frozenset(), 0.0)
    # the most that the words from each on can add: what can't be better isn't tried
    most = [(0, 0.0)]
    long = len(words) > 6  # of short entries few uses are left to try, and remembering them costs more
    later: list[frozenset[int]] = [frozenset()]  # tokens that the words from each on can use
    for w in reversed(words):
        sims = [sim for sim, _ in found.get(w, ())]
        most.append((most[-1][0] + bool(sims), most[-1][1] + max(sims, default=0.0)))
        if long:
            later.append(later[-1].union(*(at for _, at in found.get(w, ()))))
    most.reverse()
    later.reverse()
    seen: dict[tuple[int, frozenset[int]], tuple[int, float]] = {}  # the best of the words before that leaves the later ones the same tokens

    def go(k: int, n: int, total: float, used: frozenset[int], least: float) -> None:
        nonlocal best
        if k == len(words):
            if (n, total) > best[:2]:
                best = (n, total, used, least)
            return
        if n + most[k][0] < best[0] or n + most[k][0] == best[0] and total + most[k][1] <= best[1] + 1e-12:
            return
        if long:
            state = (k, used & later[k])
            if state in seen and (n, total) <= seen[state]:
                return
            seen[state] = (n, total)
        for sim, at in found.get(words[k], ()):
            if not at & used:
                go(k + 1, n + 1, total + sim, used | at, min(least, sim))
        go(k + 1, n, total, used, least)

    go(0, 0, 0.0, frozenset(), 1.0)
    return best


def judge(tokens: list[str], repaired: dict[str, list[tuple[str, float]]], vocab: Vocabulary) -> Verdict:
    """What a name means. ``repaired`` has the words of its units, of those at least that need repair."""
    found: dict[str, list[tuple[float, frozenset[int]]]] = defaultdict(list)
    for at, token in units(tokens):
        for word, sim in repaired.get(token) or (vocab.plain(token) if len(at) == 1 and vocab.is_plain(token) else ()):
            parts = word.split(" ")
            for k, w in enumerate(parts):  # each word of a glued token takes a part of it
                found[w].append((sim, at if len(parts) == 1 else frozenset([(min(at) + 1) * _PARTS + k])))
    for w in found:
        found[w] = sorted(found[w], key=lambda x: -x[0])
    content = {i for i, t in enumerate(tokens) if t not in vocab.fillers and not t.isdigit() and not any(c.isdigit() for c in t.translate(LOOKALIKES))}
    acronym: set[str] = set()
    for i, t in enumerate(tokens):
        if t in vocab.acronyms:
            acronym |= vocab.acronyms[t]
            content.discard(i)
    ranked = []
    for e in {e for w in found for e in vocab.by_rare.get(w, ())}:
        words = vocab.entries[e]
        if sum(w in found for w in words) < len(words) - 1:
            continue
        got, _, used, least = _assign(words, found)
        if got < len(words) - 1:
            continue
        flat = {u if u < _PARTS else u // _PARTS - 1 for u in used}
        norm = math.sqrt(sum(vocab.idf[w] ** 2 for w in words))
        sims = {w: max((s for s, at in found[w] if at <= used), default=0.0) for w in words if w in found}
        left = content - flat
        weight = math.sqrt(sum(vocab.idf[w] ** 2 for w in sims) + 4.0 * len(left))
        score = sum(vocab.idf[w] ** 2 * s for w, s in sims.items()) / (norm * weight or 1.0)
        initials = sum(s <= 0.5 for s in sims.values())
        ranked.append((got == len(words) and initials < 2, score, e, left, least, got))
    full = sorted((r for r in ranked if r[0]), key=lambda r: (-r[1], r[2]))
    if full:
        top = [r[2] for r in full if r[1] > full[0][1] - 1e-9]
        agreed = [e for e in top if e in acronym]
        if len(agreed) == 1:
            top = agreed
        if len(top) == 1:
            return Verdict(FULL, tuple(top), full[0][4])
        return Verdict(PARTIAL, tuple(top), full[0][1])
    partial = sorted((r for r in ranked if not r[3] and r[5] == len(vocab.entries[r[2]]) - 1 and r[5] > 2 and r[4] > 0.65), key=lambda r: (-r[1], r[2]))
    if partial:
        return Verdict(PARTIAL, tuple(r[2] for r in partial if r[1] > partial[0][1] - 0.02), partial[0][1])
    known = [max((s for s, at in found[w] if i in at), default=0.0) for w in found for i in content if any(i in at for _, at in found[w])]
    if acronym and len(content) < 3:
        return Verdict(PARTIAL, tuple(sorted(acronym)), 1.0)
    if len(content) > 2:
        exact = sum(1 for i in content if any(s > 0.8 and i in at for w in found for s, at in found[w]))
        return Verdict(OTHER, (), 1.0 if exact > 3 else 0.5) if known else Verdict(NOTHING, (), 0.0)
    return Verdict(NOTHING, (), 0.0)


def units(tokens: list[str]) -> list[tuple[frozenset[int], str]]:
    """Every token and, marked by a plus, every two neighbours joined; with the places they take."""
    return [*((frozenset([i]), t) for i, t in enumerate(tokens)), *((frozenset([i, i + 1]), f"+{a}{b}") for i, (a, b) in enumerate(zip(tokens, tokens[1:])))]


def decide(verdicts: list[Verdict]) -> str | None:
    """The entry that all fields of a row mean; None if none is sure."""
    full = [v for v in verdicts if v.kind == FULL]
    other = max((v.score for v in verdicts if v.kind == OTHER), default=0.0)
    if full and not (other == 1.0 and max(v.score for v in full) < 0.85):
        votes = Counter(v.entries[0] for v in full)
        best = max(votes.items(), key=lambda x: (x[1], max(v.score for v in full if v.entries[0] == x[0]), x[0]))
        return best[0]
    if other:
        return None
    sets = [set(v.entries) for v in verdicts if v.kind == PARTIAL]
    both = set.intersection(*sets) if sets else set()
    return both.pop() if len(both) == 1 else None


def _words(text: str) -> list[tuple[str, float]]:
    """Repaired words from 'word:similarity' joined by bars, each with its greatest similarity."""
    best: dict[str, float] = {}
    for w, _, s in (x.rpartition(":") for x in text.split("|")):
        best[w] = max(best.get(w, 0.0), float(s))
    return list(best.items())


def resolve_names(fields: DataFrame, reference: DataFrame, fillers: frozenset[str] = FILLERS, short_forms: dict[str, str] | None = None) -> DataFrame:
    """``source_table, row_key, dataset_id`` of every row of ``fields``; ``unmatched`` where no entry is meant.

    ``fields`` has ``source_table, row_key, text``, a row per field; null and blank
    texts say nothing, but their rows come out. ``reference`` has ``dataset_id,
    dataset_name, aliases``; it is a registry of fixed size, checked to be under
    100,000 entries, which every task holds for ranking. ``fillers`` are words round
    a name that are no part of it, ``short_forms`` such that aren't made by leaving
    letters out. Equal texts are judged once. Empty tables give no rows.
    """
    rows = reference.select("dataset_id", "dataset_name", "aliases").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("the reference list is too large to be held by every task")
    vocab = Vocabulary.of([tuple(r) for r in rows], fillers, short_forms)

    texts = fields.where("text is not null").select("text").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toks = [tokens_of(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(toks, pa.list_(pa.string())), pa.array([list(vocab.to_repair(t)) for t in toks], pa.list_(pa.string()))], names=["text", "tokens", "units"])

    cut_up = materialise(texts.mapInArrow(cut, "text string, tokens array<string>, units array<string>").withColumn("text_id", F.md5(F.encode("text", "utf-8"))), "names")

    repaired = repaired_units(cut_up.select(F.explode("units").alias("unit")).distinct(), vocab)
    used = cut_up.select("text_id", F.explode("units").alias("unit")).join(repaired, "unit").groupBy("text_id").agg(F.collect_list(F.struct("unit", "words")).alias("repaired"))
    judged_in = cut_up.select("text_id", "tokens").join(used, "text_id", "left")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = functools.lru_cache(maxsize=100_000)(_words)
        for b in batches:
            got = [judge(t, {x["unit"]: read(x["words"]) for x in r or ()}, vocab) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.kind for v in got], pa.int32()), pa.array([list(v.entries) for v in got], pa.list_(pa.string())), pa.array([v.score for v in got], pa.float64())], names=["text_id", "kind", "entries", "score"])

    verdicts = judged_in.mapInArrow(rank, "text_id string, kind int, entries array<string>, score double")
    keyed = fields.select("source_table", "row_key", F.md5(F.encode("text", "utf-8")).alias("text_id"))
    said = keyed.where("text_id is not null").distinct().join(verdicts.where(F.col("kind") > NOTHING), "text_id")
    per_row = said.groupBy("source_table", "row_key").agg(F.array_sort(F.collect_list(F.struct("kind", "entries", "score"))).alias("v"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decide([Verdict(x["kind"], tuple(x["entries"]), x["score"]) for x in v]) for v in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], names=["source_table", "row_key", "dataset_id"])

    settled = per_row.mapInArrow(settle, "source_table string, row_key string, dataset_id string").where("dataset_id is not null")
    every = fields.select("source_table", "row_key").where("row_key is not null").distinct()
    return every.join(settled, ["source_table", "row_key"], "left").select("source_table", "row_key", F.coalesce("dataset_id", F.lit("unmatched")).alias("dataset_id"))
