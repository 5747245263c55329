"""Variant spellings of names typed by people.

A trie join. Names are sharded by what else their records share (an institution,
an iD). At a large place, each surname part is first joined to all parts within
its bound: words so near share a form with letters left out, which names the shard
where they meet; in it the words form a trie that a Levenshtein automaton walks. A
part and its neighbours are then a shard, as is a small place as a whole; order,
initials, short names and middle names are checked in it. Links are closed over
with connected components.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.people import Name, given_forms, institution_words, parse_name
from citeloom.llm.resolve import edit_distance, neighbourhood
from citeloom.operators.packed import ID_DELIMITER, PackedGrammar, orcid_value
from citeloom.operators.versions import latest_version
from citeloom.sources.session import materialise

WHOLE = 64  # names up to which a place is one shard


@dataclass
class Trie:
    """Words with what belongs to them."""

    root: dict = field(default_factory=dict)

    def add(self, word: str, value: object) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(value)

    def near(self, word: str, most: int) -> Iterator[tuple[int, list]]:
        """(edits, values) of all words within ``most`` edits. The automaton's state
        is the band of edits round the letters read so far, none beyond ``most`` + 1;
        a swap of neighbours needs the band before it."""
        n, over = len(word), most + 1
        width = range(2 * most + 1)
        # place k of a band at depth i stands for the first i - most + k letters of the word
        stack: list[tuple[dict, int, list[int], list[int] | None, str]] = [(self.root, 0, [k - most if k >= most and k - most <= n else over for k in width], None, "")]
        while stack:
            node, i, band, before, last = stack.pop()
            at = n - i + most
            if 0 <= at <= 2 * most and band[at] <= most and "" in node:
                yield band[at], node[""]
            base = i - most  # of the next band, the letter that place k ends with
            for c, child in node.items():
                if not c:
                    continue
                new, left, best = [], over, over
                for k in width:
                    j = base + k
                    if j < -1 or j >= n:
                        left = over
                    elif j == -1:
                        left = i + 1
                    else:
                        x = word[j]
                        d = band[k] if x == c else band[k] + 1
                        if left < d - 1:
                            d = left + 1
                        if k < 2 * most and band[k + 1] < d - 1:
                            d = band[k + 1] + 1
                        if before is not None and j and x == last and word[j - 1] == c and before[k] < d - 1:
                            d = before[k] + 1
                        left = d if d < over else over
                    new.append(left)
                    if left < best:
                        best = left
                if best <= most:
                    stack.append((child, i + 1, new, band, c))


def bound(word: str, strong: bool) -> int:
    """Edits that a word may differ by: none in short ones, one, or two where the iD says the same."""
    return 0 if len(word) < 4 else 2 if strong and len(word) > 5 else 1


def near_words(words: DataFrame) -> DataFrame:
    """(place, word, near): all pairs of words of a place within the bound of ``word``, each with itself.

    ``words`` has distinct ``place, word, strong``. A shard has the words that share
    a form of their neighbourhoods: few, however large the place.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [list(neighbourhood(w, bound(w, strong))) for w, strong in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.list_(pa.string())), *b.columns], names=["forms", "place", "word", "strong"])

    formed = words.select("place", "word", "strong").mapInArrow(spread, "forms array<string>, place string, word string, strong boolean")
    shards = formed.withColumn("form", F.explode("forms")).select(F.xxhash64("place", "form").alias("shard"), "place", "word", "strong")
    shards = shards.repartition("shard").sortWithinPartitions("shard")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, str]] = []
        for _, rows in _by_shard(batches):
            if len(rows) < 2:
                continue
            trie = Trie()
            for place, w, _ in rows:
                trie.add(w, (place, w))
            for place, w, strong in rows:  # shards are named by hashes, so places may meet
                out += {(place, w, v) for _, vs in trie.near(w, bound(w, strong)) for at, v in vs if at == place and v != w}
            if len(out) > 10_000:
                yield _columns(out, ["place", "word", "near"])
                out = []
        yield _columns(out, ["place", "word", "near"])

    near = shards.mapInArrow(join, "place string, word string, near string").distinct()
    return near.unionByName(words.select("place", "word", F.col("word").alias("near")))


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """A batch of texts."""
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*rows)) or [()] * len(names)], names=names)


# -- institutions ------------------------------------------------------------------


def near_tokens(tokens: DataFrame) -> DataFrame:
    """(token, near): all pairs of distinct words within their bound, each with itself.

    ``tokens`` has distinct ``token``. The same trie join, of one place.
    """
    words = tokens.select(F.lit("").alias("place"), F.col("token").alias("word"), F.lit(True).alias("strong"))
    return near_words(words).select(F.col("word").alias("token"), "near")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """Rows of each shard, from batches sorted by it (its column is the first)."""
    key, held = None, []
    for b in batches:
        for k, *row in zip(*[c.to_pylist() for c in b.columns]):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(tuple(row))
    if held:
        yield key, held


def canonical_institutions(forms: DataFrame, ratio: int = 4) -> DataFrame:
    """(form, canon) for forms that are misspelt: the nearest form at least ``ratio`` times as common.

    ``forms`` has ``form`` (words joined by blanks) and its count ``n``. Forms agree
    if their words pair off within their bounds.
    """
    words = forms.select("form", "n", F.explode(F.split("form", " ")).alias("token"))
    df = words.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    near = near_tokens(df.select("token"))
    # the place in a form with the fewest forms behind its near words is the one to look up
    weight = near.join(df.withColumnRenamed("token", "near"), "near").groupBy("token").agg(F.sum("df").alias("load"))
    rarest = words.join(weight, "token").groupBy("form", "n").agg(F.min_by("token", F.struct("load", "token")).alias("token"))
    looked = rarest.join(near, "token").select(F.col("form"), F.col("n"), F.col("near").alias("token"))
    common = words.select(F.col("form").alias("canon"), F.col("n").alias("m"), "token")
    pairs = looked.join(common, "token").where((F.col("m") >= ratio * F.col("n")) & (F.col("form") != F.col("canon"))).select("form", "canon", "m").distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = [_form_distance(x.split(" "), y.split(" ")) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d, pa.int32())], names=["form", "canon", "m", "d"])

    scored = pairs.mapInArrow(check, "form string, canon string, m long, d int").where("d >= 0")
    return scored.groupBy("form").agg(F.min_by("canon", F.struct("d", -F.col("m"), "canon")).alias("canon"))


def _form_distance(a: list[str], b: list[str]) -> int:
    """Edits between two forms word by word; -1 if their words don't pair off."""
    if abs(len(a) - len(b)) > 0:
        x, y = "".join(sorted("".join(a))), "".join(sorted("".join(b)))
        return 9 if abs(len(x) - len(y)) < 2 and len(set(a) & set(b)) >= max(len(a), len(b)) - 2 and edit_distance(x, y, 2) < 3 else -1
    total, rest = 0, list(b)
    for w in sorted(a, key=lambda w: w not in b):
        best = min(((edit_distance(w, v, 2), v) for v in rest), default=(9, ""))
        if best[0] > bound(w, True):
            return -1
        total += best[0]
        rest.remove(best[1])
    return total


# -- names ---------------------------------------------------------------------------


def surnames_agree(a: tuple[str, ...], b: tuple[str, ...], strong: bool) -> int:
    """Edits between surnames, -1 if they differ; of a double one a part may be left out."""
    if len(a) > len(b):
        a, b = b, a
    total = 0
    for x, y in zip(a, b):
        d = edit_distance(x, y, 2)
        if d > bound(min(x, y, key=len), strong):
            if len(a) == 1 and len(b) > 1 and edit_distance(x, b[-1], 2) <= bound(x, strong):
                return 1
            return -1
        total += d
    return total + (len(a) != len(b))


def given_agree(a: Name, b: Name, known: frozenset[str], strong: bool) -> bool:
    """Whether given and middle names can be one person's. ``known`` are established given names, which are no misspellings of each other."""
    x, y = a.given, b.given
    if not x or not y:
        return strong
    if min(len(x), len(y)) == 1:
        ok = any(f[0] == (y if len(y) == 1 else x)[0] for f in given_forms(x if len(y) == 1 else y)) if max(len(x), len(y)) > 1 else x == y
    elif given_forms(x) & given_forms(y):
        ok = True
    elif x in known and y in known:
        ok = False
    else:
        ok = any(edit_distance(f, g, 2) <= (2 if strong and min(len(f), len(g)) > 4 else 1) and min(len(f), len(g)) > 2 for f in given_forms(x) for g in given_forms(y))
    return ok and (not a.middle or not b.middle or a.middle[0] == b.middle[0])


def same_name(a: Name, b: Name, known: frozenset[str], strong: bool) -> bool:
    """Either order of surname and given name."""
    if surnames_agree(a.surname, b.surname, strong) >= 0 and given_agree(a, b, known, strong):
        return True
    if len(a.surname) == 1 and len(b.given) > 1:
        turned = Name((b.given,), "-".join(b.surname), b.middle)
        return surnames_agree(a.surname, turned.surname, strong) >= 0 and given_agree(a, turned, known, strong)
    return False


class _Shard:
    """People of one shard by surname and given name, so that only those are compared who may agree."""

    def __init__(self, names: list[Name], strong: bool, known: frozenset[str]):
        self.names, self.strong, self.established = names, strong, known
        self.surnames = Trie()
        for i, n in enumerate(names):
            for part in n.surname:
                self.surnames.add(part, (i, True))
            if len(n.given) > 1:  # in the other order
                self.surnames.add(n.given, (i, False))
        self.known: dict[tuple[str, ...], tuple[Trie, dict[str, list[int]], dict[str, list[int]]]] = {}

    def _near_surname(self, surname: tuple[str, ...]) -> tuple[Trie, dict[str, list[int]], dict[str, list[int]]]:
        """Of the people whose surname is near: their given names as a trie, the full ones and the bare initials by first letter. Made once for a surname."""
        got = self.known.get(surname)
        if got is None:
            given, full, bare = Trie(), defaultdict(list), defaultdict(list)
            met = {v for part in surname for _, vs in self.surnames.near(part, bound(part, self.strong)) for v in vs}
            for j in sorted({j for j, _ in met}):
                n = self.names[j]
                if len(n.given) < 2:
                    bare[n.given[:1]].append(j)
                    continue
                for form in {*(given_forms(n.given) if (j, True) in met else ()), *(given_forms("-".join(n.surname)) if (j, False) in met else ())}:  # in either order
                    given.add(form, j)
                # an initial is too little to turn an established given name, or a short one, into a surname
                if (j, True) in met or len(n.given) > 3 and n.given not in self.established:
                    for letter in {f[0] for f in given_forms(n.given)}:
                        full[letter].append(j)
            got = self.known[surname] = (given, full, bare)
        return got

    def like(self, i: int) -> list[int]:
        """People with a full given name near that of ``i``."""
        given = self._near_surname(self.names[i].surname)[0]
        most = 2 if self.strong else 1
        return sorted({j for form in given_forms(self.names[i].given) for _, vs in given.near(form, most) for j in vs} - {i})

    def full_with_initial(self, i: int) -> list[int]:
        _, full, _ = self._near_surname(self.names[i].surname)
        letter = self.names[i].given[:1]
        return full.get(letter, []) if letter else [j for js in full.values() for j in js]

    def bare_with_initial(self, i: int) -> list[int]:
        return self._near_surname(self.names[i].surname)[2].get(self.names[i].given[:1], [])


def shard_links(people: list[tuple[str, str, str, bool, bool]], strong: bool, home: str = "") -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Links between the people of a shard: (name, iDs, author, given name
    is established, whether it's by a surname part that the shard has them, or else by the given name).

    An initial stands for a full name only if one person's alone fits; people with
    different iDs aren't linked. The search for a second fitting person ends with
    it, and people already linked aren't compared again.

    ``home`` is the surname part whose neighbours the shard has, so what initials
    stand for is known of people with that part only; empty if the shard has all. The
    second list has links of theirs to initials of other parts, which hold if they
    are found from there too.
    """
    names = [Name.of_text(p[0]) for p in people]
    ids = [set(p[1].split()) for p in people]
    known = frozenset(n.given for n, p in zip(names, people) if p[3])
    shard = _Shard(names, strong, known)
    group = list(range(len(people)))
    links: list[tuple[int, int]] = []
    halves: list[tuple[int, int]] = []
    here = [not home or home in n.surname for n in names]
    bare = [i for i, n in enumerate(names) if len(n.given) < 2 and here[i]]
    # people of other parts are compared with each other only where an initial may stand for them
    asks = [len(n.given) > 1 and (bool(bare) and by_surname or at) for n, at, (*_, by_surname) in zip(names, here, people)]

    def fit(i: int, j: int, near: bool = strong) -> bool:
        if not strong and ids[i] and ids[j] and not ids[i] & ids[j]:
            return False
        return same_name(names[i], names[j], known, near)

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    def link(i: int, j: int) -> None:
        if find(i) != find(j):
            group[find(i)] = find(j)
            links.append((i, j))

    for i in range(len(names)):
        if asks[i]:
            for j in shard.like(i):
                if find(i) != find(j) and fit(i, j):  # of turned names one side may find the other only
                    link(i, j)
    ambiguous: set[int] = set()
    for i in bare:
        fits: dict[int, int] = {}
        alike: list[int] = []
        # people of just this surname come first; misspelt ones count only where there is none,
        # and are one if the spelling between them is what sets them apart
        for exact in (True, False):
            for j in shard.full_with_initial(i):
                if (names[j].surname == names[i].surname) == exact and find(j) not in fits and fit(i, j):
                    if any(fit(j, k, True) for k in fits.values()):
                        alike.append(j)
                        continue
                    fits[find(j)] = j
                    if len(fits) > 1 or strong:
                        break
            if fits:
                break
        if len(fits) == 1:
            for j in [*fits.values(), *alike]:
                link(i, j)
        elif fits:
            ambiguous.add(i)
    # initials without a full name are one person's if their middle initials, and those of whom
    # they were found to be, agree; one without a middle initial that fits several is none of theirs
    middles: dict[int, set[str]] = defaultdict(set)
    for i, n in enumerate(names):
        middles[find(i)] |= set(n.middle[:1])

    def apart(i: int, j: int) -> bool:
        return not strong and bool(middles[find(i)] and middles[find(j)] and not middles[find(i)] & middles[find(j)])

    for i in bare:
        if i in ambiguous:
            continue
        near = [j for j in shard.bare_with_initial(i) if j not in ambiguous and j != i and find(i) != find(j) and fit(i, j)]
        if not strong and not middles[find(i)] and len(set().union(*(middles[find(j)] for j in near))) > 1:
            near = [j for j in near if not middles[find(j)]]
        for j in near:
            if here[j] and i >= j or find(i) == find(j) or apart(i, j):
                continue
            if here[j]:
                both = middles[find(i)] | middles[find(j)]
                link(i, j)
                middles[find(i)] = both
            else:
                halves.append((i, j))
    return [(people[i][2], people[j][2]) for i, j in links], [(people[i][2], people[j][2]) for i, j in halves]


# -- records -------------------------------------------------------------------------


def profiles(authors: DataFrame) -> DataFrame:
    """``author_id, name, ids, forms``: parsed name, iDs joined by blanks, institutions' words joined by blanks."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = PackedGrammar(ID_DELIMITER, opens_list=True)
        for b in batches:
            out = []
            for a, n, f, l, o, affs in zip(*[c.to_pylist() for c in b.columns]):
                name = parse_name(n, f, l)
                ids = sorted({v for x in grammar.parse(o) if (v := orcid_value(x.value))}) if o else []
                forms = sorted({" ".join(w) for x in affs or () if (w := institution_words(x))})
                out.append((a, name.text if name else None, " ".join(ids), forms))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.string()))], names=["author_id", "name", "ids", "forms"])

    cols = ["author_id", "name", "first_name", "last_name", "orcid", "affiliations"]
    latest = latest_version(authors, F.col("author_id"), F.col("updated_at"), cols).select(*cols)
    return latest.mapInArrow(parse, "author_id string, name string, ids string, forms array<string>")


def components(links: DataFrame) -> DataFrame:
    """``id, root`` of every id in ``links`` (``a, b``): its component's least id.

    Large-star and small-star rounds until nothing changes; each round is written
    to the shared folder, so the plan stays short and a lost executor costs one.
    """
    def state(table: DataFrame) -> tuple:
        """What tells one round's edges from another's; read from the table that was just written."""
        return tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())

    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    now, before = state(edges), None
    while now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialise(small, "small")
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def linked_authors(authors: DataFrame, known_share: float = 0.0005, known_least: int = 4) -> DataFrame:
    """``author_id, person``: every record that is linked to another one, with the least author_id of its person.

    Records are one person if their names can be one name and they share an iD or
    an institution; different iDs at one institution keep them apart. A given name
    is established if ``known_share`` of all records and ``known_least`` have it.
    Records without a name or an id come out unlinked, i.e. not at all.
    """
    records = materialise(profiles(authors).where("author_id is not null and name is not null"), "people")
    total = records.count()
    given = F.split("name", r"\|")[1]
    known = records.groupBy(given.alias("given")).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= max(known_least, known_share * total)) & (F.length("given") > 1)).select("given")
    flagged = records.withColumn("given", given).join(known.withColumn("known", F.lit(True)), "given", "left").select("author_id", "name", "ids", "forms", F.coalesce("known", F.lit(False)).alias("known"))
    flagged = materialise(flagged, "people")
    forms = flagged.select(F.explode("forms").alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    canon = canonical_institutions(materialise(forms, "forms"))
    placed = flagged.select("author_id", "name", "ids", "known", F.explode("forms").alias("form")).join(canon, "form", "left")
    at = placed.select("author_id", "name", "ids", "known", F.concat(F.lit("A "), F.coalesce("canon", "form")).alias("place"))
    by_id = flagged.where("ids <> ''").select("author_id", "name", "ids", "known", F.explode(F.transform(F.split("ids", " "), lambda x: F.concat(F.lit("O "), x))).alias("place"))
    # equal people at one place become one before anything is compared
    nodes = materialise(at.unionByName(by_id), "places")
    reps = materialise(nodes.groupBy("place", "name", "ids", "known").agg(F.min("author_id").alias("rep")), "reps")
    stars = nodes.join(reps, ["place", "name", "ids", "known"]).where("author_id <> rep").select(F.col("author_id").alias("a"), F.col("rep").alias("b"))

    # names may stand in the other order: a given name meets surnames, but no given names
    name = F.split("name", r"\|")
    marked = F.transform(F.split(name[0], "-"), lambda x: F.struct(x.alias("part"), F.lit(True).alias("surname")))
    turned = F.when(F.length(name[1]) > 1, F.array(F.struct(name[1].alias("part"), F.lit(False).alias("surname"))))
    tokens = F.concat(marked, F.coalesce(turned, F.array().cast("array<struct<part:string,surname:boolean>>")))
    sized = reps.join(reps.groupBy("place").agg(F.count(F.lit(1)).alias("n")), "place")
    columns = ["name", "ids", "rep", "known"]
    small = sized.where(f"n > 1 and n <= {WHOLE}").select("place", F.lit("").alias("home"), *columns, F.lit(True).alias("surname"))
    every = materialise(sized.where(f"n > {WHOLE}").select("place", *columns, F.inline(tokens)), "parts")
    parts = every.select("place", F.col("part").alias("word"), F.col("place").startswith("O").alias("strong")).distinct()
    near = near_words(parts).select("place", F.col("word").alias("home"), F.col("near").alias("part"))
    near = near.join(every.where("surname").select("place", F.col("part").alias("home")).distinct(), ["place", "home"], "left_semi")
    large = near.join(every, ["place", "part"]).groupBy("place", "home", *columns).agg(F.max("surname").alias("surname"))
    sharded = small.unionByName(large).select(F.struct("place", "home").alias("shard"), *columns, "surname")
    sharded = sharded.repartition("shard").sortWithinPartitions("shard")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, str]] = []
        for shard, rows in _by_shard(batches):
            if len(rows) < 2:
                continue
            sure, halves = shard_links(rows, shard["place"].startswith("O"), shard["home"])
            out += [(a, b, "") for a, b in sure]
            out += [(a, b, shard["place"]) for a, b in halves]
            if len(out) > 10_000:
                yield _columns(out, ["a", "b", "half"])
                out = []
        yield _columns(out, ["a", "b", "half"])

    found = materialise(sharded.mapInArrow(join, "a string, b string, half string"), "links")
    halves = found.where("half <> ''")
    both = halves.join(halves.select(F.col("b").alias("a"), F.col("a").alias("b"), "half"), ["a", "b", "half"], "left_semi")
    links = found.where("half = ''").unionByName(both).select("a", "b").unionByName(stars)
    return components(links).select(F.col("id").alias("author_id"), F.col("root").alias("person"))


def same_person_pairs(linked: DataFrame, part_size: int = 1000) -> DataFrame:
    """Every pair of records of one person, smaller id first. A person of more than ``part_size``
    records is cut into parts, each of which meets all records, so that none is one task."""
    linked = materialise(linked, "linked")
    parts = F.greatest(F.ceil(F.col("n") / part_size), F.lit(1))
    sized = linked.join(linked.groupBy("person").agg(F.count(F.lit(1)).alias("n")), "person").withColumn("parts", parts)
    one = sized.select("person", F.pmod(F.xxhash64("author_id"), "parts").alias("part"), F.col("author_id").alias("x"))
    all_ = sized.select("person", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.col("author_id").alias("y"))
    return one.join(all_, ["person", "part"]).where("x < y").select(F.col("x").alias("author_id_1"), F.col("y").alias("author_id_2"))


def unplaced(authors: DataFrame) -> DataFrame:
    """``author_id`` of records that nothing can link: without a name, or with neither an iD nor an institution."""
    return profiles(authors).where("author_id is not null and (name is null or (ids = '' and size(forms) = 0))").select("author_id")
