import random

import pytest

from citeloom.llm import authors
from citeloom.llm.authors import Trie, bound, components, linked_authors, near_words, same_person_pairs, unplaced
from citeloom.llm.people import Name, institution_words, parse_name
from citeloom.llm.resolve import edit_distance


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("José Ñandolez", "nandolez|jose|"), ("Ñandolez, José", "nandolez|jose|"), ("NANDOLEZ Jose", "nandolez|jose|"), ("Nandolez J", "nandolez|j|"), ("J. R. Nandolez", "nandolez|j|r"), ("Nandolez, J.R.", "nandolez|j|r"), ("Nandolez JR", "nandolez|j|r"),
        ("jose nandolez", "nandolez|jose|"), ("Dr. José  Nandolez Jr.", "nandolez|jose|"), ("Ana Lopez-Maria", "lopez-maria|ana|"), ("Cher", "cher||"), ("Søren Łuk", "luk|soren|"),
    ],
)
def test_names(text, name):
    assert parse_name(text).text == name
    assert Name.of_text(name).text == name


def test_no_names():
    assert parse_name(None) is None and parse_name("  ") is None and parse_name("123 -") is None
    assert parse_name(None, "Ana", "Lopez").text == "lopez|ana|"


def test_institutions():
    a = institution_words("Dept. of Soil Science, Univ. of Halemoor, Halemoor, US")
    assert a == institution_words("UNIVERSITY OF HALEMOOR") == ("halemoor", "university")
    assert institution_words(None) == () and institution_words("") == ()
    assert institution_words("Centre for Soil Studies, Oldon") == ("centre", "oldon", "soil", "studies")


def test_trie_finds_all_neighbours():
    rnd = random.Random(3)
    words = list({"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8))) for _ in range(300)})
    trie = Trie()
    for w in words:
        trie.add(w, w)
    for w in words[:60]:
        for most in (0, 1, 2):
            got = sorted(v for _, vs in trie.near(w, most) for v in vs)
            assert got == sorted(v for v in words if edit_distance(w, v, most) <= most)


SCHEMA = "author_id string, name string, first_name string, last_name string, orcid string, affiliations array<string>, updated_at timestamp, person int"


def people(rows):
    return [(a, n, None, None, o, f, None, 1) for a, n, o, f in rows]


def groups(df):
    out = {}
    for r in linked_authors(df).collect():
        out.setdefault(r.person, set()).add(r.author_id)
    return sorted(sorted(g) for g in out.values())


def test_links(spark):
    x, y = ["University of Halemoor"], ["Oldon Institute of Technology"]
    rows = [
        ("a1", "Katherine Vapadell", None, x), ("a2", "K. Vapadell", "", x), ("a3", "Vapadell, Kathy", None, ["Univ. of Halemoor"]), ("a4", "Katherine Vapdell", None, x),
        ("b1", "Katherine Vapadell", None, y),  # a namesake elsewhere
        ("c1", "Omar Torkedi", "0099-0000-0000-0001", x), ("c2", "TORKEDI Omar", "['0099-0000-0000-0001', '0099-0000-0000-0009']", y), ("c3", "Zelda Quim", "0099-0000-0000-0001", y),  # an iD that isn't hers
        ("d1", "Mia Harlo", "0099-0000-0000-0002", x), ("d2", "Mia Harlo", "0099-0000-0000-0003", x),  # different iDs
        ("e1", "Samuel Fenkaro", None, y), ("e2", "Sylvia Fenkaro", None, y), ("e3", "S. Fenkaro", None, y),  # an initial of two people
        ("f1", None, None, None), ("f2", "  ", "", []), ("f3", "Only Name", None, [None, ""]), (None, "Katherine Vapadell", None, x),
    ]
    df = spark.createDataFrame(people(rows) + people(rows[:2]), SCHEMA)
    assert groups(df) == [["a1", "a2", "a3", "a4"], ["c1", "c2"]]
    pairs = {tuple(r) for r in same_person_pairs(linked_authors(df)).collect()}
    assert ("a1", "a4") in pairs and ("c1", "c2") in pairs and len(pairs) == 7


def test_misspelt_institution(spark):
    rows = [(f"n{i}", f"Person{chr(97 + i)}{chr(98 + i)} Surname{chr(97 + i)}qu", None, ["Tolemoor Research Council"]) for i in range(8)]
    rows += [("z1", "Hugo Brelakovo", None, ["Tolemoor Research Council"]), ("z2", "Hugo Brelakovo", None, ["Tolmeoor Reserch Council"])]
    assert groups(spark.createDataFrame(people(rows), SCHEMA)) == [["z1", "z2"]]


def test_empty(spark):
    assert linked_authors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    links = [(f"{i:03}", f"{i + 1:03}") for i in range(0, 40)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {f"{i:03}": "000" for i in range(41)} | {"x": "x", "y": "x"}


def edited(word, n, rnd):
    for _ in range(n):
        i = rnd.randrange(len(word) - 1)
        kind, c = rnd.randrange(4), rnd.choice("aeklrst")
        word = [word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :]][kind]
    return word


@pytest.mark.parametrize("strong", [False, True])
def test_shards_lose_no_neighbour(spark, strong):
    """The shards and their tries against all pairs of words of 4 to 8 letters with 1 and 2 edits, each edit anywhere."""
    rnd = random.Random(5)
    words = {"ukeko", "ukako", "slengesen", "selngeden", "unaotni", "unstoni", "zazavao", "zanzaao"}
    for n in range(4, 9):
        for _ in range(12):
            w = "".join(rnd.choice("aeklrst") for _ in range(n))
            words |= {w, *(edited(w, k, rnd) for k in (1, 1, 1, 2, 2, 2))}
    rows = [("A x" if not strong else "O x", w, strong) for w in words] + [("A y", "ukeko", strong)]
    got = sorted(tuple(r) for r in near_words(spark.createDataFrame(rows, "place string, word string, strong boolean")).collect())
    want = [(p, w, v) for p, w, _ in rows for q, v, _ in rows if p == q and edit_distance(w, v, 2) <= bound(w, strong)]
    assert got == sorted(want)


@pytest.mark.parametrize("whole", [0, 64])
def test_edits_anywhere_in_surnames(spark, monkeypatch, whole):
    """At large places and at small ones."""
    monkeypatch.setattr(authors, "WHOLE", whole)
    x, y = ["University of Halemoor"], ["Oldon Institute of Technology"]
    rows = [("a1", "Omar Ukeko", None, x), ("a2", "Omar Ukako", None, x), ("b1", "Zelda Abcd", None, x), ("b2", "Zelda Abdc", None, x), ("c1", "Hugo Slengesen", "0099-0000-0000-0001", x), ("c2", "Hugo Selngeden", "0099-0000-0000-0001", y)]
    assert groups(spark.createDataFrame(people(rows), SCHEMA)) == [["a1", "a2"], ["b1", "b2"], ["c1", "c2"]]


@pytest.mark.parametrize("whole", [0, 64])
def test_initials_of_misspelt_surnames(spark, monkeypatch, whole):
    """What an initial may stand for is known in full, wherever the edits are."""
    monkeypatch.setattr(authors, "WHOLE", whole)
    x, y = ["University of Halemoor"], ["Oldon Institute of Technology"]
    rows = [("a1", "K. Vapadell", None, x), ("a2", "Katherine Vapdell", None, x), ("a3", "Kurt Vapadel", None, x)]  # two people
    rows += [("b1", "M. Norlonmura", None, y), ("b2", "Mei Norlonmuura", None, y), ("b3", "Mei Nolonmura", None, y)]  # one
    rows += [("c1", "T. Brelakovo", None, y), ("c2", "T. Brelakvo", None, y)]
    assert groups(spark.createDataFrame(people(rows), SCHEMA)) == [["b1", "b2", "b3"], ["c1", "c2"]]


def test_large_places_give_the_same(spark, monkeypatch):
    rnd = random.Random(8)
    rows = []
    for k in range(25):
        w = "".join(rnd.choice("aeklrst") for _ in range(rnd.randrange(4, 9)))
        rows += [(f"p{k:02}{i}", f"{g} {s.capitalize()}", rnd.choice([None, f"0099-0000-0000-{k:04}"]), ["University of Halemoor"]) for i, (g, s) in enumerate([("Katherine", w), ("Katherine", edited(w, 1, rnd)), ("Kathy", edited(w, 2, rnd)), ("Omar", edited(w, 1, rnd))])]
    df = spark.createDataFrame(people(rows), SCHEMA)
    monkeypatch.setattr(authors, "WHOLE", 10_000)
    whole = groups(df)
    monkeypatch.setattr(authors, "WHOLE", 0)
    assert groups(df) == whole and len(whole) > 10


@pytest.mark.parametrize("whole", [0, 64])
def test_reordered_names(spark, monkeypatch, whole):
    """Of two established given names, of short parts, with a short name."""
    monkeypatch.setattr(authors, "WHOLE", whole)
    x, y = ["University of Halemoor"], ["Oldon Institute of Technology"]
    rows = [("a1", "Robert Thomas", None, x), ("a2", "Thomas Robert", None, x), ("b1", "Wei Li", None, x), ("b2", "Li Wei", None, x), ("c1", "Robert Smith", None, x), ("c2", "Smith Bob", None, x), ("d1", "T. Thomas", None, x)]
    rows += [(f"{g}{i}", f"{g} {s}", None, y) for g in ("Robert", "Thomas", "Wei", "Li") for i, s in enumerate(("Vapadell", "Torkedi", "Fenkaro", "Brelakovo", "Quimlado"))]
    assert groups(spark.createDataFrame(people(rows), SCHEMA)) == [["a1", "a2"], ["b1", "b2"], ["c1", "c2"]]


@pytest.mark.parametrize("whole", [0, 64])
def test_short_surnames_with_an_edit_in_the_middle(spark, monkeypatch, whole):
    monkeypatch.setattr(authors, "WHOLE", whole)
    x = ["University of Halemoor"]
    names = ["John Smith", "John Smyth", "Anna Walker", "Anna Welker", "Ines Lopez", "Ines Lobez", "Hugo Jones", "Hugo Jomes"]
    df = spark.createDataFrame(people([(f"a{i}", n, None, x) for i, n in enumerate(names)]), SCHEMA)
    assert groups(df) == [["a0", "a1"], ["a2", "a3"], ["a4", "a5"], ["a6", "a7"]]


@pytest.mark.parametrize("whole", [0, 64])
def test_middle_initials_keep_people_apart(spark, monkeypatch, whole):
    monkeypatch.setattr(authors, "WHOLE", whole)
    x, y = ["University of Halemoor"], ["Oldon Institute of Technology"]
    rows = [("a1", "John A. Smith", None, x), ("a2", "J. Smith", None, x), ("a3", "J. B. Smith", None, x)]
    rows += [("b1", "J. Smith", None, y), ("b2", "J. A. Smith", None, y), ("b3", "J. B. Smith", None, y), ("b4", "J. B. Smyth", None, y)]
    assert groups(spark.createDataFrame(people(rows), SCHEMA)) == [["a1", "a2"], ["b3", "b4"]]


def test_pairs_of_a_large_person(spark):
    df = spark.createDataFrame([(f"{i:03}", "p") for i in range(60)] + [("x", "q"), ("y", "q")], "author_id string, person string")
    want = {(f"{i:03}", f"{j:03}") for i in range(60) for j in range(i + 1, 60)} | {("x", "y")}
    for size in (7, 1000):
        got = [tuple(r) for r in same_person_pairs(df, size).collect()]
        assert len(got) == len(want) and set(got) == want


def test_unplaced(spark):
    rows = [("a", "Only Name", None, [None, ""]), ("b", "Has Place", None, ["Oldon Institute"]), ("c", None, None, ["Oldon Institute"]), ("d", "Has Id", "0099-0000-0000-0001", None), (None, "x y", None, None)]
    assert sorted(r.author_id for r in unplaced(spark.createDataFrame(people(rows), SCHEMA)).collect()) == ["a", "c"]
