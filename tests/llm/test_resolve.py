import random
import time

import pytest

from citeloom.llm.resolve import FULL, NOTHING, OTHER, PARTIAL, Vocabulary, _words, edit_distance, judge, repaired_units, resolve_names, rest_words, tokens_of, unit_words, units

SEEDS = [
    ("s1", "Municipal Literacy Greenhouse Atlas", "MLGA; Municipal Literacy Greenhouse Atlas"), ("s2", "Periurban Pesticide Poultry Tracker (PPPT)", "PPPT"), ("s3", "Northern Grocery Seed Database", "NGSD"),
    ("s4", "Northern Grocery Migration Census (NGMC)", "NGMC"), ("s5", "Transvalley Poultry Dental Database", "TPDD"), ("s6", "Coastal Household Wage Questionnaire", "CHWQ"), ("s7", "Upland Dairy Freight Panel", None),
]
VOCAB = Vocabulary.of(SEEDS)


def repair(vocab, unit):
    """What a unit stands for if it is compared with every word."""
    every = [k + w for w in vocab.words for k in "ESWPQ" if k != "W" or vocab.short_forms.get(unit) == w]
    words, glued = unit_words(unit, every)
    out = dict(words)
    for w, rest, first in glued:
        for v, s in rest_words(rest, every):
            whole = f"{w} {v}" if first else f"{v} {w}"
            out[whole] = max(out.get(whole, 0), s)
    return sorted(out.items())


def verdict(text):
    tokens = tokens_of(text)
    return judge(tokens, {u: r for _, u in units(tokens) if not VOCAB.is_plain(u) and (r := repair(VOCAB, u))}, VOCAB)


@pytest.mark.parametrize(
    ("text", "entry"),
    [
        ("municipal literacy greenhouse atlas", "s1"), ("Atlas of Municipal Literacy Greenhouse", "s1"), ("Literacy Greenhouse Atlas, Municipal (wave 3)", "s1"), ("mncpl ltrcy grnhs atls", "s1"), ("Muni. Lit. Greenh. Atlas 2014", "s1"),
        ("Ｍｕｎｉｃｉｐａｌ_Literacy_Greenhouse_Atlas", "s1"), ("Periurban PesticidePoultry Tracker", "s2"), ("periurban pest0cide poultry trcaker", "s2"), ("Northern Grocery S. Database", "s3"), ("Northern Grocery Seed DB", "s3"),
        ("Transva lley Poultry Dental Data base", "s5"), ("Coastal HH Wage Qnaire", "s6"), ("own tabulations from Upland Dairy Freight Panel public release 2020", "s7"),
    ],
)
def test_names_that_mean_an_entry(text, entry):
    v = verdict(text)
    assert (v.kind, v.entries) == (FULL, (entry,))


@pytest.mark.parametrize(("text", "entry"), [("MLGA", "s1"), ("the p.p.p.t. wave 2", "s2"), ("TPDD-14", "s5"), ("Pesticide Poultry Tracker", "s2"), ("Upland Dairy Freight", "s7")])
def test_names_that_may_mean_an_entry(text, entry):
    v = verdict(text)
    assert (v.kind, v.entries) == (PARTIAL, (entry,))


@pytest.mark.parametrize("text", ["Municipal Literacy Poultry Atlas", "Northern Grocery Dental Database", "Periurban Pesticide Vineyard Tracker", "Halilburg's Poultry Tracker"])
def test_another_word_is_another_dataset(text):
    assert verdict(text).kind in (OTHER, NOTHING)


@pytest.mark.parametrize("text", ["", " ", "n/a", "-", "this dataset", "see Table 2", "the aforementioned register", "https://x.example/poultry/dental?v=2", "🙂" * 50, "word " * 5000])
def test_texts_that_say_nothing(text):
    assert not verdict(text).entries


def test_edit_distance():
    assert [edit_distance(*x, 2) for x in (("abc", "abc"), ("abc", "acb"), ("abc", "abxc"), ("abc", "xyz"), ("", "ab"), ("a", "abcd"))] == [0, 1, 1, 3, 2, 3]


def test_rows(spark):
    rows = [
        ("t", "1", "MLGA"), ("t", "1", "n/a"), ("t", "2", "Municipal Literacy Poultry Atlas"), ("t", "2", "MLGA"), ("t", "3", None), ("t", "4", ""), ("t", "5", "PPPT"), ("t", "5", "Pesticide Poultry Tracker"),
        ("t", "5", "PPPT"), ("u", "1", "Coastal Household Wage Questionnaire"), ("t", None, "MLGA"), ("t", "6", "x" * 100_000),
    ]
    fields = spark.createDataFrame([(*r, 7) for r in rows], "source_table string, row_key string, text string, kind int")
    ref = spark.createDataFrame([*SEEDS, (None, "No Id Here Panel", None), ("s9", None, None)], "dataset_id string, dataset_name string, aliases string")
    got = {(r.source_table, r.row_key): r.dataset_id for r in resolve_names(fields, ref).collect()}
    assert got == {("t", "1"): "s1", ("t", "2"): "unmatched", ("t", "3"): "unmatched", ("t", "4"): "unmatched", ("t", "5"): "s2", ("t", "6"): "unmatched", ("u", "1"): "s6"}
    assert resolve_names(fields.limit(0), ref).count() == 0
    assert {r.dataset_id for r in resolve_names(fields, ref.limit(0)).collect()} == {"unmatched"}


def test_no_candidate_is_cut():
    """A short form of more than 12 words keeps the longest one; a word at more than 4 places keeps the weakest."""
    words = [f"st{c}rm" for c in "abcdefghijklmn"]
    many = Vocabulary.of([(f"e{i}", f"{w} Register", None) for i, w in enumerate(words)] + [("long", "Stratospherical Ozone Census", None)])
    assert len(repair(many, "st")) == 15 and "stratospherical" in dict(repair(many, "st"))
    tokens = tokens_of("St. Ozone Census")
    got = judge(tokens, {u: r for u in many.to_repair(tokens) if (r := repair(many, u))}, many)
    assert (got.kind, got.entries) == (FULL, ("long",))
    six = Vocabulary.of([("six", "wanted aone btwo cthree dfour efive", None)])
    others = ["aone", "btwo", "cthree", "dfour", "efive"]
    repaired = {f"t{w}": [(w, 0.95), ("wanted", 0.9)] for w in others} | {"tlast": [("wanted", 0.8)]}
    assert judge(list(repaired), repaired, six).kind == FULL


def test_the_join_finds_what_comparing_with_every_word_finds(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("aeiostrn") for _ in range(n))
    vocab = Vocabulary.of([(f"e{i}", " ".join(word(rnd.randrange(2, 11)) for _ in range(3)), None) for i in range(60)])

    def bent(w):
        w = list(w)
        for _ in range(rnd.randrange(4)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randrange(3)] = rnd.choice(["", "x", "a", "0", "t"])
        return "".join(w)

    asked = {bent(w) for w in vocab.words for _ in range(4)} | {a + bent(b) for a, b in zip(vocab.words, reversed(vocab.words))} | {bent(a) + b for a, b in zip(vocab.words, reversed(vocab.words))}
    asked |= {"".join(c for c in w if rnd.random() < 0.6) for w in vocab.words for _ in range(4)} | {"+" + bent(w) for w in vocab.words} | {w[:n] for w in vocab.words for n in (1, 2, 3)} | {"hh", "vax", "+", "+a"}
    asked = sorted(x for x in asked if x and not vocab.is_plain(x))
    got = {r.unit: sorted(_words(r.words)) for r in repaired_units(spark.createDataFrame([(x,) for x in asked], "unit string"), vocab).collect()}
    expect = {x: r for x in asked if (r := repair(vocab, x))}
    assert len(expect) > 300 and any(" " in w for r in expect.values() for w, _ in r)
    assert got == expect


def test_long_entries_take_no_time():
    words = [f"word{chr(97 + i)}" for i in range(13)]
    vocab = Vocabulary.of([("long", " ".join(words), None)])
    tokens = [f"t{i}" for i in range(26)]
    repaired = {t: [(w, 0.9 - 0.01 * ((i + j) % 4)) for j, w in enumerate(words) if (i + j) % 4 < 2] for i, t in enumerate(tokens)}
    start = time.perf_counter()
    assert judge(tokens, repaired, vocab).kind == FULL
    assert time.perf_counter() - start < 1


def test_word_lists_are_parameters(spark):
    fields = spark.createDataFrame([("t", "1", "zz Coastal Hhold Wage Questionnaire"), ("t", "2", "Coastal hsld Wage Questionnaire qq")], "source_table string, row_key string, text string")
    ref = spark.createDataFrame(SEEDS, "dataset_id string, dataset_name string, aliases string")
    got = {r.row_key: r.dataset_id for r in resolve_names(fields, ref, fillers=frozenset(["zz", "qq"]), short_forms={"hhold": "household"}).collect()}
    assert got == {"1": "s6", "2": "s6"}
