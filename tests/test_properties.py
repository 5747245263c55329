"""Properties over generated inputs."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.functions.similarity import indel_ratio_of
from citeloom.operators.fulltext import harvest
from citeloom.operators.packed import PackedGrammar
from citeloom.operators.shred import json_triples

PLAIN = st.text(st.characters(blacklist_characters=";,|\n\t\r•；，、()[]{}\"'“”‘’«»„", blacklist_categories=("Cs",)), min_size=1).filter(lambda s: s == s.strip())


@given(st.lists(PLAIN, max_size=8), st.sampled_from(["; ", ",", "|", "\n", " • "]))
def test_plain_values_come_back(values, delimiter):
    assert [i.value for i in PackedGrammar().parse(delimiter.join(values)) if i.value] == values


@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), min_size=1).filter(lambda s: s == s.strip()), max_size=6))
def test_quoted_values_come_back(values):
    packed = "; ".join('"' + v.replace('"', '""') + '"' for v in values)
    assert [i.value for i in PackedGrammar().parse(packed) if i.value] == values


@given(st.text(max_size=200))
def test_any_field_can_be_read(text):
    items = PackedGrammar().parse(text)
    assert sum(len(i.value) for i in items) <= len(text)


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=10), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "n", "root"]), x, max_size=3), max_leaves=12)


@given(JSON, st.integers(0, 3))
def test_any_json_can_be_walked(value, layers):
    text = json.dumps(value)
    for _ in range(layers):
        text = json.dumps(text)
    opened = [(p, o) for p, o, leaf, _ in json_triples(text, "root", frozenset("ab")) if leaf is None]
    assert len(opened) == len(set(opened))
    assert len(harvest(value)) == len({t.lower() for t in harvest(value)})


@settings(max_examples=200)
@given(st.text("abcd", max_size=30), st.text("abcd", max_size=30))
def test_ratio_is_symmetric_and_bounded(a, b):
    assert indel_ratio_of(a, b) == indel_ratio_of(b, a) and 0 <= indel_ratio_of(a, b) <= 100 and (indel_ratio_of(a, b) == 100) == (a == b)
