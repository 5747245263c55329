"""Round trips over generated inputs."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm.bpe import TOKENIZER_DIR, encoder
from citeloom.llm.mixing import permute
from citeloom.llm.people import Name, parse_name
from citeloom.llm.resolve import edit_distance, tokens_of

PATH = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(blacklist_categories=("Cs",)), max_size=120))
def test_ids_spell_the_text(text):
    e = encoder(PATH)
    ids = np.frombuffer(e.encode(text), np.int32).tolist()
    assert b"".join(e.tokens[i] for i in ids) == text.encode()


@given(st.integers(1, 5000), st.integers(0, 2**62))
def test_permutations(n, key):
    got = permute(np.arange(n), np.full(n, n), np.full(n, key))
    assert len(set(got.tolist())) == n and got.min() == 0 and got.max() == n - 1


@given(st.text(max_size=60))
def test_any_name_can_be_read(text):
    n = parse_name(text)
    if n is not None:
        assert Name.of_text(n.text) == n
    assert all(tokens_of(text))


@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_edits(a, b, c):
    d = lambda x, y: edit_distance(x, y, 20)
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, b) <= max(len(a), len(b))
