import os
import random

import numpy as np
import pytest

from citeloom.llm.bpe import TOKENIZER_DIR, encode_corpus, encoder

PATH = os.environ.get("TOKENIZER", f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    from citeloom.llm.bpe import PIECES

    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=encoder(PATH).ranks, special_tokens={})


def ids(text):
    return np.frombuffer(encoder(PATH).encode(text), np.int32).tolist()


def test_texts_as_merges_make_them(reference):
    rnd = random.Random(2)
    bits = [" ", "  ", "\n", " \n", "\t", "\r\n", "a", "the", " data", "é", "漢字", "🙂", "'s", "'re", "123", "...", "<|endoftext|>", "ﬁ", "\x00", "aaaaaaaa", " ", "I'll", "é"]
    for _ in range(4000):
        s = "".join(rnd.choice(bits) for _ in range(rnd.randrange(16)))
        assert ids(s) == reference.encode_ordinary(s), repr(s)


def test_long_pieces_without_blanks(reference):
    rnd = random.Random(3)
    for n in (1, 50, 3000):
        for letters in ("ab", "abcdeiorstnhly", "漢é", "="):
            s = "".join(rnd.choice(letters) for _ in range(n))
            assert ids(s) == reference.encode_ordinary(s)


def test_corpus_null_empty_repeated_and_clashing(spark, reference):
    rows = [(1, None, 9), (2, "", 9), (3, "some text", 9), (3, "some text", 9), (None, " ", 9)]
    out = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids int"), vocabulary=PATH)
    assert out.columns == ["doc_id", "ids"]
    got = sorted(((r.doc_id or 0, r.ids) for r in out.collect()))
    some = reference.encode_ordinary("some text")
    assert got == [(0, reference.encode_ordinary(" ")), (1, []), (2, []), (3, some), (3, some)]
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string"), vocabulary=PATH).count() == 0


def test_memo_is_bounded():
    from citeloom.llm.bpe import BpeEncoder

    e = BpeEncoder(PATH, memo=10)
    a = e.encode(" ".join(f"word{i}" for i in range(200)))
    assert len(e.word_memo) <= 10 and a == encoder(PATH).encode(" ".join(f"word{i}" for i in range(200)))
