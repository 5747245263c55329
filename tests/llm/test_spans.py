import random

import pytest

from citeloom.llm.spans import SharedAutomaton, anchors, coverage, shared_spans

LEAST = 80


def brute(docs, least):
    texts = {}
    for d, t in docs:
        if t is not None:
            texts.setdefault(d, t)
    where = {}
    for d, t in texts.items():
        for i in range(len(t) - least + 1):
            where.setdefault(t[i : i + least], set()).add(d)
    out = set()
    for d, t in texts.items():
        run = None
        for i in range(len(t) - least + 1):
            if len(where[t[i : i + least]]) > 1:
                if run and i <= run[1]:
                    run[1] = i + least
                else:
                    if run:
                        out.add((d, *run))
                    run = [i, i + least]
        if run:
            out.add((d, *run))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij é漢🙂") for _ in range(rnd.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rnd.randrange(10, 80)) for _ in range(12)]
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            parts.append(text(rnd.randrange(1, 40)))
            if rnd.random() < 0.6:
                s = rnd.choice(shared)
                a = rnd.randrange(len(s) // 2)
                parts.append(s[a : a + rnd.randrange(10, len(s))])
        docs.append((d, "".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "a" * 500), (103, "a" * 300), (104, "ab" * 200), (105, None), (106, ""), (107, "x" * (LEAST - 1)), (108, "x" * (LEAST - 1)), (109, "y" * LEAST), (110, "y" * LEAST)]
    return docs


@pytest.mark.parametrize("shard_texts", [128, 1])  # automata for all, split path for nearly all
def test_against_brute_force(spark, shard_texts):
    docs = corpus(4)
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, anchor int")
    got = {tuple(r) for r in shared_spans(df, LEAST, shard_texts).collect()}
    assert got == brute(docs, LEAST)


def test_long_text_in_pieces(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(600_000))
    docs = [(1, long), (2, "z" * 50 + long[262_000:262_500] + "q"), (3, "w" + long[599_900:] + "v")]
    got = {tuple(r) for r in shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), LEAST).collect()}
    assert got == {(1, 262_000, 262_500), (2, 50, 550), (1, 599_900, 600_000), (3, 1, 101)}


def test_repeats_within_one_document_and_empty(spark):
    t = "some sentence that is long enough to be taken for a stretch of eighty characters in all. "
    df = spark.createDataFrame([(1, t + t), (1, t + t), (2, "other")], "doc_id long, text string")
    assert shared_spans(df, LEAST).count() == 0
    assert shared_spans(df.limit(0), LEAST).count() == 0
    assert coverage(df.limit(0), shared_spans(df.limit(0), LEAST)).count() == 0


def test_coverage(spark):
    t = "x1" * 60
    df = spark.createDataFrame([(1, t + "abc"), (2, t), (3, None)], "doc_id long, text string")
    rows = {r.doc_id: (r.n_chars, r.shared_chars, r.shared_part) for r in coverage(df, shared_spans(df, LEAST)).collect()}
    assert rows == {1: (123, 120, 0.97561), 2: (120, 120, 1.0), 3: (0, 0, 0.0)}


def test_every_stretch_has_an_anchor():
    rnd = random.Random(1)
    for letters in ("ab", "abcdefghijklmnop", "a"):
        t = "".join(rnd.choice(letters) for _ in range(1000))
        owner, _, at, first, last, *_ = anchors(["short", t], LEAST)
        covered = {s for a, b in zip(first.tolist(), last.tolist()) for s in range(a, b + 1)}
        assert covered == set(range(len(t) - LEAST + 1)) and set(owner.tolist()) == {1}
        assert all(f <= p and p + 64 <= f + LEAST or p >= l for p, f, l in zip(at.tolist(), first.tolist(), last.tolist()))


def test_automaton_tells_documents_apart():
    a = SharedAutomaton()
    a.add("abcdefgh", 1, 1)
    a.add("xxcdefyy", 2, 2)
    a.close()
    assert a.spans("abcdefgh", 3) == [(2, 6)] and a.spans("xxcdefyy", 4) == [(2, 6)] and a.spans("xxcdefyy", 5) == []


def test_bound(spark):
    with pytest.raises(ValueError):
        shared_spans(spark.createDataFrame([], "doc_id long, text string"), 10)


def test_texts_of_one_doc_id_keep_their_places(spark):
    rnd = random.Random(3)
    piece = lambda: "".join(rnd.choice("abcdefgh ") for _ in range(300))
    x, y = piece(), piece()
    docs = [(1, "one" + x + piece()), (1, piece() + y + "two"), (2, piece() + x[40:250]), (3, y[:200] + piece())]
    got = {tuple(r) for r in shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), LEAST).collect()}
    assert got == {(1, 43, 253), (1, 300, 500), (2, 300, 510), (3, 0, 200)}


@pytest.mark.parametrize("shard_texts", [512, 20])
def test_one_passage_in_very_many_texts(spark, shard_texts):
    rnd = random.Random(8)
    piece = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    licence = piece(150)
    docs = [(i, piece(90) + "|" + licence + "|" + piece(90)) for i in range(120)] + [(1000 + i, piece(400)) for i in range(20)]
    got = {tuple(r) for r in shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), LEAST, shard_texts).collect()}
    assert got == brute(docs, LEAST) and len(got) == 120


def test_stretches_no_longer_than_an_anchor(spark):
    docs = corpus(6)[:40] + [(100, "y" * 64), (101, "y" * 64)]
    got = {tuple(r) for r in shared_spans(spark.createDataFrame(docs, "doc_id long, text string"), 64).collect()}
    assert got == brute(docs, 64)
