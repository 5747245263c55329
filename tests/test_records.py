"""Nested records, packed fields, orphan references, versions."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from citeloom.operators.orphans import missing_keys, orphan_references, orphan_report
from citeloom.operators.packed import ID_DELIMITER, PackedGrammar, orcid_value, split_packed
from citeloom.operators.shred import decode, flat_table, json_triples, shred_columns, shred_json
from citeloom.operators.versions import latest_version

AUTHORS = "id string, path int, authors array<struct<id:string,name:string,tags:array<string>,inst:array<struct<id:string,geo:struct<city:string>>>>>"


def test_shred_typed_columns(spark):
    rows = [
        ("p1", 1, [("a", "Ann", ["x", None], [("i1", ("C",)), None, ("i2", None)]), None, (None, None, None, None)]),
        ("p2", 1, []), ("p3", 1, None), (None, 1, [("b", None, [], [])]), ("p1", 1, [("a", "Ann", ["x", None], [("i1", ("C",)), None, ("i2", None)]), None, (None, None, None, None)]),
    ]
    g = shred_columns(spark.createDataFrame(rows, AUTHORS), "id", ["authors"])
    got = sorted({(r.record_key or "", r.path, tuple(r.ords), tuple(sorted((k, v) for k, v in r.leaves.items() if v))) for r in g.collect()})
    assert got == [
        ("", "authors", (0,), (("id", "b"),)), ("p1", "authors", (0,), (("id", "a"), ("name", "Ann"))), ("p1", "authors", (2,), ()),
        ("p1", "authors.inst", (0, 0), (("geo.city", "C"), ("id", "i1"))), ("p1", "authors.inst", (0, 2), (("id", "i2"),)), ("p1", "authors.tags", (0, 0), (("", "x"),)),
    ]
    flat = flat_table(g, "authors.inst", ["id", "geo.city", "nothing"]).distinct().orderBy("pos").collect()
    assert [(r.record_key, r.parent_ords, r.pos, r.id, r.geo_city, r.nothing) for r in flat] == [("p1", [0], 0, "i1", "C", None), ("p1", [0], 2, "i2", None, None)]
    assert shred_columns(spark.createDataFrame([], AUTHORS), "id", ["authors"]).count() == 0
    with pytest.raises(ValueError):
        shred_columns(spark.createDataFrame([], AUTHORS), "id", ["id"])


ARRAYS = frozenset(["a", "b"])


@pytest.mark.parametrize(
    ("text", "places"),
    [
        ('{"a": [{"n": 1}, null, {"n": 2}]}', [("r.a", 0), ("r.a", 2)]), ('{"a": {"n": 1}}', [("r.a", 0)]), ('{"a": "[{\\"n\\": 1}]"}', [("r.a", 0)]), ('{"a": "{\\"n\\": 1}"}', [("r.a", 0)]),
        (json.dumps(json.dumps({"a": [{"n": 1}]})), [("r.a", 0)]), ('{"r": {"a": [{}]}}', [("r.a", 0)]), (json.dumps({"r": json.dumps({"r": {"b": [1, {"x": 2}]}})}), [("r.b", 1)]),
        ('{"a": []}', []), ('{"a": null}', []), ("", []), (None, []), ("{broken", []), ("[1, 2]", []), ("null", []), ('"text"', []), ('{"a": 5, "b": "x"}', []), ('{"a": ["{\\"n\\": 1}"]}', [("r.a", 0)]), ("[" * 100_000, []),
    ],
)
def test_json_walks(text, places):
    assert [(p, o[0]) for p, o, leaf, kind in json_triples(text, "r", ARRAYS) if leaf is None and kind == "object" and o] == places


def test_shred_json(spark):
    rows = [("k1", '{"a": [{"n": "x", "deep": {"m": [1, 2], "s": [{"t": 1}, {"t": 2}]}}]}', 1), ("k2", None, 1), ("k3", "no", 1), (None, '{"a": {"n": "y"}}', 1)]
    g = shred_json(spark.createDataFrame(rows, "k string, r string, path int"), "k", "r", ["a"])
    got = sorted((r.record_key or "", r.path, tuple(r.ords), tuple(sorted(r.leaves.items()))) for r in g.collect())
    assert [g for g in got if g[2]] == [("", "r.a", (0,), (("n", "y"),)), ("k1", "r.a", (0,), (("n", "x"),)), ("k1", "r.a.deep.m", (0, 0), (("", "1"),)), ("k1", "r.a.deep.m", (0, 1), (("", "2"),)), ("k1", "r.a.deep.s", (0, 0), (("t", "1"),)), ("k1", "r.a.deep.s", (0, 1), (("t", "2"),))]
    assert shred_json(spark.createDataFrame([], "k string, r string"), "k", "r", ["a"]).count() == 0
    assert decode('"\\"x\\""') is None


def items(text, **kw):
    return [(i.value, i.error) for i in PackedGrammar(**kw).parse(text) if i.value]


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("a; b", ["a", "b"]), ("a", ["a"]), (" ; a ;; ", ["a"]), ('"a; b" | c', ["a; b", "c"]), ('"the ""x"" y"', ['the "x" y']), ("“a, b”•c", ["a, b", "c"]), ("'a | b','c'", ["a | b", "c"]), ("Bob's thing; x", ["Bob's thing", "x"]),
        ("'Bob's, thing'; x", ["Bob's, thing", "x"]), ("X (a; b), Y [c | d]", ["X (a; b)", "Y [c | d]"]), ("a\nb\tc；d", ["a", "b", "c", "d"]), ("https://x.y/a/b?v=1; z", ["https://x.y/a/b?v=1", "z"]), ('""; a', ["a"]), ("((a; b); c); d", ["((a; b); c)", "d"]), ("", []), ("  ", []), (";;;", []),
    ],
)
def test_packed_values(text, values):
    assert items(text) == [(v, "") for v in values]


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ('"a; b', [('"a', "unclosed_quote"), ("b", "")]), ('"a" b; c', [('"a" b', "unclosed_quote"), ("c", "")]), ("x (a; b", [("x (a", "unclosed_bracket"), ("b", "")]), ("a); b", [("a)", "unclosed_bracket"), ("b", "")]), ("'tis; b", [("'tis", ""), ("b", "")]),
    ],
)
def test_malformed_values_are_read_again(text, values):
    assert items(text) == values


def test_long_fields_take_linear_time():
    for text in ('"' * 20_000, "(" * 20_000, "'a;" * 20_000, "a;" * 50_000, '"a;' * 20_000):
        assert PackedGrammar().parse(text)


def test_ids():
    g = PackedGrammar(ID_DELIMITER, opens_list=True)
    ids = lambda t: [orcid_value(i.value) for i in g.parse(t) if i.value]
    assert ids("0099-0000-0000-000x / 0099000000000001 and orcid:0099-0000-0000-0002") == ["0099-0000-0000-000X", "0099-0000-0000-0001", "0099-0000-0000-0002"]
    assert ids("['0099-0000-0000-0001', \"0099-0000-0000-0002\"]") == ["0099-0000-0000-0001", "0099-0000-0000-0002"]
    assert ids("https://orcid.org/0099-0000-0000-0001\n0099-0000-0000-0003|none") == ["0099-0000-0000-0001", "0099-0000-0000-0003", None]


def test_split_packed(spark):
    rows = [("k", 'a; "b; c"', 1), ("k", 'a; "b; c"', 2), ("n", None, 1), ("e", "", 1), ("b", " ", 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "key string, packed string, pos int")
    got = sorted((r.row_key or "", r.pos, r.value, r.error) for r in split_packed(df, "key", "packed").collect())
    assert got == [("", 1, "x", ""), ("k", 1, "a", ""), ("k", 2, "b; c", "")]
    ids = split_packed(spark.createDataFrame([("k", "junk, 0099000000000001")], "key string, packed string"), "key", "packed", "orcid").collect()
    assert sorted((r.pos or 0, r.value, r.error) for r in ids) == [(0, "junk", "no_id"), (1, "0099-0000-0000-0001", "")]
    assert split_packed(df.limit(0), "key", "packed").count() == 0


def test_latest_version(spark):
    t = lambda n: datetime(2024, 1, n)
    rows = [("A", t(1), "old", [1]), ("a ", t(3), "new", None), ("a", t(3), "new", None), ("b", None, "only", []), (None, t(9), "no key", []), (" ", t(9), "blank", [])]
    df = spark.createDataFrame(rows, "k string, at timestamp, v string, _row array<int>")
    got = {r["_key"]: r.v for r in latest_version(df, F.when(F.trim("k") != "", F.lower(F.trim("k"))), F.col("at"), ["k", "v", "_row"]).collect()}
    assert got == {"a": "new", "b": "only"}
    assert latest_version(df.limit(0), F.col("k"), F.col("at"), ["v"]).count() == 0


def test_orphans(spark):
    refs = [("f", "k1", "r1", "2024-01"), ("f", "gone", "r1", "2024-01"), ("f", "gone", "r2", None), ("f", "gone", "r2", None), ("g", "k1", "r3", "2024-02"), ("f", None, "r4", "2024-01"), ("f", "é漢", "r5", "2024-01")]
    refs += [("f", "hot", f"h{i}", "2024-03") for i in range(500)]
    parents = [("f", "k1"), ("f", "k1"), ("g", "other"), ("f", None), ("f", "é漢")]
    r = spark.createDataFrame(refs, "field string, ref_key string, row_key string, month string")
    p = spark.createDataFrame(parents, "field string, ref_key string")
    assert {tuple(x) for x in missing_keys(r, p).collect()} == {("f", "gone"), ("f", "hot"), ("g", "k1")}
    found = orphan_references(r, p)
    assert {(x.field, x.row_key) for x in found.collect()} == {("f", "r1"), ("f", "r2"), ("g", "r3")} | {("f", f"h{i}") for i in range(500)}
    report = {(x.field, x.month): (x.n_refs, x.n_orphans, x.n_orphan_keys) for x in orphan_report(found, r).collect()}
    assert report == {("f", "2024-01"): (4, 1, 1), ("f", None): (2, 2, 1), ("g", "2024-02"): (1, 1, 1), ("f", "2024-03"): (500, 500, 1)}
    assert orphan_references(r.limit(0), p).count() == 0
    assert orphan_references(r, p.limit(0)).count() == 506


@pytest.mark.parametrize(
    ("text", "ends"),
    [
        ("(0099-0000-0000-0001; 0099-0000-0000-0002)", "12"), ("0099-0000-0000-0001/0099-0000-0000-0002, 0099-0000-0000-0003", "123"), ("'0099-0000-0000-0001 0099-0000-0000-0002'", "12"),
        ("0099 0000 0000 0001", "1"), ("0099 0000 0000 0001 0099 0000 0000 0002; orcid: 0099 0000 0000 0003", "123"), ("0099-0000-0000-0001 0099-0000-0000-0002 0099000000000003", "123"),
    ],
)
def test_every_id_of_a_field(spark, text, ends):
    got = split_packed(spark.createDataFrame([("k", text)], "key string, packed string"), "key", "packed", "orcid").where("pos is not null").orderBy("pos").collect()
    assert [(r.pos, r.value) for r in got] == [(i, f"0099-0000-0000-000{e}") for i, e in enumerate(ends, 1)]
