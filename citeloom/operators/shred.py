"""Deeply nested records as flat tables.

Every record is streamed once as path-value-ordinal triples: a JSON text token by
token, a typed column (which the file reader has parsed already) by a walk that is
made from its schema. Triples whose path has the same repeated ancestor, at the
same ordinals, belong to one element; they are kept together while they are made,
so that grouping them needs no shuffle. Each group of paths is then pivoted into
one table.

Group rows: ``record_key``, ``path`` (of the repeated ancestor), ``ords`` (place
in each enclosing array, from 0), ``kind`` (object, array or value), ``leaves`` (map from the leaf's path below the
ancestor to its value as text). ``ords`` without its last entry is the parent's.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GROUP = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("ords", T.ArrayType(T.IntegerType(), False)),
        T.StructField("kind", T.StringType()),
        T.StructField("leaves", T.MapType(T.StringType(), T.StringType())),
    ]
)
GROUPS = T.ArrayType(GROUP)
ROW_SCHEMA = "record_key string, path string, ords array<int>, kind string, leaves map<string,string>"


# -- typed columns ---------------------------------------------------------------


def _leaves(value: Column, kind: T.DataType, below: str) -> list[tuple[str, Column]]:
    """Leaf paths and values under one element, as far as no array begins."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _leaves(value.getField(f.name), f.dataType, f"{below}.{f.name}" if below else f.name)]
    if isinstance(kind, T.ArrayType):
        return []
    return [(below, F.to_json(value) if isinstance(kind, T.MapType) else value.cast("string"))]


def _arrays(value: Column, kind: T.DataType, path: str) -> list[tuple[str, Column, T.DataType]]:
    """Arrays that begin under one element."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _arrays(value.getField(f.name), f.dataType, f"{path}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        return [(path, value, kind.elementType)]
    return []


def _groups(path: str, array: Column, kind: T.DataType, ords: list[Column]) -> Column:
    """All groups of an array and of the arrays inside its elements."""

    def element(x: Column, i: Column) -> Column:
        at = [*ords, i]
        leaves = _leaves(x, kind, "")
        kinds = "object" if isinstance(kind, T.StructType) else "array" if isinstance(kind, T.ArrayType) else "value"
        own = F.struct(F.lit(path).alias("path"), F.array(*at).alias("ords"), F.lit(kinds).alias("kind"), F.map_from_arrays(F.array(*[F.lit(n) for n, _ in leaves]), F.array(*[v for _, v in leaves])).cast("map<string,string>").alias("leaves"))
        inner = [_groups(p, v, k, at) for p, v, k in (_arrays(x, kind, path) if isinstance(kind, T.StructType) else [(path + ".item", x, kind.elementType)] if isinstance(kind, T.ArrayType) else [])]
        return F.when(x.isNull(), F.array().cast(GROUPS)).otherwise(F.concat(F.array(own).cast(GROUPS), *inner))

    return F.coalesce(F.flatten(F.transform(array, element)), F.array().cast(GROUPS))


def shred_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Group rows of the typed nested ``columns``; built from their schema, in the JVM.

    Null and empty arrays give no rows, null elements none but keep their place.
    """
    parts = [_groups(p, v, k, []) for c in columns for p, v, k in _arrays(F.col(f"`{c}`"), df.schema[c].dataType, c)]
    if not parts:
        raise ValueError(f"no array in {columns}")
    rows = df.select(F.col(f"`{key}`").cast("string").alias("record_key"), F.explode(F.concat(*parts)).alias("g"))
    return rows.select("record_key", "g.path", "g.ords", "g.kind", "g.leaves")


# -- JSON text -------------------------------------------------------------------

# The tokens of JSON.
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("[^"\\\x00-\x1f]*(?:\\.[^"\\\x00-\x1f]*)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null|NaN|-?Infinity))')
_REST = re.compile(r"[ \t\n\r]*\Z")
OBJECT, ARRAY = "{", "["
KINDS = {OBJECT: "object", ARRAY: "array"}
#: Levels of nesting from which a text counts as no JSON, as in Spark's own reader.
DEEPEST = 1000

#: Where a value stands (names of members and places in arrays), and the value:
#: whether it is a text, and its characters; of an object or array its opening sign.
Triple = tuple[tuple[str | int, ...], bool, str | None]


def scan(text: str) -> list[Triple] | None:
    """The triples of a JSON text in the order in which they stand; None if it isn't JSON.

    The text is read token by token and no tree is built. Of members of one name
    the last one counts.
    """
    out: list[Triple] = []
    at, state, path = 0, "value", ()
    stack: list[tuple[tuple[str | int, ...], dict[str, tuple[int, int]] | None]] = []  # path of the open container; of an object, its members' first triples
    while state != "end":
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at, kind = m.end(), m.lastindex
        token = m.group(kind)
        closes = token == ("}" if stack and stack[-1][1] is not None else "]") and kind == 1 and bool(stack)
        if state in ("value", "first value") and not (closes and state == "first value"):
            if kind == 1:
                if token not in "{[" or len(stack) >= DEEPEST:
                    return None
                out.append((path, False, token))
                stack.append((path, {} if token == "{" else None))
                state = "first name" if token == "{" else "first value"
                path = path if token == "{" else (*path, 0)
                continue
            if kind == 2:
                try:
                    out.append((path, True, token[1:-1] if "\\" not in token else json.loads(token)))
                except ValueError:
                    return None
            else:
                out.append((path, False, None if token == "null" else token))
            state = "next" if stack else "end"
        elif state in ("name", "first name") and kind == 2:
            base, seen = stack[-1]
            try:
                name = token[1:-1] if "\\" not in token else json.loads(token)
            except ValueError:
                return None
            if name in seen:
                first = seen[name]
                out[:] = [t for i, t in enumerate(out) if i < first or t[0][: len(base) + 1] != (*base, name)]
                seen = {n: next(i for i, t in enumerate(out) if t[0][: len(base) + 1] == (*base, n)) for n in seen if n != name}
                stack[-1] = (base, seen)
            seen[name] = len(out)
            path, state = (*base, name), "colon"
        elif state == "colon" and token == ":" and kind == 1:
            state = "value"
        elif state == "next" and token == "," and kind == 1:
            base, seen = stack[-1]
            path, state = (base, "name") if seen is not None else ((*base, path[len(base)] + 1), "value")
        elif closes and state in ("next", "first value", "first name"):
            path = stack.pop()[0]
            state = "next" if stack else "end"
        else:
            return None
    return out if _REST.match(text, at) else None


def _opened(triples: list[Triple] | None) -> list[Triple] | None:
    """The triples of the JSON value in a text, through all layers of encoding; None where there is none."""
    while triples and triples[0][1] and not triples[0][0]:
        triples = scan(triples[0][2])
    return triples


def _members(triples: list[Triple]) -> Iterator[tuple[str | int, list[Triple]]]:
    """The members of an object or array, each with its triples."""
    for step, held in groupby(triples[1:], lambda t: t[0][0]):
        yield step, [(steps[1:], is_text, value) for steps, is_text, value in held]


def decode(value: object) -> object:
    """The JSON value that ``value`` holds, through all layers of encoding; None if it isn't JSON."""
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def _elements(path: str, ords: tuple[int, ...], sub: list[Triple]) -> Iterator[tuple[str, tuple[int, ...], str | None, str | None]]:
    """Triples below (``path``, ``ords``), each at its nearest repeated ancestor."""
    for steps, is_text, value in sub:
        at, o, names = path, ords, []
        for s in steps:
            if isinstance(s, int):
                at, o, names = f"{at}.{'.'.join(names)}" if names else f"{at}.item", (*o, s), []
            else:
                names.append(s)
        if not names and (is_text or value is not None):
            yield at, o, None, KINDS.get("" if is_text else value, "value")  # an element opens
        if is_text or value not in (OBJECT, ARRAY):
            if names or value is not None:
                yield at, o, ".".join(names), value


def json_triples(text: str | None, root: str, arrays: frozenset[str]) -> Iterator[tuple[str, tuple[int, ...], str | None, str | None]]:
    """(path, ordinals, leaf, value) of each leaf, at its nearest repeated ancestor.

    ``root`` names the column; an object wrapped in a member of that name is opened.
    A member in ``arrays`` counts whether it is an array, an array encoded as text,
    or a lone object (place 0). An element opens with leaf None and its kind
    (object, array or value); one that is a value has the leaf "". What stands outside any array belongs to the record:
    path ``root`` and no ordinals. Elements of arrays in arrays have ``.item``
    after the path. Null elements give nothing but keep their place.
    """
    top = _opened(scan(text)) if text else None
    while top and top[0][2] == OBJECT and not top[0][1]:
        members = dict(_members(top))
        if root not in members or arrays & members.keys():
            break
        inner = _opened(members.pop(root))
        for name, sub in members.items():
            yield from _elements(root, (), [((name, *steps), is_text, value) for steps, is_text, value in sub])
        top = inner
    if not top:
        return
    if top[0][1] or top[0][2] != OBJECT:
        if top[0][2] == ARRAY:
            for i, sub in _members(top):
                yield from _elements(f"{root}.item", (i,), sub)
        return
    yield root, (), None, "object"
    for name, sub in members.items():
        held = _opened(sub) if name in arrays else None
        if not held or held[0][1] or held[0][2] not in (OBJECT, ARRAY):
            yield from _elements(root, (), [((name, *steps), is_text, value) for steps, is_text, value in sub])
            continue
        for i, element in [(0, held)] if held[0][2] == OBJECT else _members(held):
            said = _opened(element)
            yield from _elements(f"{root}.{name}", (i,), said if said and said[0][2] in (OBJECT, ARRAY) else element)


def plain_json(text: str | None, root: str, arrays: frozenset[str]) -> str | None:
    """The object that ``text`` holds as JSON of one form: unwrapped, each of ``arrays`` an
    array of its objects; None where there is no object. It opens what :func:`json_triples` opens."""
    top = decode(text)
    while isinstance(top, dict) and root in top and not arrays & top.keys():
        top = decode(top[root])
    if not isinstance(top, dict):
        return None
    out = dict(top)
    for name in arrays & top.keys():
        held = decode(top[name])
        if isinstance(held, list):
            out[name] = [x for e in held if isinstance(x := decode(e), dict)]
        elif isinstance(held, dict):
            out[name] = [held]
        else:
            del out[name]
    return json.dumps(out, ensure_ascii=False)


def plain_json_column(column: str, arrays: list[str]) -> Column:
    """:func:`plain_json` of a column; only that column goes to Python."""
    wanted = frozenset(arrays)

    @F.pandas_udf(T.StringType())
    def opened(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: plain_json(t, column, wanted))

    return opened(F.col(column))


def shred_json(df: DataFrame, key: str, column: str, arrays: list[str], only: list[str] | None = None) -> DataFrame:
    """Group rows of the JSON text in ``column``; of the paths in ``only``, if given.

    Every record is streamed once; triples at one repeated ancestor and ordinal are
    its group. Null, broken and non-JSON texts give no rows. Names that hold a dot
    aren't told from nested ones.
    """
    wanted, paths = frozenset(arrays), frozenset(only or ())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_key", pa.string()), ("path", pa.string()), ("ords", pa.list_(pa.int32())), ("kind", pa.string()), ("leaves", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            keys, places, ords, kinds, leaves = [], [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                groups: dict[tuple[str, tuple[int, ...]], tuple[str | None, dict[str, str | None]]] = {}
                before: list[tuple[tuple[str, tuple[int, ...]], str, str | None]] = []  # leaves of a record that stand before it opens
                for path, o, leaf, value in json_triples(text, column, wanted):
                    if paths and path not in paths:
                        continue
                    if leaf is None:
                        groups[path, o] = (value, {})
                    elif (path, o) in groups:
                        groups[path, o][1][leaf] = value
                    else:
                        before.append(((path, o), leaf, value))
                for place, leaf, value in before:
                    groups.setdefault(place, ("object", {}))[1].setdefault(leaf, value)
                for (path, o), (kind, held) in groups.items():
                    keys.append(k), places.append(path), ords.append(o), kinds.append(kind), leaves.append(list(held.items()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.string()), pa.array(ords, pa.list_(pa.int32())), pa.array(kinds, pa.string()), pa.array(leaves, pa.map_(pa.string(), pa.string()))], schema=schema)

    return df.select(F.col(f"`{key}`").cast("string").alias("record_key"), F.col(f"`{column}`").cast("string")).mapInArrow(parse, ROW_SCHEMA)


# -- the flat tables -------------------------------------------------------------


def flat_table(groups: DataFrame, path: str, leaves: list[str]) -> DataFrame:
    """The table of one group of paths: ``record_key``, ``parent_ords``, ``pos`` and a column for each leaf.

    ``(record_key, parent_ords)`` refers to ``(record_key, parent_ords || pos)`` of the enclosing table.
    """
    return pivoted(groups, {path: leaves}).drop("path")


def pivoted(groups: DataFrame, tables: dict[str, list[str]]) -> DataFrame:
    """The tables of several groups of paths, a row per element: ``path`` and the columns of
    :func:`flat_table`; leaves that a table hasn't are null in its rows. All in one pass."""
    own = groups.where(F.col("path").isin(*tables))
    names = list(dict.fromkeys(x for leaves in tables.values() for x in leaves))
    only = lambda x: F.col("path").isin(*[p for p, leaves in tables.items() if x in leaves])
    columns = [F.when(only(x), F.try_element_at("leaves", F.lit(x))).alias(x.replace(".", "_")) for x in names]
    return own.select("path", "record_key", F.slice("ords", 1, F.greatest(F.size("ords") - 1, F.lit(0))).alias("parent_ords"), F.try_element_at("ords", F.lit(-1)).alias("pos"), *columns)
