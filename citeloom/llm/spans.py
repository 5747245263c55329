"""Long exact spans shared between records.

A character is shared if it lies in a stretch of ``least`` characters that another
document holds too. Suffix automata of a whole corpus don't fit anywhere and would
have to meet every document; so the corpus is cut into reference shards that are
sure to hold all partners of a stretch, and an automaton is built for each:

1. Every stretch of ``least`` characters names an anchor: the inner ``GRAM``
   characters with the smallest hash. Equal stretches name equal anchors, so only
   anchors that two documents have can lie in a shared stretch, and of these only
   those with half of the rest in common before or after the anchor. The text round
   an anchor, as far as its stretches reach, is its window; only places and hashes
   of the window and the sides leave the task that reads the text.
2. The windows round an anchor are its reference shard. Equal ones are one, marked
   with the documents it has; a shard of one window is shared as a whole, and no
   text of it is ever moved. Of other shards each window's text is fetched once.
3. The shard's texts are cut to what agrees with some other text round the anchor
   and put into one suffix automaton whose states know whether they occur in more
   than one document. Streaming a text through it gives at each place the longest
   match with another document; matches of ``least`` or more are its shared spans.
4. Shards of many different windows are split by stretch instead of going to a task.

Nothing is sampled: the anchors only decide where a stretch is compared.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.sources.session import materialise

GRAM = 64
CHUNK = 1 << 18
_POS = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_TABLES: dict[str, np.ndarray] = {}


def gram_hashes(chars: np.ndarray, gram: int) -> np.ndarray:
    """A mixed rolling hash of every ``gram`` characters."""
    n = len(chars)
    if len(_TABLES.get("up", ())) < n:
        size = max(n, CHUNK * 2)
        _TABLES["up"], _TABLES["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    a = (chars.astype(np.uint64) + np.uint64(0x51ED270B)) * np.uint64(0xFF51AFD7ED558CCD)
    a ^= a >> np.uint64(33)
    s = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(a * _TABLES["up"][:n], out=s[1:])
    h = (s[gram:] - s[:-gram]) * _TABLES["down"][: n - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, step = len(x) - w + 1, 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[w - step : w - step + n])


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def window_hash(text: str) -> int:
    """The hash of a window, as :func:`anchors` gives it."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(_code_points(text))).astype(np.int64))


def anchors(texts: list[str], least: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, anchor hash, its place, first and last stretch that names it, hash of the window, sides), of texts of ``least`` or more characters.

    A stretch reaches half of ``least - gram`` beyond its anchor on one side at least.
    The sides are 16 bits of a hash of so many characters before the anchor and as
    many of those after it; 0 where the text has fewer.
    """
    reach = -(-(least - gram) // 2)
    parts: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, np.ndarray]] = []  # text, place of the piece in it, characters

    def flush() -> None:
        if not held:
            return
        chars = np.concatenate([c for _, _, c in held])
        ends = np.cumsum([len(c) for _, _, c in held])
        h = gram_hashes(chars, gram)
        packed = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        best = (_sliding_min(packed, least - gram + 1) & _POS).astype(np.int64)
        owner = np.repeat(np.arange(len(held)), [len(c) for _, _, c in held])[: len(best)]
        starts = np.flatnonzero(np.arange(len(best)) + least <= ends[owner])
        p, o = best[starts], owner[starts]
        new = np.r_[True, (p[1:] != p[:-1]) | (o[1:] != o[:-1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(starts)] - 1
        o = o[first]
        shift = np.array([at for _, at, _ in held])[o] - (ends - [len(c) for _, _, c in held])[o]
        sides = np.zeros(len(first), dtype=np.uint32)
        if reach and len(chars) >= reach:
            side, at, low = (gram_hashes(chars, reach) >> np.uint64(48)).astype(np.uint32) | np.uint32(1), p[first], (ends - [len(c) for _, _, c in held])[o]
            before, after = at - reach >= low, at + gram + reach <= ends[o]
            sides[before] = side[at[before] - reach] << np.uint32(16)
            sides[after] |= side[at[after] + gram]
        raw, a, b = memoryview(chars).cast("B"), (starts[first] * 4).tolist(), ((starts[last] + least) * 4).tolist()
        windows = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(a, b)), np.uint64, len(a))
        parts.append((np.array([t for t, _, _ in held])[o], h[p[first]].view(np.int64), p[first] + shift, starts[first] + shift, starts[last] + shift, windows.view(np.int64), sides.view(np.int32)))
        held.clear()

    size = 0
    for t, text in enumerate(texts):
        if len(text) < least:
            continue
        chars = _code_points(text)
        for at in range(0, len(chars) - least + 1, CHUNK):
            piece = chars[at : at + CHUNK + least - 1]
            if size + len(piece) > 2 * CHUNK:
                flush()
                size = 0
            held.append((t, at, piece))
            size += len(piece)
    flush()
    if not parts:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z, z, z, z, z.astype(np.int32)
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(7))  # type: ignore[return-value]


class SharedAutomaton:
    """A suffix automaton of several texts; each text comes with the least and greatest document that has it."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.lo, self.hi = [-1], [0], [None], [None]

    def _new(self, length: int, link: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.link.append(link), self.length.append(length), self.lo.append(None), self.hi.append(None)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, ch: str) -> int:
        c = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(ch) == q:
            self.next[p][ch] = c
            p = self.link[p]
        return c

    def add(self, text: str, lo: int, hi: int) -> None:
        last = 0
        for ch in text:
            q = self.next[last].get(ch)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, ch)
            else:
                cur, p = self._new(self.length[last] + 1, 0, {}), last
                while p >= 0 and ch not in self.next[p]:
                    self.next[p][ch] = cur
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][ch]
                    self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, ch)
                last = cur
            self.lo[last] = lo if self.lo[last] is None else min(lo, self.lo[last])
            self.hi[last] = hi if self.hi[last] is None else max(hi, self.hi[last])

    def close(self) -> None:
        """Tell every state whether its texts occur in several documents."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for v in reversed(order):
            u = self.link[v]
            if u > 0:
                self.lo[u] = self.lo[v] if self.lo[u] is None else min(self.lo[u], self.lo[v])
                self.hi[u] = self.hi[v] if self.hi[u] is None else max(self.hi[u], self.hi[v])
        self.match = [0] * len(self.link)
        for v in order:
            self.match[v] = -1 if self.lo[v] != self.hi[v] else self.match[self.link[v]] if self.match[self.link[v]] >= 0 else self.length[self.link[v]]

    def spans(self, text: str, least: int) -> list[tuple[int, int]]:
        """Maximal runs of characters of an added text that lie in shared matches of ``least`` or more."""
        out: list[tuple[int, int]] = []
        v = 0
        for i, ch in enumerate(text, 1):
            v = self.next[v][ch]
            m = self.match[v]
            m = i if m < 0 else m
            if m >= least:
                if out and i - m <= out[-1][1]:
                    out[-1] = (min(out[-1][0], i - m), i)
                else:
                    out.append((i - m, i))
        return out


def _agreement(parts: list[str]) -> list[int]:
    """For each text the longest prefix it has in common with any other one."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    got = [0] * len(parts)
    for a, b in zip(order, order[1:]):
        n = len(os.path.commonprefix([parts[a], parts[b]]))
        got[a], got[b] = max(got[a], n), max(got[b], n)
    return got


def shard_spans(windows: list[tuple[str, int, int, int]], least: int, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """Shared spans of each text (text, anchor's place, least and greatest document) of one shard."""
    left = _agreement([w[:at][::-1] for w, at, _, _ in windows])
    right = _agreement([w[at + gram :] for w, at, _, _ in windows])
    cut: list[tuple[str, int]] = []
    docs: dict[str, tuple[int, int]] = {}
    for (w, at, lo, hi), a, b in zip(windows, left, right):
        part, shift = (w, 0) if lo < hi else (w[at - a : at + gram + b], at - a)
        cut.append((part, shift))
        if len(part) >= least:
            x, y = docs.get(part, (lo, hi))
            docs[part] = (min(x, lo), max(y, hi))
    if not docs:
        return [[] for _ in windows]
    found: dict[str, list[tuple[int, int]]] = {}
    if len(docs) == 1:  # a chain: every state has the same documents
        found = {t: [(0, len(t))] if lo < hi else [] for t, (lo, hi) in docs.items()}
    else:
        automaton = SharedAutomaton()
        for t, (lo, hi) in docs.items():
            automaton.add(t, lo, hi)
        automaton.close()
        found = {t: automaton.spans(t, least) for t in docs}
    return [[(a + shift, b + shift) for a, b in found.get(t, [])] for t, shift in cut]


def merged_runs(spans: DataFrame) -> DataFrame:
    """Maximal runs of the half-open intervals ``doc_id, a, b``; touching ones are one."""
    by = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("a") <= before, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("_run", run).groupBy("doc_id", "_run").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).drop("_run")


def shared_spans(docs: DataFrame, least: int = 200, shard_texts: int = 512) -> DataFrame:
    """``doc_id, span_start, span_end`` of every maximal run of shared characters.

    Code points of whole texts are compared exactly; windows of one anchor are told
    apart by 64 bits more. Null, empty and shorter texts have no spans; a text's
    repetition within itself is none; rows with the same ``doc_id`` are one
    document. Shards of more than ``shard_texts`` different windows take the split
    path. ``least`` is between ``GRAM`` and 4095.
    """
    if not GRAM <= least < 4096:
        raise ValueError(f"least must lie between {GRAM} and 4095")
    # length() counts code points; shorter texts can't hold a stretch
    texts = docs.select("doc_id", "text").where(F.length("text") >= least)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, h, at, first, last, win, sides = anchors(b.column(1).to_pylist(), least)
            # one number for the three places: the later two lie within `least` of the first stretch
            place = (first << 24) | ((at - first) << 12) | (last - first)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array(h), pa.array(place), pa.array(win), pa.array(sides)], names=["doc_id", "anchor", "place", "win", "sides"])

    named = materialise(texts.mapInArrow(name, "doc_id long, anchor long, place long, win long, sides int"), "anchors")
    several = named.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    hits = materialise(named.join(several, "anchor", "left_semi"), "hits")
    if least > GRAM:
        # a shared stretch has one of the two sides in common with another document; what has none holds no stretch
        side = F.explode(F.array(F.nullif(F.shiftrightunsigned("sides", 16), F.lit(0)), F.nullif(-F.col("sides").bitwiseAND(0xFFFF), F.lit(0)))).alias("side")
        sides = hits.select("doc_id", "anchor", "place", side).where("side is not null")
        met = sides.groupBy("anchor", "side").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("anchor", "side")
        kept = sides.join(met, ["anchor", "side"], "left_semi").select("doc_id", "anchor", "place").distinct()
        hits = materialise(hits.drop("sides").join(kept, ["doc_id", "anchor", "place"], "left_semi"), "hits")
    stats = hits.groupBy("anchor").agg((F.min("win") == F.max("win")).alias("alike"))
    hits = hits.join(stats, "anchor")
    first, length = F.shiftright("place", 24), F.col("place").bitwiseAND(0xFFF) + least
    alike = hits.where("alike").select("doc_id", first.alias("a"), (first + length).alias("b"))

    mixed = materialise(hits.where("not alike").select("doc_id", "anchor", "win", "place"), "mixed")
    one = mixed.groupBy("anchor", "win").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "place")).alias("rep"))
    wanted = materialise(one.groupBy(F.col("rep.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "win", "rep.place", "lo", "hi")).alias("wanted")), "wanted")
    # a table of its own, so that Spark knows its size: few ids go to every task and the
    # other texts are never shuffled; many are joined by the partitions the next join needs
    wanted_docs = materialise(wanted.select("doc_id"), "wanted-docs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in ws:
                    start = x["place"] >> 24
                    window = text[start : start + (x["place"] & 0xFFF) + least]
                    if window_hash(window) == x["win"]:  # not so in another text with the same doc_id
                        rows.append((x["anchor"], x["win"], x["place"] >> 12 & 0xFFF, x["lo"], x["hi"], window))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["anchor", "win", "at", "lo", "hi", "text"])

    asked = texts.join(wanted_docs, "doc_id", "left_semi").join(wanted, "doc_id").select("text", "wanted")
    windows = materialise(asked.mapInArrow(cut, "anchor long, win long, at int, lo long, hi long, text string"), "windows")
    large = materialise(windows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_texts).select("anchor"), "large")
    light, heavy = windows.join(large, "anchor", "left_anti"), windows.join(large, "anchor", "left_semi")
    shards = light.groupBy("anchor").agg(F.collect_list(F.struct("win", "text", "at", "lo", "hi")).alias("texts"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for anchor, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held = sorted({x["win"]: x for x in held}.values(), key=lambda x: x["win"])
                for x, spans in zip(held, shard_spans([(x["text"], x["at"], x["lo"], x["hi"]) for x in held], least)):
                    out += [(anchor, x["win"], a, e) for a, e in spans]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["anchor", "win", "a", "b"])

    found = shards.mapInArrow(match, "anchor long, win long, a int, b int")
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                raw = memoryview(_code_points(r["text"])).cast("B")
                n = len(r["text"]) - least + 1
                grams = np.fromiter((xxhash.xxh3_64_intdigest(raw[4 * i : 4 * (i + least)]) for i in range(n)), np.uint64, n).view(np.int64)
                same = [pa.array(np.full(n, r[c], dtype=np.int64)) for c in ("anchor", "win", "lo", "hi")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(grams)], names=["anchor", "win", "lo", "hi", "a", "gram"])

    # split path: a row per stretch, counted like any other key
    grams = heavy.select("anchor", "win", "lo", "hi", "text").mapInArrow(stretches, "anchor long, win long, lo long, hi long, a int, gram long")
    common = grams.groupBy("anchor", "gram").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).where("x < y").select("anchor", "gram")
    split = grams.join(common, ["anchor", "gram"], "left_semi").select("anchor", "win", "a", (F.col("a") + least).alias("b"))
    spans = found.unionByName(split).join(mixed.select("anchor", "win", "doc_id", first.alias("first")), ["anchor", "win"])
    every = spans.select("doc_id", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b")).unionByName(alike)
    return merged_runs(every).select("doc_id", F.col("span_start").cast("int"), F.col("span_end").cast("int"))


def coverage(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """How much of each document is shared: ``doc_id, n_chars, n_spans, shared_chars, shared_part``."""
    sums = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    rows = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars")).join(sums, "doc_id", "left").fillna(0, ["n_spans", "shared_chars"])
    return rows.withColumn("shared_part", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(F.lit(0.0)))
