"""Byte-pair encoding of a corpus with a public vocabulary.

Exact merges in linear time, without merging: the bytes of a piece are mapped to
Latin-1 for pyahocorasick, which gives the longest token at each place. A token
sequence is what the merges make exactly if every two neighbours would stay apart
when merged on their own; so the encoder takes longest tokens, goes back to the
next shorter one where a neighbour doesn't fit, and remembers what fits.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default folder of the vocabulary files; a parameter everywhere.
TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: how this vocabulary splits text into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A split before single spaces that a non-space follows never cuts a piece.
_WORDS = re.compile(r"(?= \S)")
_INNER_RUN = re.compile(r" \s")


class BpeEncoder:
    """Encoder for a ``.tiktoken`` vocabulary whose ids are merge ranks."""

    def __init__(self, path: str, pattern: str = PIECES, memo: int = 1_000_000):
        self.tokens = [b""] * 0
        ranks: dict[bytes, int] = {}
        for line in Path(path).read_bytes().splitlines():
            if line.strip():
                word, rank = line.split()
                ranks[base64.b64decode(word)] = int(rank)
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for word, rank in ranks.items():
            self.tokens[rank] = word
        self._split_tokens()
        self.automaton = ahocorasick.Automaton()
        for word, rank in ranks.items():
            self.automaton.add_word(word[::1].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern)
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.most = memo
        self.piece_memo: dict[str, bytes] = {}
        self.word_memo = _Memo(lambda w: self.encode_text(" " + w), memo)

    def _split_tokens(self) -> None:
        """For each token the two it is merged from, by the merges of lower rank."""
        n = len(self.tokens)
        self.left, self.right = list(range(n)), list(range(n))
        self.pair: dict[tuple[int, int], int] = {}
        for rank, word in sorted((r, w) for w, r in self.ranks.items() if len(w) > 1):
            parts = [self.ranks[word[i : i + 1]] for i in range(len(word))]
            while len(parts) > 2:
                best = min(((self.pair.get(p, n), i) for i, p in enumerate(zip(parts, parts[1:]))))
                if best[0] == n:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            if len(parts) == 2:
                self.left[rank], self.right[rank] = parts
                self.pair[parts[0], parts[1]] = rank

    def _fit(self, a: int, b: int) -> bool:
        """Whether the merges keep ``a`` and ``b`` apart: undo both along their
        seam, latest merge first, and see if an earlier one would have joined it."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, bound, ok = a, b, len(self.tokens), True
        while True:
            joined = self.pair.get((x, y))
            if joined is not None and joined < bound:
                ok = False
                break
            x_done, y_done = self.left[x] == x and self.right[x] == x, self.left[y] == y and self.right[y] == y
            if x_done and y_done:
                break
            if y_done or (not x_done and x > y):
                bound, x = x, self.right[x]
            else:
                bound, y = y + 1, self.left[y]
        if len(self.fits) > 4 * self.most:
            self.fits.clear()
        self.fits[a, b] = ok
        return ok

    def _shorter(self, token: int) -> int:
        """The longest proper prefix of a token that is a token; -1 if none."""
        got = self.shorter.get(token)
        if got is None:
            word = self.tokens[token]
            got = next((self.ranks[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in self.ranks), -1)
            self.shorter[token] = got
        return got

    def encode_piece(self, raw: bytes) -> list[int]:
        """Tokens of one piece."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest = [-1] * n
        # iter gives every match by its end; the longest by start is kept
        for end, rank in self.automaton.iter(raw.decode("latin-1")):
            start = end + 1 - len(self.tokens[rank])
            longest[start] = rank  # ends ascend, so later is longer
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            prev = out[-1] if out else -1
            while token >= 0:
                end = at + len(self.tokens[token])
                if not dead[end] and (prev < 0 or self._fit(prev, token)):
                    break
                token = self._shorter(token)
            if token >= 0:
                out.append(token)
                at += len(self.tokens[token])
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                token = out.pop()
                at -= len(self.tokens[token])
                token = self._shorter(token)
        return out

    def _piece(self, piece: str) -> bytes:
        got = self.piece_memo.get(piece)
        if got is None:
            got = np.array(self.encode_piece(piece.encode("utf-8", "replace")), np.int32).tobytes()
            if len(piece) <= 64:
                if len(self.piece_memo) >= self.most:
                    self.piece_memo.clear()
                self.piece_memo[piece] = got
        return got

    def encode_text(self, text: str) -> bytes:
        """Ids of a text as int32 bytes, piece by piece."""
        return b"".join(map(self._piece, self.pieces.findall(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as int32 bytes; null and empty texts have none."""
        if not text:
            return b""
        if _INNER_RUN.search(text):
            first, *words = _WORDS.split(text)
            return b"".join([self.encode_text(first), *[self.word_memo[w[1:]] for w in words]])
        first, *words = text.split(" ")
        if words and not words[-1]:  # a blank at the very end is a piece of its own
            words.pop()
            return b"".join([self.encode_text(first), *map(self.word_memo.__getitem__, words), self._piece(" ")])
        return b"".join([self.encode_text(first), *map(self.word_memo.__getitem__, words)])


class _Memo(dict):
    """Remembers up to ``most`` short words; emptied when full, so its size is bounded."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        got = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got


_ENCODERS: dict[str, BpeEncoder] = {}


def encoder(path: str) -> BpeEncoder:
    """One encoder per worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BpeEncoder(path)
    return _ENCODERS[path]


def encode_corpus(docs: DataFrame, text: str = "text", vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken", counts_only: bool = False) -> DataFrame:
    """``docs`` without ``text``, with ``ids`` (array<int>, or ``n_tokens`` if ``counts_only``).

    Whole texts, no special tokens: their strings are ordinary text. A null and an
    empty text both give an empty list; repeated rows stay; an empty table gives
    an empty one. A column of ``docs`` named like the result is replaced.
    """
    name = "n_tokens" if counts_only else "ids"
    keep = [c for c in docs.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            got = [bpe.encode(t) for t in batch.column(len(keep)).to_pylist()]
            lengths = np.fromiter(map(len, got), np.int64, len(got)) // 4
            if counts_only:
                col: pa.Array = pa.array(lengths)
            else:
                col = pa.ListArray.from_arrays(np.r_[0, np.cumsum(lengths)].astype(np.int32), np.frombuffer(b"".join(got), np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], col], names=[*keep, name])

    kind: T.DataType = T.LongType() if counts_only else T.ArrayType(T.IntegerType())
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, kind)])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)
