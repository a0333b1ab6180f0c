"""Texts as the token ids of a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's public pattern; each distinct piece is encoded
once per worker. Inside a piece the longest vocabulary match at every position comes from an
Aho-Corasick automaton over the tokens' bytes (mapped to Latin-1 text), and the encoding is
found by backtracking: take the longest match, step back to its next shorter prefix whenever
it cannot follow the token before it, and remember positions that lead nowhere. Two adjacent
tokens are compatible if encoding their concatenation gives exactly the two, a question that
the merge table answers and a memo keeps. The result is the one that merging by rank gives, in
time linear in the piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Where the vocabulary lies; a parameter, never copied.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern of byte-level BPE.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
CACHE = 300_000

#: Pairs of tokens whose fit a worker remembers.
MOST_PAIRS = 1_000_000


class Encoder:
    """Byte-level BPE by longest matches and adjacent-token compatibility."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN) -> None:
        import ahocorasick

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.cache: dict[str, list[int]] = {}

    def _merge(self, piece: bytes) -> list[bytes]:
        """The reference answer by rank order; used for single tokens to learn their last merge."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60 or len(parts) == 2:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _half(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self.halves:
            text = self.tokens[token]
            parts = self._merge(text) if len(text) > 1 else [text]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _fit(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is how their concatenation is encoded."""
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= MOST_PAIRS:
                self.fits.clear()  # a worker lives long; what is needed is soon learned again
            found = self.fits[key] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        # Undo merges from the latest on; a merge across the border that comes before the next
        # one on either side means that the pair would not have stayed apart.
        limit = 1 << 60
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < limit:
                return False
            if left > right:
                limit = left
                half = self._half(left)
                if half is not None:
                    left = half[1]
                    if left == limit:
                        return True
                else:
                    limit = right + 1
                    half = self._half(right)
                    if half is None:
                        return True
                    if half[0] + 1 > limit:
                        return True
                    right = half[0]
            else:
                limit = right + 1
                half = self._half(right)
                if half is not None:
                    right = half[0]
                else:
                    limit = left
                    half = self._half(left)
                    if half is None:
                        return True
                    left = half[1]

    def _next_shorter(self, token: int) -> int:
        """The longest proper prefix of a token that is a token; -1 for a single byte."""
        if token not in self.shorter:
            text = self.tokens[token]
            self.shorter[token] = next((self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), -1)
        return self.shorter[token]

    def piece(self, text: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        longest = [-1] * len(text)
        for end, rank in self.automaton.iter(text.decode("latin-1")):
            start = end + 1 - len(self.tokens[rank])
            if longest[start] < 0 or len(self.tokens[rank]) > len(self.tokens[longest[start]]):
                longest[start] = rank
        out: list[int] = []
        position, token, dead = 0, longest[0], bytearray(len(text) + 1)
        while position < len(text):
            while True:
                end = position + len(self.tokens[token])
                if not dead[end] and (not out or self._fit(out[-1], token)):
                    out.append(token)
                    position = end
                    token = longest[end] if end < len(text) else -1
                    break
                token = self._next_shorter(token)
                if token < 0:
                    dead[position] = 1
                    token = out.pop()
                    position -= len(self.tokens[token])
                    token = self._next_shorter(token)
                    while token < 0:
                        dead[position] = 1
                        token = out.pop()
                        position -= len(self.tokens[token])
                        token = self._next_shorter(token)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; empty for null and empty texts."""
        out: list[int] = []
        if text:
            cache = self.cache
            for p in self.split.findall(text):
                ids = cache.get(p)
                if ids is None:
                    ids = self.piece(p.encode("utf-8", "surrogatepass"))
                    if len(cache) < CACHE and len(p) <= 64:
                        cache[p] = ids
                out += ids
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str = VOCABULARY, pattern: str = PATTERN) -> Encoder:
    """One encoder per worker process."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, ids)`` of every document, null and empty texts included (an empty list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 500):
                ids = [e.encode(t) for t in texts.slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, tokens)`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            sizes = [len(e.encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return documents.select("doc_id", F.col("text")).mapInArrow(run, "doc_id long, tokens long")
