"""Encoding with a public byte-level BPE vocabulary by backtracking.

Longest token matches come from an Aho-Corasick automaton over the vocabulary; a match is taken if the table of compatible
pairs says that the merges would keep the pair apart, else the next shorter match is tried, else the last token is taken
back. This gives exactly the merges' result in linear time, without a merge queue. Decoding uses an offset table.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files; never copied into the repository.
TOKENIZER_DIR = os.environ.get("QUIRE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces remembered per worker and their length in characters; others are encoded anew, with the same result.
CACHE_PIECES, CACHE_CHARS = 400_000, 40


class BacktrackingEncoder:
    """Encoder of one vocabulary given as ranks (token bytes -> id), ids being in merge order after the single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for b, i in ranks.items():
            self.tokens[i] = b
        # the automaton works on text: bytes are mapped one to one to code points
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.prefix: dict[int, int] = {}
        self.split: list[tuple[int, int] | None] = [None] * size
        self.pairs: dict[int, int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1:
                parts = self._last_merge(b, i)
                if parts is None:  # no merge makes it: never produced
                    continue
                self.split[i] = parts
                self.pairs[parts[0] << 32 | parts[1]] = i
        # offset table for decoding
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in self.tokens], out=self.offsets[1:])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one: the only split in two earlier tokens that the lower merges keep apart."""
        get = self.ranks.get
        for n in range(1, len(token)):
            a = get(token[:n])
            if a is not None and a < rank:
                b = get(token[n:])
                if b is not None and b < rank and self._apart(a, b):
                    return a, b
        return None

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of the token, or -1."""
        got = self.prefix.get(token)
        if got is None:
            t = self.tokens[token]
            got = next((self.ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ranks), -1)
            self.prefix[token] = got
        return got

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right standing side by side."""
        key = (left, right)
        got = self.compatible.get(key)
        if got is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            got = self.compatible[key] = self._apart(left, right)
        return got

    def _apart(self, left: int, right: int) -> bool:
        # undo merges around the border from the latest on; a pair that merges before one of them was made forbids the border
        limit = 1 << 60
        while True:
            merged = self.pairs.get(left << 32 | right)
            if merged is not None and merged < limit:
                return False
            if left > right:
                parts, limit = self.split[left], left
                if parts is None:
                    limit = right + 1
                    parts = self.split[right]
                    if parts is None:
                        return True
                    right = parts[0]
                else:
                    left = parts[1]
            else:
                parts, limit = self.split[right], right + 1
                if parts is None:
                    limit = left
                    parts = self.split[left]
                    if parts is None:
                        return True
                    left = parts[1]
                else:
                    right = parts[0]

    def longest(self, text: str) -> list[int]:
        """For each place of text (one character a byte) the longest token that begins there."""
        best, ranks = [-1] * len(text), self.tokens
        for end, token in self.automaton.iter(text):
            start = end - len(ranks[token]) + 1
            if best[start] < 0 or len(ranks[token]) > len(ranks[best[start]]):
                best[start] = token
        return best

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece of the split."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        at_place, tokens = self.longest(piece.decode("latin-1")), self.tokens
        dead = bytearray(len(piece) + 1)
        out: list[int] = []
        at, n, token = 0, len(piece), at_place[0]
        while at < n:
            while True:
                end = at + len(tokens[token])
                if not dead[end] and (not out or self.apart(out[-1], token)):
                    out.append(token)
                    at = end
                    if at < n:
                        token = at_place[at]
                    break
                token = self.shorter(token)
                if token < 0:  # nothing fits here: take the last token back and try a shorter one
                    dead[at] = 1
                    token = out.pop()
                    at -= len(tokens[token])
                    token = self.shorter(token)
                    if token < 0:
                        # the place before is dead as well; go on taking back
                        while token < 0:
                            dead[at] = 1
                            token = out.pop()
                            at -= len(tokens[token])
                            token = self.shorter(token)
        return tuple(out)

    def decode(self, ids) -> bytes:
        """The bytes of a list of ids, gathered through the offset table."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)
        return self.bytes[index].tobytes()


@lru_cache(maxsize=4)
def load_encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> BacktrackingEncoder:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return BacktrackingEncoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


_SPLIT = regex.compile(PATTERN)


class TextEncoder:
    """Whole texts through the encoder, with caches from piece to ids and from word to ids (as bytes of int32).

    A space after a non-space always begins a piece, so a text may be cut at its spaces as long as every part ends
    with a non-space; parts that recur are looked up without running the split pattern again.
    """

    def __init__(self, encoder: BacktrackingEncoder):
        self.encoder = encoder
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = np.array(self.encoder.encode_piece(piece.encode("utf-8", "replace")), np.int32).tobytes()
            if len(piece) <= CACHE_CHARS:
                if len(self.pieces) >= CACHE_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def _part(self, part: str) -> bytes:
        return b"".join(map(self._piece, _SPLIT.findall(part)))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as the bytes of an int32 array; b'' for an empty or null text."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        out: list[bytes] = []
        add, known, words = out.append, self.words.get, self.words
        held = first if not first or first[-1].isspace() else None  # what doesn't end with a non-space yet
        if held is None:
            add(self._part(first))
        for w in rest:
            if held is None:
                got = known(w)
                if got is None:
                    if not w or w[-1].isspace():
                        held = " " + w
                        continue
                    got = self._part(" " + w)
                    if len(w) <= CACHE_CHARS:
                        if len(words) >= CACHE_PIECES:
                            words.clear()
                        words[w] = got
                add(got)
            else:
                held = f"{held} {w}"
                if w and not w[-1].isspace():
                    add(self._part(held))
                    held = None
        if held:
            add(self._part(held))
        return b"".join(out)


@lru_cache(maxsize=4)
def text_encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> TextEncoder:
    return TextEncoder(load_encoder(name, folder))


def encode_text(text: str | None, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> list[int]:
    """Ids of a text without special tokens (their strings are ordinary text); [] for an empty or null text."""
    return np.frombuffer(text_encoder(name, folder).encode(text), np.int32).tolist()


def encode_column(df: DataFrame, text: str, keep: list[str], ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns keep and ids, the token ids of the text column, one row for each row of df.

    Empty and null texts have an empty list. Whole texts are encoded, whatever their length. No shuffle; the encoder's
    tables are built once per worker from the vocabulary file in folder.
    """
    src = df.select(*keep, F.col(text).cast("string").alias("__t"))
    schema = ", ".join([*[f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep], f"`{ids}` array<int>"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = text_encoder(name, folder).encode
        for batch in batches:
            parts = [encode_one(t) for t in batch.column("__t").to_pylist()]
            ends = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
            values = pa.array(np.frombuffer(b"".join(parts), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, ids])

    return src.mapInArrow(encode, schema)


def token_counts(df: DataFrame, text: str, keep: list[str], count: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns keep and count, the number of tokens of the text (0 for an empty or null text). No shuffle."""
    src = df.select(*keep, F.col(text).cast("string").alias("__t"))
    schema = ", ".join([*[f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep], f"`{count}` long"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = text_encoder(name, folder).encode
        for batch in batches:
            out = [len(encode_one(t)) // 4 for t in batch.column("__t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.int64())], names=[*keep, count])

    return src.mapInArrow(measure, schema)


def decode_column(df: DataFrame, ids: str, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns keep and the text of the ids; a null list gives a null text, bytes that are no UTF-8 are replaced."""
    src = df.select(*keep, F.col(ids).cast("array<int>").alias("__i"))
    schema = ", ".join([*[f"`{c}` {src.schema[c].dataType.simpleString()}" for c in keep], f"`{text}` string"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoder(name, folder)
        for batch in batches:
            out = [None if x is None else enc.decode(x).decode("utf-8", "replace") for x in batch.column("__i").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(out, pa.string())], names=[*keep, text])

    return src.mapInArrow(decode, schema)
