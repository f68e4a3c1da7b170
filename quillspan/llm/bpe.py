"""Byte-level BPE encoding of a whole corpus (problem 8).

A text is cut into words by the vocabulary's own pattern; each word is encoded by
a backtracking encoder: Aho-Corasick gives the tokens that start at each byte,
longest first, and a pair-compatibility test tells whether two neighbours could
stand next to one another in the true merge order. The result is exact and each
byte is entered at most once per token length, so time is linear. Words repeat, so
a bounded table of encoded words does most of the work. Decoding gathers bytes by
an offset table.

Scale: one narrow pass (no shuffle); what is broadcast is the vocabulary file, of
fixed size. Whole texts are encoded, in Arrow batches.

Defined results: null and empty texts give an empty list; blank texts are encoded
as they are; names of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Encoded words kept by a worker; the table is emptied when it is full.
WORDS_KEPT = 1 << 18

# Unicode White_Space, as the vocabulary's pattern means it.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(major: str) -> str:
    """A character class body of all code points of one major category."""
    codes = (c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == major)
    out = []
    for _, run in itertools.groupby(enumerate(codes), lambda x: x[1] - x[0]):
        run = [c for _, c in run]
        out.append(f"\\U{run[0]:08x}" + (f"-\\U{run[-1]:08x}" if len(run) > 1 else ""))
    return "".join(out)


def _pattern(letters: str, numbers: str, space: str) -> re.Pattern:
    return re.compile(
        f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


_ASCII_WORDS = _pattern("A-Za-z", "0-9", "\\t\\n\\x0b\\x0c\\r ")


@lru_cache(maxsize=1)
def _all_words() -> re.Pattern:
    return _pattern(_ranges("L"), _ranges("N"), _SPACE)


def split_words(text: str) -> list[str]:
    """The pieces inside which merges happen."""
    return (_ASCII_WORDS if text.isascii() else _all_words()).findall(text)


def _byte_letters() -> dict[str, int]:
    """The printable letter by which the vocabulary file writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one byte-level BPE vocabulary."""

    def __init__(self, data: bytes) -> None:
        model = json.loads(data)
        special = {t["content"] for t in model.get("added_tokens", [])}
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in special}
        size = max(vocab.values()) + 1
        tokens = [b""] * size
        for t, i in vocab.items():
            tokens[i] = t
        self.tokens = tokens
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        # merge order: halves of each token and the token of each pair
        self.left, self.right = list(range(size)), list(range(size))
        self.order = [-1] * size
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            i = vocab[a + b]
            self.pairs[vocab[a], vocab[b]] = i
            self.left[i], self.right[i], self.order[i] = vocab[a], vocab[b], rank
        self.find = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.find.add_word(t.decode("latin-1"), (len(t), i))
        self.find.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)

    def fits(self, a: int, b: int) -> bool:
        """Whether tokens a, b can be neighbours: no merge across their seam comes
        before the merges that made them."""
        known = self._fits.get((a, b))
        if known is None:
            known = self._fits[a, b] = self._seam_holds(a, b)
            if len(self._fits) > 1 << 20:
                self._fits.clear()
        return known

    def _seam_holds(self, a: int, b: int) -> bool:
        # walk down the right edge of a and the left edge of b, undoing the later
        # merge first; a pair across the seam that merges before the last undone
        # merge would have been made instead
        order, undone = self.order, 1 << 60
        while True:
            joint = self.pairs.get((a, b))
            if joint is not None and order[joint] < undone:
                return False
            if order[a] < 0 and order[b] < 0:
                return True
            # of equal merges the left one was made first, so the right is undone first
            if order[a] > order[b]:
                undone, a = order[a], self.right[a]
            else:
                undone, b = order[b] + 1, self.left[b]

    def encode_word(self, word: bytes) -> list[int]:
        """The merges of one word, by backtracking over longest matches."""
        n = len(word)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.find.iter(word.decode("latin-1")):
            starts[end - found[0] + 1].append(found)
        for s in starts:
            s.sort(reverse=True)
        dead = bytearray(n + 1)
        ids: list[int] = []
        tried: list[int] = [0]
        pos = 0
        while pos < n:
            options, k = starts[pos], tried[-1]
            while k < len(options):
                size, token = options[k]
                k += 1
                if not dead[pos + size] and (not ids or self.fits(ids[-1], token)):
                    ids.append(token)
                    tried[-1] = k
                    tried.append(0)
                    pos += size
                    break
            else:
                dead[pos] = 1
                tried.pop()
                pos -= len(self.tokens[ids.pop()])
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text."""
        return np.frombuffer(b"".join(map(self.words.__getitem__, split_words(text))), np.int32)

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of each token."""
        return self.offsets[ids + 1] - self.offsets[ids]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a list of ids, gathered by the offset table."""
        ids = np.asarray(ids, np.int64)
        sizes = self.lengths(ids)
        ends = np.cumsum(sizes)
        at = np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[at].tobytes()


class _Words(dict):
    """Encoded words as bytes of int32, filled on demand."""

    def __init__(self, bpe: ByteBpe) -> None:
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.bpe.encode_word(word.encode("utf-8", "replace")), np.int32).tobytes()
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


def vocabulary_bytes(path: str | None = None) -> bytes:
    """The vocabulary file; read on the driver only."""
    with open(path or os.path.join(TOKENIZERS, "byte_bpe_50k.json"), "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _loaded(data: bytes) -> ByteBpe:
    return ByteBpe(data)


def encode_column(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row."""
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary_bytes(path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocab.value)
        get = bpe.words.__getitem__
        for batch in batches:
            parts, ends = [], [0]
            for t in batch.column(1).to_pylist():
                if t:
                    ids = b"".join(map(get, split_words(t)))
                    parts.append(ids)
                    ends.append(ends[-1] + len(ids) // 4)
                else:
                    ends.append(ends[-1])
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    return docs.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"{key} {kind}, ids array<int>")


def decode_column(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text) of lists of ids: the round trip of :func:`encode_column`."""
    vocab = encoded.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocab.value)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")
