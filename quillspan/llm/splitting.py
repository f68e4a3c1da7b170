"""Splitting oversized texts at natural boundaries (problem 10).

A text's structure (form feeds, headings by level, blocks, list items, lines,
sentences, clauses, words) is parsed into a tree: the nodes between boundaries of one
level are siblings, deeper levels their subtrees. The tree is packed bottom-up: a node
that fits is one unit, an oversized one is descended into and gives the units its
children were merged to, and sibling units are merged up to the limit. Each piece
starts ``overlap`` tokens before the end of the one before.

Scale: one narrow pass; whether a text can be too long is first asked of its byte
length, in the scan, as a text has at most as many tokens as bytes.

Defined results: texts of at most ``limit`` tokens, null and empty ones give no
row. Pieces are cut between characters; a piece never has more than ``limit``
tokens, counted in the whole text or by itself; consecutive pieces share
``overlap`` tokens (up to three more where the overlap would start inside a
character; fewer only where one token with its overlap is over the limit by itself).
Null ids are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.bpe import ByteBpe, _loaded, vocabulary_bytes

LIMIT, OVERLAP = 512, 64

# Boundary levels from the root down; a boundary stands before the named thing.
PART, HEADING, BLOCK, ITEM, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 0, 1, 8, 9, 10, 11, 12, 13, 14
NEVER = 99

_HEAD = re.compile(r"(#{1,6})[ \t]|<h([1-6])\b")
_ITEM = re.compile(r"[ \t]*(?:[-*•+]|\d{1,3}[.)])[ \t]")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]")
_CLAUSE = re.compile(r"[;:,—–]\s+|[、，；]")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(character positions, levels) of every boundary above the word."""
    at: list[int] = []
    level: list[int] = []
    pos, after_blank = 0, False
    for line in text.split("\n"):
        if pos:
            if not line or line.isspace():
                at.append(pos), level.append(LINE)
            elif m := _HEAD.match(line):
                at.append(pos), level.append(HEADING + (len(m[1]) if m[1] else int(m[2])) - 1)
            elif after_blank:
                at.append(pos), level.append(BLOCK)
            else:
                at.append(pos), level.append(ITEM if _ITEM.match(line) else LINE)
        after_blank = not line or line.isspace()
        pos += len(line) + 1
    for pattern, lv in ((_SENTENCE, SENTENCE), (_CLAUSE, CLAUSE)):
        ends = [m.end() for m in pattern.finditer(text)]
        at += ends
        level += [lv] * len(ends)
    if "\f" in text:
        ends = [i + 1 for i, c in enumerate(text) if c == "\f"]
        at += ends
        level += [PART] * len(ends)
    return np.array(at, np.int64), np.array(level, np.int64)


def token_levels(text: str, bpe: ByteBpe, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level of the boundary before each token, byte offset of each token)."""
    raw = text.encode("utf-8", "replace")
    ends = np.concatenate([[0], np.cumsum(bpe.lengths(ids))])
    data = np.frombuffer(raw, np.uint8)
    levels = np.full(len(ids) + 1, INSIDE, np.int64)
    starts = ends[:-1]
    lead = data[starts]
    levels[:-1][(lead == 0x20) | (lead == 0x0A)] = WORD
    levels[:-1][(lead & 0xC0) == 0x80] = NEVER
    at, lv = boundaries(text)
    if len(at):
        if len(raw) != len(text):
            widths = np.concatenate([[0], np.flatnonzero((data & 0xC0) != 0x80), [len(raw)]])[1:]
            at = widths[np.minimum(at, len(text))]
        # the token that starts at or before the boundary; spaces belong to what follows
        tok = np.searchsorted(starts, at, side="right") - 1
        tok = np.where(at >= len(raw), len(ids), tok)
        order = np.argsort(-lv, kind="stable")  # the highest level is written last
        tok, lv = tok[order], lv[order]
        fine = levels[tok] != NEVER
        levels[tok[fine]] = np.minimum(levels[tok[fine]], lv[fine])
    return levels, ends


class Node:
    """A stretch of tokens, with the nodes of the next level below it if it is too large
    for one unit."""

    __slots__ = ("start", "end", "children")

    def __init__(self, start: int, end: int, children: list[Node]) -> None:
        self.start, self.end, self.children = start, end, children


def tree(levels: np.ndarray, start: int, end: int, room: int) -> Node:
    """The structure of [start, end), entered only where a node is oversized. Runs of
    smaller siblings are one node each, kept by their edges."""
    if end - start <= room:
        return Node(start, end, [])
    inner = levels[start + 1 : end]
    level = inner.min() if len(inner) else NEVER
    if level == NEVER:
        return Node(start, end, [])
    edges = np.concatenate([[start], start + 1 + np.flatnonzero(inner == level), [end]])
    return Node(start, end, [tree(levels, int(a), int(b), room) for a, b in zip(edges[:-1], edges[1:])])


def merged(node: Node, room: int) -> list[tuple[int, int]]:
    """Units of a node, bottom-up: those of its children, neighbours merged while they fit."""
    if not node.children:
        return [(node.start, node.end)]
    out: list[tuple[int, int]] = []
    for child in node.children:
        for a, b in merged(child, room) if child.children else ((child.start, child.end),):
            if out and b - out[-1][0] <= room:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def pack(levels: np.ndarray, start: int, end: int, room: int) -> list[tuple[int, int]]:
    """Units of at most ``room`` tokens that make up [start, end) of a text."""
    return merged(tree(levels, start, end, room), room)


def split_text(text: str, bpe: ByteBpe, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(first token, end token, text) of each piece; nothing if the text fits."""
    ids = bpe.encode(text)
    if len(ids) <= limit:
        return []
    levels, ends = token_levels(text, bpe, ids)
    raw = text.encode("utf-8", "replace")

    def begin(cut: int, shared: int) -> int:
        start = max(0, cut - shared)
        while start and levels[start] == NEVER:
            start -= 1
        return start

    def piece(a: int, b: int) -> str:
        return raw[ends[a] : ends[b]].decode("utf-8")

    out: list[tuple[int, int, str]] = []
    # a character is four tokens at most, so an overlap has up to three more
    todo = pack(levels, 0, len(ids), limit - overlap - 3)[::-1]
    while todo:
        a, b = todo.pop()
        if not a and b <= overlap + 3 and todo:
            b = todo.pop()[1]  # the first piece has no overlap and holds that of the next
        start = begin(a, overlap) if a else 0
        got = piece(start, b)
        # a piece that starts or ends within a word may be longer by itself
        over = len(bpe.encode(got)) - limit
        if over > 0 and b - a > 1:
            units = pack(levels, a, b, max(1, min(b - a - over, (b - a + 1) // 2)))
            if len(units) > 1:
                todo += units[::-1]
                continue
        shared = overlap
        while over > 0 and shared:
            shared //= 2
            start = begin(a, shared)
            got = piece(start, b)
            over = len(bpe.encode(got)) - limit
        out.append((start, b, got))
    return out


def split_column(docs: DataFrame, path: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, piece_no, start_token, end_token, text) of every oversized text."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece_no int, start_token int, end_token int, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(vocab.value)
        for batch in batches:
            rows: list[tuple] = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                rows += [(i, k, a, b, p) for k, (a, b, p) in enumerate(split_text(t, bpe, limit, overlap))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(cols[0], pa.int64())),
                    *[pa.array(c, pa.int32()) for c in cols[1:4]],
                    pa.array(cols[4], pa.string()),
                ],
                ["doc_id", "piece_no", "start_token", "end_token", "text"],
            )

    text = F.col("text").cast("string")
    return docs.filter(F.octet_length(text) > limit).select("doc_id", text.alias("text")).mapInArrow(run, schema)


def split_ids(pieces: DataFrame) -> DataFrame:
    """The ids of the texts that had to be split."""
    return pieces.filter("piece_no = 0").select("doc_id")
