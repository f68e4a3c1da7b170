"""Main content of web pages (problem 1).

A page's markup is read into a sequence of leaves: the runs of text between block
boundaries, whatever lines they stand on (a page on one line has the same leaves as the
same page set out line by line). A recurrent labeller reads, for each leaf, hashed
tag-path and hashed word vectors and a few measures of its shape; a bidirectional LSTM in
numpy carries the context of the whole page, so that the same words are kept in an
article and dropped in a sidebar. The weights are trained by ``boilerplate_train`` and
shipped with the package (well under a megabyte); they are all that is broadcast.

Scale: the first delivery of each page is chosen by its key and time alone; whole pages
then pass once. Pages of like length are run together in blocks of at most
``BLOCK_CELLS`` leaves, so memory does not depend on the longest page beyond its own text.

Defined results: null, empty and blank html give no lines (``article_text`` reads the
page's ``text`` instead, a leaf a line); a page fetched again is the same page and gives
its lines once (first delivery, null times last); lines are split at the line feed and
counted from 1; lines without visible text are never reported; script, style, comments
and the like are no text.
"""

from __future__ import annotations

import html
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD_SLOTS, PATH_SLOTS = 4096, 512
BLOCK_CELLS = 20_000
WEIGHTS = os.path.join(os.path.dirname(__file__), "boilerplate.npz")

_TAG = re.compile(r"<!--|<(/?)([a-zA-Z][a-zA-Z0-9-]*)[^<>]*?(/?)>")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
# Elements without content, without visible text, and within a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template title noscript svg iframe object textarea select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small strong sub sup td th time tt u var wbr".split())
SHAPES = 15


class Leaf:
    """A run of visible text: the lines it stands on, its text, tag path and share of link text."""

    __slots__ = ("lines", "text", "path", "linked")

    def __init__(self, lines: tuple[int, ...], text: str, path: tuple[str, ...], linked: float) -> None:
        self.lines, self.text, self.path, self.linked = lines, text, path, linked


def leaves(page: str) -> list[Leaf]:
    """The leaf sequence of a page."""
    out: list[Leaf] = []
    stack: list[str] = []
    words: list[str] = []
    lines: list[int] = []
    own: tuple[str, ...] = ()
    linked = total = 0
    line, pos = 1, 0
    alone: list[int] = []  # depths of spans that open a leaf of their own

    def flush() -> None:
        nonlocal linked, total, own
        if words:
            blocks = [t for t in stack if t not in INLINE]
            out.append(Leaf(tuple(sorted(set(lines))), " ".join(words), (*blocks[-6:], "!", *own[:3]), linked / total))
        words.clear(), lines.clear()
        own, linked, total = (), 0, 0

    def read(text: str) -> None:
        nonlocal line, linked, total, own
        for i, part in enumerate(text.split("\n")):
            if i:
                line += 1
                if "pre" in stack:
                    flush()
            if not part or part.isspace():
                continue
            got = html.unescape(part).split()
            if got:
                if not words:
                    own = tuple(t for t in stack if t in INLINE)
                words.extend(got)
                lines.append(line)
                size = sum(map(len, got))
                total += size
                linked += size if "a" in stack else 0

    for m in _TAG.finditer(page):
        if m.start() < pos:
            continue
        read(page[pos : m.start()])
        pos = m.end()
        line += page.count("\n", m.start(), pos)
        if m[2] is None:
            end = page.find("-->", pos)
            end = len(page) if end < 0 else end + 3
            line += page.count("\n", pos, end)
            pos = end
            continue
        tag = m[2].lower()
        if tag in HIDDEN and not m[1] and not m[3]:
            close = re.compile(f"</{tag}\\b[^<>]*>", re.IGNORECASE).search(page, pos)
            end = close.end() if close else len(page)
            line += page.count("\n", pos, end)
            pos = end
        elif tag == "span":
            if not m[1]:
                if not words:
                    alone.append(len(stack))
                stack.append(tag)
            elif tag in stack:
                if alone and alone[-1] >= len(stack) - 1 - stack[::-1].index(tag):
                    flush()
                    alone.pop()
                while stack.pop() != tag:
                    pass
        elif tag in VOID or m[3]:
            if tag not in INLINE:
                flush()
        elif tag in INLINE:
            if not m[1]:
                stack.append(tag)
            elif tag in stack:
                while stack.pop() != tag:
                    pass
        else:
            flush()
            if not m[1]:
                stack.append(tag)
            elif tag in stack:
                while stack.pop() != tag:
                    pass
            alone = [d for d in alone if d < len(stack)]
    read(page[pos:])
    flush()
    return out


def text_leaves(text: str) -> list[Leaf]:
    """The leaf sequence of a page of which only the visible text is there."""
    return [Leaf((i,), " ".join(t.split()), ("text", "!"), 0.0) for i, t in enumerate(text.split("\n"), 1) if t.strip()]


def _slot(text: str, slots: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % slots


class Features:
    """Of a leaf sequence: word slots of all leaves in a row and where each leaf's end,
    slots of first words and paths, and shapes."""

    __slots__ = ("words", "ends", "first", "paths", "shape")

    def __init__(self, words, ends, first, paths, shape) -> None:
        self.words, self.ends, self.first, self.paths, self.shape = words, ends, first, paths, shape


_hashed: dict[str, int] = {}


def _hash(token: str) -> int:
    h = _hashed.get(token)
    if h is None:
        if len(_hashed) > 1 << 18:
            _hashed.clear()
        h = _hashed[token] = zlib.crc32(token.encode("utf-8", "replace"))
    return h


def features(page: list[Leaf], title: str = "") -> Features:
    """Features of a leaf sequence, of all words of each leaf."""
    n = len(page)
    paths = np.zeros((n, 3), np.int32)
    first = np.zeros(n, np.int32)
    shape = np.zeros((n, SHAPES), np.float32)
    flat, ends = [], np.zeros(n, np.int64)
    size = 0
    for i, leaf in enumerate(page):
        t = leaf.text
        tokens = ["0" if w.isdigit() else w for w in _TOKEN.findall(t.lower())]
        h = np.array([_hash(w) for w in tokens], np.uint64)
        # words and pairs of neighbours
        both = np.concatenate([h, (h[:-1] * np.uint64(31) + h[1:]) ^ np.uint64(0x9E37)]) if len(h) else h
        flat.append((both % np.uint64(WORD_SLOTS - 1)).astype(np.int32) + 1)
        size += len(both)
        ends[i] = size
        first[i] = 1 + _slot("^" + " ".join(tokens[:2]), WORD_SLOTS - 1)
        bar = leaf.path.index("!")
        keys = ("/".join(leaf.path), "up " + "/".join(leaf.path[:bar]), "own " + "/".join(leaf.path[bar:]))
        paths[i] = [1 + _slot(k, PATH_SLOTS - 1) for k in keys]
        count = max(len(tokens), 1)
        shape[i] = (
            np.log1p(len(t)) / 6,
            leaf.linked,
            t[-1] in ".!?:;",
            t.endswith(("…", "...")),
            sum(c.isdigit() for c in t) / len(t),
            sum(t.count(c) for c in ".,;") / count,
            t.count("|") / count,
            (i + 1) / n,
            min(n, 200) / 200,
            len(leaf.path) / 9,
            t[0].isupper(),
            i == 0,
            count <= 3,
            bool(title) and t == title,
            sum(t.count(c) for c in (". ", "! ", "? ")) > 0,
        )
    return Features(np.concatenate(flat) if flat else np.empty(0, np.int32), ends, first, paths, shape)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def inputs(w: dict[str, np.ndarray], f: Features) -> np.ndarray:
    """Input vectors: mean vector of all words, those of the first words and the paths, shapes."""
    sums = np.concatenate([np.zeros((1, w["E"].shape[1]), w["E"].dtype), np.cumsum(w["E"][f.words], 0, dtype=np.float64)])
    starts = np.concatenate([[0], f.ends[:-1]])
    bag = ((sums[f.ends] - sums[starts]) / np.maximum(f.ends - starts, 1)[:, None]).astype(np.float32)
    return np.concatenate([bag, w["E"][f.first], *[w["P"][f.paths[:, k]] for k in range(3)], f.shape], -1)


def lstm(x: np.ndarray, mask: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False):
    """One direction over (time, batch, input); masked steps carry the state."""
    steps, batch, _ = x.shape
    size = wh.shape[0]
    h, c = np.zeros((batch, size), x.dtype), np.zeros((batch, size), x.dtype)
    pre = x @ wx + b
    out = np.zeros((steps, batch, size), x.dtype)
    trace = []
    for t in range(steps):
        z = pre[t] + h @ wh
        i, f, o = sigmoid(z[:, :size]), sigmoid(z[:, size : 2 * size]), sigmoid(z[:, 2 * size : 3 * size])
        g = np.tanh(z[:, 3 * size :])
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        h_new = o * tc
        m = mask[t][:, None]
        if keep:
            trace.append((h, c, i, f, o, g, tc))
        h, c = m * h_new + (1 - m) * h, m * c_new + (1 - m) * c
        out[t] = h
    return (out, trace) if keep else out


def scores(w: dict[str, np.ndarray], pages: list[Features]) -> list[np.ndarray]:
    """Probability that each leaf belongs to the article, for pages of like length."""
    longest, batch = max(len(p.ends) for p in pages), len(pages)
    mask = np.zeros((longest, batch), np.float32)
    x = np.zeros((longest, batch, w["f_x"].shape[0]), np.float32)
    for j, f in enumerate(pages):
        x[: len(f.ends), j] = inputs(w, f)
        mask[: len(f.ends), j] = 1
    fwd = lstm(x, mask, w["f_x"], w["f_h"], w["f_b"])
    bwd = lstm(x[::-1], mask[::-1], w["b_x"], w["b_h"], w["b_b"])[::-1]
    z = np.concatenate([fwd, bwd, x], -1) @ w["o_w"] + w["o_b"]
    p = sigmoid(z[..., 0])
    return [p[: len(f.ends), j] for j, f in enumerate(pages)]


def load_weights(path: str = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def heading(title: str | None, source: str | None = None) -> str:
    """The page's own part of a title that also names the site."""
    parts = re.split(r"\s+[–—|-]\s+", title or "")
    return " ".join((" – ".join(parts[:-1]) if len(parts) > 1 else parts[0]).split())


def label_pages(w: dict[str, np.ndarray], pages: list[tuple[str | None, str | None]], threshold: float = 0.5, texts: list[str | None] | None = None):
    """For each (html, title): [(leaf, kept)]. Where there is no html, a text may stand for it."""
    seqs = [leaves(h) if h else text_leaves(texts[i]) if texts and texts[i] else [] for i, (h, _) in enumerate(pages)]
    feats = [features(s, heading(t)) for s, (_, t) in zip(seqs, pages)]
    out: list[list[tuple[Leaf, bool]]] = [[] for _ in pages]
    order = sorted((i for i, s in enumerate(seqs) if s), key=lambda i: len(seqs[i]))
    block: list[int] = []

    def flush() -> None:
        for i, p in zip(block, scores(w, [feats[i] for i in block])):
            out[i] = [(leaf, bool(k)) for leaf, k in zip(seqs[i], p > threshold)]
        block.clear()

    for i in order:
        if block and len(seqs[i]) * (len(block) + 1) > BLOCK_CELLS:
            flush()
        block.append(i)
    if block:
        flush()
    return out


def _pages(rows: DataFrame) -> DataFrame:
    """First deliveries, chosen by key and time; of equal times one by the hash of its text.
    Only then are whole pages read: they are joined to the chosen keys."""
    at = F.struct(F.col("loaded_at").isNull().alias("late"), "loaded_at", F.xxhash64("html", "title", "text").alias("h"))
    rows = rows.filter("page_id is not null").select(
        "page_id", at.alias("at"), *[F.col(c).cast("string").alias(c) for c in ("html", "title", "text")]
    )
    first = rows.groupBy("page_id").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    # only keys that came more than once meet in a shuffle of pages
    again = first.filter("n > 1").select("page_id", "at")
    once = rows.join(again.select("page_id"), "page_id", "left_anti")
    twice = rows.join(again, ["page_id", "at"], "left_semi").dropDuplicates(["page_id"])
    return once.unionByName(twice.select(*once.columns)).select("page_id", "html", "title", "text")


def article_lines(rows: DataFrame, weights: str = WEIGHTS, with_text: bool = False) -> DataFrame:
    """(page_id, line_no, text) of every line of the article of each page; with ``with_text``
    also of pages that have no html but a text."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(load_weights(weights))
    kind = rows.schema["page_id"].dataType.simpleString()
    pages = _pages(rows)
    pages = pages if with_text else pages.filter("html is not null").withColumn("text", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                col = [part.column(i).to_pylist() for i in (1, 2, 3)]
                got = label_pages(shared.value, list(zip(col[0], col[1])), texts=col[2])
                at, nos, texts = [], [], []
                for i, page in enumerate(got):
                    # a line is the article's if a leaf on it is; a leaf's text stands on its first
                    mine: dict[int, list[str]] = {}
                    for leaf, kept in page:
                        if kept:
                            mine.setdefault(leaf.lines[0], []).append(leaf.text)
                            for no in leaf.lines[1:]:
                                mine.setdefault(no, [])
                    for no in sorted(mine):
                        at.append(i), nos.append(no), texts.append("\n".join(mine[no]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(nos, pa.int32()), pa.array(texts, pa.string())],
                    ["page_id", "line_no", "text"],
                )

    return pages.mapInArrow(run, f"page_id {kind}, line_no int, text string")


def article_text(rows: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """(page_id, text): the main body of each page that has one, a line for each leaf."""
    lines = article_lines(rows, weights, with_text=True).filter("text <> ''")
    lines = lines.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return lines.select("page_id", F.array_join(F.col("l.text"), "\n").alias("text"))
