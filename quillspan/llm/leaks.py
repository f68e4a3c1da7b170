"""Evaluation texts leaking into training text (problem 9).

The evaluation items are normalised to words; the set of their n-grams is
broadcast. A scan of the documents looks each word window up in the set; where an
item has enough hits within one stretch the stretch is verified by the longest common
subsequence of words, and documents with a verified stretch are reported, dropped or
cleaned of it.

A repeat broken up so that few n-grams are left is found by its words, without loss: what
keeps ``SHARE`` of an item's words keeps at least ``RARE`` of all among its rarest
``1 - SHARE + RARE``, so a stretch with so many of these is verified in the same way. Of
few items of few words (``PRODUCT_PAIRS``), which their rarest words do not tell apart, all
words are counted instead, by products of matrices; both find the same.

Scale: one narrow pass over the documents, no shuffle. The broadcast is bounded: at most
``MAX_ITEMS`` items, a parameter (a held-out set is small; more are refused), indexed
once a worker in blocks of ``BLOCK_ITEMS``; each n-gram is twelve bytes.

Parameters: an item is given away where a stretch of at most ``STRETCH`` times its
words repeats ``SHARE`` of them in order. A stretch is verified at once if at least
``MIN_HITS`` of its windows of ``NGRAM`` words are in the set (fewer for items of
under 18 words: a quarter of their windows).

Defined results: null, empty and blank texts and items give no row; an item of
fewer than NGRAM words is found only as a whole; a document or item that occurs
twice is reported under each id.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.bpe import _ranges

NGRAM, MIN_HITS = 3, 4
SHARE, STRETCH = 0.5, 1.5
RARE = 0.25
#: Texts and blocks looked at side by side: working memory, not a limit of the result.
PART_CHARS, BLOCKS_AT_ONCE = 1 << 18, 1 << 14
#: Most (item, word) codes looked up in a table rather than a sorted list.
DENSE_PAIRS = 1 << 23
#: Most (item, word) codes counted by products of matrices, over steps of so many words.
PRODUCT_PAIRS, STEP = 1 << 20, 16
BLOCK_ITEMS = 20_000
#: Most evaluation items; a held-out set is small by its nature.
MAX_ITEMS = 1_000_000

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "һ": "h", "ӏ": "l", "α": "a", "β": "b", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
    "đ": "d", "ɑ": "a", "ƒ": "f", "æ": "ae", "œ": "oe",
}
_LOOK = str.maketrans(LOOKALIKES)
_NOTHING = re.compile("[­​-‏⁠-⁤﻿'’‘`´ʼ]")
_CUT = re.compile(r"[-‐‑­¬=][ \t]*(?:\r\n|[\n\r  ])[ \t>|#*/]*(?=[^\W\d_])")
_ESCAPES = re.compile(r"\\(?:u([0-9a-fA-F]{4})|[nrtfv])")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=1)
def _accents() -> re.Pattern:
    return re.compile(f"[{_ranges('M')}]")


class _Plain(dict):
    """Characters of decomposed text to what stands for them: none for accents and what is
    no part of a word, Latin letters for those that look like them."""

    def __missing__(self, c: int) -> str | int | None:
        x = chr(c)
        self[c] = None if _accents().match(x) or _NOTHING.match(x) else _LOOK.get(c, c)
        return self[c]


_PLAIN = _Plain()


def normal_words(text: str) -> list[str]:
    """Words without case, accents, punctuation, cuts, look-alikes and markup."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _ESCAPES.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    text = _CUT.sub("", text)
    if text.isascii():
        return _ASCII_WORD.findall(text.lower().replace("'", "").replace("`", ""))
    # the one of the characters left out that would be decomposed
    text = unicodedata.normalize("NFKD", text.replace("\u00b4", "")).casefold()
    return _WORD.findall(text.translate(_PLAIN))


def common_words(masks: dict[int, int], m: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    full = (1 << m) - 1
    v = full
    for w in words:
        if w in masks:
            u = v & masks[w]
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


class ItemSet:
    """Items of one block with their n-grams as sorted codes."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        self.ids: list[int] = []
        self.items: list[list[int]] = []
        self.vocab: dict[str, int] = {}
        for i, t in zip(ids, texts):
            words = normal_words(t) if t else []
            if words:
                self.ids.append(i)
                self.items.append([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words])
        self.base = len(self.vocab) + 1
        codes, owner = [], []
        for k, item in enumerate(self.items):
            c = np.unique(self.codes(np.array(item, np.int64)))
            codes.append(c)
            owner.append(np.full(len(c), k, np.int32))
        flat = np.concatenate(codes) if codes else np.empty(0, np.int64)
        own = np.concatenate(owner) if owner else np.empty(0, np.int32)
        order = np.argsort(flat, kind="stable")
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.owner = own[order]
        self.masks = []
        for item in self.items:
            mask: dict[int, int] = {}
            for i, w in enumerate(item):
                mask[w] = mask.get(w, 0) | (1 << i)
            self.masks.append(mask)
        size = np.array([len(x) for x in self.items], np.int64)
        self.size, self.limbs = size, -(-size // 64)
        # each word of each item: its code, how often and (by limbs) where it stands
        pairs = [(k * self.base + w, k, w) for k, mask in enumerate(self.masks) for w in sorted(mask)]
        self.pair_keys = np.array([x for x, _, _ in pairs], np.int64)
        self.pair_times = np.array([self.masks[k][w].bit_count() for _, k, w in pairs] + [0], np.int64)
        self.pair_row = np.full(len(pairs) + 1, -1, np.int64)
        self.places: dict[int, list[np.ndarray]] = {}
        low = (1 << 64) - 1
        for limbs in np.unique(self.limbs).tolist():
            at = [i for i, (_, k, _) in enumerate(pairs) if self.limbs[k] == limbs]
            self.pair_row[at] = np.arange(len(at))
            masks = [self.masks[pairs[i][1]][pairs[i][2]] for i in at]
            self.places[limbs] = [np.array([*[m >> 64 * j & low for m in masks], 0], np.uint64) for j in range(limbs)]
        self.dense: np.ndarray | None = None
        if len(self.items) * self.base <= DENSE_PAIRS:
            self.dense = np.full(len(self.items) * self.base, len(pairs), np.int32)
            self.dense[self.pair_keys] = np.arange(len(pairs))
        self.width, self.need = (STRETCH * size).astype(np.int64), -(-(size * SHARE) // 1).astype(np.int64)
        self.least_grams = np.maximum(1, np.minimum(MIN_HITS, (size - NGRAM + 1) // 4))
        # of its size - need + n rarest words a repeat keeps n
        self.least_words = np.maximum(1, (size * RARE).astype(np.int64))
        self.word_first: np.ndarray | None = None
        self.by_product = len(self.items) * self.base <= PRODUCT_PAIRS
        self._products: tuple[np.ndarray, list[tuple]] | None = None
        self.short = {}
        for k, item in enumerate(self.items):
            if len(item) < NGRAM:
                self.short.setdefault(tuple(item), []).append(k)

    def _rank(self, line: np.ndarray) -> None:
        """Lists of the items by their rarest words. Any order of rarity is exact; that of
        the first texts seen tells the words of the items from those of the language."""
        spread = np.bincount(line, minlength=self.base + 1)
        keys = [np.empty((0, 2), np.int64)]
        for k, item in enumerate(self.items):
            if len(item) >= NGRAM:
                rare = sorted(item, key=lambda w: (spread[w], w))[: len(item) - int(self.need[k]) + int(self.least_words[k])]
                keys.append(np.array([(w, k) for w in sorted(set(rare))], np.int64))
        flat = np.concatenate(keys)
        flat = flat[np.argsort(flat[:, 0], kind="stable")]
        self.word_first = np.searchsorted(flat[:, 0], np.arange(self.base + 2))
        self.word_owner = flat[:, 1].copy()

    def codes(self, words: np.ndarray) -> np.ndarray:
        """One integer for each window of NGRAM known words."""
        if len(words) < NGRAM:
            return np.empty(0, np.int64)
        n = len(words) - NGRAM + 1
        out = np.zeros(n, np.int64)
        known = np.ones(n, bool)
        for i in range(NGRAM):
            w = words[i : i + n]
            out = (out * self.base + w) % ((1 << 61) - 1)
            known &= w > 0
        return np.where(known, out, -1)

    def found(self, text: str) -> list[int]:
        """Indexes of the items that a text gives away."""
        return sorted({k for k, _, _ in self.stretches([normal_words(text)], whole=False)[0]})

    def stretches(self, texts: list[list[str]], whole: bool = True) -> list[list[tuple[int, int, int]]]:
        """(item, first word, end) of the stretches of each text that give items away: all
        that do not overlap (``whole``), or one for each item."""
        get = self.vocab.get
        lists = [[get(w, 0) for w in text] for text in texts]
        out: list[list[tuple[int, int, int]]] = [[(k, i, i + len(s)) for s, i in self._short(x) for k in self.short[s]] for x in lists]
        if not self.items:
            return out
        # one line of words with gaps wider than any stretch
        gap = int(self.width.max()) + NGRAM
        at = np.cumsum([0, *[len(x) + gap for x in lists]])
        line = np.zeros(at[-1], np.int64)
        for x, i in zip(lists, at):
            line[i : i + len(x)] = x
        sure: set[tuple[int, int]] = set()
        for k, runs in self._crowded(*self._grams(line), self.least_grams):
            for run in runs:
                d = int(np.searchsorted(at, run[0], side="right")) - 1
                if (d, k) not in sure and (got := self._given(k, [(run[0] - at[d], run[1] - at[d])], lists[d], whole)):
                    sure.add((d, k))
                    if not whole:
                        out[d] += got
        # what has too few n-grams left is found by its words alone, which is exact
        who, low, high = self._blocks(line) if self.by_product else self._listed(line)
        if len(who):
            who, first, last = self._counted(who, low, high, line)
            if not whole:
                doc = np.searchsorted(at, first, side="right") - 1
                open_ = np.array([(d, k) not in sure for d, k in zip(doc.tolist(), who.tolist())], bool)
                who, first, last = who[open_], first[open_], last[open_]
            doc = np.searchsorted(at, first, side="right") - 1
            for i, a, b in self._dense(who, first, last, line):
                d, k = int(doc[i]), int(who[i])
                got = self._given(k, [(a - at[d], b - at[d])], lists[d], whole, exact=True)
                out[d] += got if whole or (d, k) not in sure else []
                if got:
                    sure.add((d, k))
        return [_joined(x) for x in out]

    def _dense(self, who: np.ndarray, first: np.ndarray, last: np.ndarray, line: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(run, first, end) of the blocks of runs that share enough words in order with
        their item to hold a stretch: blocks of one and a half stretches, half a stretch
        apart, so that each stretch lies in one."""
        width = self.width[who]
        step = np.maximum(width // 2, 1)
        low = first
        n = np.maximum((np.minimum(last - width + 1, len(line)) - low + step - 1) // step, 1)
        run = np.repeat(np.arange(len(who)), n)
        start = low[run] + step[run] * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        size = np.minimum(width[run] + step[run] + 1, len(line) - start)
        for limbs in np.unique(self.limbs[who]):
            part = np.flatnonzero(self.limbs[who[run]] == limbs)
            for a in range(0, len(part), BLOCKS_AT_ONCE):
                at = part[a : a + BLOCKS_AT_ONCE]
                k = who[run[at]]
                dense = at[self._in_order(k, start[at], size[at], line, int(limbs)) >= self.need[k]]
                yield from zip(run[dense].tolist(), start[dense].tolist(), (start[dense] + size[dense]).tolist())

    def _in_order(self, k: np.ndarray, start: np.ndarray, size: np.ndarray, line: np.ndarray, limbs: int) -> np.ndarray:
        """Longest common subsequence of items and stretches of the line, bit-parallel over
        the items' words and side by side over the pairs."""
        table = self.places[limbs]
        v = np.full((limbs, len(k)), ~np.uint64(0), np.uint64)
        for t in range(int(size.max())):
            word = np.where(t < size, line[np.minimum(start + t, len(line) - 1)], 0)
            row = self.pair_row[self._pair(k, word)]
            carry = np.uint64(0)
            for j in range(limbs):
                mask = table[j][row]
                u = v[j] & mask
                s = v[j] + u
                over = s < u
                s += carry
                if j + 1 < limbs:
                    carry = (over | (s < carry)).astype(np.uint64)
                np.bitwise_and(v[j], ~mask, out=v[j])
                v[j] |= s
        kept = np.zeros(len(k), np.int64)
        for j in range(limbs):
            own = np.clip(self.size[k] - 64 * j, 0, 64)
            low = np.where(own == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(own, 63).astype(np.uint64)) - np.uint64(1))
            kept += np.bitwise_count(~v[j] & low)
        return kept

    def _pair(self, k: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of (item, word) among the pairs; one past them for a word it has not."""
        key = k * self.base + word
        if self.dense is not None:
            return self.dense[key]
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == key, at, len(self.pair_keys))

    def _short(self, words: list[int]) -> Iterator[tuple[tuple[int, ...], int]]:
        for size in {len(s) for s in self.short}:
            for i in range(len(words) - size + 1):
                if (s := tuple(words[i : i + size])) in self.short:
                    yield s, i

    def _grams(self, arr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, position) of every window of the text in the set of n-grams."""
        codes = self.codes(arr)
        if not len(self.grams) or not len(codes):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        slot = np.minimum(np.searchsorted(self.grams, codes), len(self.grams) - 1)
        at = np.flatnonzero(self.grams[slot] == codes)
        return _spread(at, self.first[slot[at]], self.first[slot[at] + 1], self.owner)

    def _prefix(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, position) of every word of the line among the rarest ones of an item."""
        at = np.flatnonzero(self.word_first[line + 1] > self.word_first[line])
        return _spread(at, self.word_first[line[at]], self.word_first[line[at] + 1], self.word_owner)

    def _listed(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, low, high) of the parts of the line that hold all stretches with enough of
        an item's rarest words."""
        if self.word_first is None:
            self._rank(line)
        runs = [(k, a, b) for k, part in self._crowded(*self._prefix(line), self.least_words, ends=False) for a, b in part]
        who, first, last = np.array(runs, np.int64).reshape(-1, 3).T
        # a stretch with hits starts at most its length before the first of them
        return who, np.maximum(first - self.width[who], 0), np.minimum(last + self.width[who] + 1, len(line))

    def _tables(self) -> tuple[np.ndarray, list[tuple]]:
        """The columns of words, those that an item has most often first, and (steps that hold
        a stretch, items, how many columns any of them has j times or more for each j,
        (column, j) by items) of the items whose stretches span as many steps."""
        if self._products is None:
            steps = (self.width + STEP - 2) // STEP + 1
            steps[self.size < NGRAM] = 0
            times = np.zeros((len(self.items), self.base), np.int64)
            for k in np.flatnonzero(steps).tolist():
                times[k] = np.bincount(self.items[k], minlength=self.base)
            order = np.argsort(-times.max(axis=0), kind="stable")
            column, times, parts = np.argsort(order), times[:, order], []
            for n in np.unique(steps[steps > 0]).tolist():
                some = np.flatnonzero(steps == n)
                most = times[some].max(axis=0)
                size = [int(np.flatnonzero(most >= j)[-1]) + 1 for j in range(1, int(most.max()) + 1)]
                has = np.concatenate([(times[some, :c] >= j).T for j, c in enumerate(size, 1)])
                parts.append((n, some, size, has.astype(np.float32)))
            self._products = (column, parts)
        return self._products

    def _blocks(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, low, high) of the parts of the line that hold all stretches with as many
        words as a repeat needs: of every block of steps that holds any stretch starting in
        its first one, the words in common with each item (repeated ones as often as both
        have them) are a product of two matrices."""
        column, tables = self._tables()
        at = np.flatnonzero(line)
        n = len(line) // STEP + 1
        known = np.concatenate([[0], np.cumsum(np.bincount(at // STEP, minlength=n))])
        # sums that wrap around still differ by what a block holds
        kind = np.min_scalar_type(STEP * max([t[0] for t in tables], default=1))
        counts = np.bincount(at // STEP * self.base + column[line[at]], minlength=n * self.base).astype(kind)
        total = np.zeros((n + 1, self.base), kind)
        np.cumsum(counts.reshape(n, self.base), axis=0, dtype=kind, out=total[1:])
        out = [np.empty((3, 0), np.int64)]
        for steps, items, size, has in tables:
            end = np.minimum(np.arange(n) + steps, n)
            need = self.need[items]
            full = np.flatnonzero(known[end] - known[:-1] >= need.min())
            block = total[end[full]] - total[full]
            seen = np.empty((len(full), len(has)), bool)
            for j, c in enumerate(size, 1):
                a = sum(size[: j - 1])
                np.greater_equal(block[:, :c], j, out=seen[:, a : a + c])
            k, b = np.nonzero((seen.astype(np.float32) @ has >= need).T)
            if not len(k):
                continue
            b = full[b]
            # blocks that overlap are one part
            step = np.flatnonzero((np.diff(k) != 0) | (np.diff(b) > steps)) + 1
            begin, last = np.concatenate([[0], step]), np.concatenate([step, [len(k)]]) - 1
            out.append(np.stack([items[k[begin]], b[begin] * STEP, np.minimum((b[last] + steps) * STEP, len(line))]))
        return tuple(np.concatenate(out, axis=1))

    def _counted(self, who: np.ndarray, low: np.ndarray, high: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first, last) of the parts of runs where as many words as a repeat needs lie
        within a stretch, each counted as often as the item has it."""
        none = np.empty(0, np.int64)
        if not len(who):
            return none, none, none
        size = high - low
        run = np.repeat(np.arange(len(who), dtype=np.int32), size)
        pos = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
        pair = self._pair(np.repeat(who, size), line[pos])
        keep = np.flatnonzero(pair < len(self.pair_keys))
        run, pos, pair = run[keep].astype(np.int64), pos[keep], pair[keep].astype(np.int64)
        # a word counts for the stretches that start after the one it would repeat too often
        group = run * (len(self.pair_keys) + 1) + pair
        order = np.argsort(group, kind="stable")
        group, there = group[order], pos[order]
        before = np.arange(len(order)) - self.pair_times[pair[order]]
        again = (before >= 0) & (group[before] == group)
        left = np.empty(len(order), np.int64)
        left[order] = np.where(again, there[before], -1)
        width = self.width[who[run]]
        left = np.maximum(left, pos - width - 1)
        span = len(line) + 1
        starts = run * span + pos
        n = np.searchsorted(np.sort(run * span + left), starts) - np.arange(len(starts))
        full = np.flatnonzero(n >= self.need[who[run]])
        if not len(full):
            return none, none, none
        run, pos, width = run[full], pos[full], width[full]
        step = np.flatnonzero((np.diff(run) != 0) | (np.diff(pos) > width[1:])) + 1
        begin, end = np.concatenate([[0], step]), np.concatenate([step, [len(run)]]) - 1
        return who[run[begin]], pos[begin], pos[end] + width[end]

    def _crowded(self, who: np.ndarray, pos: np.ndarray, least: np.ndarray, ends: bool = True) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(item, runs) where enough hits of an item lie within a stretch: from the first hit of
        a run to the end of the last such stretch, or to its start."""
        if not len(who):
            return
        order = np.lexsort((pos, who))
        who, pos = who[order], pos[order]
        end = np.arange(len(who)) + least[who] - 1
        near = np.minimum(end, len(who) - 1)
        start = np.flatnonzero((end < len(who)) & (who[near] == who) & (pos[near] - pos <= self.width[who]))
        if not len(start):
            return
        yield from _runs(who[start], pos[start], pos[near[start]] if ends else pos[start], self.width)

    def _given(self, k: int, runs: list[tuple[int, int]], words: list[int], whole: bool, exact: bool = False) -> list[tuple[int, int, int]]:
        """The verified stretches of runs of hits, or within exact bounds."""
        m, width, need, masks = len(self.items[k]), int(self.width[k]), int(self.need[k]), self.masks[k]
        out: list[tuple[int, int, int]] = []
        for first, last in runs:
            lo, hi = (max(0, first), min(len(words), last)) if exact else (max(0, first - width), min(len(words), last + NGRAM + width))
            region = words[lo:hi]
            if common_words(masks, m, region) < need:
                continue
            starts = [i for i, w in enumerate(region) if w in masks]
            # the fullest window first: most leaks end the search at once
            there = np.zeros(len(region) + 1, np.int64)
            there[1:][starts] = 1
            total = np.cumsum(there)
            inside = {i: int(total[min(i + width, len(region))] - total[i]) for i in starts}
            taken: list[tuple[int, int]] = []
            for i in sorted(starts, key=lambda i: (-inside[i], i)):
                if inside[i] < need:
                    break
                if any(i < e and i + width > b for b, e in taken):
                    continue
                if common_words(masks, m, region[i : i + width]) >= need:
                    taken.append(self._tight(k, region, i, min(i + width, len(region))))
                    if not whole:
                        return [(k, lo + taken[0][0], lo + taken[0][1])]
            out += [(k, lo + b, lo + e) for b, e in taken]
        return out

    def _tight(self, k: int, region: list[int], i: int, j: int) -> tuple[int, int]:
        """The stretch without the words at its ends that the repeat does not need."""
        m, masks = len(self.items[k]), self.masks[k]
        most = common_words(masks, m, region[i:j])
        lo, hi = i, j
        while lo < hi:  # the shortest head that keeps them all
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if common_words(masks, m, region[i:mid]) >= most else (mid + 1, hi)
        j, lo, hi = lo, i, lo
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if common_words(masks, m, region[mid:j]) >= most else (lo, mid - 1)
        return lo, j


def _joined(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches in order, those of one item that overlap as one."""
    out: list[tuple[int, int, int]] = []
    for k, a, b in sorted(found):
        if out and out[-1][0] == k and a < out[-1][2]:
            out[-1] = (k, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((k, a, b))
    return out


def _runs(who: np.ndarray, pos: np.ndarray, end: np.ndarray, width: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Starts in order of item and position as runs (first, last end); those further apart
    than a stretch belong to different runs."""
    step = np.flatnonzero((np.diff(who) != 0) | (np.diff(pos) > width[who[1:]])) + 1
    last, runs = -1, []
    for a, b in zip([0, *step.tolist()], [*step.tolist(), len(who)]):
        k = int(who[a])
        if k != last and runs:
            yield last, runs
            runs = []
        last = k
        runs.append((int(pos[a]), int(end[b - 1])))
    yield last, runs


def _spread(at: np.ndarray, first: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of each entry of the lists [first, end) met at each position."""
    size = end - first
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return owner[np.repeat(first, size) + step], np.repeat(at, size)


def leaked(docs: DataFrame, items: DataFrame, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, eval_id) of each document and item it gives away."""
    return _scanned(docs, items, block, _pair_rows, "eval_id bigint").distinct()


def leaked_spans(docs: DataFrame, items: DataFrame, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, eval_id, start_char, end_char) of every stretch that gives an item away."""
    return _scanned(docs, items, block, _span_rows, "eval_id bigint, start_char int, end_char int")


def without_spans(docs: DataFrame, items: DataFrame, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, text, n_removed): the documents with every such stretch taken out, and how
    many characters that were; null texts stay null."""
    return _scanned(docs, items, block, _clean_rows, "text string, n_removed int", nulls=True)


def _scanned(docs: DataFrame, items: DataFrame, block: int, rows_of, columns: str, nulls: bool = False) -> DataFrame:
    """One pass over the documents; each task goes through the items block by block."""
    spark = docs.sparkSession
    rows = items.select("eval_id", F.col("text").cast("string")).filter("text is not null and eval_id is not null")
    got = sorted(map(tuple, rows.limit(MAX_ITEMS + 1).collect()))
    if len(got) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} evaluation items: scan them in parts")
    shared = spark.sparkContext.broadcast([got[a : a + block] for a in range(0, len(got), block)])
    kind = docs.schema["doc_id"].dataType.simpleString()
    scan = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scan = scan if nulls else scan.filter("text is not null")
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _sets_of(shared)
        types = {"eval_id": pa.int64(), "text": pa.string()}
        for batch in batches:
            at, rows = [], []
            texts = batch.column(1).to_pylist()
            for a, part in _parts(texts):
                for i, row in rows_of(sets, part):
                    at.append(a + i)
                    rows.append(row)
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, types.get(n, pa.int32())) for c, n in zip(cols, names)]], ["doc_id", *names]
            )

    return scan.mapInArrow(run, f"doc_id {kind}, {columns}")


_built: list = [None, None]


def _sets_of(shared) -> list[ItemSet]:
    """The item sets of a worker, built once."""
    if _built[0] is not shared.value:
        _built[:] = [shared.value, [ItemSet([i for i, _ in part], [t for _, t in part]) for part in shared.value]]
    return _built[1]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about PART_CHARS characters with the place of each."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PART_CHARS:
            yield a, texts[a : i + 1]
            a, size = i + 1, 0
    if a < len(texts):
        yield a, texts[a:]


def _pair_rows(sets: list[ItemSet], texts: list[str | None]) -> Iterator[tuple[int, tuple]]:
    words = [normal_words(t) if t else [] for t in texts]
    for items in sets:
        for i, found in enumerate(items.stretches(words, whole=False)):
            for k in sorted({k for k, _, _ in found}):
                yield i, (items.ids[k],)


def _span_rows(sets: list[ItemSet], texts: list[str | None]) -> Iterator[tuple[int, tuple]]:
    words = [normal_words(t) if t else [] for t in texts]
    pieces: dict[int, list[tuple[int, int]]] = {}
    for items in sets:
        for i, found in enumerate(items.stretches(words)):
            for k, a, b in found:
                if i not in pieces:
                    pieces[i] = [m.span() for m in re.finditer(r"\S+", texts[i])]
                yield i, (items.ids[k], *char_span(texts[i], pieces[i], a, b))


def _clean_rows(sets: list[ItemSet], texts: list[str | None]) -> Iterator[tuple[int, tuple]]:
    spans: dict[int, list[tuple[int, int]]] = {}
    for i, (_, a, b) in _span_rows(sets, texts):
        spans.setdefault(i, []).append((a, b))
    for i, text in enumerate(texts):
        out, at, gone = [], 0, 0
        for a, b in sorted(spans.get(i, ())):
            out.append(text[at : max(a, at)])
            gone += max(b, at) - max(a, at)
            at = max(at, b)
        yield i, ("".join(out) + text[at:] if out else text, gone)


def char_span(text: str, pieces: list[tuple[int, int]], a: int, b: int) -> tuple[int, int]:
    """(start, end) of the characters that hold the normal words a to b of a text, whole
    pieces between white space. Words grow with the text, so both ends are searched."""

    def until(n: int) -> int:
        """Fewest pieces whose text holds n words."""
        lo, hi = 0, len(pieces)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if mid and len(normal_words(text[: pieces[mid - 1][1]])) >= n else (mid + 1, hi)
        return lo

    return pieces[until(a + 1) - 1][0], pieces[until(b) - 1][1]


def without_leaks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that give nothing away."""
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti")


def leak_report(found: DataFrame) -> DataFrame:
    """How many documents give each item away."""
    return found.groupBy("eval_id").agg(F.count("*").alias("n_docs"))
