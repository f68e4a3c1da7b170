"""Noise in text from scanned pages (problem 3).

Lines that belong to the page (running heads and feet, page numbers, rules, stamps)
are told by what repeats at the edges of an item's pages and by numbers that run
with them. The rest becomes one character stream without lines, decoded jointly
into words: a Viterbi search over a trie of known words allows words split by a
blank, run together, cut by a hyphen at a line end, and misread characters, each at
a cost. The search is skipped where its outcome is certain: a copy of a known word is
cheaper than any misreading of another, so it runs over the windows of the stream, line
ends kept, around all that is not a known word and around known words that joined make up
a known word; within ``CONTEXT`` tokens of these, known words are cheap arcs and may be
pieces of a split word. Cuts that the words alone settle (the joined or the hyphenated
form is known) are settled by rule. Paragraph boundaries are the cheapest set under a
dynamic program over the gaps between lines.

Scale: pages are grouped by item in blocks of ``BLOCK_PAGES`` with one page of
context on either side, so an item of any length is spread over tasks. The words
broadcast are those making up at least one in ``WORD_SHARE`` of the clean text, so
there are at most that many.

Defined results: null and blank bodies have no lines; repeated deliveries of a page
count once (the first); lines are split at the line feed and counted from 1; pages
with null item_id or ordinal are no pages; chunks of other kinds are left alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_PAGES = 64
WORD_SHARE = 1_000_000
HYPHENS = "-‐‑­¬="

# What a printed form is misread as.
MISREADINGS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("l", "i"), ("i", "l"), ("5", "s"),
    ("6", "b"), ("8", "b"), ("9", "g"), ("@", "a"), ("¢", "c"), ("ſ", "s"), ("é", "e"), ("c", "e"), ("e", "c"), ("i", "r"),
    ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("m", "ni"), ("ii", "u"), ("cl", "d"),
    ("d", "cl"), ("vv", "w"), ("ri", "n"), ("n", "ri"), ("v", "y"), ("y", "v"), ("u", "n"), ("n", "u"), ("q", "g"), ("$", "s"),
    ("3", "e"), ("4", "a"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("li", "h"), ("h", "li"), ("ln", "m"), ("nn", "m"), ("a", "o"), ("o", "a"), ("r", "i"),
    ("0", "O"), ("s", "ſ"), ("tl", "d"), ("ci", "a"), ("(", "c"), ("ä", "a"), ("è", "e"), ("ö", "o"), ("ü", "u"), ("l", "t"),
)
_BY_SEEN: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _seen, _true in MISREADINGS:
    _BY_SEEN[_seen[0]].append((_seen, _true))

# Digits as they are misread in page numbers.
_DIGITS = str.maketrans("lIiOoSsZzBbGgqT|!", "11100552286699711"[:17])
_ROMAN = re.compile(r"[ivxlcdm]+", re.IGNORECASE)
_RULE = re.compile(r"[\s\-_=~*.—–·•]+")
_STAMP = re.compile(r"(?:s[cęe¢]an [o0]f \w+ .{0,3}r[cbh¢e]+.{0,2}[hb][il!1]ve?, s.{2,6} \S+|pr[il!1]n\w+ [il!1]n \S+|\S{1,4}-\S{2,5}/\S+)", re.IGNORECASE)
_PART = re.compile(r"[A-Z]{1,4}-\d+")
_PLAIN = re.compile(r"\d[\d.,:/%]*|[\d.,:;/%]+|\d+(?:st|nd|rd|th)")
_EDGE = "\"'“”‘’()[]{}.,;:?!…"

# Costs of the decoder, in about the negative log of their odds.
MISREAD, SPLIT, RUN_TOGETHER, CUT, BREAK, UNKNOWN, UNKNOWN_CHAR = 2.0, 2.5, 3.0, 0.3, 3.5, 5.0, 0.4
MOST = 9.0
#: Known tokens on either side of an unknown one that are decoded with it, and the most
#: pieces of a split word that the costs allow.
CONTEXT, PIECES = 3, 4


class Words:
    """Known words as a trie, with the cost of each."""

    def __init__(self, counts: dict[str, int]) -> None:
        total = sum(counts.values()) or 1
        self.counts = counts
        self.common = frozenset(sorted(counts, key=lambda w: (-counts[w], w))[:30]) - {"of"}
        self.trie: dict = {}
        for w, n in counts.items():
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = 0.12 * -math.log(n / total)
        self.rarest = 0.12 * -math.log(1 / total)
        self._found: dict[str, tuple[str, tuple[int, ...]] | None] = {}

    def cost(self, n: int) -> float:
        return self.rarest - 0.12 * math.log(n)

    def known(self, word: str) -> bool:
        w = word.lower().replace("’", "'")
        if w in self.counts:
            return True
        if w.endswith("'s") and w[:-2] in self.counts:
            return True
        return "-" in w and all(p in self.counts for p in w.split("-") if p)

    def from_here(self, text: str, start: int) -> list[tuple[int, float, str, tuple[int, ...]]]:
        """(end, cost, word, misread positions) of every known word that the
        characters from ``start`` may be."""
        out: dict[tuple[int, str], tuple[float, tuple[int, ...]]] = {}
        stack = [(self.trie, start, 0.0, "", ())]
        n = len(text)
        while stack:
            node, i, cost, word, bad = stack.pop()
            if "" in node and word:
                end_cost = cost + node[""]
                if i < n and text[i].isalnum():
                    end_cost += RUN_TOGETHER
                if end_cost <= MOST and (i, word) not in out or out.get((i, word), (99,))[0] > end_cost:
                    out[i, word] = (end_cost, bad)
            if i >= n:
                continue
            c = text[i]
            if c in node:
                stack.append((node[c], i + 1, cost, word + c, bad))
            if word and c == " ":
                if cost + SPLIT <= MOST and i + 1 < n and text[i + 1].isalnum():
                    # letters set apart cost once, not once a letter
                    apart = len(word) == 1 or (i >= 2 and text[i - 2] == " ")
                    stack.append((node, i + 1, cost + (0.4 if apart and cost >= SPLIT else SPLIT), word, bad))
            elif word and c in HYPHENS and i + 1 < n and text[i + 1] == "\n":
                stack.append((node, i + 2, cost + CUT, word, bad))
            elif word and c == "\n" and cost + BREAK <= MOST:
                stack.append((node, i + 1, cost + BREAK, word, bad))
            if cost + MISREAD <= MOST:
                for seen, true in _BY_SEEN.get(c, ()):
                    if text.startswith(seen, i):
                        at = node
                        for t in true:
                            at = at.get(t)
                            if at is None:
                                break
                        else:
                            stack.append((at, i + len(seen), cost + MISREAD, word + true, (*bad, i)))
        return [(end, cost, word, bad) for (end, word), (cost, bad) in out.items()]

    def decode(self, span: str, copies: dict[int, list[tuple[int, float]]] | None = None, bars: frozenset[int] = frozenset()) -> list[tuple[int, int, str, tuple[int, ...]]]:
        """(start, end, word or '' for a copy, misread positions): the cheapest
        reading of a span of lower-case text with line feeds kept. ``copies``: (end,
        cost) of further copies from a position; ``bars``: what is within a word or
        such a copy."""
        n = len(span)
        best = [(1e9, -1, "", ())] * (n + 1)
        best[0] = (0.0, -1, "", ())
        for i in range(n):
            if best[i][0] >= 1e9:
                continue
            base = best[i][0]
            for end, cost in copies.get(i, ()) if copies else ():
                if base + cost < best[end][0]:
                    best[end] = (base + cost, i, "", ())
            if i in bars:
                continue
            if not (span[i].isalnum() or span[i] in "@¢|!$ſ("):
                if base < best[i + 1][0]:
                    best[i + 1] = (base, i, "", ())
                if span[i] not in "|!":
                    continue
            starts_word = i == 0 or not span[i - 1].isalnum() or best[i][2] != ""
            if starts_word:
                for end, cost, word, bad in self.from_here(span, i):
                    if base + cost < best[end][0]:
                        best[end] = (base + cost, i, word, bad)
                j = i
                while j < n and not span[j].isspace():
                    j += 1
                cost = base + UNKNOWN + UNKNOWN_CHAR * (j - i)
                if j > i and cost < best[j][0]:
                    best[j] = (cost, i, "", ())
        out, i = [], n
        while i > 0:
            _, start, word, bad = best[i]
            if start < 0:
                return [(0, n, "", ())]
            out.append((start, i, word, bad))
            i = start
        return out[::-1]


def _number(token: str) -> set[int]:
    """What page number a token may be, arabic or roman, through misreadings."""
    t = token.strip("[]()~-–—.|, ")
    if t.lower().startswith("p."):
        t = t[2:].strip()
    out: set[int] = set()
    if not t or " " in t:
        return out
    if _ROMAN.fullmatch(t) and (len(t) > 2 or not t.isupper()):
        value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
        got = [value[c] for c in t.lower()]
        out.add(sum(-a if a < b else a for a, b in zip(got, [*got[1:], 0])))
    d = t.translate(_DIGITS)
    if d.isdigit() and len(d) <= 5 and (any(c.isdigit() for c in t) or len(t) > 1):
        out.add(int(d))
    return out


def _numbers(line: str) -> set[int]:
    """Numbers that a head or foot may carry: alone, first or last in it."""
    t = line.strip()
    if m := re.fullmatch(r"\S{4}\s+(\S+)\s+[o0][ft]\s+\S+", t):
        return _number(m[1])
    tokens = re.split(r"\s*\|\s*|\s{2,}", t)
    picks = {tokens[0], tokens[-1], t}
    if m := re.search(r"(?:sh\S{2,4}\s+|/)(\S+)$", t):
        picks.add(m[1])
    return set().union(*map(_number, picks))


def _bare(line: str) -> str:
    """Letters of a head without its number, misreadings evened out."""
    t = re.sub(r"(?:^\s*\S{1,6}(?:\s*\|\s*|\s{2,}))|(?:(?:\s*\|\s*|\s{2,})\S{1,6}\s*$)", "", line.strip()).lower()
    for a, b in (("vv", "w"), ("rn", "m"), ("ii", "u"), ("cl", "d"), ("ri", "n")):
        t = t.replace(a, b)
    return re.sub(r"[^a-z]", "", t.translate(str.maketrans("01|!5689@¢ſéf", "oillsbbgacset")))


def _alike(a: str, b: str) -> bool:
    if not a or not b or abs(len(a) - len(b)) > 3:
        return False
    if a == b:
        return True
    grams = lambda s: Counter(s[i : i + 2] for i in range(len(s) - 1))
    x, y = grams(a), grams(b)
    return 2 * sum((x & y).values()) >= 1.5 * max(len(a), len(b))


def _title_like(line: str, common: frozenset[str] = frozenset()) -> bool:
    """Whether a line may be a head: a name, not a part of a sentence."""
    t = line.strip()
    if not 3 < len(t) < 90 or t[-1] in ".,;:" or re.search(r"[.,;:] |\.{3}", t) or len(t.split()) > 40:
        return False
    return sum(w in common for w in t.lower().split()) < 2


_SPACED = re.compile(r"(?:\S {1,3}){4,}\S?")


def _shouted(line: str) -> bool:
    letters = [c for c in line if c.isalpha()]
    return len(letters) > 8 and sum(c.isupper() for c in letters) >= 0.75 * len(letters)


def furniture_lines(
    pages: list[tuple[int, list[str]]], title: str = "", common: frozenset[str] = frozenset()
) -> set[tuple[int, int]]:
    """(ordinal, line index) of the lines that belong to the page."""
    out: set[tuple[int, int]] = set()
    edges: list[tuple[int, int, str, str]] = []  # ordinal, index, side, text
    for o, lines in pages:
        full = [i for i, t in enumerate(lines) if t.strip()]
        top, bottom = full[:3], [i for i in full[-3:] if i not in full[:3]]
        edges += [(o, i, "top", lines[i]) for i in top] + [(o, i, "bottom", lines[i]) for i in bottom]
        for i in full:
            if _RULE.fullmatch(lines[i]) and len(lines[i].strip()) >= 3:
                out.add((o, i))
    # the number that runs with the pages
    votes: Counter[int] = Counter()
    for o, i, _, t in edges:
        # a number in a form that only page numbers have weighs more than a bare one
        formed = re.fullmatch(r"\s*(?:\[.+\]|[-~] .+ [-~]|\S{4} \S+ \S\S \S+|p\S? ?\S+|[ivxlc]{3,})\s*", t) or " | " in t
        for n in _numbers(t):
            votes[n - o] += 3 if formed else 1
    offset = None
    if votes:
        offset, seen = votes.most_common(1)[0]
        if seen < 2 and len(pages) > 1:
            offset = None
    # what is twice as wide as the printed lines is none of them
    widths = sorted(len(t.strip()) for _, lines in pages for t in lines if t.strip())
    wide = 2 * max(widths[len(widths) // 2], 45) if widths else 0
    for o, i, _, t in edges:
        if (o, i) in out or len(t.strip()) > wide:
            continue
        if _STAMP.fullmatch(t.strip()):
            out.add((o, i))
        elif offset is not None and (o + offset) in _numbers(t):
            out.add((o, i))
        elif offset is None and len(pages) == 1 and re.fullmatch(r"\[\S+\]|[-~] \S+ [-~]|[Pp]age \S+ of \S+|p\. ?\S+|\S{1,5} \| .*", t.strip()):
            out.add((o, i))
    # heads that come again, alone in their line, at the very edge
    heads: dict[str, set[int]] = defaultdict(set)
    where: dict[tuple[int, int], str] = {}
    for o, lines in pages:
        full = [i for i, t in enumerate(lines) if t.strip()]
        for seq in (full[:3], full[::-1][:3]):
            for i in seq:
                if (o, i) in out:
                    if _bare(lines[i]) and not _STAMP.fullmatch(lines[i].strip()):
                        heads[_bare(lines[i])].add(o)
                    continue
                spaced = _SPACED.fullmatch(lines[i].strip())
                if (spaced or _title_like(lines[i], common)) and len(_bare(lines[i])) >= 6:
                    where[o, i] = _bare(lines[i])
                break
    for key, b in where.items():
        heads[b].add(key[0])
    keys = list(heads)
    near = {a: [b for b in keys if _alike(a, b)] for a in keys}
    own = _bare(title)
    text_of = dict(pages)
    tops = {o: next((i for i, t in enumerate(lines) if t.strip() and (o, i) not in out), -1) for o, lines in pages}
    for (o, i), b in where.items():
        line = text_of[o][i].strip()
        pages_with = set().union(*(heads[x] for x in near[b]))
        made = line[0] in "—~" or (tops[o] == i and (_SPACED.fullmatch(line) or _shouted(line) or re.search(r"\S {3}\S", line)))
        if (len(pages_with) >= 2 and (not line[0].islower() or _alike(b, own) or _heads_like(b, where, text_of))) or _alike(b, own) or made:
            out.add((o, i))
    # an item that has plain heads has one on facing pages too, though seen once
    headed = {o for o, i in out if tops[o] == i and where.get((o, i))}
    if headed and not any(line[0] in "—~" or _SPACED.fullmatch(line) or _shouted(line) for line in (text_of[o][tops[o]].strip() for o in headed)):
        for (o, i), _ in where.items():
            if tops[o] == i and o not in headed and not text_of[o][i].strip()[0].islower() and not re.match(r"\s*\d+\. ", text_of[o][i]):
                out.add((o, i))
    return out


def _heads_like(bare: str, where: dict[tuple[int, int], str], text_of: dict[int, list[str]]) -> bool:
    """Whether another line that looks like a head reads the same."""
    return any(_alike(bare, b) and not text_of[o][i].strip()[0].islower() for (o, i), b in where.items())


def _tokens(line: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in re.finditer(r"\S+", line)]


class _Token:
    """A token of the stream: the lines it starts and ends in, its text, whether it is
    read as it stands, and whether it is cut from the next token at a line end."""

    __slots__ = ("line", "end_line", "text", "known", "joint")

    def __init__(self, line: int, end_line: int, text: str, known: bool, joint: bool = False) -> None:
        self.line, self.end_line, self.text, self.known, self.joint = line, end_line, text, known, joint


def _settled(words: Words, t: str, nxt: str) -> tuple[str, bool] | None:
    """(text, cut) of a token with a hyphen at its line's end and the next one, where
    the words settle whether it is a cut."""
    a, b = t[:-1], nxt
    body = b.rstrip(_EDGE)
    bare = a.lstrip(_EDGE)
    core, kept = (bare + body).lower(), (bare + "-" + body).lower()
    if re.fullmatch(r"[A-Z]{1,4}", bare) and re.match(r"[\dlOISB]+", body) and not body.isalpha():
        return a + "-" + b, False
    if kept in words.counts or (words.known(bare) and words.known(body) and core not in words.counts and t[-1] == "-" and len(body) > 2 and len(a) > 1):
        return a + "-" + b, False
    if words.known(core) or "-" in a and words.known(a.split("-", 1)[0]) and words.known(a.split("-", 1)[1] + body):
        return a + b, True
    return None


def read_lines(lines: list[tuple[tuple[int, int], str]], words: Words) -> tuple[dict, dict, list[list[str]]]:
    """Of the text lines of an item in order: which are cut at their end, which are
    misread, and the repaired words of each line (a cut word goes with its start)."""
    cut: dict[tuple[int, int], bool] = {}
    misread: dict[tuple[int, int], bool] = {}
    fixed: list[list[str]] = [[] for _ in lines]
    toks = [[t for _, t in _tokens(t)] for _, t in lines]
    stream: list[_Token] = []
    taken = [0] * len(lines)
    for k, row in enumerate(toks):
        for i in range(taken[k], len(row)):
            t = row[i]
            if i == len(row) - 1 and len(t) > 1 and t[-1] in HYPHENS and k + 1 < len(lines) and toks[k + 1] and t[-2].isalnum():
                if got := _settled(words, t, toks[k + 1][0]):
                    if got[1]:
                        cut[lines[k][0]] = True
                    stream.append(_Token(k, k + 1, got[0], True))
                    taken[k + 1] = 1
                else:
                    stream.append(_Token(k, k, t, False, True))
                continue
            core = t.strip(_EDGE)
            known = not core or words.known(core) or _PART.fullmatch(core) or _PLAIN.fullmatch(core) or not any(c.isalnum() for c in core)
            stream.append(_Token(k, k, t, bool(known)))
    near = [False] * len(stream)
    for i, t in enumerate(stream):
        if not t.known:
            near[max(0, i - CONTEXT) : i + CONTEXT + 1 + t.joint] = [True] * (min(len(stream), i + CONTEXT + 1 + t.joint) - max(0, i - CONTEXT))
    # known words whose characters joined are a known word too are read anew: no other
    # reading of a known word can be cheaper than a copy of it
    for i in range(len(stream) - 1):
        joined = stream[i].text.lstrip(_EDGE).lower()
        for j in range(i + 1, min(i + PIECES, len(stream))):
            if not joined.isalpha():
                break
            last = stream[j].text.lower()
            if joined + last.rstrip(_EDGE) in words.counts:
                near[i : j + 1] = [True] * (j + 1 - i)
            joined += last
    i = 0
    while i < len(stream):
        if not near[i]:
            fixed[stream[i].line].append(stream[i].text)
            i += 1
            continue
        j = i
        while j < len(stream) and near[j]:
            j += 1
        _read_window(stream[i:j], [k for k, _ in lines], words, cut, misread, fixed)
        i = j
    return cut, misread, fixed


def _read_window(window: list[_Token], keys: list, words: Words, cut: dict, misread: dict, fixed: list[list[str]]) -> None:
    """Decode a window of the stream and enter what is found in it."""
    text, starts = "", []
    for i, t in enumerate(window):
        if i:
            text += " " if window[i - 1].end_line == t.line else "\n"
        starts.append(len(text))
        text += t.text
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    copies: dict[int, list[tuple[int, float]]] = defaultdict(list)
    whole: set[tuple[int, int]] = set()
    joints: set[int] = set()
    bars: set[int] = set()
    owner: list[int] = []
    for i, (t, at) in enumerate(zip(window, starts)):
        owner += [i] * (len(t.text) + 1)
        if t.known:
            core = t.text.strip(_EDGE).lower().replace("’", "'")
            n = words.counts.get(core)
            copies[at].append((at + len(t.text), words.cost(n) if n else 0.0 if not any(c.isalpha() for c in core) else words.rarest))
        elif t.joint and i + 1 < len(window):
            # an unknown word that is cut
            b = window[i + 1].text.rstrip(_EDGE) or window[i + 1].text
            end = starts[i + 1] + len(b)
            copies[at].append((end, UNKNOWN + UNKNOWN_CHAR * (len(t.text) - 1 + len(b)) + CUT))
            whole.add((at, end))
            joints.add(starts[i + 1] - 1)
            if t.text[-1] != "-":  # no hyphen of a compound
                bars.add(starts[i + 1] - 1)
    line, later = window[0].line, window[0].line
    out = ""
    read: set[int] = set()

    def put() -> None:
        nonlocal out
        if out:
            fixed[line].append(out)
        out = ""

    decoded = False
    for a, b, word, bad in words.decode(low, copies, frozenset(bars)):
        seen = text[a:b]
        if word and decoded and out[-1:].isalnum():
            put()  # words that were run together
        decoded = bool(word)
        if word or (a, b) in whole:
            if word:
                read.update(owner[a:b])
            inner = [p for p in range(a, b) if text[p] == "\n"]
            for p in inner:
                if text[p - 1] in HYPHENS:
                    cut[keys[window[owner[p]].end_line]] = True
            for p in bad:
                misread[keys[window[owner[p]].line]] = True
            out += _cased(word, seen) if word else re.sub(f"[{re.escape(HYPHENS)}]\n", "", seen)
            if inner:
                later = window[owner[b - 1]].line
            continue
        for p in range(a, b):
            if p in joints:  # a compound, with its hyphen
                later = window[owner[p + 1]].line
                if out and out[-1] in HYPHENS:
                    out = out[:-1] + "-"
            elif text[p] in " \n":
                put()
                line = later = window[owner[p + 1]].line if text[p] == "\n" else max(later, window[owner[p]].end_line)
            else:
                out += text[p]
    put()
    for i, t in enumerate(window):
        if not t.known and i not in read and re.search(r"[@¢|!$ſ]|(?<=[a-z])\d|\d(?=[a-z]{2})", t.text.strip(_EDGE)):
            misread[keys[t.line]] = True


def _cased(word: str, seen: str) -> str:
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if seen[:1].isupper() else word


def paragraphs(lines: list[tuple[str, str, bool]]) -> list[str]:
    """Join repaired lines (text, line as printed, blank line before) to paragraphs:
    the cheapest set of breaks, by dynamic programming over the gaps."""
    n = len(lines)
    if not n:
        return []
    width = max(len(p) for _, p, _ in lines)
    ends = [t.rstrip("\"'”)")[-1:] in ".!?:" for t, _, _ in lines]

    def gap(i: int) -> float:
        """Cost of a break before line i, less the cost of none."""
        text, printed, blank = lines[i]
        cost = 1.0
        cost += -4.0 if blank else 0.8
        cost += -3.0 if printed.startswith("   ") else 0.0
        cost += -1.0 if len(lines[i - 1][1].rstrip()) < 0.75 * width else 0.8
        cost += 2.5 if text[:1].islower() else 0.0
        return cost

    # a paragraph's cost depends on its last line and on whether that is its only one, so
    # the best start of a longer one is carried along
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    longer, longer_at = float("inf"), 0
    for j in range(1, n + 1):
        opened = best[j - 1] + (gap(j - 1) if j > 1 else 0.0)
        alone = opened + (0.0 if ends[j - 1] else 0.6)
        more = longer + (0.0 if ends[j - 1] else 2.0)
        best[j], back[j] = (more, longer_at) if more <= alone else (alone, j - 1)
        if opened < longer:
            longer, longer_at = opened, j - 1
    cuts, j = [], n
    while j:
        cuts.append((back[j], j))
        j = back[j]
    return [" ".join(t for t, _, _ in lines[a:b] if t) for a, b in reversed(cuts)]


def repair(pages: list[tuple[int, str]], words: Words, title: str = "") -> tuple[list[tuple[int, int, str]], list[tuple[int, str]]]:
    """((ordinal, line_no, kind) of each case, (ordinal, paragraph) in order)."""
    split = [(o, body.split("\n")) for o, body in pages]
    page_lines = furniture_lines(split, title, words.common)
    found = [(o, i + 1, "furniture") for o, i in page_lines]
    stream, blank = [], []
    for o, lines in split:
        gap = False
        for i, t in enumerate(lines):
            if (o, i) in page_lines:
                continue
            if not t.strip():
                gap = True
                continue
            stream.append(((o, i), t))
            blank.append(gap)
            gap = False
    cut, misread, fixed = read_lines(stream, words)
    found += [(o, i + 1, "hyphen") for o, i in cut] + [(o, i + 1, "ocr") for o, i in misread]
    lines = [(" ".join(w), t, g) for w, (_, t), g in zip(fixed, stream, blank)]
    keys = [k for k, _ in stream]
    paras, at = [], 0
    for p in paragraphs(lines):
        paras.append((keys[min(at, len(keys) - 1)][0] if keys else 0, p))
        seen = 0
        while at < len(lines) and seen < len(p):
            seen += len(lines[at][0]) + (1 if lines[at][0] else 0)
            at += 1
    return found, paras


def word_counts(*texts: DataFrame) -> dict[str, int]:
    """Words of clean text that make up at least one in WORD_SHARE of it."""
    all_ = None
    for t in texts:
        t = t.toDF("text").filter("text is not null")
        all_ = t if all_ is None else all_.unionByName(t)
    pattern = r"[\p{L}]+(?:['’-][\p{L}]+)*"
    counts = (
        all_.select(F.explode(F.expr(f"regexp_extract_all(lower(text), r\"{pattern}\", 0)")).alias("w"))
        .groupBy("w")
        .agg(F.count("*").alias("n"))
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") >= max(2, -(-total // WORD_SHARE))).collect()
    out: dict[str, int] = {}
    for w, n in rows:
        w = w.replace("’", "'")
        out[w] = out.get(w, 0) + n
        if "'" in w:
            continue
        for p in w.split("-"):
            if "-" in w and len(p) > 1:
                out[p] = out.get(p, 0) + n
    return out


def page_blocks(chunks: DataFrame) -> DataFrame:
    """First deliveries of page chunks, with the block each belongs to or is context of."""
    pages = (
        chunks.filter("location.kind = 'page' and item_id is not null and ordinal is not null and body is not null")
        .groupBy("item_id", "ordinal")
        .agg(F.min_by("body", F.struct(F.col("loaded_at").isNull(), F.col("loaded_at"))).alias("body"))
    )
    o, n = F.col("ordinal"), BLOCK_PAGES
    own = F.floor(o / n).cast("int")
    blocks = F.array_compact(
        F.array(own, F.when((o % n == 0) & (o > 0), own - 1), F.when(o % n == n - 1, own + 1))
    )
    return pages.withColumn("block", F.explode(blocks))


def _run_blocks(words, out: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = _words_of(words)
        rows = []
        for (item, block), g in pdf.groupby(["item_id", "block"], sort=False):
            g = g.sort_values("ordinal")
            title = g["title"].iloc[0]
            found, paras = repair(list(zip(g["ordinal"].astype(int), g["body"])), known, title if isinstance(title, str) else "")
            mine = lambda o: o // BLOCK_PAGES == block  # noqa: B023, E731
            if out == "found":
                rows += [(item, o, i, kind) for o, i, kind in found if mine(o)]
            else:
                rows += [(item, o, k, p) for k, (o, p) in enumerate(paras) if mine(o)]
        cols = ["item_id", "ordinal", "line_no", "kind"] if out == "found" else ["item_id", "ordinal", "para_no", "text"]
        return pd.DataFrame(rows, columns=cols)

    return run


_built: list = [None, None]


def _words_of(shared) -> Words:
    counts = shared.value
    if _built[0] is not counts:
        _built[:] = [counts, Words(counts)]
    return _built[1]


def _applied(chunks: DataFrame, items: DataFrame, words: dict[str, int], out: str, schema: str) -> DataFrame:
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(words)
    titles = items.filter("item_id is not null").groupBy("item_id").agg(F.min("title").alias("title"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        page_blocks(chunks)
        .join(titles, "item_id", "left")
        .groupBy(F.pmod(F.xxhash64("item_id", "block"), F.lit(n)).alias("bucket"))
        .applyInPandas(_run_blocks(shared, out), schema)
    )


def noise_lines(chunks: DataFrame, items: DataFrame, words: dict[str, int]) -> DataFrame:
    """(item_id, ordinal, line_no, kind) of every noisy line of page chunks."""
    return _applied(chunks, items, words, "found", "item_id string, ordinal int, line_no int, kind string")


def repaired_text(chunks: DataFrame, items: DataFrame, words: dict[str, int]) -> DataFrame:
    """(item_id, text): the continuous paragraphs of each scanned item."""
    paras = _applied(chunks, items, words, "text", "item_id string, ordinal int, para_no int, text string")
    return (
        paras.groupBy("item_id")
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", "para_no", "text"))).alias("p"))
        .select("item_id", F.array_join(F.col("p.text"), "\n\n").alias("text"))
    )
