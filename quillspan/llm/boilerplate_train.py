"""Training of the page labeller: labels from structure, a recurrent network by example.

    python -m quillspan.llm.boilerplate_train FETCHED_REFERENCES.parquet [OUT.npz]

Pages carry no labels, and no list of phrases is given: what is sure is labelled by the
structure of the page and by what repeats over pages. A text that stands on several pages
is furniture; so are texts with a repeated call after their last sentence and a lone line that begins like one on several pages while running
text never begins a sentence so; link lists, trails and teasers are known by their form.
Running text, tables, quotes and dated sources are the article. Weak leaves go by their
neighbours. The network sees neither these rules nor the site, only hashed words, tag
paths and shapes in context. At most ``TRAIN_PAGES`` whole pages are used, chosen by page
hash.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np

from quillspan.llm.boilerplate import (
    PATH_SLOTS,
    SHAPES,
    WEIGHTS,
    WORD_SLOTS,
    Features,
    Leaf,
    features,
    heading,
    inputs,
    label_pages,
    leaves,
    lstm,
    sigmoid,
)

TRAIN_PAGES = 4000
WORD_DIM, PATH_DIM, HIDDEN = 24, 10, 32

#: Pages on which a text, or the beginning of a lone sentence, makes it furniture.
REPEATED = 3
#: Share of the pages from which a text is furniture even if it is whole sentences.
EVERYWHERE = 0.04

_DATED = re.compile(r",\s*\d{4}$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_])")


def _even(text: str) -> str:
    return re.sub(r"\d+", "0", text.lower())


def _same(text: str) -> str:
    """What two texts are compared by: a sentence as it is, else without its numbers."""
    return text.lower() if text[-1] in ".!?" else _even(text)


def _running(text: str) -> bool:
    """Whether a text is several whole sentences."""
    parts = _SENTENCE.split(text)
    return len(parts) > 1 and len(text) >= 40 * len(parts) and all(p.rstrip("\"'”)")[-1:] in tuple(".!?:") for p in parts)


def _opening(text: str) -> str:
    return " ".join(re.findall(r"\w+|[^\w\s]", _even(text))[:3])


def _tail(text: str) -> str:
    """What follows the last sentence of a text without an end of its own."""
    parts = _SENTENCE.split(text)
    return _even(parts[-1]) if len(parts) > 1 and parts[-1][-1] not in ".!?:;\"'”)" else ""


def _form(leaf: Leaf) -> set[str]:
    return {"h" if re.fullmatch(r"h[1-6]", p) else p for p in leaf.path}


class Repeats:
    """What repeats over a sample of pages: whole texts and beginnings of lone sentences."""

    def __init__(self, pages: list[list[Leaf]]) -> None:
        whole: dict[str, int] = {}
        for page in pages:
            for t in {_same(leaf.text) for leaf in page}:
                whole[t] = whole.get(t, 0) + 1
        self.whole = {t for t, n in whole.items() if n >= REPEATED}
        self.everywhere = {t for t, n in whole.items() if n >= max(REPEATED, EVERYWHERE * len(pages))}
        ended: dict[str, int] = {}
        for page in pages:
            for t in {_tail(leaf.text) for leaf in page} - {""}:
                ended[t] = ended.get(t, 0) + 1
        self.ended = {t for t, n in ended.items() if n >= REPEATED}
        opened: dict[str, int] = {}
        running: set[str] = set()
        for page in pages:
            lone = set()
            for leaf in page:
                parts = _SENTENCE.split(leaf.text)
                if len(parts) > 1 and _same(leaf.text) not in self.whole:
                    running.update(_opening(p) for p in parts)
                elif len(parts) == 1 and not _form(leaf) & {"table", "pre", "h"}:
                    lone.add(_opening(leaf.text))
            for t in lone:
                opened[t] = opened.get(t, 0) + 1
        self.opened = {t for t, n in opened.items() if n >= REPEATED and t not in running}


def rule_labels(page: list[Leaf], title: str, repeats: Repeats, site: str = "") -> np.ndarray:
    """1 article, 0 furniture, -1 unknown, for each leaf."""
    n = len(page)
    out = np.full(n, -1)
    plain = all("pre" in leaf.path for leaf in page)  # a page without markup
    for i, leaf in enumerate(page):
        t = leaf.text
        form, parts = _form(leaf), _SENTENCE.split(t)
        sentence = len(t) >= 40 and t.rstrip("\"'”)")[-1:] in tuple(".!?:") and " " in t
        code = bool(re.search(r"[<>{};]|&&", t))
        if title and t == title:
            out[i] = 1
        elif site and t.lower() == site.lower():
            out[i] = 0
        elif "h" in form and leaf.linked < 0.5:
            continue
        elif leaf.linked < 0.5 and (form & {"table", "blockquote"} or "pre" in form and (code or not plain)):
            out[i] = 1
        elif _running(t) and _same(t) not in repeats.everywhere:
            out[i] = 1
        elif _DATED.search(t) and plain:
            out[i] = 1
        elif i + 1 < n and len(t.split()) <= 2 and _DATED.search(page[i + 1].text):
            out[i] = 1  # the heading of a list of sources
        elif _same(t) in repeats.whole:
            out[i] = 0
        elif t.endswith(("…", "...")) or _tail(t) in repeats.ended:
            out[i] = 0
        elif " > " in t and not sentence:
            out[i] = 0
        elif len(re.split(r" \| |\s{3,}", t)) >= 3 and not re.search(r"\d", t):
            out[i] = 0
        elif leaf.linked > 0.95 and not _DATED.search(t):
            out[i] = 0
        elif len(parts) > 1:
            out[i] = 1
        elif _opening(t) in repeats.opened and "li" not in form:
            # a whole sentence may be the article's: its neighbours tell
            out[i] = -1 if sentence else 0
        elif _DATED.search(t) and 0 < leaf.linked < 0.97:
            out[i] = 1
        elif sentence:
            out[i] = 1
    # a heading above a teaser, and lists under a furniture heading, are furniture
    for i in range(n - 1):
        if out[i] == -1 and page[i + 1].text.endswith(("…", "...")):
            out[i] = 0
    for i in range(1, n):
        if out[i] == -1 and out[i - 1] == 0 and "ul" in page[i].path and len(page[i].text.split()) <= 8:
            out[i] = 0
    # what stays weak goes with its nearer sure neighbours
    sure = out.copy()
    for i in np.flatnonzero(out == -1):
        before = next((sure[j] for j in range(i - 1, -1, -1) if sure[j] >= 0), 0)
        after = next((sure[j] for j in range(i + 1, n) if sure[j] >= 0), 0)
        if before == after:
            out[i] = before
        elif after == 1 and "ul" not in page[i].path and i + 1 < n and page[i + 1].path[:-1][:1] == page[i].path[:1]:
            out[i] = 1
    return out


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    width = 2 * WORD_DIM + 3 * PATH_DIM + SHAPES
    g = lambda *s, k=0.1: (rng.standard_normal(s) * k).astype(np.float32)
    w = {"E": g(WORD_SLOTS, WORD_DIM), "P": g(PATH_SLOTS, PATH_DIM)}
    for d in "fb":
        w[d + "_x"], w[d + "_h"] = g(width, 4 * HIDDEN, k=width**-0.5), g(HIDDEN, 4 * HIDDEN, k=HIDDEN**-0.5)
        w[d + "_b"] = np.zeros(4 * HIDDEN, np.float32)
        w[d + "_b"][HIDDEN : 2 * HIDDEN] = 1
    w["o_w"], w["o_b"] = g(2 * HIDDEN + width, 1), np.zeros(1, np.float32)
    return w


def _back(dout, trace, mask, wh):
    """Gradient of :func:`lstm` with respect to its gate inputs and weights."""
    steps, batch, size = dout.shape
    dz = np.zeros((steps, batch, 4 * size), np.float32)
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((batch, size), np.float32), np.zeros((batch, size), np.float32)
    for t in range(steps - 1, -1, -1):
        h0, c0, i, f, o, g, tc = trace[t]
        m = mask[t][:, None]
        dh = dh + dout[t]
        dhn, dcn = dh * m, dc * m
        do, dcn = dhn * tc, dcn + dhn * o * (1 - tc * tc)
        z = np.concatenate([dcn * g * i * (1 - i), dcn * c0 * f * (1 - f), do * o * (1 - o), dcn * i * (1 - g * g)], 1)
        dz[t] = z
        dwh += h0.T @ z
        dh = z @ wh.T + dh * (1 - m)
        dc = dcn * f + dc * (1 - m)
    return dz, dwh


def train(pages: list[tuple[str, str, str]], epochs: int = 6, seed: int = 7, batch: int = 24, quiet: bool = True, repeats: Repeats | None = None):
    """Weights from (html, title, site) of pages."""
    rng = np.random.default_rng(seed)
    seqs = [(leaves(h), heading(title), site) for h, title, site in pages]
    repeats = repeats or Repeats([q for q, _, _ in seqs])
    data = [(features(q, t), rule_labels(q, t, repeats, site)) for q, t, site in seqs if q]
    data.sort(key=lambda d: len(d[1]))
    w = fresh(rng)
    mom, sq, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    groups = [data[i : i + batch] for i in range(0, len(data), batch)]
    for epoch in range(epochs):
        total = 0.0
        rate = 4e-3 * (1 - epoch / epochs) + 2e-4
        for k in rng.permutation(len(groups)):
            part = groups[k]
            t, b = max(len(d[1]) for d in part), len(part)
            x = np.zeros((t, b, w["f_x"].shape[0]), np.float32)
            y, mask = np.full((t, b), -1), np.zeros((t, b), np.float32)
            seen = []
            for j, (f, lab) in enumerate(part):
                m = len(lab)
                # forgetting words at random makes the network lean on context
                f = Features(f.words * (rng.random(len(f.words)) > 0.15), f.ends, f.first * (rng.random(m) > 0.25), f.paths, f.shape)
                x[:m, j], y[:m, j], mask[:m, j] = inputs(w, f), lab, 1
                seen.append(f)
            fo, ft = lstm(x, mask, w["f_x"], w["f_h"], w["f_b"], keep=True)
            bo, bt = lstm(x[::-1], mask[::-1], w["b_x"], w["b_h"], w["b_b"], keep=True)
            joint = np.concatenate([fo, bo[::-1], x], -1)
            p = sigmoid((joint @ w["o_w"] + w["o_b"])[..., 0])
            known = (y >= 0).astype(np.float32)
            count = max(known.sum(), 1)
            total += float(-(known * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / count)
            dlog = ((p - y) * known / count)[..., None].astype(np.float32)
            g = {"o_w": np.einsum("tbi,tbo->io", joint, dlog), "o_b": dlog.sum((0, 1))}
            dj = dlog @ w["o_w"].T
            dx = dj[..., 2 * HIDDEN :].copy()
            for d, dout, trace, msk, xin in (
                ("f", dj[..., :HIDDEN], ft, mask, x),
                ("b", dj[..., HIDDEN : 2 * HIDDEN][::-1], bt, mask[::-1], x[::-1]),
            ):
                dz, g[d + "_h"] = _back(dout, trace, msk, w[d + "_h"])
                g[d + "_x"], g[d + "_b"] = np.einsum("tbi,tbj->ij", xin, dz), dz.sum((0, 1))
                back = dz @ w[d + "_x"].T
                dx += back if d == "f" else back[::-1]
            ge, gp = np.zeros_like(w["E"]), np.zeros_like(w["P"])
            for j, f in enumerate(seen):
                d = dx[: len(f.ends), j]
                many = np.diff(f.ends, prepend=0)
                np.add.at(ge, f.words, np.repeat(d[:, :WORD_DIM] / np.maximum(many, 1)[:, None], many, 0))
                np.add.at(ge, f.first, d[:, WORD_DIM : 2 * WORD_DIM])
                for k3 in range(3):
                    at = 2 * WORD_DIM + k3 * PATH_DIM
                    np.add.at(gp, f.paths[:, k3], d[:, at : at + PATH_DIM])
            ge[0] = 0
            g["E"], g["P"] = ge, gp
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            for k2, v in g.items():
                v = v * min(1.0, 2.0 / (norm + 1e-9))
                mom[k2] = 0.9 * mom[k2] + 0.1 * v
                sq[k2] = 0.999 * sq[k2] + 0.001 * v * v
                w[k2] -= rate * (mom[k2] / (1 - 0.9**step)) / (np.sqrt(sq[k2] / (1 - 0.999**step)) + 1e-8)
            w["E"][0] = 0
        if not quiet:
            print(f"epoch {epoch}: loss {total / len(groups):.4f}", flush=True)
    return w


def site_name(title: str) -> str:
    parts = re.split(r"\s+[–—|-]\s+", title or "")
    return parts[-1] if len(parts) > 1 else ""


def main(source: str, out: str = WEIGHTS) -> None:
    import pandas as pd

    rows = pd.read_parquet(source, columns=["page_id", "html", "title"]).drop_duplicates("page_id")
    rows = rows[rows.html.notna()]
    rows = rows.assign(o=[zlib.crc32(str(i).encode()) for i in rows.page_id]).sort_values("o")
    pages = [(h, t, site_name(t)) for h, t in zip(rows.html, rows.title)]
    held, used = pages[: len(pages) // 10], pages[len(pages) // 10 :][:TRAIN_PAGES]
    repeats = Repeats([leaves(h) for h, _, _ in used])
    w = train(used, quiet=False, repeats=repeats)
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in w.items()})
    good = seen = 0
    for (_, t, s), got in zip(held, label_pages(w, [(h, t) for h, t, _ in held])):
        y = rule_labels([leaf for leaf, _ in got], heading(t), repeats, s)
        for (_, k), v in zip(got, y):
            if v >= 0:
                seen += 1
                good += k == bool(v)
    print(f"held out: {good / max(seen, 1):.4f} of {seen} leaves agree with the rules")


if __name__ == "__main__":
    main(*sys.argv[1:])
