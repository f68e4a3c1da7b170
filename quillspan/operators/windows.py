"""Evidence windows: a ranked chunk with its neighbours, cut to a readable passage.

Scale: the neighbours of a seed are looked up by item and ordinal, both equal, so no row
meets more than it needs however large its item; the passage itself is chosen in Arrow
batches of seeds.

Defined results: a row that was not found by text, whose digest is none or not that of
the live item, whose chunk is gone or whose passage is blank, too wide or no gain is left
as it is, with ``windowed`` null; a blank query or bounds out of range are refused.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADING = re.compile(r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*$")
_HEAD_START = re.compile(r"(?m)^#{1,6}[ \t]+")
_WORD = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
# Words that do not tell one heading from another. An archive adds its own
# name by the parameter ``also_small``.
SMALL_WORDS = frozenset(
    "a an and are as at be by can could did do does for from has have how in is it its library may of on or should the this to what when where which who why "
    "with would".split()
)
# Bounds of a window, and how far its ends may move to a break.
LEAST_CHARACTERS, MOST_CHUNKS = 80, 8
END_REACH, LINE_REACH, BLANK_REACH = 80, 80, 40
HEX64 = "^[0-9a-f]{64}$"


def neighbours(seeds: DataFrame, chunks: DataFrame, radius: int = 3) -> DataFrame:
    """(seed_id, item_id, seed_ordinal, chunk_id, ordinal, body, start, end): the
    chunks around each seed with their places in the joined text."""
    s = seeds.select(F.col("chunk_id").alias("seed_id"), F.col("item_id").alias("s_item"), F.col("ordinal").alias("seed_ordinal"))
    n = s.join(
        chunks.select("item_id", "chunk_id", "ordinal", "body"),
        (F.col("s_item") == F.col("item_id")) & F.col("ordinal").between(F.col("seed_ordinal") - radius, F.col("seed_ordinal") + radius),
    ).drop("s_item")
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "body")))
    g = n.groupBy("seed_id", "item_id", "seed_ordinal").agg(parts.alias("p"))
    ends = F.transform("p", lambda x, i: F.aggregate(F.slice("p", 1, i + 1), F.lit(0), lambda a, y: a + F.length(y["body"]) + 1))
    g = g.withColumn("e", ends)
    return g.select("seed_id", "item_id", "seed_ordinal", F.posexplode(F.arrays_zip("p", "e")).alias("k", "z")).select(
        "seed_id",
        "item_id",
        "seed_ordinal",
        F.col("z.p.chunk_id").alias("chunk_id"),
        F.col("z.p.ordinal").alias("ordinal"),
        F.col("z.p.body").alias("body"),
        (F.col("z.e") - 1 - F.length("z.p.body")).alias("start"),
        (F.col("z.e") - 1).alias("end"),
    )


def telling(text: str, also_small: frozenset[str] = frozenset()) -> list[str]:
    """Words of a text that tell it from others; all of them if none does."""
    words = [w.casefold() for w in _WORD.findall(text)]
    return [w for w in words if len(w) > 1 and w not in SMALL_WORDS and w not in also_small] or words


def sections(text: str) -> list[tuple[int, int, str]]:
    """(start, end, heading) of each headed section, in order: it ends where the next
    heading of its level or a higher one starts."""
    next_of: dict[int, int] = {}
    out = []
    for h in reversed(list(_HEADING.finditer(text))):
        level = len(h[1])
        out.append((h.start(), min((at for k, at in next_of.items() if k <= level), default=len(text)), h[2]))
        next_of[level] = h.start()
    return out[::-1]


def _break_before(text: str, start: int, end: int) -> int:
    """The last line end or blank shortly before ``end``, else ``end``."""
    if end >= len(text):
        return len(text)
    low = max(start + 1, end - END_REACH)
    return next((at for at in (text.rfind(c, low, end) for c in "\n ") if at > start), end)


def _break_after(text: str, start: int) -> int:
    """The beginning of a line or word shortly after ``start``, else ``start``."""
    if start <= 0:
        return 0
    found = (text.find("\n", start, start + LINE_REACH), text.find(" ", start, start + BLANK_REACH))
    return next((at + 1 for at in found if at >= 0), start)


def interval(text: str, query: str, seed: tuple[int, int], most: int, also_small: frozenset[str] = frozenset()) -> tuple[int, int, bool]:
    """(start, end, truncated) of the passage for a query around a seed's span: the
    section headed by all that the query tells, else a stretch around the query's words."""
    wanted = telling(query, also_small)
    for start, end, heading in sections(text) if wanted else ():
        here = seed[0] <= start <= seed[1] or start <= seed[0] < end
        if here and set(wanted) <= set(telling(heading, also_small)):
            end = start + len(text[start:end].rstrip())
            return (start, end, False) if end - start <= most else (start, _break_before(text, start, start + most), True)
    folded = text.casefold()
    spots = (folded.find(w, *seed) for w in (" ".join(query.split()).casefold(), *wanted))
    anchor = next((at for at in spots if at >= 0), seed[0] + (seed[1] - seed[0]) // 2)
    start = max(0, anchor - most // 4)
    end = min(len(text), start + most)
    start = _break_after(text, max(0, min(start, end - most)))
    end = _break_before(text, start, end)
    return start, end, start > 0 or end < len(text)


def passage(
    query: str, bodies: list[str], seed: int, shown: str | None, most: int, max_chunks: int, also_small: frozenset[str] = frozenset()
) -> tuple[str, list[int], bool] | None:
    """(snippet, places of the chunks in it, truncated), or none where the row stays."""
    spans, at = [], 0
    for body in bodies:
        spans.append((at, at + len(body)))
        at += len(body) + 1
    text = "\n".join(bodies)
    start, end, short = interval(text, query, spans[seed], most, also_small)
    met = [i for i, (a, b) in enumerate(spans) if b > start and a < end]
    if len(met) > max_chunks:
        if seed not in met:
            return None
        first = max(0, min(met.index(seed), len(met) - max_chunks))
        met = met[first : first + max_chunks]
        start, end, short = max(start, spans[met[0]][0]), min(end, spans[met[-1]][1]), True
    end = min(end, start + most)
    snippet = text[start:end].strip()
    places = [i for i, (a, b) in enumerate(spans) if b > start and a < end]
    shown = (shown or "").strip()
    if not met or not snippet or not 0 < len(places) <= max_chunks:
        return None
    if len(snippet) < len(shown) and not _HEAD_START.search(snippet):
        return None
    return snippet, places, short


def expand_evidence(
    results: DataFrame, items: DataFrame, chunks: DataFrame, query: str, most: int = 480, max_chunks: int = 3, also_small: frozenset[str] = frozenset()
) -> DataFrame:
    """Evidence rows (item_id, chunk_id, sha256, snippet, retrieval_method and others) with
    wider snippets where these are safe, and chunk_ids, windowed, window_truncated."""
    if not query.strip() or most < LEAST_CHARACTERS or not 1 <= max_chunks <= MOST_CHUNKS:
        raise ValueError("a query and bounds in range are required")
    key = ["item_id", "chunk_id", "shown"]
    rows = results.withColumn("shown", F.coalesce("snippet", F.lit("")))
    live = items.select("item_id", F.lower("sha256").alias("live_sha"))
    seeds = (
        rows.filter(F.coalesce("retrieval_method", F.lit("")) != "metadata")
        .filter(F.lower("sha256").rlike(HEX64))
        .join(live, (rows.item_id == live.item_id) & (F.lower("sha256") == F.col("live_sha")), "left_semi")
        .select(*key)
        .distinct()
        .join(chunks.select("item_id", "chunk_id", F.col("ordinal").alias("seed_ordinal")), ["item_id", "chunk_id"])
    )
    around = F.sequence(F.greatest(F.col("seed_ordinal") - max_chunks, F.lit(0)), F.col("seed_ordinal") + max_chunks)
    near = seeds.withColumn("ordinal", F.explode(around)).join(
        chunks.select("item_id", "ordinal", F.col("chunk_id").alias("near_id"), "body"), ["item_id", "ordinal"]
    )
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "near_id", "body"))).alias("parts")

    def choose(batches):
        for pdf in batches:
            out = []
            for item, chunk, shown, parts in zip(pdf.item_id, pdf.chunk_id, pdf.shown, pdf.parts):
                seed = next(i for i, x in enumerate(parts) if x["near_id"] == chunk)
                if got := passage(query, [x["body"] for x in parts], seed, shown, most, max_chunks, also_small):
                    out.append((item, chunk, shown, got[0], [parts[i]["near_id"] for i in got[1]], got[2]))
            yield pd.DataFrame(out, columns=[*key, "wide", "chunk_ids", "window_truncated"])

    schema = "item_id string, chunk_id string, shown string, wide string, chunk_ids array<string>, window_truncated boolean"
    found = near.groupBy(*key).agg(parts).mapInPandas(choose, schema).withColumn("windowed", F.lit(True))
    return rows.join(found, key, "left").withColumn("snippet", F.coalesce("wide", "snippet")).drop("shown", "wide")
