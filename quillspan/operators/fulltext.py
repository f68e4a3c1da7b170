"""Ranked full-text retrieval over chunks: field-weighted BM25, a substring
fallback, a metadata stage, and the two-stage evidence list.

Scale: the index is written once (:func:`write_index`): postings with positions in
folders by hash of their term, sorted by it, a term that most rows hold spread over
several files; the length and title of each row; one row of statistics. A query reads the
folders of its own terms alone, never a text; document frequencies come from the same
postings; the top k is a distributed top-k, and texts are read of these k rows only.
:func:`bm25` does the same over rows that carry their tokens, without an index.

Defined results: a query without terms, or a limit of none, gives no rows; null
fields count as empty.
"""

from __future__ import annotations

import functools
import operator
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillspan.functions.text import count_of, index_tokens
from quillspan.session import cut

# Field weights and the ranking function's parameters.
WEIGHTS = {"title": 5.0, "source": 4.0, "tags": 3.0, "body": 1.0}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
METADATA_WEIGHT = 5
SNIPPET_TOKENS = 28
POSTINGS = "term string, item_id string, chunk_id string, dl int, field string, positions array<int>, bucket int"
#: Files that the postings of one term are spread over.
SPREAD = 8


def query_terms(query: str) -> list[str]:
    return [t.lower() for t in re.findall(r"[A-Za-z0-9][A-Za-z0-9_.-]*", query)]


def phrase(term: str) -> list[str]:
    """The index tokens that a query term must match in a row, one after another."""
    t = "".join(c for c in unicodedata.normalize("NFD", term.lower()) if not unicodedata.combining(c))
    return [x for x in re.split(r"[\W_]+", t) if x]


def token_rows(chunks: DataFrame) -> DataFrame:
    """(item_id, chunk_id, title, title_t, source_t, tags_t, body_t, dl) of chunk rows
    that carry title, source and tags."""
    out = chunks.select(
        "item_id", "chunk_id", "title", *[index_tokens(F.array_join(f, " ") if f == "tags" else F.col(f)).alias(f + "_t") for f in WEIGHTS]
    )
    return out.withColumn("dl", functools.reduce(operator.add, [F.size(f + "_t") for f in WEIGHTS]))


def postings(rows: DataFrame) -> DataFrame:
    """(term, item_id, chunk_id, field, tf): the index as a table."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f + "_t").alias("t")) for f in WEIGHTS])
    return (
        rows.select("item_id", "chunk_id", F.explode(fields).alias("f"))
        .select("item_id", "chunk_id", "f.field", F.explode("f.t").alias("term"))
        .groupBy("term", "item_id", "chunk_id", "field")
        .agg(F.count("*").alias("tf"))
    )


def corpus_stats(rows: DataFrame) -> DataFrame:
    """(n_rows, total_tokens, avgdl)."""
    return rows.agg(
        F.count("*").alias("n_rows"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"), F.round(F.avg("dl"), 6).alias("avgdl")
    )


def _hits(tokens: str, words: list[str]) -> Column:
    if len(words) == 1:
        return F.size(F.filter(tokens, lambda t: t == words[0]))
    # neighbours by a look-ahead over the joined tokens: one pass, overlaps counted
    joined = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    return F.regexp_count(joined, F.lit("(?= " + "  ".join(words) + " )"))


def _one_row(df: DataFrame, stats: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(stats.withColumn("_k", F.lit(1))), "_k").drop("_k")


def bm25(rows: DataFrame, query: str) -> DataFrame:
    """(item_id, chunk_id, title, score) of the rows that match every term."""
    phrases = [p for p in map(phrase, query_terms(query)) if p]
    if not phrases:
        return rows.select("item_id", "chunk_id", "title", F.lit(0.0).alias("score")).limit(0)
    freq = rows.select(
        "item_id",
        "chunk_id",
        "title",
        "dl",
        *[functools.reduce(operator.add, [F.lit(w) * _hits(f + "_t", p) for f, w in WEIGHTS.items()]).alias(f"f{i}") for i, p in enumerate(phrases)],
    )
    many = len(phrases)
    stats = freq.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(many)])
    return _score(freq, stats, F.col("n"), F.col("avgdl"), many).select("item_id", "chunk_id", "title", "score")


def _score(found: DataFrame, stats: DataFrame, n: Column, avgdl: Column, many: int) -> DataFrame:
    """Rows that match every phrase, with their score; ``stats`` holds n0, n1, ..."""
    every = functools.reduce(operator.and_, [F.col(f"f{i}") > 0 for i in range(many)])

    def part(i: int) -> Column:
        f, rows = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.ln((n - rows + 0.5) / (rows + 0.5))
        return F.when(idf <= 0, IDF_FLOOR).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / avgdl))

    score = functools.reduce(operator.add, [part(i) for i in range(many)])
    return _one_row(found.filter(every), stats).withColumn("score", F.round(score, 6))


def write_index(chunks: DataFrame, path: str, buckets: int = 32) -> Index:
    """Write the index of chunk rows that carry title, source and tags."""
    spark = chunks.sparkSession
    rows = token_rows(chunks)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f + "_t").alias("t")) for f in WEIGHTS])
    terms = rows.select("item_id", "chunk_id", "dl", F.explode(fields).alias("f")).select(
        "item_id", "chunk_id", "dl", "f.field", F.posexplode("f.t").alias("pos", "term")
    )
    lists = terms.groupBy("term", "item_id", "chunk_id", "dl", "field").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD))
    (
        lists.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        .repartition("bucket", spread)
        .sortWithinPartitions("bucket", "term")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{path}/postings")
    )
    rows.select("item_id", "chunk_id", "title", "dl").write.mode("overwrite").parquet(f"{path}/rows")
    sizes = spark.read.parquet(f"{path}/rows")
    stats = sizes.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"), F.lit(buckets).alias("buckets"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    return Index(spark, path)


class Index:
    """A written index."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{part}")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, item_id, chunk_id, dl, field, positions) of all or some terms."""
        rows = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        if terms is None:
            return rows
        n = self._read("stats").first()["buckets"]
        here = functools.reduce(operator.or_, [F.col("bucket") == F.pmod(F.xxhash64(F.lit(t)), F.lit(n)).cast("int") for t in terms], F.lit(False))
        return rows.filter(here & F.col("term").isin(terms))

    def stats(self) -> DataFrame:
        """(n_rows, total_tokens, avgdl)."""
        avg = F.when(F.col("n_rows") > 0, F.round(F.col("total_tokens") / F.col("n_rows"), 6))
        return self._read("stats").select("n_rows", "total_tokens", avg.alias("avgdl"))

    def search(self, query: str) -> DataFrame:
        """(item_id, chunk_id, title, score) of the rows that match every term."""
        phrases = [p for p in map(phrase, query_terms(query)) if p]
        if not phrases:
            return self._read("rows").select("item_id", "chunk_id", "title", F.lit(0.0).alias("score")).limit(0)
        rows = self.postings(sorted({t for p in phrases for t in p}))
        # a group holds one entry for each term of the query
        fields = rows.groupBy("item_id", "chunk_id", "dl", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
        where = lambda t: F.coalesce(F.try_element_at("at", F.lit(t)), F.array().cast("array<int>"))

        def times(p: list[str]) -> Column:
            follows = lambda x: functools.reduce(operator.and_, [F.array_contains(where(t), x + j) for j, t in enumerate(p) if j], F.lit(True))
            return F.size(F.filter(where(p[0]), follows))

        weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("field")]
        freq = fields.groupBy("item_id", "chunk_id", "dl").agg(*[F.sum(times(p) * weight).alias(f"f{i}") for i, p in enumerate(phrases)])
        seen = freq.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))])
        stats = self._read("stats").first()
        n, total = stats["n_rows"], stats["total_tokens"]
        found = _score(freq, seen, F.lit(float(n)), F.lit(total / n if n else 1.0), len(phrases))
        return found.join(self._read("rows").select("item_id", "chunk_id", "title"), ["item_id", "chunk_id"]).select("item_id", "chunk_id", "title", "score")


_PIECE = re.compile(r"[^\W_]+(?:[\u0300-\u036f]+[^\W_]*)*")


def _folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def snippet(body: str, phrases: list[list[str]], size: int = SNIPPET_TOKENS) -> str:
    """The stretch of ``size`` tokens that shows most of the phrases, with marks where text
    is left out and blanks collapsed."""
    spots = [m.span() for m in _PIECE.finditer(body)]
    tokens = [_folded(body[a:b]) for a, b in spots]
    n = len(tokens)
    hits = sorted({(i, k, len(p)) for k, p in enumerate(phrases) for i in range(n - len(p) + 1) if tokens[i : i + len(p)] == p})
    begins = [i for i, (a, _) in enumerate(spots) if i == 0 or _opens(body, a)]

    def worth(start: int) -> tuple[int, int]:
        """(score, centred start) of the window from a token on."""
        inside = [h for h in hits if start <= h[0] < start + size]
        kinds = len({k for _, k, _ in inside})
        if not inside:
            return 0, start
        middle = inside[0][0] - int((size - (inside[-1][0] + inside[-1][2] - inside[0][0])) / 2)
        return 1000 * kinds + len(inside) - kinds, max(0, min(middle, n - size))

    best, start = 0, 0
    for i, _, _ in hits:
        score, centred = worth(i)
        if score > best:
            best, start = score, centred
        if n > size:
            opening = max(b for b in begins if b <= i)
            if opening < i:
                score = worth(opening)[0] + (100 if opening else 120)
                if score > best:
                    best, start = score, opening
    end = start + size
    text = body[spots[start][0] if start else 0 : spots[end - 1][1] if end < n else len(body)]
    return " ".join(((" … " if start else "") + text + (" … " if end < n else "")).split())


def _opens(body: str, at: int) -> bool:
    """Whether a sentence begins at a character: blanks and a full stop or colon before it."""
    before = body[:at].rstrip(" \t\r\n")
    return len(before) < at and before[-1:] in (".", ":")


def with_snippets(hits: DataFrame, chunks: DataFrame, query: str) -> DataFrame:
    """Hits with the snippet of each: the bodies of these rows alone are read."""
    phrases = [p for p in map(phrase, query_terms(query)) if p]

    @F.pandas_udf(StringType())
    def shown(body: pd.Series) -> pd.Series:
        return body.map(lambda b: snippet(b, phrases), na_action="ignore")

    return hits.join(chunks.select("item_id", "chunk_id", "body"), ["item_id", "chunk_id"]).withColumn("snippet", shown("body")).drop("body")


def top(rows: DataFrame, limit: int) -> DataFrame:
    """The best rows: score, then title without case, then ids."""
    return rows.orderBy(F.desc("score"), F.lower("title"), "item_id", "chunk_id").limit(max(limit, 0))


def substring_search(chunks: DataFrame, query: str) -> DataFrame:
    """Fallback without an index: occurrences of any term in the body."""
    terms = query_terms(query)
    body = F.lower("body")
    score = functools.reduce(operator.add, [count_of(body, t) for t in terms], F.lit(0))
    first = F.array_min(F.filter(F.array(*[F.locate(t, body) for t in terms]), lambda p: p > 0)) - 1 if terms else F.lit(0)
    start = F.greatest(F.lit(0), first - F.lit(220 // 3))
    snippet = F.trim(F.regexp_replace(body.substr(start + 1, F.lit(220)), r"\s+", " "))
    return (
        chunks.select("item_id", "chunk_id", "title", score.cast("double").alias("score"), snippet.alias("snippet"))
        .filter("score > 0")
    )


def metadata_search(items: DataFrame, query: str) -> DataFrame:
    """(item_id, title, score): occurrences of any term in the catalog fields."""
    terms = query_terms(query)
    hay = F.lower(
        F.concat_ws(" ", "title", "source", "trust_class", F.coalesce("version_label", F.lit("")), F.array_join("tags", " "))
    )
    score = functools.reduce(operator.add, [count_of(hay, t) * METADATA_WEIGHT for t in terms], F.lit(0))
    return items.select("item_id", "title", score.cast("double").alias("score")).filter("score > 0")


def evidence(index: Index, items: DataFrame, query: str, limit: int) -> DataFrame:
    """(stage, item_id, chunk_id, title, score, retrieval_method): ranked chunks first,
    items found by metadata only as far as the limit allows. The ranked rows, at most
    ``limit``, are written once."""
    chunk_hits = cut(top(index.search(query), limit), "hits")
    rest = metadata_search(items, query).join(chunk_hits.select("item_id").distinct(), "item_id", "left_anti")
    both = chunk_hits.select(F.lit(1).alias("stage"), "item_id", "chunk_id", "title", "score", F.lit("full_text").alias("retrieval_method")).unionByName(
        rest.select(
            F.lit(2).alias("stage"), "item_id", F.lit(None).cast("string").alias("chunk_id"), "title", "score", F.lit("metadata").alias("retrieval_method")
        )
    )
    return both.orderBy("stage", F.desc("score"), F.lower("title"), "item_id", "chunk_id").limit(max(limit, 0))
