"""Queries and oracle SQL of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import batches, boilerplate, bpe, leaks, scans, splitting
from quillspan.sources.tables import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return boilerplate.article_lines(table(spark, base, "fetched_references")).select("page_id", "line_no")


def p1_text(spark: SparkSession, base: str) -> DataFrame:
    return boilerplate.article_text(table(spark, base, "fetched_references"))


def _clean_words(spark: SparkSession, base: str) -> dict[str, int]:
    lines = table(spark, base, "chunks").filter("location.kind = 'lines'").select("body")
    return scans.word_counts(lines, table(spark, base, "candidates").select("staged_text"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return scans.noise_lines(table(spark, base, "chunks"), table(spark, base, "items"), _clean_words(spark, base))


def p3_text(spark: SparkSession, base: str) -> DataFrame:
    return scans.repaired_text(table(spark, base, "chunks"), table(spark, base, "items"), _clean_words(spark, base))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    history = batches.History(spark)
    for name, batch in batches.batches_of(table(spark, base, "candidates")):
        history.check(batch, name)
    return history.found()


def p8_ids(spark: SparkSession, base: str, vocabulary: str | None = None) -> DataFrame:
    return bpe.encode_column(table(spark, base, "documents"), vocabulary)


def p8_decoded(spark: SparkSession, base: str) -> DataFrame:
    return bpe.decode_column(p8_ids(spark, base))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return leaks.leaked(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p9_clean(spark: SparkSession, base: str) -> DataFrame:
    """Every document, with the stretches that give items away taken out."""
    return leaks.without_spans(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p9_spans(spark: SparkSession, base: str) -> DataFrame:
    return leaks.leaked_spans(table(spark, base, "documents"), table(spark, base, "eval_items"))


def p9_report(spark: SparkSession, base: str) -> DataFrame:
    return leaks.leak_report(p9_found(spark, base))


def p10_pieces(spark: SparkSession, base: str, vocabulary: str | None = None) -> DataFrame:
    return splitting.split_column(table(spark, base, "documents"), vocabulary)


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return splitting.split_ids(p10_pieces(spark, base))


def queries():
    named = (p1_found, p1_text, p3_found, p3_text, p4_found, p8_ids, p8_decoded, p9_found, p9_clean, p9_spans, p9_report, p10_found, p10_pieces)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
