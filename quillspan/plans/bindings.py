"""Catalog-shaped views of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.keys import not_blank
from quillspan.operators.catalog import first_delivery
from quillspan.operators.chunking import chunk_texts
from quillspan.operators.fulltext import Index, write_index
from quillspan.session import scratch_path
from quillspan.sources.tables import spread, table


def items(spark: SparkSession, base: str) -> DataFrame:
    return first_delivery(table(spark, base, "items"), "item_id")


def candidates(spark: SparkSession, base: str) -> DataFrame:
    return first_delivery(table(spark, base, "candidates"), "candidate_id")


def document_items(spark: SparkSession, base: str) -> DataFrame:
    """Documents as catalog items with their text."""
    head = F.split(F.regexp_extract("text", r"^[^\r\n]*", 0), " ")
    return (
        spread(table(spark, base, "documents"))
        .filter("text is not null")
        .filter(not_blank("text"))
        .select(
            F.concat(F.lit("lib_"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("item_id"),
            F.array_join(F.slice(head, 1, 6), " ").alias("title"),
            "source",
            "trust_class",
            F.concat(F.lit("v1."), F.col("doc_id") % 10).alias("version_label"),
            F.array(
                F.concat(F.lit("format:"), F.coalesce("media_type", F.lit("unknown"))), F.concat(F.lit("lang:"), F.coalesce("lang", F.lit("und")))
            ).alias("tags"),
            F.sha2("text", 256).alias("sha256"),
            "text",
            "doc_id",
        )
    )


def document_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of the documents with the catalog fields they are ranked by."""
    return chunk_texts(document_items(spark, base).select("item_id", "sha256", "text", "title", "source", "tags"), also=("title", "source", "tags"))


_INDEXES: dict[tuple[str, str], str] = {}


def document_index(spark: SparkSession, base: str) -> Index:
    """The index of the documents' chunks: written to the shared folder when it is first
    asked for in an application, then read."""
    key = (spark.sparkContext.applicationId, base)
    if key not in _INDEXES:
        path = scratch_path(spark, "index")
        write_index(document_chunks(spark, base), path)
        _INDEXES[key] = path
    return Index(spark, _INDEXES[key])
