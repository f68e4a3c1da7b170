"""Union of independent providers, with a cap and a status for each."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillspan.functions.text import short_id
from quillspan.operators.web import tag_strip

RESULT = "provider string, uri string, title string, source string, summary string"


def result_row(df: DataFrame, provider: str, uri: str, title: str, source: str, summary: str, order: str | None = None, id_parts: tuple[str, ...] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one provider in the common shape. ``order`` holds the provider's own order of
    its rows; ``id_parts`` what their ids are made of, if not address and title."""
    parts = [F.lit(provider), *[F.col(c) for c in id_parts or (uri, title)]]
    return df.select(
        F.lit(provider).alias("provider"),
        F.col(uri).cast("string").alias("uri"),
        F.substring(F.trim(title), 1, 300).alias("title"),
        F.substring(F.trim(source), 1, 300).alias("source"),
        F.col(summary).cast("string").alias("summary"),
        short_id("fs_", *parts).alias("result_id"),
        *([F.col(order).alias("provider_order")] if order else []),
        *also,
    )


def library_rows(evidence: DataFrame) -> DataFrame:
    """Evidence rows as results of the library: ids by item and chunk, what else is known
    of them in ``metadata``."""
    known = ("item_id", "chunk_id", "source_uri", "trust_class", "sha256", "score", "retrieval_method", "location", "lifecycle_state", "warnings")
    there = [F.col(c) if c in evidence.columns else F.lit(None).cast("string").alias(c) for c in known]
    rows = evidence.withColumn("metadata", F.struct(*there)).withColumn("of_chunk", F.coalesce("chunk_id", F.lit("metadata")))
    rows = rows.withColumn("library_uri", F.concat(F.lit("library:"), "item_id"))
    return result_row(rows, "library", "library_uri", "title", "source", "snippet", id_parts=("item_id", "of_chunk"), also=("metadata",))


def federate(
    providers: Mapping[str, DataFrame | Callable[[], DataFrame] | None], limit: int | None = None, most: int = 500
) -> tuple[DataFrame, dict[str, str]]:
    """(rows, status): at most ``limit`` of each provider in its own order (``provider_order``,
    else title and address). A provider that fails, when it is planned or read, or is
    missing costs only its own rows: with a limit (``most`` at most) its rows are read one
    provider after another; without one the plans are united as they are."""
    if limit is not None and not 0 <= limit <= most:
        raise ValueError(f"a limit of 0 to {most} is required")
    out, status = None, {}
    for rank, (name, made) in enumerate(providers.items()):
        if made is None:
            status[name] = "disabled"
            continue
        try:
            df = made() if callable(made) else made
            order = ["provider_order"] if "provider_order" in df.columns else ["title", "uri"]
            part = df.withColumn("provider_rank", F.lit(rank))
            if limit is not None:
                best = part.orderBy(*order).limit(limit)
                rows = [(*r, i + 1) for i, r in enumerate(best.drop("provider_order").collect())]
                schema = best.drop("provider_order").schema.add("position", IntegerType())
                part = df.sparkSession.createDataFrame(rows, schema)
            else:
                part = part.drop("provider_order")
        except Exception as e:
            status[name] = "error: " + type(e).__name__
            continue
        status[name] = "ok"
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no provider is available")
    return out.withColumn("summary", F.substring(F.coalesce(tag_strip(F.col("summary")), F.lit("")), 1, 900)), status


def provider_counts(rows: DataFrame, status: Mapping[str, str]) -> DataFrame:
    """(provider, status, n_results) of every provider that was asked."""
    asked = rows.sparkSession.createDataFrame(list(status.items()), "provider string, status string")
    n = rows.groupBy("provider").agg(F.count("*").alias("n"))
    return asked.join(n, "provider", "left").select("provider", "status", F.coalesce("n", F.lit(0)).alias("n_results"))
