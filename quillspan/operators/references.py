"""References to records that do not exist (problem 2).

The distinct references are anti-joined against the parents' keys, which leaves the
missing and deleted ones; an inner join with the later parents gives the late ones.
What remains is joined back to the referring records. Counting per table and month is a plain
aggregate over that.

Scale: both sides of every join are pre-aggregated to one row per key, so a key
that a third of all rows name is one row in the join. The join back carries only
suspect keys; these are replicated over ``salts`` so that the records of one hot
key are spread over that many tasks.

Defined results: null and blank references are no cases; a repeated record counts
once, with its earliest delivery; a null ``loaded_at`` gives a null month and is
never late; a null record key is no record; columns beyond those named are
ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.keys import norm_key


@dataclass(frozen=True)
class Link:
    """One reference field: rows of ``table`` name keys of ``parent_table``."""

    table: str
    rows: DataFrame
    key: str
    ref: str
    parent_table: str
    parents: DataFrame
    parent_key: str
    delivered: str = "loaded_at"


def orphan_references(links: Sequence[Link], removals: DataFrame, salts: int = 16) -> DataFrame:
    """(table_name, record_key, ref_month, status) of every orphan or late reference."""
    kids = None
    for k in links:
        part = (
            k.rows.select(
                F.lit(k.table).alias("table_name"),
                F.lit(k.parent_table).alias("parent_table"),
                F.col(k.key).cast("string").alias("record_key"),
                norm_key(F.col(k.ref).cast("string")).alias("ref"),
                F.col(k.delivered).alias("at"),
            )
            .filter(F.col("record_key").isNotNull())
            .groupBy("table_name", "parent_table", "record_key")
            .agg(F.min_by("ref", F.struct("at", "ref")).alias("ref"), F.min("at").alias("first_at"))
            .filter(F.col("ref").isNotNull())
        )
        kids = part if kids is None else kids.unionByName(part)

    seen: set[str] = set()
    parents = None
    for k in links:
        if k.parent_table in seen:
            continue
        seen.add(k.parent_table)
        part = (
            k.parents.select(
                F.lit(k.parent_table).alias("parent_table"),
                norm_key(F.col(k.parent_key).cast("string")).alias("ref"),
                F.col(k.delivered).alias("at"),
            )
            .filter(F.col("ref").isNotNull())
            .groupBy("parent_table", "ref")
            .agg(F.min("at").alias("parent_first"))
        )
        parents = part if parents is None else parents.unionByName(part)

    gone = (
        removals.select(F.lower(F.trim("table_name")).alias("parent_table"), norm_key("record_key").alias("ref"))
        .filter(F.col("ref").isNotNull())
        .distinct()
        .withColumn("removed", F.lit(True))
    )
    keys = ["parent_table", "ref"]
    refs = kids.groupBy(*keys).agg(F.min("first_at").alias("min_first"))
    absent = (
        refs.join(parents.select(*keys), keys, "left_anti")
        .join(gone, keys, "left")
        .select(*keys, F.lit(None).cast(dict(parents.dtypes)["parent_first"]).alias("parent_first"), F.col("removed").isNotNull().alias("removed"))
    )
    late = (
        refs.join(parents, keys)
        .filter(F.col("parent_first") > F.col("min_first"))
        .select(*keys, "parent_first", F.lit(None).cast("boolean").alias("removed"))
    )
    suspects = absent.unionByName(late).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    status = (
        F.when(F.col("removed").isNull(), F.when(F.col("parent_first") > F.col("first_at"), F.lit("late")))
        .when(F.col("removed"), F.lit("deleted"))
        .otherwise(F.lit("missing"))
    )
    return (
        kids.withColumn("salt", F.pmod(F.xxhash64("record_key"), F.lit(salts)).cast("int"))
        .join(suspects, ["parent_table", "ref", "salt"])
        .select(
            "table_name",
            "record_key",
            F.substring(F.col("first_at").cast("string"), 1, 7).alias("ref_month"),
            status.alias("status"),
        )
        .filter(F.col("status").isNotNull())
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphan references per table, month and status."""
    return found.groupBy("table_name", "ref_month", "status").agg(F.count("*").alias("n_refs"))
