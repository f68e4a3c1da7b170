"""Retention catalog of stored objects: listing, promotion, purge and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Retention classes from least to most kept.
RETENTION = ("CACHE", "ROLLING", "STANDARD", "PROTECTED", "PERMANENT")
CLEANUP, RESERVE = 0.15, 0.10


def rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, RETENTION)), c), F.lit(0)).cast("int")


def list_objects(objects: DataFrame, kind: str | None = None, retention: str | None = None, limit: int = 100) -> DataFrame:
    """The newest objects; the limit is the feature (1 to 1000)."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")
    if kind:
        objects = objects.filter(F.col("kind") == kind)
    if retention:
        objects = objects.filter(F.col("retention") == retention)
    return objects.orderBy(F.desc("created"), F.desc("object_id")).limit(limit)


def promote(objects: DataFrame, to: str) -> DataFrame:
    """Retention after a promotion: it is raised, never lowered."""
    new = F.when(rank(F.col("retention")) < rank(F.lit(to)), to).otherwise(F.col("retention"))
    return objects.select("object_id", new.alias("retention"), (new != F.col("retention")).alias("promoted"))


def purgeable(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("retention").isin("CACHE", "ROLLING"))


def health(capacity: DataFrame) -> DataFrame:
    """(name, free_fraction, state) of (name, frsize, blocks, bavail)."""
    free = F.when(F.col("blocks") > 0, F.col("bavail") / F.col("blocks")).otherwise(0.0)
    return capacity.select(
        "name", F.round(free, 6).alias("free_fraction"), F.when(free <= RESERVE, "reserve_guard").when(free <= CLEANUP, "cleanup_due").otherwise("healthy").alias("state")
    )
