"""Integrity audits, snapshots and their drift. All are anti-joins and aggregates of
pre-reduced keys; nothing is collected."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNAPSHOT_FIELDS = (
    "title", "source", "source_uri", "trust_class", "media_type", "language", "sha256", "storage_path", "extracted_text_path", "imported_at", "published_at",
    "rights_note", "tags", "version_label", "lifecycle_state", "stale_after", "supersedes_item_id", "superseded_by_item_id",
)
CANDIDATE_FIELDS = (
    "title", "source", "source_uri", "trust_class", "language", "sha256", "staged_path", "staged_at", "state", "published_at", "rights_note", "tags",
    "rejection_reason", "version_label", "stale_after", "supersedes_item_id",
)
PATH_FIELDS = ("storage_path", "extracted_text_path", "staged_path")
#: Stands for the library's folder: catalog paths are relative to it.
LIBRARY_ROOT = "/library-data"


def duplicate_payloads(items: DataFrame) -> DataFrame:
    """(sha256, n_items, item_ids) of payloads that several items share."""
    return (
        items.filter("sha256 is not null")
        .groupBy("sha256")
        .agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("item_ids"))
        .filter("n_items > 1")
    )


def payload_findings(items: DataFrame, candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(severity, code, identifier, path) comparing records with stored files (path,
    sha256; sha256 null where a file can't be read)."""
    f = files.select(F.col("path").alias("f_path"), F.col("sha256").alias("f_sha"), F.lit(True).alias("there"))

    def check(rows: DataFrame, key: str, path: str, prefix: str) -> DataFrame:
        at = rows.select(F.col(key).alias("identifier"), F.col(path).alias("path"), "sha256").filter("path is not null")
        code = (
            F.when(F.col("there").isNull(), f"{prefix}_missing")
            .when(F.col("f_sha").isNull(), f"{prefix}_unreadable")
            .when(F.col("f_sha") != F.col("sha256"), f"{prefix}_checksum_mismatch")
        )
        return at.join(f, F.col("path") == F.col("f_path"), "left").select(F.lit("error").alias("severity"), code.alias("code"), "identifier", "path").filter("code is not null")

    def lost(rows: DataFrame, path: str) -> DataFrame:
        at = rows.select(F.col("item_id").alias("identifier"), F.col(path).alias("path")).filter("path is not null")
        return at.join(f.select(F.col("f_path").alias("path")), "path", "left_anti").select(F.lit("warning").alias("severity"), F.lit("extracted_text_missing").alias("code"), "identifier", "path")

    def orphans(folder: str, rows: DataFrame, path: str, code: str) -> DataFrame:
        here = files.filter(F.startswith("path", F.lit(folder))).select("path")
        return here.join(rows.select(F.col(path).alias("path")), "path", "left_anti").select(
            F.lit("warning").alias("severity"), F.lit(code).alias("code"), F.lit(None).cast("string").alias("identifier"), "path"
        )

    staged = candidates.filter("state = 'staged'")
    parts = [
        check(items, "item_id", "storage_path", "archive"),
        check(staged, "candidate_id", "staged_path", "staged_payload"),
        lost(items, "extracted_text_path"),
        orphans("archive/", items, "storage_path", "orphan_archive_payload"),
        orphans("text/", items, "extracted_text_path", "orphan_extracted_text"),
        orphans("incoming/", staged, "staged_path", "orphan_incoming_payload"),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def findings_summary(findings: DataFrame) -> DataFrame:
    """(n_errors, n_warnings, healthy) in one row."""
    return findings.agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        (F.count_if(F.col("severity") == "error") == 0).alias("healthy"),
    )


def relative_path(path: Column, root: str = LIBRARY_ROOT) -> Column:
    """A path without ``.`` and ``..`` relative to the root; null if it is empty or
    leads out of the root."""
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    steps = F.filter(F.split(full, "/"), lambda x: ~x.isin("", "."))
    real = F.aggregate(
        steps, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    )
    at = F.concat(F.lit("/"), F.array_join(real, "/"))
    home = root.rstrip("/") + "/"
    inside = F.substring(at, len(home) + 1, 1 << 30)
    return F.when(path == "", None).when(F.startswith(at, F.lit(home)), inside).when(F.concat(at, F.lit("/")) == home, F.lit("."))


def _records(rows: DataFrame, key: str, fields: tuple[str, ...], root: str) -> DataFrame:
    kinds = dict(rows.dtypes)

    def value(f: str) -> Column:
        if f in PATH_FIELDS:
            return relative_path(F.col(f), root).alias(f)
        if kinds[f].startswith("array"):
            return F.coalesce(F.col(f), F.array().cast(kinds[f])).alias(f)
        return F.col(f)

    body = F.to_json(F.struct(*[value(f) for f in sorted([key, *fields])]), {"ignoreNullFields": "false"})
    return rows.select(key, body.alias("record"))


def snapshot_records(items: DataFrame, root: str = LIBRARY_ROOT) -> DataFrame:
    """(item_id, record): canonical JSON of each item, fields in order, nulls kept."""
    return _records(items, "item_id", SNAPSHOT_FIELDS, root)


def candidate_records(candidates: DataFrame, root: str = LIBRARY_ROOT) -> DataFrame:
    """(candidate_id, record): canonical JSON of each candidate."""
    return _records(candidates, "candidate_id", CANDIDATE_FIELDS, root)


def _grouped_hash(records: DataFrame, key: str) -> DataFrame:
    """(h, n) of records in any order, in one row."""
    r = records.select(key, F.sha2("record", 256).alias("h"))
    g = r.groupBy(F.substring(F.sha2(key, 256), 1, 3).alias("g")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat(key, F.lit(":"), "h"))), "|"), 256).alias("gh"), F.count("*").alias("n")
    )
    return g.agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("g", F.lit(":"), "gh"))), "|"), 256).alias("h"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )


def snapshot_id(items: DataFrame, prefix: str = "snap_", candidates: DataFrame | None = None, root: str = LIBRARY_ROOT) -> DataFrame:
    """(snapshot_id, n_items, n_candidates): a hash over the ordered hashes of the
    records of items and, if given, candidates. Hashes are combined in 4096 groups
    first, so no row holds the whole catalog."""
    i = _grouped_hash(snapshot_records(items, root), "item_id").select(F.col("h").alias("ih"), F.col("n").alias("n_items"))
    if candidates is None:
        both = i.select("*", F.lit("").alias("ch"), F.lit(0).cast("long").alias("n_candidates"))
    else:
        c = _grouped_hash(candidate_records(candidates, root), "candidate_id")
        both = i.crossJoin(c.select(F.col("h").alias("ch"), F.col("n").alias("n_candidates")))
    # both are one row; none and no candidates are told apart
    core = F.concat(F.lit("items:"), "ih", F.lit("|candidates:"), "ch")
    return both.select(F.concat(F.lit(prefix), F.sha2(core, 256)).alias("snapshot_id"), "n_items", "n_candidates")


def drift(old: DataFrame, new: DataFrame, key: str = "item_id", value: str = "record") -> DataFrame:
    """(key, change): added, removed or changed records between two snapshots."""
    o = old.select(key, F.col(value).alias("o"))
    n = new.select(key, F.col(value).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return o.join(n, key, "full_outer").select(key, change.alias("change")).filter("change is not null")
