"""Catalog views, lineage, freshness, identity lookup, mutations and ingest plans.

Scale: lookups that were one query a row are joins of unique keys; every state
change is a projection over the whole table, written as a new version. Defined
results: repeated deliveries are one record (the first); null keys are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.keys import norm_key
from quillspan.functions.text import deadline_us, none_if_blank, tidy_tags


def first_delivery(rows: DataFrame, key: str, delivered: str = "loaded_at") -> DataFrame:
    """One row per key, as delivered first."""
    cols = [c for c in rows.columns if c != key]
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(F.col(delivered).isNull(), F.col(delivered))).alias("r"))
    return first.select(key, "r.*")


def with_successor(items: DataFrame) -> DataFrame:
    """Items with the item that supersedes each (the smallest, if several do)."""
    next_ = (
        items.select(norm_key("supersedes_item_id").alias("k"), F.col("item_id").alias("by"))
        .filter("k is not null")
        .groupBy("k")
        .agg(F.min("by").alias("successor_item_id"), F.count("*").alias("n_successors"))
    )
    return items.withColumn("k", norm_key("item_id")).join(next_, "k", "left").drop("k")


def catalog_items(items: DataFrame) -> DataFrame:
    """The catalog in order of import, with tidy tags and successor."""
    out = with_successor(items).withColumn("tags", tidy_tags(F.col("tags")))
    return out.orderBy("imported_at", "item_id")


def lineage_violations(items: DataFrame) -> DataFrame:
    """(item_id, code): links that break a linear supersession."""
    said = items.select("item_id", norm_key("supersedes_item_id").alias("k"), "lifecycle_state").filter("k is not null")
    keys = items.select(norm_key("item_id").alias("k"), F.col("lifecycle_state").alias("target_state"))
    at = said.join(keys, "k", "left")
    many = said.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    missing = at.filter("target_state is null").select("item_id", F.lit("missing_target").alias("code"))
    open_ = at.filter("target_state <> 'superseded'").select("item_id", F.lit("target_not_superseded").alias("code"))
    several = said.join(many, "k").select("item_id", F.lit("multiple_successors").alias("code"))
    return missing.unionByName(open_).unionByName(several)


def warnings(now_us: int) -> Column:
    """Freshness and lineage warnings of an item, in a fixed order."""
    late = deadline_us(F.col("stale_after"))
    given = none_if_blank("stale_after").isNotNull()
    return F.array_compact(
        F.array(
            F.when(F.col("lifecycle_state") == "superseded", "source_superseded").when(F.col("lifecycle_state") == "stale", "source_stale"),
            F.when(given & late.isNull(), "invalid_stale_after").when(late <= now_us, "freshness_deadline_passed"),
        )
    )


def stale_items(items: DataFrame, now_us: int) -> DataFrame:
    return items.filter((F.col("lifecycle_state") == "stale") | (deadline_us(F.col("stale_after")) <= now_us))


def lookup(rows: DataFrame, wanted: DataFrame, key: str, wanted_col: str = "wanted") -> DataFrame:
    """(wanted, key, status) of identifiers: a key, a sha256 or a prefix of either.

    Exact matches win, the smallest of several; prefixes must be unique. Prefixes are
    literal. The wanted identifiers are a request, not a table: they are broadcast
    only if the optimiser finds them small.
    """
    w = wanted.select(none_if_blank(wanted_col).alias("wanted")).filter("wanted is not null").distinct()
    # equality on four characters first: a prefix match never leaves its bucket
    pair = F.explode(F.array(F.col(key), F.col("sha256"))).alias("name")
    names = rows.select(key, pair).withColumn("b", F.left("name", F.lit(4)))
    hits = names.join(w.withColumn("b", F.left("wanted", F.lit(4))), "b").filter(F.startswith("name", F.col("wanted")))
    exact = F.max(F.col("name") == F.col("wanted"))
    by_key = hits.groupBy("wanted", key).agg(exact.alias("exact"))
    got = by_key.groupBy("wanted").agg(
        F.min(F.when(F.col("exact"), F.col(key))).alias("exact_key"), F.min(key).alias("only_key"), F.count("*").alias("n")
    )
    return w.join(got, "wanted", "left").select(
        "wanted",
        F.coalesce("exact_key", F.when(F.col("n") == 1, F.col("only_key"))).alias(key),
        F.when(F.col("exact_key").isNotNull(), "exact").when(F.col("n") == 1, "prefix").when(F.col("n") > 1, "ambiguous").otherwise("not_found").alias("status"),
    )


def staged_candidates(candidates: DataFrame, state: str) -> DataFrame:
    return candidates.filter(F.col("state") == state).orderBy("staged_at", "candidate_id")


def publish(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Items after publishing every staged candidate: new rows appended, predecessors
    named by them superseded."""
    new = candidates.filter("state = 'staged'")
    named = new.select(norm_key("supersedes_item_id").alias("k")).filter("k is not null").distinct().withColumn("hit", F.lit(True))
    old = (
        items.withColumn("k", norm_key("item_id"))
        .join(named, "k", "left")
        .select("item_id", "title", "sha256", F.when(F.col("hit"), "superseded").otherwise(F.col("lifecycle_state")).alias("lifecycle_state"))
    )
    made = new.select(
        F.concat(F.lit("lib_"), F.left(F.sha2(F.col("candidate_id"), 256), F.lit(32))).alias("item_id"), "title", "sha256", F.lit("active").alias("lifecycle_state")
    )
    return old.unionByName(made)


def remove(items: DataFrame, gone: Column) -> DataFrame:
    """(sha256, n_before, n_after, drop_payload) when the rows ``gone`` are removed;
    linked rows stay, and a payload goes with its last reference."""
    linked = none_if_blank("supersedes_item_id").isNotNull() | none_if_blank("superseded_by_item_id").isNotNull()
    out = F.coalesce(gone & ~linked, F.lit(False))
    n = items.groupBy("sha256").agg(F.count("*").alias("n_before"), F.count_if(~out).alias("n_after"))
    return n.filter("n_after < n_before").withColumn("drop_payload", F.col("n_after") == 0)


def mark_stale(items: DataFrame, chosen: Column) -> DataFrame:
    """New lifecycle states; superseded items stay superseded."""
    state = F.when(chosen & (F.col("lifecycle_state") != "superseded"), "stale").otherwise(F.col("lifecycle_state"))
    return items.select("item_id", state.alias("lifecycle_state"))


def ingest_plan(files: DataFrame, known: DataFrame, publish: bool = False, dry_run: bool = False, max_bytes: int = 256 << 20) -> DataFrame:
    """(path, action, reason) of each file (path, sha256, source, source_uri, bytes,
    ignore) against what is ``known`` (sha256, source, source_uri, state)."""
    kept = known.filter(F.coalesce("state", F.lit("")) != "rejected").select("sha256", "source", "source_uri").distinct().withColumn("there", F.lit(True))
    cond = (files.sha256 == kept.sha256) & files.source.eqNullSafe(kept.source) & files.source_uri.eqNullSafe(kept.source_uri)
    f = files.join(kept.select(*[F.col(c) for c in kept.columns]), cond, "left").select(files["*"], "there")
    usable = ~F.col("ignore") & (F.col("bytes") <= max_bytes) & F.col("there").isNull()
    if dry_run:
        again = F.lit(False)
    else:
        # within a batch the first in path order is taken, the others are there already
        firsts = f.filter(usable).groupBy("sha256", "source", "source_uri").agg(F.min("path").alias("first_path"))
        on = (F.col("f.sha256") == F.col("g.sha256")) & F.col("f.source").eqNullSafe(F.col("g.source")) & F.col("f.source_uri").eqNullSafe(F.col("g.source_uri"))
        f = f.alias("f").join(firsts.alias("g"), on, "left").select("f.*", "g.first_path")
        again = F.col("first_path") != F.col("path")
    reason = (
        F.when(F.col("ignore"), "sidecar_ignore")
        .when(F.col("bytes") > max_bytes, "file_too_large")
        .when(F.col("there").isNotNull() | F.coalesce(again, F.lit(False)), "already_present")
    )
    done = ("planned_publish" if publish else "planned_stage") if dry_run else ("published" if publish else "staged")
    return f.select("path", F.when(reason.isNotNull(), "skipped").otherwise(done).alias("action"), reason.alias("reason"))


def resolve_metadata(files: DataFrame) -> DataFrame:
    """Precedence of metadata: sidecar, embedded, arguments, defaults; trust is never
    embedded. Columns side_*, emb_* and arg_* may be null or blank."""
    c = lambda *names: F.coalesce(*[none_if_blank(n) for n in names])
    suffix = F.coalesce(F.nullif(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.lit("")), F.lit("unknown"))
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", ""), r"_+", " ")
    tags = F.concat(
        F.coalesce("arg_tags", F.array().cast("array<string>")),
        F.coalesce("side_tags", F.array().cast("array<string>")),
        F.array(F.concat(F.lit("format:"), suffix)),
        F.array_compact(F.array(F.concat(F.lit("author:"), none_if_blank("emb_author")))),
    )
    return files.select(
        "path",
        F.coalesce(c("side_title", "emb_title"), stem).alias("title"),
        c("side_source", "arg_source").alias("source"),
        F.coalesce(c("side_trust", "arg_trust"), F.lit("unknown")).alias("trust_class"),
        F.coalesce(c("side_language", "emb_language", "arg_language"), F.lit("en")).alias("language"),
        tidy_tags(tags).alias("tags"),
    )


def dedup_events(events: DataFrame) -> DataFrame:
    """Append-only log without repeated event ids: the first of each."""
    return events.groupBy("event_id").agg(F.min(F.struct(*[c for c in events.columns if c != "event_id"])).alias("r")).select("event_id", "r.*")


def latest_state(events: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """Current state per key: the last event by time and id."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, "event_id")).alias("state"), F.count("*").alias("n_events"))


def sessions(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """Runs of events of a key without a longer pause."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    pause = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    n = F.sum(F.when(pause > gap_seconds * 1_000_000, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("session_no", n).groupBy(key, "session_no").agg(F.count("*").alias("n_events"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
