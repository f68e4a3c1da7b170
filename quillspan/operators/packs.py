"""Portable packs: members, ids, verification codes, adoption and revision history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import deadline_us, none_if_blank, short_id

HEX64 = "^[0-9a-f]{64}$"
# What a member may not drift in without a warning.
DRIFT_FIELDS = ("title", "lifecycle_state", "version_label", "stale_after", "trust_class", "supersedes_item_id", "superseded_by_item_id")
MEMBER_FIELDS = (
    "item_id", "title", "source", "source_uri", "trust_class", "media_type", "language", "sha256", "version_label", "lifecycle_state", "stale_after",
    "supersedes_item_id", "superseded_by_item_id", "rights_note", "tags",
)
SIDECAR_FIELDS = ("author", "publisher", "license_status", "source_published_at", "acquired_at", "acquisition_method", "source_library_imported_at")
MAX_MEMBERS, MAX_BYTES = 10_000, 8 << 30


def sidecars(provenance: DataFrame) -> DataFrame:
    """(item_id, source_provenance): what goes with an item of its sidecar."""
    return provenance.select("item_id", F.struct(*[none_if_blank(f).alias(f) for f in SIDECAR_FIELDS]).alias("source_provenance"))


def members(items: DataFrame, provenance: DataFrame, payloads: DataFrame) -> DataFrame:
    """Member rows of a pack per source: what is carried of each item, with the size of
    its payload (sha256, bytes) and its sidecar, null if there is none."""
    p = payloads.groupBy("sha256").agg(F.max("bytes").alias("payload_bytes"))
    tags = F.coalesce("tags", F.array().cast("array<string>")).alias("tags")
    carried = items.select(F.col("source").alias("pack_name"), *[tags if f == "tags" else f for f in MEMBER_FIELDS])
    return carried.join(p, "sha256", "left").join(sidecars(provenance), "item_id", "left").select("pack_name", *MEMBER_FIELDS, "payload_bytes", "source_provenance")


def manifest_ids(m: DataFrame) -> DataFrame:
    """(pack_name, pack_id, n_members): ids over all that the members carry."""
    carried = sorted([*MEMBER_FIELDS, "payload_bytes", "source_provenance"])
    return _ids(m, F.sha2(F.to_json(F.struct(*carried), {"ignoreNullFields": "false"}), 256))


def pack_ids(m: DataFrame) -> DataFrame:
    """(pack_name, pack_id, n_members): ids over the members' identity and payload
    alone; :func:`manifest_ids` tells apart packs that differ in any member field."""
    return _ids(m, F.sha2(F.concat_ws("|", "item_id", "sha256", "title"), 256))


def _ids(m: DataFrame, line: Column) -> DataFrame:
    """Ids do not depend on member order. Members are hashed in groups first, so that a
    large pack is no large row."""
    g = m.groupBy("pack_name", F.substring(F.sha2("item_id", 256), 1, 2).alias("g")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "|"), 256).alias("h"), F.count("*").alias("n")
    )
    return g.groupBy("pack_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat("g", F.lit(":"), "h"))), "|").alias("s"), F.sum("n").alias("n_members")).select(
        "pack_name", short_id("kpack_", F.col("pack_name"), F.col("s")).alias("pack_id"), "n_members"
    )


def member_codes(m: DataFrame) -> DataFrame:
    """(pack_name, item_id, codes): what is wrong with each member by itself."""
    n = m.groupBy("pack_name", "item_id").agg(F.count("*").alias("n"))
    codes = F.array_compact(
        F.array(
            F.when(none_if_blank("title").isNull(), "member_title_missing"),
            F.when(~F.coalesce(F.col("sha256").rlike(HEX64), F.lit(False)), "member_sha256_invalid"),
            F.when(F.col("n") > 1, "duplicate_member"),
        )
    )
    return m.join(n, ["pack_name", "item_id"]).select("pack_name", "item_id", F.array_join(codes, ",").alias("codes")).filter("codes <> ''").distinct()


def against_library(m: DataFrame, items: DataFrame, provenance: DataFrame) -> DataFrame:
    """(pack_name, item_id, codes): members against the live library and its sidecars."""
    live = items.select("item_id", F.lit(True).alias("there"), F.col("sha256").alias("l_sha"), *[F.col(f).alias(f"l_{f}") for f in DRIFT_FIELDS])
    now = sidecars(provenance).select("item_id", F.col("source_provenance").alias("l_source_provenance"))
    at = m.join(live, "item_id", "left").join(now, "item_id", "left")
    codes = F.when(F.col("there").isNull(), F.array(F.lit("missing_library_item"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("l_sha") != F.col("sha256"), "payload_checksum_mismatch"),
                *[F.when(~F.col(f).eqNullSafe(F.col(f"l_{f}")), f"drift_{f}") for f in (*DRIFT_FIELDS, "source_provenance")],
            )
        )
    )
    return at.select("pack_name", "item_id", F.array_join(F.array_sort(codes), ",").alias("codes")).filter("codes <> ''")


def pack_sizes(m: DataFrame, payloads: DataFrame) -> DataFrame:
    """(pack_name, n_members, n_payloads, total_bytes, within_limits): each payload
    counts once."""
    p = payloads.groupBy("sha256").agg(F.max("bytes").alias("bytes"))
    d = m.select("pack_name", "sha256").distinct().join(p, "sha256", "left")
    s = d.groupBy("pack_name").agg(F.count("*").alias("n_payloads"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"))
    n = m.groupBy("pack_name").agg(F.count("*").alias("n_members"))
    return n.join(s, "pack_name").withColumn("within_limits", (F.col("n_members") <= MAX_MEMBERS) & (F.col("total_bytes") <= MAX_BYTES))


def adoption_id(candidate: Column, pack: Column) -> Column:
    return short_id("adopt_", candidate, pack)


def adoption_plan(m: DataFrame, items: DataFrame) -> DataFrame:
    """(pack_name, item_id, action, adoption_tag): what adopting each member would do.
    Remote trust, tags, freshness and lineage are never promoted."""
    have = items.groupBy("sha256").agg(F.count("*").alias("n_local"))
    ok = F.coalesce(F.col("sha256").rlike(HEX64), F.lit(False))
    return m.join(have, "sha256", "left").select(
        "pack_name",
        "item_id",
        F.when(~ok, "blocked").when(F.col("lifecycle_state") == "superseded", "warn_superseded").when(F.col("n_local") > 1, "adopt_shared").otherwise("adopt").alias("action"),
        short_id("adopted:", F.col("pack_name"), F.col("item_id")).alias("adoption_tag"),
    )


def origins(provenance: DataFrame, adoptions: DataFrame) -> DataFrame:
    """(item_id, adoption_id, pack_name, pack_version, sha_bound) of adopted items."""
    from quillspan.functions.keys import norm_key

    a = adoptions.select(norm_key("adoption_id").alias("k"), "adoption_id", "pack_name", "pack_version", "manifest_sha256")
    p = provenance.select("item_id", norm_key("origin_adoption_id").alias("k"), "sha256").filter("k is not null")
    return p.join(a, "k").select("item_id", "adoption_id", "pack_name", "pack_version", F.col("sha256").rlike(HEX64).alias("sha_bound"))


def family_id(name: Column) -> Column:
    """Revisions of one pack: its name without case and runs of blanks."""
    return F.concat(F.lit("pfam_"), F.left(F.sha2(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), 256), F.lit(24)))


def revision_history(adoptions: DataFrame) -> DataFrame:
    """(family_id, adoption_id, revision_no, state, superseded_by): every revision of
    a family in order of adoption; the last is active, others superseded."""
    from pyspark.sql import Window

    w = Window.partitionBy("family_id").orderBy("adopted_us", "adoption_id")
    rows = adoptions.withColumn("family_id", family_id(F.col("pack_name"))).withColumn("adopted_us", F.unix_micros(F.try_to_timestamp("adopted_at")))
    return rows.select(
        "family_id",
        "adoption_id",
        F.row_number().over(w).alias("revision_no"),
        F.when(F.lead("adoption_id").over(w).isNull(), "active").otherwise("superseded").alias("state"),
        F.lead("adoption_id").over(w).alias("superseded_by"),
    )


def revision_invariants(history: DataFrame) -> DataFrame:
    """(family_id, n_revisions, n_active, ids_unique, valid) of each family."""
    g = history.groupBy("family_id").agg(
        F.count("*").alias("n_revisions"), F.count_if(F.col("state") == "active").alias("n_active"), F.countDistinct("adoption_id").alias("n_ids")
    )
    return g.select(
        "family_id", "n_revisions", "n_active", (F.col("n_ids") == F.col("n_revisions")).alias("ids_unique"), ((F.col("n_active") <= 1) & (F.col("n_ids") == F.col("n_revisions"))).alias("valid")
    )


PROVENANCE_FIELDS = ("author", "publisher", "license_status", "source_published_at", "acquired_at", "acquisition_method")


def merge_provenance(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sidecars after a merge: new values win where they are given, bound to one sha."""
    n = new.select("item_id", F.col("sha256").alias("n_sha"), *[none_if_blank(f).alias(f"n_{f}") for f in PROVENANCE_FIELDS])
    bound = F.col("n_sha").isNull() | F.col("sha256").isNull() | (F.col("n_sha") == F.col("sha256"))
    return old.join(n, "item_id", "full_outer").select(
        "item_id",
        F.coalesce("sha256", "n_sha").alias("sha256"),
        *[F.when(bound, F.coalesce(f"n_{f}", none_if_blank(f))).otherwise(none_if_blank(f)).alias(f) for f in PROVENANCE_FIELDS],
        bound.alias("sha_bound"),
    )


def provenance_codes(p: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, code): sidecars that are not bound to a live item's payload."""
    live = items.select("item_id", F.col("sha256").alias("l_sha"))
    code = F.when(F.col("l_sha").isNull(), "item_missing").when(F.lower(F.trim("sha256")) != F.lower(F.trim("l_sha")), "sha256_drift")
    return p.join(live, "item_id", "left").select("item_id", code.alias("code")).filter("code is not null")


def fold_lifecycle(commands: DataFrame) -> DataFrame:
    """Current state per family of a command log (family_id, seq, action): register,
    activate, stale, supersede, remove; commands that a state forbids are refused."""
    import pandas as pd

    # Which states a command may start from and where it leads.
    moves = {
        "register": ({None}, "installed"), "activate": ({"installed", "stale"}, "active"), "stale": ({"installed", "active"}, "stale"),
        "supersede": ({"active", "stale"}, "superseded"), "remove": ({"installed", "stale", "superseded"}, "removed"),
    }

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, refused = None, 0
        for action in pdf.sort_values("seq")["action"]:
            start, to = moves.get(action, (set(), None))
            if state == to:
                continue
            if state in start:
                state = to
            else:
                refused += 1
        return pd.DataFrame({"family_id": [pdf["family_id"].iloc[0]], "state": [state], "n_refused": [refused]})

    return commands.groupBy("family_id").applyInPandas(run, "family_id long, state string, n_refused int")


def adopted_drift(adopted: DataFrame, items: DataFrame) -> DataFrame:
    """(adoption_id, local_item_id, codes) of adopted rows (adoption_id, local_item_id,
    sha256, local_trust, adoption_tag) that no longer agree with the live item; several
    rows of one local item within an adoption are one finding too."""
    live = items.select(F.col("item_id").alias("local_item_id"), F.col("sha256").alias("l_sha"), F.col("trust_class").alias("l_trust"), F.col("tags").alias("l_tags"), F.lit(True).alias("there"))
    n = adopted.groupBy("adoption_id", "local_item_id").agg(F.count("*").alias("n"))
    tagged = F.coalesce(F.array_contains("l_tags", F.col("adoption_tag")), F.lit(False))
    codes = F.when(F.col("there").isNull(), F.array(F.lit("item_missing"))).otherwise(
        F.array_compact(
            F.array(
                F.when(~F.coalesce(F.col("sha256").rlike(HEX64), F.lit(False)), "sha256_invalid").when(F.col("l_sha") != F.col("sha256"), "hash_drift"),
                F.when(~F.col("l_trust").eqNullSafe(F.col("local_trust")), "trust_drift"),
                F.when(~tagged, "tag_missing"),
                F.when(F.col("n") > 1, "duplicate_local_item"),
            )
        )
    )
    at = adopted.join(n, ["adoption_id", "local_item_id"]).join(live, "local_item_id", "left")
    return at.select("adoption_id", "local_item_id", F.array_join(codes, ",").alias("codes")).filter("codes <> ''").distinct()


# What a revision is bound to its adoption record by.
BINDING = ("pack_id", "pack_version", "manifest_sha256", "local_trust")


def binding_drift(revisions: DataFrame, records: DataFrame) -> DataFrame:
    """(adoption_id, codes): revisions whose record is gone or differs from what they are
    bound to."""
    r = records.select("adoption_id", F.lit(True).alias("there"), *[F.col(f).alias(f"r_{f}") for f in BINDING])
    codes = F.when(F.col("there").isNull(), F.array(F.lit("record_missing"))).otherwise(
        F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"r_{f}")), f"drift_{f}") for f in BINDING]))
    )
    return revisions.join(r, "adoption_id", "left").select("adoption_id", F.array_join(codes, ",").alias("codes")).filter("codes <> ''")


def imported_provenance(adopted: DataFrame, carried: DataFrame, items: DataFrame) -> DataFrame:
    """(local_item_id, origin_pack_id, origin_adoption_id, status, source_provenance): the
    sidecars that adopted items (adoption_id, pack_id, local_item_id, remote_item_id,
    sha256) bring from the members of their pack (pack_id, item_id, sha256,
    source_provenance). Only ``restored`` rows carry one; a payload that is not the
    member's, or not the live item's, is refused."""
    m = carried.select("pack_id", F.col("item_id").alias("remote_item_id"), F.col("sha256").alias("m_sha"), "source_provenance", F.lit(True).alias("member"))
    live = items.select(F.col("item_id").alias("local_item_id"), F.col("sha256").alias("l_sha"))
    status = (
        F.when(F.col("member").isNull(), "member_missing")
        .when(F.col("source_provenance").isNull(), "no_provenance")
        .when(~F.col("m_sha").eqNullSafe(F.col("sha256")), "payload_drift")
        .when(~F.col("l_sha").eqNullSafe(F.col("m_sha")), "local_drift")
        .otherwise("restored")
    )
    at = adopted.join(m, ["pack_id", "remote_item_id"], "left").join(live, "local_item_id", "left").withColumn("status", status)
    return at.select(
        "local_item_id", F.col("pack_id").alias("origin_pack_id"), F.col("adoption_id").alias("origin_adoption_id"), "status",
        F.when(F.col("status") == "restored", F.col("source_provenance")).alias("source_provenance"),
    )


# What a sidecar may never hold.
FORBIDDEN_FIELDS = ("authority_granted canonical_receipt trust_class capability capabilities permissions commands executor court_decision").split()
TIME_FIELDS = ("source_published_at", "acquired_at", "source_library_imported_at")


def sidecar_code(raw: Column) -> Column:
    """What is wrong with a sidecar as JSON text; null if nothing is."""
    keys = F.json_object_keys(raw)
    bad = F.array_sort(F.array_intersect(keys, F.array(*map(F.lit, FORBIDDEN_FIELDS))))
    unknown = F.array_sort(F.array_except(keys, F.array(*map(F.lit, SIDECAR_FIELDS))))
    late = [F.when(none_if_blank(F.get_json_object(raw, f"$.{f}")).isNotNull() & deadline_us(F.get_json_object(raw, f"$.{f}")).isNull(), f) for f in TIME_FIELDS]
    return (
        F.when(keys.isNull(), "not_an_object")
        .when(F.size(bad) > 0, F.concat(F.lit("authority_field:"), F.get(bad, 0)))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown_field:"), F.get(unknown, 0)))
        .when(F.coalesce(*late).isNotNull(), F.concat(F.lit("not_a_time:"), F.coalesce(*late)))
    )
