"""What changed between consecutive full snapshots (problem 6).

Each row is reduced to a compact key (two 64-bit hashes of different seeds) and one row hash. Rows
are hash-bucketed by key; inside a bucket the arrays are sorted in numpy and
``searchsorted`` finds, per delivered pair of snapshots, the keys added, removed
and changed. Only differing keys are joined back to the table for their values.

Scale: a bucket holds every snapshot's rows of its keys, ~36 bytes a row; the
number of buckets follows the shuffle partitions. Corrected deliveries are reduced
to the latest one by a map-side aggregate before anything is bucketed, so a key
delivered very often does not fill a bucket. The list of snapshot numbers is the
only thing that reaches the driver: four bytes a snapshot, refused above
``MAX_SNAPSHOTS``.

Defined results: a null or blank key is no record; null and blank values are
equal; of several rows the greatest ``loaded_at`` counts (ties: the greatest
values); a null snapshot number is no snapshot; the first snapshot has no
changes; an empty table has none at all. Columns not named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.keys import strip
from quillspan.session import cut

#: Most snapshots compared in one run: their numbers are a list of this length.
MAX_SNAPSHOTS = 1 << 20

KINDS = ("added", "removed", "changed")


def normal_rows(
    rows: DataFrame,
    key: str = "item_id",
    values: Sequence[str] = ("sha256", "lifecycle_state", "candidate_id"),
    number: str = "snapshot_no",
    delivered: str = "loaded_at",
) -> DataFrame:
    """One row per snapshot and key, as delivered last, with normalised values."""
    norm = lambda c: F.coalesce(F.lower(strip(F.col(c).cast("string"))), F.lit(""))
    latest = F.max(F.struct(F.col(delivered).alias("at"), *[norm(c).alias(f"v{i}") for i, c in enumerate(values)]))
    return (
        rows.filter(F.col(number).isNotNull())
        .groupBy(F.col(number).cast("int").alias("snapshot_no"), norm(key).alias("item_id"))
        .agg(latest.alias("r"))
        .filter(F.col("item_id") != "")
        .select("snapshot_no", "item_id", *[F.col(f"r.v{i}").alias(c) for i, c in enumerate(values)])
    )


def _pack(pdf: pd.DataFrame) -> np.ndarray:
    keys = np.empty(len(pdf), dtype=[("a", "<i8"), ("b", "<i8")])
    keys["a"], keys["b"] = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
    return keys


def _differences(numbers: np.ndarray):
    """The grouped function: snapshot pairs of one bucket to differing keys."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # 128-bit keys become dense ranks once; searchsorted then works on ints
        keys = _pack(pdf)
        uniq, rank = np.unique(keys, return_inverse=True)
        snap = np.searchsorted(numbers, pdf["snapshot_no"].to_numpy())
        h = pdf["h"].to_numpy()
        order = np.lexsort((rank, snap))
        rank, snap, h = rank[order], snap[order], h[order]
        bounds = np.searchsorted(snap, np.arange(len(numbers) + 1))
        out_no, out_rank, out_kind = [], [], []

        def put(s: int, ranks: np.ndarray, kind: int) -> None:
            out_no.append(np.full(len(ranks), numbers[s], np.int32))
            out_rank.append(ranks)
            out_kind.append(np.full(len(ranks), kind, np.int8))

        for s in range(1, len(numbers)):
            a0, a1, b1 = bounds[s - 1], bounds[s], bounds[s + 1]
            old, new = rank[a0:a1], rank[a1:b1]
            at = np.searchsorted(old, new)
            near = np.minimum(at, max(len(old) - 1, 0))
            both = (old[near] == new) if len(old) else np.zeros(len(new), bool)
            back = np.searchsorted(new, old)
            kept = (new[np.minimum(back, len(new) - 1)] == old) if len(new) else np.zeros(len(old), bool)
            put(s, new[~both], 0)
            put(s, old[~kept], 1)
            if len(old):
                moved = both & (h[a0:a1][near] != h[a1:b1])
                put(s, new[moved], 2)
        if not out_no:
            return pd.DataFrame({"snapshot_no": [], "k1": [], "k2": [], "kind": []})
        ranks = np.concatenate(out_rank)
        return pd.DataFrame(
            {
                "snapshot_no": np.concatenate(out_no),
                "k1": uniq["a"][ranks],
                "k2": uniq["b"][ranks],
                "kind": np.concatenate(out_kind),
            }
        )

    return run


def snapshot_numbers(rows: DataFrame, key: str = "item_id", number: str = "snapshot_no") -> np.ndarray:
    """The delivered snapshot numbers in order; refuses a list without a bound."""
    there = rows.filter(F.col(number).isNotNull() & (strip(F.col(key).cast("string")) != ""))
    got = there.select(F.col(number).cast("int").alias("n")).distinct().limit(MAX_SNAPSHOTS + 1).collect()
    if len(got) > MAX_SNAPSHOTS:
        raise ValueError(f"more than {MAX_SNAPSHOTS} snapshots: compare them in ranges of snapshot_no")
    return np.array(sorted(r[0] for r in got), dtype=np.int32)


def differing_keys(
    rows: DataFrame, values: Sequence[str], numbers: np.ndarray, buckets: int | None = None
) -> DataFrame:
    """(snapshot_no, k1, k2, kind) of normalised rows; kind indexes ``KINDS``."""
    spark = rows.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    compact = rows.select(
        "snapshot_no",
        F.xxhash64("item_id").alias("k1"),
        F.xxhash64(F.lit(1), "item_id").alias("k2"),
        F.xxhash64(*values).alias("h"),
    )
    return (
        compact.groupBy(F.pmod("k1", F.lit(n)).alias("bucket"))
        .applyInPandas(_differences(numbers), "snapshot_no int, k1 long, k2 long, kind byte")
    )


def snapshot_changes(
    rows: DataFrame,
    values: Sequence[str] = ("sha256", "lifecycle_state", "candidate_id"),
    buckets: int | None = None,
) -> DataFrame:
    """(snapshot_no, item_id, change_kind) from each snapshot to the next delivered."""
    numbers = snapshot_numbers(rows)
    rows = normal_rows(rows, values=values)
    return _named(rows, differing_keys(rows, values, numbers, buckets))


def _named(rows: DataFrame, diff: DataFrame) -> DataFrame:
    """The differing keys with their names and kinds."""
    names = (
        rows.select("item_id")
        .distinct()
        .select("item_id", F.xxhash64("item_id").alias("k1"), F.xxhash64(F.lit(1), "item_id").alias("k2"))
    )
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind").cast("int") + 1)
    return diff.join(names, ["k1", "k2"]).select("snapshot_no", "item_id", kind.alias("change_kind"))


def change_values(rows: DataFrame, values: Sequence[str] = ("sha256", "lifecycle_state", "candidate_id")) -> DataFrame:
    """Old and new values of the differing keys, fetched only for these."""
    spark = rows.sparkSession
    normal = cut(normal_rows(rows, values=values), "snapshot-rows")
    numbers = snapshot_numbers(normal)
    found = _named(normal, differing_keys(normal, values, numbers))
    numbers = numbers.tolist()
    pairs = spark.createDataFrame(list(zip(numbers[1:], numbers[:-1])), "snapshot_no int, before_no int")
    at = found.join(pairs, "snapshot_no")
    new = normal.select("snapshot_no", "item_id", *[F.col(v).alias(f"new_{v}") for v in values])
    old = normal.select(F.col("snapshot_no").alias("before_no"), "item_id", *[F.col(v).alias(f"old_{v}") for v in values])
    return (
        at.join(new, ["snapshot_no", "item_id"], "left")
        .join(old, ["before_no", "item_id"], "left")
        .select("snapshot_no", "item_id", "change_kind", *[f"old_{v}" for v in values], *[f"new_{v}" for v in values])
    )
