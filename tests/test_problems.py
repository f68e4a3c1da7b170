import datetime as dt

import pytest

from quillspan.operators import hierarchy, references, snapshot_changes
from quillspan.operators.instants import Times, parse_instants, record_instants

T0 = dt.datetime(2024, 1, 1)


def at(n):
    return T0 + dt.timedelta(days=n)


UTC = dt.timezone.utc


def us(*a):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp()) * 10**6


@pytest.mark.parametrize(
    "value,zone,want",
    [
        ("2023-03-26 02:30:00", "Europe/Berlin", us(2023, 3, 26, 1, 30)),
        ("2023-10-29 02:30", "Europe/Berlin", us(2023, 10, 29, 0, 30)),
        ("2021-11-07 01:30", "America/New_York", us(2021, 11, 7, 5, 30)),
        ("31.12.2023", "UTC", us(2023, 12, 31)),
        ("31.09.2023", "UTC", None),
        ("2024-W05-7", "UTC", us(2024, 2, 4)),
        ("2021-W53-1", "UTC", None),
        ("Tue Mar  8 00:16:45 2022", "UTC", us(2022, 3, 8, 0, 16, 45)),
        ("2019-05-05 12:46 AM", "UTC", us(2019, 5, 5, 0, 46)),
        ("1694472847633682", "Asia/Tokyo", 1694472847633682),
        ("1694472847", None, 1694472847 * 10**6),
        ("Wednesday, 24-Nov-21 19:55:47 GMT", "Asia/Tokyo", us(2021, 11, 24, 19, 55, 47)),
        ("2023-09-05T22:40:34,154Z", None, us(2023, 9, 5, 22, 40, 34) + 154000),
        ("2023-09-06T03:09:14.749670999Z", None, us(2023, 9, 6, 3, 9, 14) + 749670),
        ("2022-10-30 13:45:16 EDT", "UTC", us(2022, 10, 30, 17, 45, 16)),
        (" \t08/09/2020 17:21:56\n", "UTC", us(2020, 8, 9, 17, 21, 56)),
        ("2020-02-30", "UTC", None),
        ("2026-06-17T29:15:00Z", "UTC", None),
        ("2019-04", "UTC", None),
        ("unknown", "UTC", None),
        ("", "UTC", None),
        (None, "UTC", None),
        ("2020-01-01", "No/Where", us(2020, 1, 1)),
    ],
)
def test_instants(value, zone, want):
    got, ok = parse_instants([value], [zone])
    assert (int(got[0]) if ok[0] else None) == want


def test_instants_of_empty_tables(spark):
    rows = spark.createDataFrame([], "item_id string, source string, t string, clock string")
    zones = spark.createDataFrame([], "source string, zone_name string")
    assert record_instants([Times("x", rows, "item_id", ("t",), "source")], zones).count() == 0
    again = spark.createDataFrame([("a", "s", "2020-01-02", at(3)), ("a", "s", "2020-01-01", at(1)), ("a", "s", "2020-01-03", None)], "item_id string, source string, t string, loaded_at timestamp_ntz")
    found = record_instants([Times("x", again, "item_id", ("t",), "source")], zones)
    assert [r.epoch_us for r in found.collect()] == [us(2020, 1, 1)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_the_two_key_hashes_are_independent(spark):
    from pyspark.sql import functions as F

    same = spark.range(2).select(F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"), F.xxhash64("id", F.lit(1)).alias("chained"))
    assert all(r.b != r.chained for r in same.collect())


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_references(spark):
    kids = spark.createDataFrame(
        [("a", " P1 ", at(5), 1), ("a", " P1 ", at(9), 1), ("b", "p2", at(1), 1), ("c", "gone", at(3), 1), ("d", "none", at(40), 1), ("e", " ", at(1), 1), ("f", None, at(1), 1), (None, "p1", at(1), 1)]
        + [(f"h{i}", "nobody", at(2), 1) for i in range(200)],
        "k string, r string, loaded_at timestamp_ntz, present int",
    )
    parents = spark.createDataFrame([("p1", at(2)), ("P2", at(4)), (None, at(1))], "k string, loaded_at timestamp_ntz")
    removals = spark.createDataFrame([("ps", "GONE "), ("other", "none")], "table_name string, record_key string")
    found = references.orphan_references([references.Link("kids", kids, "k", "r", "ps", parents, "k")], removals, salts=4)
    want = [("kids", "b", "2024-01", "late"), ("kids", "c", "2024-01", "deleted"), ("kids", "d", "2024-02", "missing")]
    want += [("kids", f"h{i}", "2024-01", "missing") for i in range(200)]
    assert rows_of(found) == sorted(want)
    assert ("kids", "2024-01", "missing", 200) in rows_of(references.orphan_counts(found))
    none = kids.limit(0)
    assert references.orphan_references([references.Link("kids", none, "k", "r", "ps", parents, "k")], removals).count() == 0


def snap_brute(rows):
    norm = lambda v: (v or "").strip().lower()
    best = {}
    for n, k, v, t in rows:
        if n is not None and norm(k):
            best[n, norm(k)] = max(best.get((n, norm(k)), (dt.datetime.min, "")), (t, norm(v)))
    numbers = sorted({n for n, _ in best})
    out = set()
    for p, n in zip(numbers, numbers[1:]):
        old, new = ({k: v[1] for (m, k), v in best.items() if m == x} for x in (p, n))
        out |= {(n, k, "added") for k in new.keys() - old.keys()} | {(n, k, "removed") for k in old.keys() - new.keys()}
        out |= {(n, k, "changed") for k in new.keys() & old.keys() if old[k] != new[k]}
    return out


def test_snapshot_changes(spark):
    import random

    rng = random.Random(3)
    rows = [
        (n, rng.choice(["", " "]) + f"K{rng.randrange(40)}", rng.choice(["x", " X", "y", None, ""]), at(rng.randrange(5)) + dt.timedelta(seconds=i))
        for i, n in enumerate(rng.choices([1, 2, 4, 7], k=300))
    ]
    rows += [(None, "k1", "x", at(1)), (2, None, "x", at(1)), (2, "  ", "x", at(1))]
    df = spark.createDataFrame(rows, "snapshot_no int, item_id string, sha256 string, loaded_at timestamp_ntz")
    got = snapshot_changes.snapshot_changes(df, values=("sha256",), buckets=5)
    assert {tuple(r) for r in got.collect()} == snap_brute(rows)
    assert snapshot_changes.snapshot_changes(df.limit(0), values=("sha256",)).count() == 0
    assert snapshot_changes.snapshot_changes(df.filter("snapshot_no = 1"), values=("sha256",)).count() == 0


def tree_brute(links):
    up = dict(links)
    nodes = set(up) | set(up.values())
    out = []
    above = {}
    for v in nodes:
        seen, x = [], v
        while x in up and up[x] not in seen:
            x = up[x]
            seen.append(x)
        above[v] = seen
    ring = {v for v in nodes if v in above[v]}
    for v in nodes:
        below = sum(v in above[w] for w in nodes if w != v)
        if v in ring:
            out.append((v, min([v, *above[v]]), 0, below, "cycle"))
        elif any(a in ring for a in above[v]):
            low = min(a for a in above[v] if a in ring)
            out.append((v, low, sum(a not in ring for a in above[v]) + 1, below, "hanging"))
        else:
            out.append((v, above[v][-1] if above[v] else v, len(above[v]), below, "tree"))
    return sorted(out)


@pytest.mark.parametrize("limit", [10**6, 3])
def test_hierarchy(spark, limit):
    import random

    rng = random.Random(5)
    links = [(f"n{i:03d}", f"n{rng.randrange(i):03d}") for i in range(1, 60)]
    links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("t1", "c2"), ("t2", "t1"), ("s", "s"), ("u", "s")]
    links += [(f"L{i:02d}", f"L{i + 1:02d}") for i in range(40)] + [(f"hub{i:03d}", "hub") for i in range(100)]
    df = spark.createDataFrame(links, "node string, parent string")
    got = hierarchy.hierarchy(df, walk_limit=limit, buckets=3)
    assert rows_of(got) == tree_brute(links)
    paths = {r.item_id: r.path for r in hierarchy.hierarchy(df, paths=True, walk_limit=limit).collect()}
    assert paths["hub001"] == ["hub", "hub001"] and paths["L38"] == ["L40", "L39", "L38"] and paths["t2"] == ["c2", "t1", "t2"]
    below = rows_of(hierarchy.descendants(df, walk_limit=limit))
    n_below = {}
    for a, _ in below:
        n_below[a] = n_below.get(a, 0) + 1
    assert len(below) == len(set(below)) and {r[0]: r[3] for r in tree_brute(links) if r[3]} == n_below
    assert {("c1", "t2"), ("c1", "c2"), ("t1", "t2"), ("s", "u"), ("L40", "L00")} <= set(below)
    assert rows_of(hierarchy.cycles(df)) == [("c1", "c2", 3, ["c1", "c2", "c3"]), ("s", "s", 1, ["s"])]


def test_parent_links(spark):
    rows = [
        ("A", None, " b ", at(1)), ("a ", None, "x", at(2)), ("b", "", None, at(1)), ("c", "nowhere", None, at(1)),
        ("d", " A", "c", at(1)), ("e", None, "d", at(1)), (None, "a", "a", at(1)),
    ]
    df = spark.createDataFrame(rows, "item_id string, supersedes_item_id string, superseded_by_item_id string, loaded_at timestamp_ntz")
    assert rows_of(hierarchy.parent_links(df)) == [("b", "a"), ("d", "a")]
    assert hierarchy.hierarchy(hierarchy.parent_links(df.limit(0))).count() == 0
