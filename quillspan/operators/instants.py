"""Mixed timestamp formats and time zones to one instant (problem 5).

All formats are one regular expression of named groups, matched once a value. The
components are columns of integers; calendar ranges are checked and the instant is
assembled by integer day arithmetic, in numpy over whole Arrow batches. A time
without a zone is read on its source's clock through a table of that zone's
transitions, found by binary search.

Scale: one pass, no state across rows; the only joins are by record key and to the
small table of zones (left to the optimiser's own size check).

Defined results: null, blank and unreadable values, impossible dates and times and
values without a full date give null (no row in :func:`record_instants`). A repeated
hour is its first run; a time in a skipped hour moves forward by the gap. Unknown or
null zone names mean UTC. Of a record delivered again the first delivery counts. Digits finer than a microsecond are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillspan.functions.keys import norm_key

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Offsets in minutes that zone letters have in Europe and North America.
ZONE_LETTERS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "IST": 60, "CET": 60, "MET": 60,
    "CEST": 120, "MEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "NST": -210, "NDT": -150, "AST": -240,
    "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

#: Bare integers: (ticks a second); the unit is the one that gives a year in INTEGER_YEARS.
INTEGER_TICKS = (1, 10**3, 10**6, 10**9)
INTEGER_YEARS = (1990, 2100)
#: Zone tables cover these years; times outside use the nearest rule.
ZONE_YEARS = (1900, 2150)

_DAY = r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*"
_MON = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_ZONE = r"z|[+-]\d\d:?\d\d|[+-]\d\d|" + "|".join(sorted((z.lower() for z in ZONE_LETTERS if z != "Z"), key=len, reverse=True))


def _clock(n: str, sep: str = ":") -> str:
    return (
        rf"(?P<h{n}>\d\d?){sep}(?P<mi{n}>\d\d)(?:{sep}(?P<s{n}>\d\d)(?:[.,](?P<f{n}>\d+))?)?"
        rf"(?:\s*(?P<ap{n}>[ap]m))?(?:\s*(?P<z{n}>{_ZONE}))?"
    )


#: The one alternation. Suffix digits tell the branches apart; `_part` merges them.
FORMATS = re.compile(
    "|".join(
        (
            rf"(?P<y1>\d{{4}})-(?P<mo1>\d\d)-(?P<d1>\d\d)(?:(?:t|\s+){_clock('1')})?",
            rf"(?P<y2>\d{{4}})(?P<mo2>\d\d)(?P<d2>\d\d)t(?P<h2>\d\d)(?P<mi2>\d\d)(?:(?P<s2>\d\d)(?:[.,](?P<f2>\d+))?)?(?P<z2>{_ZONE})?",
            rf"(?P<y3>\d{{4}})-w(?P<w3>\d\d)-(?P<wd3>\d)(?:(?:t|\s+){_clock('3')})?",
            rf"(?P<mo4>\d\d?)/(?P<d4>\d\d?)/(?P<y4>\d{{4}}|\d\d)(?:,?(?:t|\s+){_clock('4')})?",
            rf"(?P<d5>\d\d?)\.(?P<mo5>\d\d?)\.(?P<y5>\d{{4}}|\d\d)(?:,?(?:t|\s+){_clock('5')})?",
            rf"(?:{_DAY},?\s+)?(?P<d6>\d\d?)[\s-](?P<mn6>{_MON})[\s-](?P<y6>\d{{4}}|\d\d)(?:,?\s+{_clock('6')})?",
            rf"(?:{_DAY},?\s+)?(?P<mn7>{_MON})\s+(?P<d7>\d\d?),?\s+(?P<y7>\d{{4}})(?:,?\s+{_clock('7')})?",
            rf"(?:{_DAY},?\s+)?(?P<mn8>{_MON})\s+(?P<d8>\d\d?)\s+(?P<h8>\d\d?):(?P<mi8>\d\d):(?P<s8>\d\d)(?:\s+(?P<z8>{_ZONE}))?\s+(?P<y8>\d{{4}})",
            r"(?P<n9>\d{9,19})",
        )
    ),
    re.IGNORECASE | re.ASCII,
)
_GROUPS = {
    part: [i for name, i in FORMATS.groupindex.items() if name.rstrip("0123456789") == part]
    for part in ("y", "mo", "mn", "d", "w", "wd", "h", "mi", "s", "f", "ap", "z", "n")
}
_INT_PARTS = ("y", "mo", "d", "w", "wd", "h", "mi", "s")


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers."""
    y = np.where(m <= 2, y - 1, y)
    era = np.floor_divide(y, 400)
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _month_days(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    lengths = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31, 0])
    return lengths[np.clip(m, 0, 13)] + ((m == 2) & leap)


def _offset_s(letters: str | None) -> int | None:
    """Seconds east of UTC; None where there is no zone; raises where it is none."""
    if not letters:
        return None
    if letters[0] in "+-":
        digits = letters[1:].replace(":", "")
        h, m = int(digits[:2]), int(digits[2:] or 0)
        if h > 15 or m > 59:
            raise ValueError(letters)
        return (1 if letters[0] == "+" else -1) * (h * 3600 + m * 60)
    return 60 * ZONE_LETTERS[letters.upper()]


@lru_cache(maxsize=1024)
def zone_table(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Local seconds from which each offset holds, and the offsets (one more).

    A local time in a repeated or skipped hour is read with the offset before the
    change: the first run, or forward by the gap.
    """
    try:
        zone = ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError, TypeError):
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    at = lambda t: int((epoch + timedelta(seconds=t)).astimezone(zone).utcoffset().total_seconds())
    starts, offsets = [], []
    lo = int((datetime(ZONE_YEARS[0], 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    end = int((datetime(ZONE_YEARS[1], 1, 1, tzinfo=timezone.utc) - epoch).total_seconds())
    step = 7 * 86400
    before = at(lo)
    offsets.append(before)
    for t in range(lo, end, step):
        after = at(t + step)
        if after == before:
            continue
        a, b = t, t + step
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if at(mid) == before else (a, mid)
        after = at(b)
        starts.append(b + max(before, after))
        offsets.append(after)
        before = after
    return np.array(starts, np.int64), np.array(offsets, np.int64)


def parse_instants(values: Sequence[str | None], zones: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(epoch microseconds, whether there is an instant) of each value."""
    n = len(values)
    part = {p: np.full(n, -1, np.int64) for p in _INT_PARTS}
    micro = np.zeros(n, np.int64)
    offset = np.zeros(n, np.int64)
    zoned = np.zeros(n, bool)
    ok = np.zeros(n, bool)
    whole = np.zeros(n, bool)
    out = np.zeros(n, np.int64)
    for i, v in enumerate(values):
        if v is None:
            continue
        m = FORMATS.fullmatch(v.strip()) if isinstance(v, str) else None
        if m is None:
            continue
        got = m.groups()
        pick = lambda p: next((got[g - 1] for g in _GROUPS[p] if got[g - 1] is not None), None)  # noqa: B023, E731
        if (number := pick("n")) is not None:
            for ticks in INTEGER_TICKS:
                if INTEGER_YEARS[0] <= 1970 + int(number) / ticks / 31556952 < INTEGER_YEARS[1]:
                    out[i] = int(number) * 10**6 // ticks
                    ok[i] = whole[i] = True
            continue
        for p in _INT_PARTS:
            if (x := pick(p)) is not None:
                part[p][i] = int(x)
        if (name := pick("mn")) is not None:
            part["mo"][i] = MONTHS.index(name[:3].lower()) + 1
        if part["y"][i] < 100 and len(pick("y")) == 2:
            part["y"][i] += 2000
        if (half := pick("ap")) is not None:
            h = part["h"][i]
            part["h"][i] = (h % 12 + 12 * (half.lower() == "pm")) if 1 <= h <= 12 else 99
        if (f := pick("f")) is not None:
            micro[i] = int(f[:6].ljust(6, "0"))
        try:
            z = _offset_s(pick("z"))
        except ValueError:
            continue
        zoned[i] = z is not None
        offset[i] = z or 0
        ok[i] = True
    y, mo, d = part["y"], part["mo"], part["d"]
    week = part["w"] >= 0
    # ISO week dates: Monday of week 1 is the Monday of the week with 4 January
    jan4 = days_from_civil(y, np.full(n, 1), np.full(n, 4))
    monday = jan4 - (jan4 + 3) % 7
    next_jan4 = days_from_civil(y + 1, np.full(n, 1), np.full(n, 4))
    weeks = (next_jan4 - (next_jan4 + 3) % 7 - monday) // 7
    week_ok = (part["w"] >= 1) & (part["w"] <= weeks) & (part["wd"] >= 1) & (part["wd"] <= 7)
    date_ok = (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= _month_days(y, mo))
    h, mi, s = (np.maximum(part[p], 0) for p in ("h", "mi", "s"))
    ok &= np.where(whole, True, np.where(week, week_ok & (y >= 1), date_ok) & (h < 24) & (mi < 60) & (s < 60))
    days = np.where(week, monday + (part["w"] - 1) * 7 + part["wd"] - 1, days_from_civil(y, mo, d))
    local = days * 86400 + h * 3600 + mi * 60 + s
    if len(open_ := np.flatnonzero(ok & ~whole & ~zoned)):
        names = np.array([zones[i] or "" for i in open_], dtype=object)
        for name in set(names.tolist()):
            at = open_[names == name]
            starts, offsets = zone_table(name)
            offset[at] = offsets[np.searchsorted(starts, local[at], side="right")]
    out = np.where(whole, out, (local - offset) * 10**6 + micro)
    return out, ok


@F.pandas_udf(LongType())
def _epoch_us(value: pd.Series, zone: pd.Series) -> pd.Series:
    """Microseconds since 1970-01-01 UTC of a written time read on a zone's clock."""
    none = lambda x: None if x is None or x is pd.NA or x != x else x
    us, ok = parse_instants([none(v) for v in value], [none(z) for z in zone])
    return pd.Series(us, dtype="Int64").mask(~ok)


#: A filter on a deterministic function would be pushed below the projection and read
#: every value twice.
epoch_us = _epoch_us.asNondeterministic()


@dataclass(frozen=True)
class Times:
    """Time fields of one table. ``clock`` is the column naming the source, or,
    with ``clock_of``, the source is found there by record key."""

    table: str
    rows: DataFrame
    key: str
    fields: tuple[str, ...]
    clock: str
    clock_of: DataFrame | None = None
    clock_key: str = "item_id"
    delivered: str = "loaded_at"


def record_instants(tables: Sequence[Times], zones: DataFrame) -> DataFrame:
    """(table_name, record_key, field_name, epoch_us): one row per record and field
    that denotes an instant."""
    zone = zones.select(norm_key("source").alias("clock"), "zone_name").filter("clock is not null")
    zone = zone.groupBy("clock").agg(F.min("zone_name").alias("zone_name"))
    parts = None
    for t in tables:
        rows = t.rows.filter(F.col(t.key).isNotNull()).select(
            F.col(t.key).cast("string").alias("record_key"),
            *[F.col(f).cast("string").alias(f) for f in t.fields],
            *([norm_key(t.clock).alias("clock")] if t.clock_of is None else []),
            (F.col(t.delivered) if t.delivered in t.rows.columns else F.lit(None).cast("timestamp")).alias("at"),
        )
        first = [c for c in rows.columns if c not in ("record_key", "at")]
        earliest = F.struct(F.col("at").isNull().alias("late"), "at", *first)
        rows = rows.groupBy("record_key").agg(F.min(earliest).alias("r")).select("record_key", *[f"r.{c}" for c in first])
        if t.clock_of is not None:
            clocks = (
                t.clock_of.select(norm_key(t.clock_key).alias("k"), norm_key(t.clock).alias("clock"))
                .filter("k is not null")
                .groupBy("k")
                .agg(F.max("clock").alias("clock"))
            )
            rows = rows.withColumn("k", norm_key("record_key")).join(clocks, "k", "left").drop("k")
        long = rows.select(
            F.lit(t.table).alias("table_name"),
            "record_key",
            "clock",
            F.explode(
                F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in t.fields])
            ).alias("x"),
        ).select("table_name", "record_key", "clock", "x.*")
        parts = long if parts is None else parts.unionByName(long)
    return (
        parts.filter(F.col("value").isNotNull())
        .join(zone, "clock", "left")
        .withColumn("epoch_us", epoch_us("value", F.coalesce("zone_name", F.lit("UTC"))))
        .filter(F.col("epoch_us").isNotNull())
        .select("table_name", "record_key", "field_name", "epoch_us")
    )


def to_timestamp(us: Column | str) -> Column:
    """A timestamp of epoch microseconds."""
    return F.timestamp_micros(us)
