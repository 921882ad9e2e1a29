"""Which hours of a window a source can answer for, which are missing, and when archives needn't be read."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR = timedelta(hours=1)
#: A content range wider than this is not believed.
WIDEST = timedelta(days=7)


def hour_of(t: datetime) -> datetime:
    return t.replace(minute=0, second=0, microsecond=0)


@dataclass(frozen=True)
class Plan:
    live_ranges: list[tuple[datetime, datetime]] = field(default_factory=list)
    gaps: list[datetime] = field(default_factory=list)
    skip_live: bool = False


class GapError(RuntimeError):
    """A strict question about hours that no source has."""


def content_hours(label: datetime, first: datetime | None, last: datetime | None) -> set[datetime]:
    """The hours an archive covers: those of its content, if its range is there, in order and believable, and its label's."""
    out = {hour_of(label)}
    if first is not None and last is not None and first <= last and last - first <= WIDEST:
        at = hour_of(first)
        while at <= last:
            out.add(at)
            at += HOUR
    return out


def build_plan(live: set[datetime], archived: set[datetime], start: datetime | None, end: datetime | None, no_archive: bool = False, strict: bool = False) -> Plan | None:
    """The plan for hours from start to end, end excluded; None without bounds, which claims nothing."""
    if start is None or end is None:
        return None
    hours, at = [], hour_of(start)
    while at < end:
        hours.append(at)
        at += HOUR
    there = live if no_archive else live | archived
    gaps = [h for h in hours if h not in there]
    if strict and gaps:
        raise GapError(f"{len(gaps)} hours are in no source, the first {gaps[0]:%Y-%m-%d %H}:00")
    ranges: list[tuple[datetime, datetime]] = []
    for h in (h for h in hours if h in live):
        if ranges and ranges[-1][1] == h:
            ranges[-1] = (ranges[-1][0], h + HOUR)
        else:
            ranges.append((h, h + HOUR))
    clipped = [(max(a, start), min(b, end)) for a, b in ranges]
    return Plan(clipped, gaps, skip_live=not clipped and not gaps)


def top_n_needs_archives(filled: bool, descending: bool, in_one_live_range: bool, archives_below: bool) -> bool:
    """A newest-first page that one live range fills, above all archives, needs none; any other page does."""
    return not (filled and descending and in_one_live_range and archives_below)


def per_pk_needs_archives(wanted: list[str], live_counts: dict[str, int], n: int, other_spellings: bool = False, latest_candidates: bool = False) -> bool:
    """Keys that all have their n rows live need no archives; a missing, short or empty key does."""
    return other_spellings or latest_candidates or not wanted or any(not k or live_counts.get(k, 0) < n for k in wanted)


def hours(df: DataFrame, at: str = "event_timestamp") -> DataFrame:
    return df.select(F.date_trunc("hour", at).cast("timestamp_ntz").alias("hour")).distinct()


def gap_hours(window: DataFrame, *covered: DataFrame) -> DataFrame:
    """Hours from (start, end), end excluded, that none of the covered tables (hour) has."""
    every = window.select(F.explode(F.sequence(F.date_trunc("hour", "start").cast("timestamp_ntz"), F.col("end") - F.expr("interval 1 microsecond"), F.expr("interval 1 hour"))).alias("hour"))
    for c in covered:
        every = every.join(c.select("hour").distinct(), "hour", "left_anti")
    return every


def contiguous(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., start, end, hours): runs of consecutive hours, end excluded."""
    by = by or []
    n = F.row_number().over(Window.partitionBy(*by).orderBy("hour"))
    island = F.col("hour").cast("timestamp").cast("long") - 3600 * n
    marked = df.select(*by, "hour").distinct().withColumn("_island", island)
    return marked.groupBy(*by, "_island").agg(F.min("hour").alias("start"), (F.max("hour") + F.expr("interval 1 hour")).alias("end"), F.count("*").alias("hours")).drop("_island")
