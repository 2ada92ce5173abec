"""Local calendar dates and times by region; instants are TIMESTAMP under a UTC session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_time(instant: Column, zone: str) -> Column:
    return F.from_utc_timestamp(instant, zone)


def local_date(instant: Column, zone: str) -> Column:
    """The calendar date in a region (TZ-01)."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def to_utc(local: Column, zone: str) -> Column:
    """The instant of a local time.  Times that a change of clocks skips or repeats resolve to one instant (TZ-03)."""
    return F.to_utc_timestamp(local, zone)


def day_hours(date: Column, zone: str) -> Column:
    """Hours of a local calendar day: 23 or 25 where clocks change (TZ-02)."""
    start = F.unix_timestamp(F.to_utc_timestamp(date.cast("timestamp"), zone))
    end = F.unix_timestamp(F.to_utc_timestamp(F.date_add(date, 1).cast("timestamp"), zone))
    return (end - start) / 3600


def fixed_offset_time(instant: Column, offset: str) -> Column:
    """Local time by a fixed offset such as ``-05:00``; differs from the region's in summer (TZ-04)."""
    return F.from_utc_timestamp(instant, offset)
