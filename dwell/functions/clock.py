"""Clock arithmetic on TIMESTAMP_NTZ columns.

Local wall-clock times carry no zone, so nothing here casts to TIMESTAMP: a cast
would go through the session zone and bend intervals around clock changes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

DAY_SECONDS = 86_400


def wall_clock(at: dt.datetime) -> Column:
    """A naive datetime as a TIMESTAMP_NTZ literal, untouched by any zone."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def _second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 00:00:00 on the same wall clock."""
    return F.unix_date(F.to_date(ts)).cast("long") * DAY_SECONDS + _second_of_day(ts)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00:00 on the same wall clock."""
    of_minute = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    minutes = F.unix_date(F.to_date(ts)).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minutes * 60_000_000 + of_minute


def from_epoch_seconds(seconds: Column) -> Column:
    """The wall-clock time that lies so many seconds after 1970-01-01 00:00:00."""
    return wall_clock(dt.datetime(1970, 1, 1)) + F.lit(dt.timedelta(seconds=1)) * seconds


def whole_second(ts: Column) -> Column:
    """Drop the fraction of a second."""
    return F.to_date(ts).cast("timestamp_ntz") + F.lit(dt.timedelta(seconds=1)) * _second_of_day(ts)


def seconds_between(start: Column, end: Column) -> Column:
    return epoch_seconds(end) - epoch_seconds(start)


def interval_seconds(seconds: int) -> Column:
    return F.lit(dt.timedelta(seconds=seconds))


def gap_exceeds(earlier: Column, later: Column, max_gap_seconds: int) -> Column:
    """Strictly more than ``max_gap_seconds`` between two polls, to the microsecond."""
    return (later - earlier) > interval_seconds(max_gap_seconds)
