"""Usage reports over the stored sessions and applications.

Every report takes its dates as parameters, and breaks ties by name and then by session
key, so that the same tables always give the same rows.  Date conditions are on the
partition column ``start_date``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from dwell.functions.dates import parse_bound
from dwell.functions.text import DEFAULT_IGNORED, has_text, is_ignored
from dwell.functions.units import hours, minutes
from dwell.operators.apps import with_app

Date = str | dt.date


# ---- date filters ---------------------------------------------------------

def on_date(sessions: DataFrame, day: Date) -> DataFrame:
    return sessions.filter(F.col("start_date") == F.lit(parse_bound(day)))


def between_dates(sessions: DataFrame, start: Date, end: Date) -> DataFrame:
    """Both ends included; an inverted range is empty."""
    return sessions.filter(
        F.col("start_date").between(F.lit(parse_bound(start)), F.lit(parse_bound(end)))
    )


def last_days(sessions: DataFrame, as_of: Date, days: int) -> DataFrame:
    """From ``days`` before ``as_of`` on, so ``days + 1`` dates up to ``as_of``."""
    first = parse_bound(as_of) - dt.timedelta(days=days)
    return sessions.filter(F.col("start_date") >= F.lit(first))


def closed(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("end_time").isNotNull())


def still_open(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("end_time").isNull())


def nonzero(report: DataFrame) -> DataFrame:
    return report.filter((F.col("minutes") > 0) | (F.col("hours") > 0))


def foreground(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("is_foreground"))


def background_windows(windows: DataFrame, ignored: tuple[str, ...] = DEFAULT_IGNORED) -> DataFrame:
    """Visible windows that are not the foreground one, without blank and ignored titles."""
    shown = windows.filter(
        ~F.col("is_foreground") & has_text(F.col("title")) & ~is_ignored(F.col("title"), ignored)
    )
    return shown.withColumnsRenamed({"app": "process_name", "title": "window_title"})


# ---- projections ----------------------------------------------------------

def usage_units(df: DataFrame, seconds: str = "duration_seconds") -> DataFrame:
    return df.withColumns({"minutes": minutes(F.col(seconds)), "hours": hours(F.col(seconds))})


def time_features(sessions: DataFrame) -> DataFrame:
    """Fractional minutes, hour of day and day of week (Monday = 0)."""
    return sessions.withColumns({
        "duration_minutes": F.col("duration_seconds") / F.lit(60.0),
        "hour_of_day": F.hour("start_time"),
        "day_of_week": F.weekday("start_time"),
    })


# ---- usage per application ------------------------------------------------

def _seconds_by_app(sessions: DataFrame, apps: DataFrame) -> DataFrame:
    """Sum per key first, so that the join sees one row per application."""
    per_key = sessions.groupBy("app_id").agg(F.sum("duration_seconds").alias("seconds"))
    return (
        with_app(per_key, apps).groupBy("name")
        .agg(F.coalesce(F.sum("seconds"), F.lit(0).cast("long")).alias("seconds"))
    )


def _ranked(usage: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = usage.orderBy(F.col("seconds").desc(), "name")
    if limit is not None:
        ordered = ordered.limit(limit)
    return ordered.select(
        "name", hours(F.col("seconds")).alias("hours"), minutes(F.col("seconds")).alias("minutes")
    )


def day_total(sessions: DataFrame, day: Date) -> DataFrame:
    """Time of a day, counting sessions of unknown applications too; 0 without data."""
    seconds = F.coalesce(F.sum("duration_seconds"), F.lit(0).cast("long"))
    return on_date(sessions, day).agg(seconds.alias("seconds")).select(
        hours(F.col("seconds")).alias("total_hours"), minutes(F.col("seconds")).alias("total_minutes")
    )


def day_by_app(sessions: DataFrame, apps: DataFrame, day: Date) -> DataFrame:
    return _ranked(_seconds_by_app(on_date(sessions, day), apps))


def range_by_app(sessions: DataFrame, apps: DataFrame, start: Date, end: Date) -> DataFrame:
    return _ranked(_seconds_by_app(between_dates(sessions, start, end), apps))


def day_top(sessions: DataFrame, apps: DataFrame, day: Date, limit: int = 10) -> DataFrame:
    """Chart rows of a day: the report without its tail, planned as a top-k."""
    return _ranked(_seconds_by_app(on_date(sessions, day), apps), limit)


def range_top(sessions: DataFrame, apps: DataFrame, start: Date, end: Date, limit: int = 20) -> DataFrame:
    return _ranked(_seconds_by_app(between_dates(sessions, start, end), apps), limit)


def top_apps(sessions: DataFrame, apps: DataFrame, as_of: Date, days: int = 1, limit: int = 5) -> DataFrame:
    return _ranked(_seconds_by_app(last_days(sessions, as_of, days), apps), limit).select(
        "name", F.col("hours").alias("total_hours"), F.col("minutes").alias("total_minutes")
    )


def range_count(sessions: DataFrame, start: Date, end: Date) -> DataFrame:
    return between_dates(sessions, start, end).agg(F.count(F.lit(1)).alias("session_count"))


# ---- usage per date, hour, title ------------------------------------------

def daily(sessions: DataFrame, as_of: Date, days: int = 7) -> DataFrame:
    """Time per date, in date order; dates without sessions are absent."""
    per_date = last_days(sessions, as_of, days).groupBy("start_date").agg(
        F.sum("duration_seconds").alias("seconds")
    )
    return per_date.orderBy("start_date").select(
        F.col("start_date").alias("date"),
        hours(F.col("seconds")).alias("total_hours"),
        minutes(F.col("seconds")).alias("total_minutes"),
    )


def hour_histogram(sessions: DataFrame, apps: DataFrame, day: Date) -> DataFrame:
    """Number of sessions that start in each hour of a day."""
    return (
        with_app(on_date(sessions, day), apps)
        .groupBy(F.hour("start_time").alias("hour_of_day"))
        .agg(F.count(F.lit(1)).alias("session_count"))
        .orderBy("hour_of_day")
    )


def usage_by_title(sessions: DataFrame, apps: DataFrame) -> DataFrame:
    """(name, window_title, seconds, session_count), summed before the join."""
    per_key = sessions.groupBy("app_id", "window_title").agg(
        F.sum("duration_seconds").alias("seconds"), F.count(F.lit(1)).alias("session_count")
    )
    return with_app(per_key, apps).groupBy("name", "window_title").agg(
        F.sum("seconds").alias("seconds"), F.sum("session_count").alias("session_count")
    )


def by_title(sessions: DataFrame, apps: DataFrame, start: Date, end: Date) -> DataFrame:
    usage = usage_by_title(between_dates(sessions, start, end), apps)
    return usage.orderBy(F.col("seconds").desc(), "name", "window_title").select(
        F.col("name").alias("app"),
        F.col("window_title").alias("window"),
        minutes(F.col("seconds")).alias("minutes"),
        hours(F.col("seconds")).alias("hours"),
        "session_count",
    )


def distinct_titles(sessions: DataFrame, apps: DataFrame, app: str) -> DataFrame:
    of_app = apps.filter(F.col("name") == app)
    return with_app(sessions, of_app).select("window_title").distinct()


# ---- session lists --------------------------------------------------------

def _activity(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        F.col("name").alias("process"),
        "window_title",
        "start_time",
        minutes(F.col("duration_seconds")).alias("duration_minutes"),
    )


def recent(sessions: DataFrame, apps: DataFrame, limit: int = 10) -> DataFrame:
    newest = with_app(sessions, apps).orderBy(
        F.col("start_time").desc(), "name", "device_id", "session_seq"
    )
    return _activity(newest.limit(limit))


def timeline(sessions: DataFrame, apps: DataFrame, day: Date) -> DataFrame:
    return _activity(
        with_app(on_date(sessions, day), apps).orderBy("start_time", "name", "device_id", "session_seq")
    )


def raw_sessions(sessions: DataFrame, apps: DataFrame, start: Date, end: Date) -> DataFrame:
    """Closed sessions of a range in time order."""
    return (
        with_app(closed(between_dates(sessions, start, end)), apps)
        .orderBy("start_time", "name", "device_id", "session_seq")
        .select(
            F.col("name").alias("process"), "window_title", "start_time", "end_time", "duration_seconds"
        )
    )
