"""The application dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def app_key(name: Column, path: Column | None = None) -> Column:
    """Stable key of (name, path); an unknown path differs from an empty one."""
    known = F.lit("\x02") if path is None else F.coalesce(path, F.lit("\x02"))
    return F.md5(F.concat(name, F.lit("\x01"), known))


def apps_seen(switches: DataFrame, name: str = "app", path: str | None = None, ts: str = "start_time") -> DataFrame:
    """One row per application that was switched to, with first and last time."""
    path_col = F.col(path) if path else F.lit(None).cast("string")
    return (
        switches.select(F.col(name).alias("name"), path_col.alias("executable_path"), F.col(ts).alias("_ts"))
        .groupBy("name", "executable_path")
        .agg(F.min("_ts").alias("first_seen"), F.max("_ts").alias("last_seen"))
        .select(
            app_key(F.col("name"), F.col("executable_path")).alias("app_id"),
            "name", "executable_path", "first_seen", "last_seen",
        )
    )


def upsert_apps(existing: DataFrame, seen: DataFrame) -> DataFrame:
    """Insert new applications, widen first/last seen of known ones; the key never changes."""
    return existing.unionByName(seen).groupBy("app_id").agg(
        F.min("name").alias("name"),
        F.min("executable_path").alias("executable_path"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def with_app(sessions: DataFrame, apps: DataFrame) -> DataFrame:
    """Sessions with their application name; sessions of unknown applications drop out.

    No hint: the application table is broadcast when its measured size allows it and
    is otherwise merge-joined with skewed keys split at run time.
    """
    return sessions.join(apps.select("app_id", "name"), "app_id")


def lookup_session(sessions: DataFrame, apps: DataFrame, device_id, session_seq) -> DataFrame:
    """One session by its key, with its application."""
    found = sessions.filter((F.col("device_id") == device_id) & (F.col("session_seq") == session_seq))
    return with_app(found, apps).select("name", "window_title", "start_time", "device_id", "session_seq")


def current_sessions(sessions: DataFrame, apps: DataFrame, device_id=None) -> DataFrame:
    """The open session of a device, or of every device."""
    running = sessions.filter(F.col("end_time").isNull())
    if device_id is not None:
        running = running.filter(F.col("device_id") == device_id)
    return with_app(running, apps).select("name", "window_title", "start_time", "device_id", "session_seq")
