"""Usage tables: how they are derived, stored and read."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dwell.operators.apps import app_key, apps_seen, upsert_apps
from dwell.operators.sessions import HotDevices, build_sessions, find_hot_devices
from dwell.schemas import APPS, SESSIONS
from dwell.sources.storage import fresh_folder

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# How the event table stands in for foreground polls.
EVENT_MAX_GAP = 12 * 3600
EVENT_IGNORED = ("/fr/",)


class UsageTables(NamedTuple):
    sessions: DataFrame
    apps: DataFrame


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_polls(events: DataFrame) -> DataFrame:
    """The device and time of every poll, for measuring."""
    return events.select(F.col("user_id").alias("device_id"), "ts")


def samples_from_events(events: DataFrame, pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """events -> samples; the title is the url of the page an event names.

    ``keep`` names further event columns to carry along.

    Few distinct page numbers occur, so a merge join on them is skewed.  The page side
    is broadcast when small; otherwise the runtime skew-join rule splits the hot keys,
    which is safe here as every row is shuffled again by device afterwards.
    """
    polls = events.select(
        F.col("user_id").alias("device_id"),
        "ts",
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("app"),
        F.get_json_object("props", "$.k").cast("long").alias("page_id"),
        *keep,
    )
    return polls.join(pages.select("page_id", "url"), "page_id", "left").select(
        "device_id", "ts", "seq", "app",
        F.coalesce("url", F.lit("")).alias("title"),
        F.lit(False).alias("is_stop"),
        *keep,
    )


def write_sessions(sessions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store sessions by start date.

    The rebalance keeps one date together where it is small and splits it over several
    tasks and files where it is large.
    """
    (
        sessions.hint("rebalance", "start_date")
        .sortWithinPartitions("start_date", "start_time")
        .write.mode(mode).partitionBy("start_date").parquet(path)
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SESSIONS).parquet(path)


def store_usage(
    spark: SparkSession,
    samples: DataFrame,
    path: str,
    max_gap_seconds: int,
    ignored: tuple[str, ...] = (),
    hot: HotDevices | None = None,
) -> UsageTables:
    """Sessionize once, store the result, and hand back the two usage tables.

    Reports then read the stored table with partition and column pruning in place of
    sessionizing every poll again.
    """
    sessions = build_sessions(samples, max_gap_seconds, ignored, hot)
    write_sessions(sessions.withColumn("app_id", app_key(F.col("app"))), f"{path}/sessions")
    named = spark.read.parquet(f"{path}/sessions")
    apps_seen(named).write.parquet(f"{path}/apps")
    return UsageTables(
        read_sessions(spark, f"{path}/sessions"), spark.read.parquet(f"{path}/apps")
    )


# ---- loads ----------------------------------------------------------------

# What a load leaves for the next one: each device's last poll, and its running session.
CARRIED = (
    "device_id long, ts timestamp_ntz, seq long, app string, title string, "
    "origin_ts timestamp_ntz, origin_seq long"
)


def append_usage(
    spark: SparkSession,
    samples: DataFrame,
    path: str,
    load: str,
    after: str | None,
    max_gap_seconds: int,
    ignored: tuple[str, ...] = (),
    hot: HotDevices | None = None,
) -> UsageTables:
    """Add the samples that have come since the load ``after`` (None: the first load).

    Only the new samples are sessionized, with one poll for every session still running.
    Sessions that end are written under this load by start date; running ones, the state
    of the devices and the applications are small tables of their own.  Files of earlier
    loads are neither read nor touched, and a load that runs again replaces itself.  Polls
    at or before the last one of their device in earlier loads are left out.
    """
    before = spark.createDataFrame([], CARRIED) if after is None else _load(spark, path, "state", after, CARRIED)
    known = before.select("device_id", F.col("ts").alias("_ts"), F.col("seq").alias("_seq"))
    late = (F.col("ts") < F.col("_ts")) | ((F.col("ts") == F.col("_ts")) & (F.col("seq") <= F.col("_seq")))
    fresh = samples.join(known, "device_id", "left").filter(~F.coalesce(late, F.lit(False))).select(*samples.columns)
    timeline = fresh.withColumns({"origin_ts": F.col("ts"), "origin_seq": F.col("seq")}).unionByName(
        before.filter("origin_seq is not null").withColumn("is_stop", F.lit(False))
    )
    folder = f"{path}/built/load={load}"  # read three times below
    built = build_sessions(timeline, max_gap_seconds, ignored, hot).withColumn("app_id", app_key(F.col("app")))
    built.write.mode("overwrite").parquet(folder)
    built = spark.read.schema(built.schema).parquet(folder)
    write_sessions(built.filter("end_time is not null").drop("app"), f"{path}/sessions/load={load}", "overwrite")
    running = built.filter("end_time is null")
    running.drop("app").write.mode("overwrite").parquet(f"{path}/open/load={load}")

    last = samples.select("device_id", "ts", "seq").unionByName(before.select("device_id", "ts", "seq")).groupBy("device_id").agg(
        F.max(F.struct("ts", "seq")).alias("_last")
    )
    starts = running.select(
        "device_id", "app", F.col("window_title").alias("title"), F.col("start_time").alias("origin_ts"),
        F.col("session_seq").alias("origin_seq"),
    )
    state = last.join(starts, "device_id", "left").select(
        "device_id", "_last.ts", "_last.seq", "app", "title", "origin_ts", "origin_seq"
    )
    state.write.mode("overwrite").parquet(f"{path}/state/load={load}")
    seen = apps_seen(built)
    apps = seen if after is None else upsert_apps(_load(spark, path, "apps", after, APPS), seen)
    apps.write.mode("overwrite").parquet(f"{path}/apps/load={load}")
    return read_usage(spark, path, load)


def _load(spark: SparkSession, path: str, table: str, load: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{table}/load={load}")


def read_usage(spark: SparkSession, path: str, load: str) -> UsageTables:
    """The usage tables after a load; loads are ordered by name."""
    with_load = StructType([*SESSIONS.fields, StructField("load", StringType())])
    closed = spark.read.schema(with_load).parquet(f"{path}/sessions").filter(F.col("load") <= load)
    names = SESSIONS.fieldNames()
    sessions = closed.select(*names).unionByName(_load(spark, path, "open", load, SESSIONS).select(*names))
    return UsageTables(sessions, _load(spark, path, "apps", load, APPS))


_stored: dict[tuple[str, str], str] = {}
_measured: dict[tuple[str, str], HotDevices] = {}


def event_samples(spark: SparkSession, folder: str) -> DataFrame:
    return samples_from_events(read_table(spark, folder, "events"), read_table(spark, folder, "pages"))


def event_hot_devices(spark: SparkSession, folder: str) -> HotDevices:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _measured:
        _measured[key] = find_hot_devices(event_polls(read_table(spark, folder, "events")))
    return _measured[key]


def event_usage(spark: SparkSession, folder: str) -> UsageTables:
    """The usage tables of an event folder, stored once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stored:
        path = fresh_folder(spark, "usage")
        store_usage(
            spark, event_samples(spark, folder), path, EVENT_MAX_GAP, EVENT_IGNORED,
            event_hot_devices(spark, folder),
        )
        _stored[key] = path
    path = _stored[key]
    return UsageTables(
        read_sessions(spark, f"{path}/sessions"), spark.read.parquet(f"{path}/apps")
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Every table with its number of rows."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def stored_path(spark: SparkSession, folder: str) -> str:
    """Where ``event_usage`` stored the tables of a folder."""
    return _stored[(spark.sparkContext.applicationId, folder)]
