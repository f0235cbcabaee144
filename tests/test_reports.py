import os
import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwell.operators import apps as ap
from dwell.operators import maintenance as mt
from dwell.plans import reports as rp
from dwell.schemas import SESSIONS
from dwell.sources import tables as tb
from dwell.sources.storage import fresh_folder

DAY = dt.date(2026, 1, 26)
NOW = dt.datetime(2026, 1, 26, 16, 0, 0)
ROWS = [
    ("chrome.exe", "GitHub主页", 180, 3600), ("code.exe", "main.py", 120, 1800),
    ("chrome.exe", "Stack Overflow", 60, 1200), ("notepad.exe", "notes.txt", 30, 600),
    ("wechat.exe", "微信聊天", 15, 300),
]


def make(spark, rows):
    """rows: (app, title, start, seconds or None for an open session)."""
    data = []
    for seq, (app, title, start, seconds) in enumerate(rows):
        end = None if seconds is None else start + dt.timedelta(seconds=seconds)
        data.append((1, seq, app, title, start, end, seconds or 0, True, start.date()))
    df = spark.createDataFrame(data, SESSIONS)
    named = df.withColumnRenamed("app_id", "app")
    return df.withColumn("app_id", ap.app_key(F.col("app_id"))), ap.apps_seen(named)


@pytest.fixture(scope="module")
def usage(spark):
    return make(spark, [(a, t, NOW - dt.timedelta(minutes=m), s) for a, t, m, s in ROWS])


def test_day_summary(usage):
    sessions, apps = usage
    total = rp.day_total(sessions, DAY).collect()[0]
    assert (total.total_minutes, total.total_hours) == (125, 2.08)
    got = [(r.name, r.minutes, r.hours) for r in rp.day_by_app(sessions, apps, "2026/1/26").collect()]
    assert got == [
        ("chrome.exe", 80, 1.33), ("code.exe", 30, 0.5), ("notepad.exe", 10, 0.17), ("wechat.exe", 5, 0.08)
    ]
    assert [r.name for r in rp.day_top(sessions, apps, DAY, 2).collect()] == ["chrome.exe", "code.exe"]


def test_empty_day_is_zero(usage):
    total = rp.day_total(usage[0], "2020-1-1").collect()[0]
    assert (total.total_hours, total.total_minutes) == (0.0, 0)


def test_unknown_application_counts_only_in_the_total(usage):
    sessions, apps = usage
    known = apps.filter(F.col("name") != "chrome.exe")
    assert rp.day_total(sessions, DAY).collect()[0].total_minutes == 125
    assert [r.minutes for r in rp.day_by_app(sessions, known, DAY).collect()] == [30, 10, 5]


def test_inverted_range_is_empty_and_last_days_has_one_more_date(spark):
    days = [(f"a{i}", "t", dt.datetime(2026, 1, 10 + i, 9), 60) for i in range(10)]
    sessions, apps = make(spark, days)
    assert rp.range_count(sessions, "2026-1-15", "2026-1-12").collect()[0].session_count == 0
    assert rp.range_count(sessions, "2026-1-12", "2026-1-15").collect()[0].session_count == 4
    assert rp.daily(sessions, "2026-1-19", 7).count() == 8


def test_open_sessions(spark):
    rows = [("a", "t", NOW, 60), ("b", "t", NOW, None)]
    sessions, apps = make(spark, rows)
    assert rp.range_count(sessions, DAY, DAY).collect()[0].session_count == 2
    assert [r.process for r in rp.raw_sessions(sessions, apps, DAY, DAY).collect()] == ["a"]
    assert [(r.name, r.session_seq) for r in ap.current_sessions(sessions, apps, 1).collect()] == [("b", 1)]
    assert [r.name for r in ap.lookup_session(sessions, apps, 1, 0).collect()] == ["a"]


def test_order_and_ties(spark):
    rows = [("b", "t", NOW, 60), ("a", "t", NOW, 60), ("c", "t", NOW - dt.timedelta(hours=1), 60)]
    sessions, apps = make(spark, rows)
    assert [r.process for r in rp.recent(sessions, apps, 2).collect()] == ["a", "b"]
    assert [r.process for r in rp.timeline(sessions, apps, DAY).collect()] == ["c", "a", "b"]
    assert [r.name for r in rp.top_apps(sessions, apps, DAY, 1, 2).collect()] == ["a", "b"]


def test_zone_of_the_session_does_not_matter(spark):
    """Wall-clock times on both sides of a clock change keep their exact distance."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = [("a", "t", dt.datetime(2024, 3, 10, 1, 59, 0), None), ("b", "t", dt.datetime(2024, 3, 10, 2, 30), None)]
        sessions, _ = make(spark, rows)
        from dwell.operators.sessions import close_open_sessions

        at = F.lit("2024-03-10 03:00:30").cast("timestamp_ntz")
        got = sorted(r.duration_seconds for r in close_open_sessions(sessions, at).collect())
        assert got == [1830, 3690]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_stored_table_prunes_dates(spark, usage):
    sessions, _ = usage
    path = fresh_folder(spark, "test")
    tb.write_sessions(sessions, path)
    plan = rp.on_date(tb.read_sessions(spark, path), DAY)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(start_date" in plan


def test_purge(spark, usage):
    sessions, _ = usage
    path = fresh_folder(spark, "test")
    older, _ = make(spark, [("a", "t", dt.datetime(2026, 1, d, 9), 60) for d in (20, 21, 22)])
    tb.write_sessions(sessions.unionByName(older), path)
    files = [f for f in tb.read_sessions(spark, path).inputFiles() if "start_date=2026-01-20" in f]
    times = {f: os.stat(f.removeprefix("file://")).st_mtime_ns for f in files}
    assert mt.purge_stored(spark, path, "2026.1.21", "2026/01/26") == 7
    assert tb.read_sessions(spark, path).count() == 1
    assert times == {f: os.stat(f.removeprefix("file://")).st_mtime_ns for f in tb.read_sessions(spark, path).inputFiles()}
    assert mt.purge_stored(spark, path, "2026.1.21", "2026/01/26") == 0
    kept, deleted = mt.purge_day(sessions, DAY)
    assert kept.count() == 0 and deleted.collect()[0].deleted_count == 5


def test_upsert_keeps_key_and_widens(spark):
    def seen(ts, path=None):
        return ap.apps_seen(
            spark.createDataFrame([("a", path, ts)], "app string, path string, start_time timestamp_ntz"),
            path="path")

    first, last = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2)
    out = ap.upsert_apps(seen(last), seen(first)).collect()
    assert [(r.name, r.first_seen, r.last_seen) for r in out] == [("a", first, last)]
    assert out[0].app_id == seen(first).collect()[0].app_id
    assert ap.upsert_apps(seen(last), seen(first, "/bin/a")).count() == 2
    assert ap.upsert_apps(seen(last, ""), seen(first)).count() == 2
