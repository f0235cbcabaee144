import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dwell.operators import sessions as S
from dwell.schemas import SAMPLES
from simulation import random_polls, simulate

KEY = ("device_id", "session_seq", "app", "window_title", "start_time", "end_time", "duration_seconds")


def rows_of(df):
    rows = [tuple(r[c] for c in KEY) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("width", [None, 1, 16, 64, 1024, 1 << 20])
def test_matches_simulation(spark, seed, width):
    polls = random_polls(random.Random(seed))
    samples = spark.createDataFrame(polls, SAMPLES)
    hot = None
    if width:
        hot = S.HotDevices({d: width for d in range(0, 40, 2)})
    got = rows_of(S.build_sessions(samples, 60, ("Desktop",), hot))
    assert got == simulate(polls, 60, ("Desktop",))


@pytest.mark.parametrize("width", [4, 64, 4096])
def test_islands_and_sleep_do_not_depend_on_slices(spark, width):
    samples = spark.createDataFrame(random_polls(random.Random(7)), SAMPLES)
    hot = S.HotDevices({d: width for d in range(40)})
    for op in (S.detect_sleep, S.number_islands):
        plain, sliced = op(samples, 60), op(samples, 60, hot)
        assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))
    changes = S.window_changes(samples, 60)
    assert sorted(map(str, changes.collect())) == sorted(
        map(str, S.window_changes(samples, 60, (), hot).collect()))


def poll_times(spark, seconds, app="chrome", title="t"):
    start = dt.datetime(2026, 1, 26, 15, 0, 0)
    rows = [(1, start + dt.timedelta(seconds=s), i, app, title, False) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, SAMPLES)


def test_gap_is_strictly_above_the_limit(spark):
    assert S.detect_sleep(poll_times(spark, [0, 1, 2]), 5).count() == 0
    assert S.detect_sleep(poll_times(spark, [0, 1, 6]), 5).count() == 0
    assert S.detect_sleep(poll_times(spark, [0, 1, 7]), 5).count() == 1


def test_window_switch(spark):
    start = dt.datetime(2026, 1, 26, 15, 0, 0)
    rows = [
        (1, start, 0, "chrome.exe", "gmail.com", False),
        (1, start + dt.timedelta(seconds=7), 1, "wegame.exe", "league of legends", False),
    ]
    out = S.build_sessions(spark.createDataFrame(rows, SAMPLES)).orderBy("start_time").collect()
    assert out[0].end_time == start + dt.timedelta(seconds=7) and out[0].duration_seconds == 7
    assert out[1].end_time is None and out[1].duration_seconds == 0


def test_same_window_after_sleep_is_a_new_session(spark):
    out = S.build_sessions(poll_times(spark, [0, 10, 200, 210]), 60).orderBy("start_time").collect()
    assert [r.duration_seconds for r in out] == [10, 0]


def test_one_shuffle_for_whole_devices(spark):
    samples = spark.createDataFrame(random_polls(random.Random(1), 3, 10), SAMPLES)
    plan = S.build_sessions(samples, 60)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


def test_hot_devices_are_found_and_bounded(spark):
    rows = [(7, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, "a", "t", False) for i in range(3000)]
    rows += [(d, dt.datetime(2024, 1, 1), 0, "a", "t", False) for d in range(100, 200)]
    samples = spark.createDataFrame(rows, SAMPLES)
    hot = S.find_hot_devices(samples, slice_rows=500)
    assert list(hot.widths) == [7]
    slices = samples.withColumn("slice", hot.slice_of(F.col("device_id"), F.col("ts")))
    sizes = slices.filter("device_id = 7").groupBy("slice").count()
    assert sizes.count() > 1 and sizes.agg(F.max("count")).collect()[0][0] <= 500
    assert slices.filter("device_id <> 7 and slice <> 0").count() == 0
    assert not S.find_hot_devices(samples)


def test_close_open_sessions(spark):
    sessions = S.build_sessions(poll_times(spark, [0, 10]), 60)
    at = F.lit(dt.datetime(2026, 1, 26, 15, 0, 30)).cast("timestamp_ntz")
    row = S.close_open_sessions(sessions, at).collect()[0]
    assert row.duration_seconds == 30 and row.end_time == dt.datetime(2026, 1, 26, 15, 0, 30)
    other = S.close_open_sessions(sessions, at, F.lit(99)).collect()[0]
    assert other.end_time is None


def test_many_medium_devices_are_all_sliced(spark):
    """No slice of any device exceeds the limit, however many devices there are."""
    polls = spark.range(0, 3000 * 40).selectExpr(
        "id % 3000 AS device_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id div 3000 * 7000) AS ts"
    )
    hot = S.find_hot_devices(polls, 15)
    assert len(hot.widths) == 3000
    sizes = polls.groupBy("device_id", hot.slice_of(F.col("device_id"), F.col("ts")).alias("slice")).count()
    assert sizes.agg(F.max("count")).collect()[0][0] <= 15
