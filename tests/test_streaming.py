import datetime as dt
import pathlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dwell.operators import sessions as S
from dwell.schemas import SAMPLES
from dwell.sources.storage import fresh_folder
from dwell.streaming import sessionize as ss
from dwell.streaming import usage as us
from simulation import random_polls, simulate
from test_sessions import rows_of

GAP = 60


def run(spark, job, folder):
    """One run over the files that have arrived since the last one."""
    query = job.start(spark.readStream.schema(SAMPLES).parquet(folder))
    query.awaitTermination()
    return ss.last_batch(query)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SAMPLES).coalesce(1).write.mode("append").parquet(folder)


class Feed:
    """A stream that gets rows in turns; after each one it starts again from its checkpoint."""

    def __init__(self, spark, **options):
        self.spark, self.options = spark, options
        self.folder, self.root = fresh_folder(spark, "in"), fresh_folder(spark, "stream")

    def push(self, rows, ignored=()):
        arrive(self.spark, self.folder, rows)
        self.job = ss.SessionStream(self.spark, self.root, GAP, ignored, **self.options)
        self.last = run(self.spark, self.job, self.folder)
        return self.job

    def all(self):
        return rows_of(self.job.closed_sessions().unionByName(self.job.open_sessions()))


def poll(second, seq, title="t", device=1, stop=False):
    return (device, dt.datetime(2024, 1, 1, 12) + dt.timedelta(seconds=second), seq, "app", title, stop)


@pytest.mark.parametrize("cell", [ss.CELL, 7_000_000])
def test_batches_and_restarts_equal_one_batch(spark, monkeypatch, cell):
    monkeypatch.setattr(ss, "CELL", cell)
    polls = random_polls(random.Random(4), devices=6, polls=80)
    polls.sort(key=lambda r: (r[1], r[2]))
    feed = Feed(spark)
    for start in range(0, len(polls), 120):
        feed.push(polls[start:start + 120], ("Desktop",))
    assert feed.all() == simulate(polls, GAP, ("Desktop",))
    assert feed.job.late_polls() == 0


def _table(polls, ignored=()):
    kind = [ss.STOP if p[5] else ss.VALID if p[3] and (p[4] or "").strip() else ss.NEUTRAL for p in polls]
    us_ = [(p[1] - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) for p in polls]
    columns = [[p[0] for p in polls], us_, [p[2] for p in polls], kind, [p[3] for p in polls], [p[4] for p in polls]]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["device_id", "us", "seq", "kind", "app", "title"])


def test_runs_of_a_hot_device_are_few():
    """An hour of polls, ten a second, of one window with blank titles between: one run and
    the outermost polls a minute, whatever the number of polls."""
    polls = [poll(i / 10, i, "t" if i % 3 else " ") for i in range(36_000)]
    runs = ss.cut_to_runs(_table(polls), GAP * 1_000_000)
    assert len(runs) <= 3 * 60 and sum(runs["polls"].to_pylist()) == len(polls)
    device = ss.Device(1, None)
    device.take(sorted(zip(*(c.to_pylist() for c in runs.columns[1:]))), GAP * 1_000_000)
    assert [(c[1], c[6], c[7]) for c in device.out] == [(1, 1, False)] and device.last_seq == 35_999


def test_late_polls_are_counted_and_left_out(spark):
    feed = Feed(spark)
    feed.push([poll(0, 0), poll(30, 1)])
    feed.push([poll(20, 9, "late"), poll(30, 1, "late"), poll(40, 2, "u")])
    assert feed.all() == simulate([poll(0, 0), poll(30, 1), poll(40, 2, "u")], GAP)
    assert feed.job.late_polls() == 2


def test_stop_closes_the_session(spark):
    feed = Feed(spark)
    feed.push([poll(0, 0)])
    assert [r.duration_seconds for r in feed.job.open_sessions().collect()] == [0]
    feed.push([poll(25, 1, stop=True)])
    feed.push([poll(30, 2)])
    assert [r.duration_seconds for r in feed.job.closed_sessions().collect()] == [25]
    assert feed.job.open_sessions().count() == 1


def test_idle_sessions_close_early_with_the_same_end(spark):
    polls = [poll(0, 0), poll(50, 1), poll(0, 2, device=2), poll(300, 3, device=2), poll(400, 4)]
    feed = Feed(spark, idle_close=True)
    feed.push(polls[:4])
    assert [r.duration_seconds for r in feed.job.closed_sessions().collect() if r.device_id == 1] == [50]
    feed.push(polls[4:])
    want, open_then = simulate(polls, GAP), {(2, 3)}
    # Device 2 has been silent for more than the limit by now and is closed as well.
    assert {r for r in feed.all() if r[:2] not in open_then} == {r for r in want if r[:2] not in open_then}
    assert [(r[5] - r[4]).total_seconds() for r in feed.all() if r[:2] in open_then] == [0]


def test_a_poll_within_the_gap_takes_an_idle_close_back(spark):
    """Device 1 is behind device 2; its polls are on time by its own clock."""
    feed = Feed(spark, idle_close=True)
    feed.push([poll(0, 0), poll(300, 1, device=2)])
    assert [(r.window_title, r.duration_seconds) for r in feed.job.closed_sessions().collect()] == [("t", 0)]  # idle so far
    feed.push([poll(30, 2, "u"), poll(50, 3, "v")])
    assert feed.job.late_polls() == 0
    got = {(r.device_id, r.window_title, r.duration_seconds) for r in feed.job.closed_sessions().collect()}
    assert got == {(1, "t", 30), (1, "u", 20), (1, "v", 0)}
    assert [r.device_id for r in feed.job.open_sessions().collect()] == [2]
    taken_back = feed.job.stored_changes().filter("sign = -1 and device_id = 1 and end_time is not null")
    assert [r.window_title for r in taken_back.collect()] == ["t"]


def test_lagging_devices_over_many_batches(spark):
    rng = random.Random(9)
    polls = random_polls(rng, devices=4, polls=60)
    behind = {d: rng.randrange(0, 3) for d in {p[0] for p in polls}}
    polls.sort(key=lambda r: (r[1], r[2]))
    feed = Feed(spark, idle_close=True)
    size = len(polls) // 3 + 1
    for batch in range(5):
        feed.push([p for i, p in enumerate(polls) if i // size + behind[p[0]] == batch], ("Desktop",))
    assert feed.job.late_polls() == 0
    want = {r[:5]: r for r in simulate(polls, GAP, ("Desktop",))}
    got = {r[:5]: r for r in feed.all()}
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or want[k][5] is None for k in want)  # or idle at the end


def test_a_run_without_data(spark):
    feed = Feed(spark)
    feed.push([poll(0, 0)])
    assert feed.last == 0 and run(spark, feed.job, feed.folder) == -1


def test_stream_goes_on_after_history_in_batch_form(spark):
    polls = random_polls(random.Random(8), devices=5, polls=60)
    polls.sort(key=lambda r: (r[1], r[2]))
    half = len(polls) // 2
    past = spark.createDataFrame(polls[:half], SAMPLES)
    sessions = S.build_sessions(past, GAP, ("Desktop",))
    known = fresh_folder(spark, "known")
    ss.device_states(past, sessions).write.parquet(known)
    feed = Feed(spark, history=known)
    feed.push(polls[half:], ("Desktop",))
    assert rows_of(sessions.filter("end_time is not null")) | feed.all() == simulate(polls, GAP, ("Desktop",))


def test_devices_share_a_bounded_number_of_state_keys(spark, monkeypatch):
    monkeypatch.setattr(ss, "BUCKETS", 3)
    polls = random_polls(random.Random(12), devices=20, polls=30)
    polls.sort(key=lambda r: (r[1], r[2]))
    for idle_close in (False, True):
        feed, half = Feed(spark, idle_close=idle_close), len(polls) // 2
        keys = []
        for part in (polls[:half], polls[half:]):
            arrive(spark, feed.folder, part)
            feed.job = ss.SessionStream(spark, feed.root, GAP, ("Desktop",), idle_close=idle_close)
            query = feed.job.start(spark.readStream.schema(SAMPLES).parquet(feed.folder))
            query.awaitTermination()
            keys += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        assert max(keys) <= 3
        want, got = simulate(polls, GAP, ("Desktop",)), feed.all()
        assert {r[:5] for r in got} == {r[:5] for r in want}
        assert idle_close or got == want


def _written(root, folder, since):
    """Bytes of files that appeared in a folder of the stream after a time."""
    base = pathlib.Path(root.removeprefix("file:")) / folder
    return sum(f.stat().st_size for f in base.rglob("*") if f.is_file() and f.stat().st_mtime > since and ".crc" not in f.name)


def test_what_a_batch_writes_does_not_grow_with_untouched_devices(spark):
    written = {}
    for devices in (5, 3000):
        feed = Feed(spark)
        feed.push([poll(d % 50, d, f"title {d}", device=d) for d in range(devices)])
        since = time.time()
        feed.push([poll(60, devices, "u", device=1)])
        written[devices] = [_written(feed.root, part, since) for part in ("changes", "checkpoint/state")]
        rows = feed.job.stored_changes().filter("sign <> 0 and device_id = 1").count()
        assert rows == 4  # announced, taken back, closed, announced
    few, many = written[5], written[3000]
    assert many[0] < 2 * few[0] + 20_000 and many[1] < 2 * few[1] + 20_000


def test_totals_of_a_session_seen_open_and_then_closed(spark):
    feed, root = Feed(spark), fresh_folder(spark, "live")

    def totals():
        job = us.LiveTotals(spark, root, "name")
        job.start(us.changes_by_app(us.read_changes(spark, feed.root))).awaitTermination()
        return [(r.name, r.minutes, r.session_count) for r in job.read().collect()]

    feed.push([poll(0, 0)])
    assert totals() == [("app", 0, 1)]
    feed.push([poll(i, i) for i in range(30, 601, 30)] + [poll(600, 601, stop=True)])
    assert totals() == [("app", 10, 1)]


def test_totals_are_folded(spark, monkeypatch):
    schema = "name string, start_time timestamp_ntz, duration_seconds long, sign int"
    job = us.LiveTotals(spark, fresh_folder(spark, "live"), "name")
    day = dt.datetime(2024, 1, 1)
    want = 0
    for batch in range(2 * us.FOLD + 3):
        rows = spark.createDataFrame([("a", day, 60 * batch, 1), ("a", day, 60, -1 if batch % 2 else 1)], schema)
        for _ in range(2 if batch % 5 == 0 or batch % us.FOLD == us.FOLD - 1 else 1):  # some run twice
            job._write(rows.withColumn("date", F.to_date("start_time")), batch)
        want += batch + (-1 if batch % 2 else 1)
        assert [r.minutes for r in job.read(batch).collect()] == [want]
        assert len(job._folders(batch)) <= us.FOLD + 1
    assert us.LiveTotals(spark, job.root, "name").read().count() == 0  # nothing run so far


def test_old_sessions_still_count(spark):
    schema = "name string, start_time timestamp_ntz, duration_seconds long"
    folder, root = fresh_folder(spark, "in"), fresh_folder(spark, "live")
    for day in (20, 1):
        spark.createDataFrame([("a", dt.datetime(2024, 1, day), 60)], schema).write.mode("append").parquet(folder)
        job = us.LiveTotals(spark, root, "name")
        job.start(spark.readStream.schema(schema).parquet(folder)).awaitTermination()
    assert sorted(str(r.date) for r in job.read().collect()) == ["2024-01-01", "2024-01-20"]


def test_live_totals_over_two_runs(spark):
    schema = "name string, window_title string, start_time timestamp_ntz, duration_seconds long"
    folder, root = fresh_folder(spark, "in"), fresh_folder(spark, "live")
    day = dt.datetime(2024, 1, 1, 23, 59, 59)
    runs = [[("a", "t", day, 3600), ("b", "t", day, 60)], [("a", "t", day, 1800), ("a", "t", day + dt.timedelta(seconds=1), 5)]]
    for rows in runs:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        job = us.LiveTotals(spark, root, "name")
        job.start(spark.readStream.schema(schema).parquet(folder)).awaitTermination()
    got = {(str(r.date), r.name): (r.hours, r.minutes, r.session_count) for r in job.read().collect()}
    assert got == {
        ("2024-01-01", "a"): (1.5, 90, 2), ("2024-01-01", "b"): (0.02, 1, 1), ("2024-01-02", "a"): (0.0, 0, 1),
    }


def test_live_apps(spark):
    job = us.LiveApps(spark, fresh_folder(spark, "apps"))
    schema = "app string, start_time timestamp_ntz"
    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    job._merge(spark.createDataFrame([("a", late)], schema), 0)
    job._merge(spark.createDataFrame([("a", early), ("b", early)], schema), 1)
    got = {(r.name, r.first_seen, r.last_seen) for r in job.read(1).collect()}
    assert got == {("a", early, late), ("b", early, early)}
