"""Adding stretches of samples to stored usage."""

import datetime as dt
import pathlib
import random

import pytest

from dwell.operators import sessions as S
from dwell.operators.apps import apps_seen
from dwell.schemas import SAMPLES
from dwell.sources import storage, tables as tb
from dwell.sources.storage import fresh_folder
from simulation import random_polls, simulate

GAP = 60
NAMES = ("device_id", "session_seq", "app_id", "window_title", "start_time", "end_time", "duration_seconds")


def _files(path):
    base = pathlib.Path(path.removeprefix("file:"))
    return {f: f.stat().st_mtime_ns for f in base.rglob("*.parquet")}


@pytest.mark.parametrize("slice_rows", [None, 20])
def test_loads_one_by_one_equal_one_build(spark, slice_rows):
    polls = random_polls(random.Random(11), devices=7, polls=90, step=7200)
    polls.sort(key=lambda r: (r[1], r[2]))
    whole = spark.createDataFrame(polls, SAMPLES)
    hot = S.find_hot_devices(whole, slice_rows) if slice_rows else None
    path, after = fresh_folder(spark, "loads"), None
    part_of = lambda p: int((p[1] - polls[0][1]) / (polls[-1][1] - polls[0][1]) * 3.99)
    assert len({p[1].date() for p in polls}) > 1
    for number in range(4):
        load, kept = str(number), {} if after is None else _files(path)
        part = spark.createDataFrame([p for p in polls if part_of(p) == number], SAMPLES)
        for _ in range(2 if number == 1 else 1):  # one load runs twice
            usage = tb.append_usage(spark, part, path, load, after, GAP, ("Desktop",), hot)
        assert kept.items() <= _files(path).items()  # files of other loads keep their time
        after = load
    want = {(d, q, a, t, s, e, n) for d, q, a, t, s, e, n in simulate(polls, GAP, ("Desktop",))}
    built = S.build_sessions(whole, GAP, ("Desktop",)).withColumn("app_id", tb.app_key(tb.F.col("app")))
    one = {tuple(r) for r in built.select(*NAMES).collect()}
    assert {tuple(r) for r in usage.sessions.select(*NAMES).collect()} == one and len(one) == len(want)
    assert sorted(map(str, usage.apps.collect())) == sorted(map(str, apps_seen(built).select(*usage.apps.columns).collect()))


def test_late_polls_and_empty_loads(spark):
    at = dt.datetime(2024, 1, 1)
    poll = lambda s, q, title="t": (1, at + dt.timedelta(seconds=s), q, "app", title, False)
    path = fresh_folder(spark, "loads")
    frame = lambda rows: spark.createDataFrame(rows, SAMPLES)
    tb.append_usage(spark, frame([poll(0, 0), poll(30, 1)]), path, "1", None, GAP)
    tb.append_usage(spark, frame([]), path, "2", "1", GAP)
    usage = tb.append_usage(spark, frame([poll(20, 9, "late"), poll(40, 2, "u")]), path, "3", "2", GAP)
    assert sorted((r.window_title, r.duration_seconds, r.end_time is None) for r in usage.sessions.collect()) == [
        ("t", 40, False), ("u", 0, True)]
    assert tb.read_usage(spark, path, "2").sessions.count() == 1  # as it was after that load


class _Cluster:
    """A session on a cluster without a shared folder."""

    def __init__(self, warehouse):
        self.conf = {"spark.sql.warehouse.dir": warehouse}
        self.sparkContext = self
        self.master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


def test_machine_local_folders_are_refused_on_a_cluster():
    for folder in ("file:/tmp/warehouse", "/tmp/warehouse", None):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.shared_root(_Cluster(folder))
    assert storage.shared_root(_Cluster("hdfs://host/warehouse/")) == "hdfs://host/warehouse"
