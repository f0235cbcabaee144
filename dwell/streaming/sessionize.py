"""Online sessionization with keyed state in the engine's state store.

A stream of polls becomes a stream of changes: rows with ``sign`` 1 are new, rows with
``sign`` -1 take back a row announced before.  A session that a micro-batch leaves running
is announced as open, and taken back when it closes.  Adding up signs gives the sessions;
adding up signed durations gives totals that correct themselves.

* Before the state is touched, each task cuts the polls it has of one device and minute
  down to runs of one window, and drops polls that neither open nor end anything.  A
  device with very many polls is spread over its minutes in that step, and its state is
  met by one row per minute and window change.
* The state of a device is its last poll and the running session.  Devices are dealt to
  ``BUCKETS`` keys by hash, and a key holds the states of its devices: handing over a key
  costs about as much as a hundred devices in it.  Only keys with new polls, or whose
  timeout is due, are read and written in a micro-batch.  Which state store holds them is
  the session's setting.
* With ``idle_close`` a key has an event-time timeout at the earliest last poll, plus the gap
  limit, of its running sessions.  When the watermark (the newest poll of any device less
  ``lateness_seconds``, to the millisecond) passes that of a session, it is announced as
  closed at its last poll.  A poll that still comes within the gap takes that back.

Polls at or before the last poll of their own device in an earlier micro-batch are late;
they are counted and left out.  Polls of one window within a minute count as one in that,
by the last of them.  Devices that lag behind others lose nothing.  A task holds its share
of a micro-batch in memory; the reader's options bound a micro-batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dwell.functions.clock import epoch_micros, from_epoch_seconds
from dwell.functions.units import int_div
from dwell.operators.sessions import DEFAULT_MAX_GAP, SESSION_COLUMNS, with_validity

# Width of the cells in which polls are cut down to runs, in microseconds.
CELL = 60_000_000

RUNS = (
    "device_id long, first_us long, first_seq long, last_us long, last_seq long, prev_us long, "
    "kind int, app string, title string, polls long"
)
PACKED = "device_id long, runs binary, mark timestamp"
PACK_DEVICES, PACK_RUNS = 5_000, 20_000
# Keys of the state, and what one holds: device -> state, pickled.  More keys cost a
# micro-batch more, fewer make it rewrite more devices that had no polls.
BUCKETS, UNNAMED = 4096, -1
STATE = "devices binary"
CHANGES = (
    "device_id long, session_seq long, app string, title string, start_us long, end_us long, "
    "sign int, is_final boolean, late_polls long"
)
STORED = (
    "device_id long, session_seq long, app string, window_title string, start_time timestamp_ntz, "
    "end_time timestamp_ntz, duration_seconds long, is_foreground boolean, start_date date, sign int, "
    "late_polls long, is_final boolean"
)

# KNOWN is no poll but the state that earlier history has left.
NEUTRAL, VALID, STOP, KNOWN = 0, 1, 2, 3
# Stands for no time and no number in state and change rows.
NONE = -(1 << 63)
# How the running session was last announced.
HIDDEN, OPEN, IDLE = 0, 1, 2


# ---- runs of polls -------------------------------------------------------------------

def cut_to_runs(polls: pa.Table, max_gap_us: int) -> pa.Table:
    """Runs of the polls of whole (device, cell) groups.

    ``polls``: device_id, us, seq, kind, app, title.  A run is a stretch of valid polls of
    one window without a gap, or a single other poll.  ``prev_us`` is the time of the
    device's poll before the run if that lies in the same cell.
    """
    polls = polls.sort_by([("device_id", "ascending"), ("us", "ascending"), ("seq", "ascending")])
    device, us, seq, kind = (polls[c].to_numpy() for c in ("device_id", "us", "seq", "kind"))
    n = len(us)
    if n == 0:
        return pa.table([pa.array([], f.type) for f in _run_schema()], schema=_run_schema())
    cell = us // CELL
    first = np.ones(n, bool)
    first[1:] = (device[1:] != device[:-1]) | (cell[1:] != cell[:-1])
    last = np.append(first[1:], True)
    gap = np.zeros(n, bool)
    gap[1:] = ~first[1:] & (us[1:] - us[:-1] > max_gap_us)
    kept = np.flatnonzero((kind != NEUTRAL) | first | last | gap)

    def same(name: str) -> np.ndarray:
        codes = polls[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)[kept]
        return codes[1:] == codes[:-1]

    joins = (
        (kind[kept][1:] == VALID) & (kind[kept][:-1] == VALID) & ~first[kept][1:] & ~gap[kept][1:] & same("app") & same("title")
    )
    begins = np.flatnonzero(np.append(True, ~joins))
    heads, tails = kept[begins], kept[np.append(begins[1:], len(kept)) - 1]
    # Dropped polls count with the run they follow, or with the next one.
    counts = np.diff(np.append(0, tails[:-1] + 1), append=n)
    before = pa.array(us[np.maximum(heads - 1, 0)], mask=first[heads])
    columns = [device[heads], us[heads], seq[heads], us[tails], seq[tails], before, kind[heads].astype(np.int32)]
    texts = [polls[c].take(pa.array(heads)).combine_chunks() for c in ("app", "title")]
    return pa.table([*map(pa.array, columns), *texts, pa.array(counts)], schema=_run_schema())


def _run_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in RUNS.split(", "))])


MARK = pa.timestamp("us", "UTC")


def _packed(devices: pa.Array, rows: list[bytes], marks: pa.Array | None = None) -> pa.RecordBatch:
    marks = pa.nulls(len(rows), MARK) if marks is None else marks
    return pa.RecordBatch.from_arrays([devices, pa.array(rows, pa.binary()), marks], names=["device_id", "runs", "mark"])


def pack(runs: pa.Table) -> Iterator[pa.RecordBatch]:
    """Runs, sorted by device, as one row per device, or several if there are very many.

    The state operator hands over every column of every device by itself, so few columns
    and rows make it several times faster.
    """
    device = runs["device_id"].to_numpy()
    starts = np.flatnonzero(np.append(True, device[1:] != device[:-1])) if len(device) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(device))
    for at in range(0, len(starts), PACK_DEVICES):
        firsts, rows = [], []
        for begin, end in zip(starts[at:at + PACK_DEVICES].tolist(), ends[at:at + PACK_DEVICES].tolist()):
            for cut in range(begin, end, PACK_RUNS):
                part = runs.slice(cut, min(PACK_RUNS, end - cut)).drop_columns("device_id")
                rows.append(pickle.dumps(list(zip(*(c.to_pylist() for c in part.columns)))))
                firsts.append(device[cut])
        yield _packed(pa.array(firsts, pa.int64()), rows)


def runs_of(samples: DataFrame, max_gap: int, ignored: tuple[str, ...]) -> DataFrame:
    kind = F.when(F.col("is_stop"), STOP).when(F.col("valid"), VALID).otherwise(NEUTRAL)
    polls = with_validity(samples, ignored).select(
        "device_id", epoch_micros(F.col("ts")).alias("us"), "seq", kind.cast("int").alias("kind"), "app", "title"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            polls = pa.Table.from_batches(held)
            runs = cut_to_runs(polls, max_gap * 1_000_000)
            yield from pack(runs)
            newest = pa.array([pc.max(polls["us"]).as_py()], MARK)
            # The only row that moves the watermark; rows without a mark are never late for it.
            yield _packed(polls["device_id"][:1].combine_chunks(), [pickle.dumps([])], newest)

    spread = polls.repartition("device_id", int_div(F.col("us"), CELL))
    return spread.mapInArrow(run, PACKED)


# ---- the state of a device -----------------------------------------------------------

class Device:
    """A device's last poll and running session, and the changes they go through."""

    def __init__(self, key: int, state: tuple | None):
        self.key = key
        self.out: list[tuple] = []
        self.late = 0
        last_us, last_seq, self.app, self.title, self.start_us, self.session_seq, self.shown = (
            state or (NONE, NONE, "", "", NONE, NONE, HIDDEN)
        )
        self.last_us, self.last_seq = (None, None) if last_us == NONE else (last_us, last_seq)
        self.before_us = self.last_us

    def state(self) -> tuple:
        return (self.last_us, self.last_seq, self.app, self.title, self.start_us, self.session_seq, self.shown)

    @property
    def running(self) -> bool:
        return self.session_seq != NONE

    def _change(self, sign: int, end_us: int | None, is_final: bool) -> None:
        self.out.append((self.key, self.session_seq, self.app, self.title, self.start_us, NONE if end_us is None else end_us, sign, is_final, 0))

    def _take_back(self) -> None:
        """An idle session was announced as closed at the last poll before this micro-batch."""
        if self.shown != HIDDEN:
            self._change(-1, self.before_us if self.shown == IDLE else None, False)
        self.shown = HIDDEN

    def close(self, at_us: int) -> None:
        if self.running:
            self._take_back()
            self._change(1, at_us, True)
            self.app = self.title = ""
            self.start_us = self.session_seq = NONE

    def _know(self, last_us: int, last_seq: int, start_us: int, seq: int, app: str | None, title: str | None) -> None:
        """Start from what history in batch form has left; its open session is announced."""
        if self.last_us is None:
            self.last_us, self.last_seq = last_us, last_seq
            self.before_us = last_us
            if app is not None:
                self.app, self.title, self.start_us, self.session_seq = app, title, start_us, seq
                self._change(1, None, False)
                self.shown = OPEN

    def take(self, runs: Iterable[tuple], max_gap_us: int) -> None:
        """Runs of a micro-batch, in time order."""
        moved = False
        for first_us, first_seq, last_us, last_seq, prev_us, kind, app, title, polls in runs:
            if kind == KNOWN:
                self._know(last_us, last_seq, first_us, first_seq, app, title)
                continue
            known = self.last_us is not None
            if known and (last_us, last_seq) <= (self.last_us, self.last_seq):
                self.late += polls
                continue
            if known:
                first_us = max(first_us, self.last_us)
                prev_us = self.last_us if prev_us is None else max(prev_us, self.last_us)
            if prev_us is not None and first_us - prev_us > max_gap_us:
                self.close(prev_us)
            self.last_us, self.last_seq, moved = last_us, last_seq, True
            if kind == STOP:
                self.close(first_us)
            elif kind == VALID and (not self.running or (self.app, self.title) != (app, title)):
                self.close(first_us)
                self.app, self.title, self.start_us, self.session_seq = app, title, first_us, first_seq
        if self.running and self.shown != OPEN and moved:
            self._take_back()
            self._change(1, None, False)
            self.shown = OPEN
        if self.late:
            self.out.append((self.key, NONE, "", "", NONE, NONE, 0, False, self.late))

    def fall_idle(self) -> None:
        self._take_back()
        self._change(1, self.last_us, False)
        self.shown = IDLE

    def due_ms(self, max_gap_us: int) -> int:
        """The first millisecond that lies more than the gap after the last poll."""
        return (self.last_us + max_gap_us) // 1000 + 1


_COLUMNS = [c.split(" ")[0] for c in CHANGES.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(_COLUMNS, map(list, zip(*rows)))))


def _take_batch(max_gap_seconds: int, idle_close: bool):
    """What happens to the devices of a key with new polls, or whose timeout is due."""
    max_gap_us = max_gap_seconds * 1_000_000

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        states = pickle.loads(state.get[0]) if state.exists else {}
        found: dict[int | None, list[tuple]] = {}
        if not state.hasTimedOut:
            for part in parts:
                numbers = [None] * len(part) if key[0] == UNNAMED else part["device_id"].tolist()
                for number, packed in zip(numbers, part["runs"]):
                    found.setdefault(number, []).extend(pickle.loads(packed))
        out: list[tuple] = []
        for number, runs in found.items():
            runs.sort(key=lambda r: (r[5] != KNOWN, r[0], r[1]))
            device = Device(number, states.get(number))
            device.take(runs, max_gap_us)
            states[number] = device.state()
            out += device.out
        if idle_close:
            now, due = state.getCurrentWatermarkMs(), []
            for number, known in states.items():
                device = Device(number, known)
                if device.running and device.shown == OPEN:
                    at = device.due_ms(max_gap_us)
                    # As a timeout of its own would be: passed, or reached with new polls.
                    if at < now or (at == now and number in found):
                        device.fall_idle()
                        states[number] = device.state()
                        out += device.out
                    else:
                        due.append(at)
            if due:
                state.setTimeoutTimestamp(min(due))
        state.update((pickle.dumps(states),))
        if out:
            yield _frame(out)

    return update


# ---- the job -------------------------------------------------------------------------

class SessionStream:
    """Sessionizes a stream of samples into ``root``; restartable from its checkpoint.

    ``history`` is a folder with what earlier history in batch form has left, written from
    ``device_states``: the first micro-batch starts from it.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        max_gap_seconds: int = DEFAULT_MAX_GAP,
        ignored: tuple[str, ...] = (),
        idle_close: bool = False,
        lateness_seconds: int = 0,
        history: str | None = None,
    ):
        self.spark, self.root = spark, root
        self.max_gap, self.ignored = max_gap_seconds, ignored
        self.idle_close, self.lateness = idle_close, lateness_seconds
        self.history = history

    def changes(self, samples: DataFrame) -> DataFrame:
        """The stream of changes."""
        runs = runs_of(samples, self.max_gap, self.ignored)
        if self.history:
            known = self.spark.readStream.schema("device_id long, runs binary").parquet(self.history)
            runs = runs.unionByName(known, allowMissingColumns=True)
        if self.idle_close:
            runs = runs.withWatermark("mark", f"{self.lateness} seconds")
        dealt = F.pmod(F.xxhash64("device_id"), F.lit(BUCKETS))
        bucket = F.when(F.col("device_id").isNull(), UNNAMED).otherwise(dealt)
        changed = runs.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
            _take_batch(self.max_gap, self.idle_close), CHANGES, STATE, "append",
            GroupStateTimeout.EventTimeTimeout if self.idle_close else GroupStateTimeout.NoTimeout,
        )
        start, end = (
            F.when(F.col(c) != NONE, int_div(F.col(c) - F.pmod(F.col(c), F.lit(1_000_000)), 1_000_000))
            for c in ("start_us", "end_us")
        )
        return changed.select(
            "device_id", "session_seq", "app", F.col("title").alias("window_title"),
            from_epoch_seconds(start).alias("start_time"), from_epoch_seconds(end).alias("end_time"),
            F.coalesce(end - start, F.lit(0).cast("long")).alias("duration_seconds"),
            F.lit(True).alias("is_foreground"), F.to_date(from_epoch_seconds(start)).alias("start_date"),
            "sign", "late_polls", "is_final",
        )

    def start(self, samples: DataFrame, **trigger) -> StreamingQuery:
        return (
            self.changes(samples).writeStream.format("parquet").partitionBy("is_final")
            .option("path", f"{self.root}/changes").option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    # ---- results ----------------------------------------------------------

    def stored_changes(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(f"{self.root}/changes")

    def closed_sessions(self) -> DataFrame:
        """All sessions that have ended, those that are idle for now among them."""
        ended = self.stored_changes().filter("is_final").select(*SESSION_COLUMNS)
        return ended.unionByName(self._announced().filter("end_time is not null"))

    def open_sessions(self) -> DataFrame:
        return self._announced().filter("end_time is null")

    def _announced(self) -> DataFrame:
        """Sessions announced before their end and not taken back."""
        rows = self.stored_changes().filter("not is_final and sign <> 0")
        left = rows.groupBy(*SESSION_COLUMNS).agg(F.sum("sign").alias("sign"))
        return left.filter("sign > 0").drop("sign")

    def late_polls(self) -> int:
        return self.stored_changes().filter("not is_final").agg(F.sum("late_polls").alias("n")).collect()[0]["n"] or 0


def device_states(samples: DataFrame, sessions: DataFrame) -> DataFrame:
    """What a stream needs to go on after history in batch form: the last poll of each
    device, and the session that history leaves open."""
    us = epoch_micros(F.col("ts"))
    last = samples.groupBy("device_id").agg(F.max(F.struct(us.alias("us"), "seq")).alias("_last"))
    opened = samples.select("device_id", F.col("seq").alias("first_seq"), us.alias("first_us"))
    running = sessions.filter("end_time is null").select(
        "device_id", F.col("session_seq").alias("first_seq"), "app", F.col("window_title").alias("title")
    )
    known = last.join(running.join(opened, ["device_id", "first_seq"]), "device_id", "left").select(
        "device_id", "first_us", "first_seq", F.col("_last.us").alias("last_us"), F.col("_last.seq").alias("last_seq"),
        "app", "title",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                pickle.dumps([(start or 0, seq or 0, us, last, None, KNOWN, app, title, 0)])
                for start, seq, us, last, app, title in zip(*(c.to_pylist() for c in batch.columns[1:]))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["device_id", "runs"])

    return known.mapInArrow(run, "device_id long, runs binary")


def last_batch(query: StreamingQuery) -> int:
    """Number of the last batch a finished query has run, -1 if there was no data yet."""
    ran = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    return max(ran, default=-1)
