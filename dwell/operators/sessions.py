"""Sessionization: polls of the foreground window -> window sessions.

Rules
-----
* A gap of strictly more than ``max_gap_seconds`` between two polls of a device, over
  all polls, means the device slept.  The running session ends at the last poll before
  the gap.  A stop poll ends it as well, at its own time.
* A poll without app, with a blank title or with an ignored title neither ends nor
  changes the running session.
* A valid poll opens a session when none runs or when app or title differ from the
  running one, which then ends at that poll.
* A session nothing has ended yet is open: NULL end, duration 0.

Scale
-----
``build_sessions`` shuffles once, on the device, and sorts once.  A device that holds a
large part of all polls would make one huge task of that, so ``find_hot_devices`` looks
for such devices first (at most ``MAX_HOT_DEVICES`` of them can exist) and the sliced
form cuts their time line into slices, sessionizes each slice for itself and stitches
the slices with one summary row per slice.  Both forms give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwell.functions.clock import (
    DAY_SECONDS, epoch_seconds, gap_exceeds, seconds_between, whole_second,
)
from dwell.functions.text import is_ignored, is_valid_sample
from dwell.functions.units import int_div

DEFAULT_MAX_GAP = 60

# Every device with more polls than SLICE_ROWS is hot and cut into slices.  The driver
# holds one number for each of the largest MAX_HOT_DEVICES of them: a device beyond those
# has at most one part in MAX_HOT_DEVICES of all polls.
MAX_HOT_DEVICES = 100_000
SLICE_ROWS = 4_000_000

SESSION_COLUMNS = (
    "device_id", "session_seq", "app", "window_title", "start_time", "end_time",
    "duration_seconds", "is_foreground", "start_date",
)


@dataclass(frozen=True)
class HotDevices:
    """Slice width in seconds for each device too large for one task."""

    widths: dict = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.widths)

    def slice_of(self, device: Column, ts: Column) -> Column:
        by_width: dict[int, list] = {}
        for key, width in self.widths.items():
            by_width.setdefault(width, []).append(key)
        whole = F.lit(0).cast("long")
        number = None
        for width, keys in sorted(by_width.items()):
            value = int_div(epoch_seconds(ts), width)
            hit = device.isin(keys)
            number = F.when(hit, value) if number is None else number.when(hit, value)
        # Never NULL, and known not to be: a NULL check added for the join of the slices
        # would make the two readers of the shuffled polls differ.
        return whole if number is None else F.coalesce(number, whole)


def find_hot_devices(polls: DataFrame, slice_rows: int = SLICE_ROWS) -> HotDevices:
    """Measure the devices that need slices; reads only ``device_id`` and ``ts``.

    Counting combines before the shuffle, and what reaches the driver is at most
    ``MAX_HOT_DEVICES`` rows.  A width of k days (minutes) is given only where no day
    (minute) has more than ``slice_rows / k`` polls, so no slice has more than
    ``slice_rows`` unless one second alone does.
    """
    per_day = polls.groupBy("device_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    per_device = per_day.groupBy("device_id").agg(
        F.sum("n").alias("rows"), F.max("n").alias("peak")
    )
    largest = (
        per_device.filter((F.col("rows") > slice_rows) & F.col("device_id").isNotNull())
        .orderBy(F.col("rows").desc()).limit(MAX_HOT_DEVICES).collect()
    )
    if not largest:
        return HotDevices()
    peaks = {row["device_id"]: row["peak"] for row in largest}
    widths = {
        device: DAY_SECONDS * _power_of_two(slice_rows // peak)
        for device, peak in peaks.items() if peak <= slice_rows
    }
    # Days too full for one slice: look at minutes, and fall back to single seconds.
    busy = [device for device in peaks if device not in widths]
    if busy:
        per_minute = (
            polls.filter(F.col("device_id").isin(busy))
            .groupBy("device_id", int_div(epoch_seconds(F.col("ts")), 60).alias("minute"))
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("device_id").agg(F.max("n").alias("peak"))
        )
        for row in per_minute.collect():
            fits = slice_rows // row["peak"]
            widths[row["device_id"]] = 60 * _power_of_two(fits) if fits else 1
    return HotDevices(widths)


def _power_of_two(n: int) -> int:
    return 1 << (n.bit_length() - 1)


# ---- polls ----------------------------------------------------------------

def with_validity(samples: DataFrame, ignored: tuple[str, ...] = ()) -> DataFrame:
    """Add ``valid``: the poll may open a session."""
    valid = is_valid_sample(F.col("app"), F.col("title")) & ~F.col("is_stop")
    if ignored:
        valid = valid & ~is_ignored(F.col("title"), ignored)
    return samples.withColumn("valid", valid)


def _in_order(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ts", "seq")


def _mark_breaks(polls: DataFrame, keys: list[str], max_gap: int) -> DataFrame:
    """``broken``: a gap or a stop lies between this poll and the one before it."""
    w = _in_order(keys)
    return (
        polls.withColumn("prev_ts", F.lag("ts").over(w))
        .withColumn("prev_stop", F.lag("is_stop").over(w))
        .withColumn("next_ts", F.lead("ts").over(w))
        .withColumn(
            "broken",
            F.coalesce(gap_exceeds(F.col("prev_ts"), F.col("ts"), max_gap), F.lit(False))
            | F.coalesce(F.col("prev_stop"), F.lit(False)),
        )
    )


def _number_breaks(polls: DataFrame, keys: list[str]) -> DataFrame:
    so_far = _in_order(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return polls.withColumn("island", F.sum(F.col("broken").cast("long")).over(so_far))


def _mark_changes(polls: DataFrame, keys: list[str]) -> DataFrame:
    """``changed``: a valid poll whose window differs from the one running before it.

    Polls that neither open nor end anything go first, apart from the outermost ones.
    After that a valid poll only has to look at the poll right before it: if that one is
    not valid, it begins an awake stretch, so no window is running.
    """
    w = _in_order(keys)
    outermost = F.col("prev_ts").isNull() | F.col("next_ts").isNull()
    kept = polls.filter(F.col("valid") | F.col("broken") | F.col("is_stop") | outermost)
    valid = F.col("valid")
    return (
        kept.withColumn("_was_valid", F.coalesce(F.lag("valid").over(w), F.lit(False)))
        .withColumn("_was_app", F.lag("app").over(w))
        .withColumn("_was_title", F.lag("title").over(w))
        .withColumn("opens_island", valid & (F.col("broken") | ~F.col("_was_valid")))
        .withColumn(
            "changed",
            F.col("opens_island")
            | (valid & ((F.col("app") != F.col("_was_app")) | (F.col("title") != F.col("_was_title")))),
        )
        .drop("_was_valid", "_was_app", "_was_title")
    )


def _with_local_end(polls: DataFrame, keys: list[str]) -> DataFrame:
    """Keep session starts, each with the time of the next event that closes it."""
    closes_at = F.when(F.col("broken"), F.col("prev_ts")).otherwise(F.col("ts"))
    return (
        polls.filter(F.col("changed") | F.col("broken") | F.col("is_stop"))
        .withColumn("end_ts", F.lead(closes_at).over(_in_order(keys)))
        .filter("changed")
    )


def _as_sessions(starts: DataFrame) -> DataFrame:
    # A carried-over poll names the start of the session it continues.
    carried = "origin_ts" in starts.columns
    start_ts, start_seq = ("origin_ts", "origin_seq") if carried else ("ts", "seq")
    return (
        starts.withColumn("start_time", whole_second(F.col(start_ts)))
        .withColumn("end_time", whole_second(F.col("end_ts")))
        .select(
            "device_id",
            F.col(start_seq).alias("session_seq"),
            "app",
            F.col("title").alias("window_title"),
            "start_time",
            "end_time",
            F.coalesce(
                seconds_between(F.col("start_time"), F.col("end_time")), F.lit(0).cast("long")
            ).alias("duration_seconds"),
            F.lit(True).alias("is_foreground"),
            F.to_date("start_time").alias("start_date"),
        )
    )


# ---- whole devices --------------------------------------------------------

def _starts_by_device(polls: DataFrame, max_gap: int) -> DataFrame:
    keys = ["device_id"]
    marked = _mark_changes(_mark_breaks(polls, keys, max_gap), keys)
    return _with_local_end(marked, keys)


# ---- sliced devices -------------------------------------------------------

def _summarise_slices(marked: DataFrame) -> DataFrame:
    """One row per (device, slice) with all its neighbours need to know."""
    at = F.struct("ts", "seq")
    head = F.col("island") == 0
    poll = F.struct("ts", "seq", "app", "title")
    summary = marked.groupBy("device_id", "slice").agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by("is_stop", at).alias("last_stop"),
        F.max("island").alias("last_island"),
        F.min(F.when(F.col("broken"), F.col("prev_ts"))).alias("head_end"),
        F.min(F.when(F.col("valid") & head, poll)).alias("first_valid"),
        F.min(F.when(F.col("changed") & head & ~F.col("opens_island"), F.col("ts"))).alias("second_start"),
        F.max(F.when(F.col("valid"), F.struct("island", "ts", "seq", "app", "title"))).alias("last_valid"),
    )
    # A slice whose only island ends with a stop poll closes it inside the slice.
    return summary.withColumn(
        "head_end", F.coalesce("head_end", F.when(F.col("last_stop"), F.col("last_ts")))
    )


def _stitch(summary: DataFrame, max_gap: int) -> DataFrame:
    """Per slice: the session carried into it, and the end of the one that leaves it."""
    w = Window.partitionBy("device_id").orderBy("slice")
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later_first = (
        Window.partitionBy("device_id").orderBy(F.col("slice").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    nothing = F.struct(
        F.lit(None).cast("string").alias("app"), F.lit(None).cast("string").alias("title")
    )
    leaves = (
        F.when(
            (F.col("last_valid.island") == F.col("last_island")) & ~F.col("last_stop"),
            F.struct(F.col("last_valid.app").alias("app"), F.col("last_valid.title").alias("title")),
        )
        .when(F.col("head_end").isNotNull() | F.col("break_before"), nothing)
    )
    running = F.col("before.app").isNotNull()
    same = (F.col("first_valid.app") == F.col("before.app")) & (
        F.col("first_valid.title") == F.col("before.title")
    )
    ends_at = (
        F.when(~running, None)
        .when(F.col("break_before"), F.col("prev_last_ts"))
        .when(F.col("first_valid").isNull(), F.col("head_end"))
        .when(same, F.coalesce("second_start", "head_end"))
        .otherwise(F.col("first_valid.ts"))
    )
    return (
        summary.withColumn("prev_last_ts", F.lag("last_ts").over(w))
        .withColumn("prev_last_stop", F.lag("last_stop").over(w))
        .withColumn(
            "break_before",
            F.col("prev_last_ts").isNull()
            | gap_exceeds(F.col("prev_last_ts"), F.col("first_ts"), max_gap)
            | F.col("prev_last_stop"),
        )
        .withColumn("_leaves", F.last(leaves, ignorenulls=True).over(up_to))
        .withColumn("before", F.lag("_leaves").over(w))
        .withColumn("_ends_at", ends_at)
        .select(
            "device_id",
            "slice",
            F.when(~F.col("break_before") & running, F.col("before")).alias("carried"),
            F.last("_ends_at", ignorenulls=True).over(later_first).alias("leaving_end"),
        )
    )


def _starts_by_slice(polls: DataFrame, max_gap: int, hot: HotDevices) -> DataFrame:
    """The summary and the starts read the same shuffled polls, so Spark shuffles once."""
    keys = ["device_id", "slice"]
    sliced = polls.withColumn("slice", hot.slice_of(F.col("device_id"), F.col("ts")))
    marked = _number_breaks(_mark_changes(_mark_breaks(sliced, keys, max_gap), keys), keys)
    stitched = _stitch(_summarise_slices(marked), max_gap)
    starts = _with_local_end(marked, keys)
    continued = F.coalesce(
        F.col("opens_island")
        & (F.col("island") == 0)
        & (F.col("app") == F.col("carried.app"))
        & (F.col("title") == F.col("carried.title")),
        F.lit(False),
    )
    return (
        starts.join(stitched, keys)
        .filter(~continued)
        .withColumn("end_ts", F.coalesce("end_ts", "leaving_end"))
    )


def _starts(polls: DataFrame, max_gap: int, hot: HotDevices | None) -> DataFrame:
    if not hot:
        return _starts_by_device(polls, max_gap)
    # The slices are joined on the device; polls without one take the other way.
    known, unknown = F.col("device_id").isNotNull(), F.col("device_id").isNull()
    sliced = _starts_by_slice(polls.filter(known), max_gap, hot)
    whole = _starts_by_device(polls.filter(unknown), max_gap)
    return sliced.select(*whole.columns).unionByName(whole)


# ---- public operators -----------------------------------------------------

def build_sessions(
    samples: DataFrame,
    max_gap_seconds: int = DEFAULT_MAX_GAP,
    ignored: tuple[str, ...] = (),
    hot: HotDevices | None = None,
) -> DataFrame:
    """Samples -> sessions.

    ``hot`` is the result of ``find_hot_devices``; without it every device is one group.
    """
    return _as_sessions(_starts(with_validity(samples, ignored), max_gap_seconds, hot))


def _breaks_in_order(samples: DataFrame, max_gap: int, hot: HotDevices | None) -> DataFrame:
    """Polls with the true previous poll and a running island number per device."""
    device = ["device_id"]
    if not hot:
        return _number_breaks(_mark_breaks(samples, device, max_gap), device)
    keys = ["device_id", "slice"]
    unknown = samples.filter(F.col("device_id").isNull())
    sliced = samples.filter(F.col("device_id").isNotNull()).withColumn(
        "slice", hot.slice_of(F.col("device_id"), F.col("ts"))
    )
    marked = _number_breaks(_mark_breaks(sliced, keys, max_gap), keys)
    ends = marked.groupBy(*keys).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max_by("is_stop", F.struct("ts", "seq")).alias("last_stop"),
        F.max("island").alias("inner_breaks"),
    )
    w = Window.partitionBy("device_id").orderBy("slice")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = (
        ends.withColumn("before_ts", F.lag("last_ts").over(w))
        .withColumn("before_stop", F.lag("last_stop").over(w))
        .withColumn(
            "edge_broken",
            F.coalesce(gap_exceeds(F.col("before_ts"), F.col("first_ts"), max_gap), F.lit(False))
            | F.coalesce(F.col("before_stop"), F.lit(False)),
        )
        .withColumn(
            "island_offset",
            F.sum(F.col("edge_broken").cast("long") + F.col("inner_breaks")).over(so_far)
            - F.col("inner_breaks"),
        )
        .select(*keys, "before_ts", "before_stop", "edge_broken", "island_offset")
    )
    first = F.col("prev_ts").isNull()
    whole = _number_breaks(_mark_breaks(unknown, device, max_gap), device)
    joined = (
        marked.join(linked, keys)
        .withColumn("island", F.col("island") + F.col("island_offset"))
        .withColumn("broken", F.when(first, F.col("edge_broken")).otherwise(F.col("broken")))
        .withColumn("prev_stop", F.when(first, F.col("before_stop")).otherwise(F.col("prev_stop")))
        .withColumn("prev_ts", F.coalesce("prev_ts", "before_ts"))
    )
    return joined.select(*whole.columns).unionByName(whole)


def detect_sleep(
    samples: DataFrame, max_gap_seconds: int = DEFAULT_MAX_GAP, hot: HotDevices | None = None
) -> DataFrame:
    """(device_id, sleep_start, wake_time) for each poll gap above the limit."""
    polls = _breaks_in_order(samples, max_gap_seconds, hot)
    slept = gap_exceeds(F.col("prev_ts"), F.col("ts"), max_gap_seconds)
    return polls.filter(slept).select(
        "device_id", F.col("prev_ts").alias("sleep_start"), F.col("ts").alias("wake_time")
    )


def number_islands(
    samples: DataFrame, max_gap_seconds: int = DEFAULT_MAX_GAP, hot: HotDevices | None = None
) -> DataFrame:
    """Every poll with the number of the awake stretch it belongs to, from 0."""
    return _breaks_in_order(samples, max_gap_seconds, hot).select(*samples.columns, "island")


def window_changes(
    samples: DataFrame,
    max_gap_seconds: int = DEFAULT_MAX_GAP,
    ignored: tuple[str, ...] = (),
    hot: HotDevices | None = None,
) -> DataFrame:
    """The polls that open a session."""
    starts = _starts(with_validity(samples, ignored), max_gap_seconds, hot)
    return starts.select("device_id", "ts", "seq", "app", "title")


def close_open_sessions(sessions: DataFrame, close_at: Column, device: Column | None = None) -> DataFrame:
    """Close open sessions (of one device, or all) at a given time; closed ones stay."""
    closing = F.col("end_time").isNull()
    if device is not None:
        closing = closing & (F.col("device_id") == device)
    end = whole_second(close_at)
    return (
        sessions.withColumn("_closing", closing)
        .withColumn("end_time", F.when(F.col("_closing"), end).otherwise(F.col("end_time")))
        .withColumn(
            "duration_seconds",
            F.when(F.col("_closing"), seconds_between(F.col("start_time"), F.col("end_time")))
            .otherwise(F.col("duration_seconds")),
        )
        .drop("_closing")
    )
