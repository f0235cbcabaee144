"""Live totals, and an application table kept current from the stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dwell.functions.units import hours, minutes
from dwell.operators.apps import apps_seen, upsert_apps, with_app
from dwell.operators.rules import DEFAULT_CATEGORIES, Category, classify
from dwell.schemas import APPS, SESSIONS
from dwell.streaming.sessionize import STORED
from dwell.streaming.versions import VersionedTable


def read_session_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stored sessions as a stream; new files are new sessions."""
    return _read_stream(spark, SESSIONS, path, files_per_batch)


def read_changes(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """What a ``SessionStream`` writes under ``root``, as a stream of signed changes."""
    return _read_stream(spark, STORED, f"{root}/changes", files_per_batch).filter("sign <> 0")


def _read_stream(spark, schema, path, files_per_batch):
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


# Sums of so many micro-batches are folded into one table.
FOLD = 8


class LiveTotals:
    """Adds up sessions per day and ``key`` as they come.

    Takes signed changes: a row with ``sign`` -1 takes back what an earlier row added, so a
    session that was counted while it ran is counted once, with its time, when it has
    closed.  Rows without a sign are new sessions.

    Every micro-batch stores its own sums under its number, so a batch that runs again
    replaces them.  Every ``FOLD`` micro-batches all sums so far are folded into one table;
    the totals are the last of those and the batches after it, however long the stream has
    run.  No session is too old to count.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root, key
        self.last_batch = -1

    def start(self, keyed: DataFrame, **trigger) -> StreamingQuery:
        sign = F.col("sign") if "sign" in keyed.columns else F.lit(1)
        return (
            keyed.select(F.to_date("start_time").alias("date"), self.key, "duration_seconds", sign.alias("sign"))
            .writeStream.foreachBatch(self._write)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("date", self.key).agg(
            F.sum(F.col("duration_seconds") * F.col("sign")).alias("seconds"),
            F.sum(F.col("sign").cast("long")).alias("session_count"),
        )
        sums.write.mode("overwrite").parquet(f"{self.root}/totals/batch_id={batch_id}")
        if (batch_id + 1) % FOLD == 0:
            # Reads the fold before it, so running the batch again gives the same table.
            folded = self._sums(self._folders(batch_id, batch_id - FOLD))
            folded.write.mode("overwrite").parquet(f"{self.root}/folded/up_to={batch_id}")
        self.last_batch = batch_id

    def _folders(self, batch_id: int, fold: int | None = None) -> list[str]:
        """The tables whose sum the totals after a batch are; ``FOLD`` of them and one at most."""
        fold = (batch_id + 1) // FOLD * FOLD - 1 if fold is None else fold
        batches = [f"{self.root}/totals/batch_id={i}" for i in range(max(fold, -1) + 1, batch_id + 1)]
        return batches + ([f"{self.root}/folded/up_to={fold}"] if fold >= 0 else [])

    def _sums(self, folders: list[str]) -> DataFrame:
        schema = f"date date, {self.key} string, seconds long, session_count long"
        reader = self.spark.read.schema(schema)
        rows = reader.parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.groupBy("date", self.key).agg(F.sum("seconds").alias("seconds"), F.sum("session_count").alias("session_count"))

    def read(self, batch_id: int | None = None) -> DataFrame:
        """The totals after a batch, or after the last one this object has run."""
        sums = self._sums(self._folders(self.last_batch if batch_id is None else batch_id))
        return sums.filter("session_count <> 0").select(
            "date", self.key, hours(F.col("seconds")).alias("hours"), minutes(F.col("seconds")).alias("minutes"), "session_count"
        )


def by_app(sessions: DataFrame, apps: DataFrame) -> DataFrame:
    return with_app(sessions, apps)


def changes_by_app(changes: DataFrame) -> DataFrame:
    return changes.withColumnRenamed("app", "name")


def changes_by_category(changes: DataFrame, categories: Sequence[Category] = DEFAULT_CATEGORIES) -> DataFrame:
    return changes.withColumn("category", classify(F.col("app"), F.col("window_title"), categories))


class LiveApps:
    """Keeps the application table current from a stream of sessions."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root
        self.apps = VersionedTable(spark, f"{root}/apps", APPS)

    def start(self, switches: DataFrame, **trigger) -> StreamingQuery:
        return (
            switches.writeStream.foreachBatch(self._merge)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def _merge(self, batch: DataFrame, batch_id: int) -> None:
        seen = apps_seen(batch)
        self.apps.write(upsert_apps(self.apps.before(batch_id), seen), batch_id)

    def read(self, batch_id: int) -> DataFrame:
        return self.apps.at(batch_id)
