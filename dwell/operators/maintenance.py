"""Deleting sessions by date.  The table is partitioned by ``start_date``."""

from __future__ import annotations

import datetime as dt
import re
from typing import NamedTuple

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from dwell.functions.dates import parse_bound
from dwell.sources.tables import read_sessions

DATE = re.compile(r"\d{4}-\d\d-\d\d")


class Purge(NamedTuple):
    kept: DataFrame
    deleted: DataFrame  # one row: deleted_count


def purge_range(sessions: DataFrame, start: str | dt.date, end: str | dt.date) -> Purge:
    """Sessions left after deleting an inclusive date range, and how many went."""
    low, high = F.lit(parse_bound(start)), F.lit(parse_bound(end))
    gone = F.col("start_date").between(low, high)
    return Purge(
        sessions.filter(~gone),
        sessions.filter(gone).agg(F.count(F.lit(1)).alias("deleted_count")),
    )


def purge_day(sessions: DataFrame, day: str | dt.date) -> Purge:
    return purge_range(sessions, day, day)


def purge_stored(spark: SparkSession, path: str, start: str | dt.date, end: str | dt.date) -> int:
    """Delete an inclusive date range from a stored table and return how many sessions went.

    They are counted from the partitions of the range, which are then dropped; files of
    other dates are neither read nor written.
    """
    low, high = parse_bound(start), parse_bound(end)
    gone = read_sessions(spark, path).filter(F.col("start_date").between(F.lit(low), F.lit(high)))
    count = gone.count()
    fs, root = pafs.FileSystem.from_uri(path)
    for entry in fs.get_file_info(pafs.FileSelector(root)):  # one entry per date
        name, _, day = entry.base_name.partition("=")
        if name == "start_date" and DATE.fullmatch(day) and low <= dt.date.fromisoformat(day) <= high:
            fs.delete_dir(entry.path)
    spark.catalog.refreshByPath(path)
    return count
