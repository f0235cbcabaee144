"""Cleaning of user-typed dates."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, functions as F

_TYPED = r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$"


def _pad(part: Column, width: int) -> Column:
    return F.when(F.length(part) < width, F.lpad(part, width, "0")).otherwise(part)


def normalise_date(raw: Column) -> Column:
    """``2026-1-5``, ``2026/01/05`` and ``2026.1.5`` -> DATE; anything else -> NULL."""
    dashed = F.translate(raw, "/.", "--")
    parts = F.split(dashed, "-")
    padded = F.concat_ws("-", _pad(parts[0], 4), _pad(parts[1], 2), _pad(parts[2], 2))
    typed = dashed.rlike(_TYPED) & ~dashed.rlike("^0{1,4}-")
    return F.when(typed, F.try_to_date(padded, "yyyy-MM-dd"))


def normalise_dates(df: DataFrame, raw: str, out: str = "day") -> DataFrame:
    return df.withColumn(out, normalise_date(F.col(raw)))


def rejected_dates(df: DataFrame, raw: str) -> DataFrame:
    """Rows whose date cannot be used."""
    return df.filter(normalise_date(F.col(raw)).isNull())


def normalise_range(df: DataFrame, raw_start: str, raw_end: str) -> DataFrame:
    """Clean both bounds; a range is usable only if both are."""
    return df.withColumns({
        "range_start": normalise_date(F.col(raw_start)),
        "range_end": normalise_date(F.col(raw_end)),
    }).withColumn("is_valid", F.col("range_start").isNotNull() & F.col("range_end").isNotNull())


def parse_bound(raw: str | dt.date) -> dt.date:
    """The same rule for one report parameter; raises ValueError on a bad date."""
    if isinstance(raw, dt.date):
        return raw
    dashed = raw.replace("/", "-").replace(".", "-")
    if not re.fullmatch(_TYPED.strip("^$"), dashed):
        raise ValueError(f"not a date: {raw!r}")
    year, month, day = map(int, dashed.split("-"))
    return dt.date(year, month, day)
