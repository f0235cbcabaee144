import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwell.functions import dates

GOOD = {
    "2026-01-26": dt.date(2026, 1, 26), "2026-1-26": dt.date(2026, 1, 26),
    "2026/1/5": dt.date(2026, 1, 5), "2026.12.31": dt.date(2026, 12, 31), "2026/1.5": dt.date(2026, 1, 5),
    "2024-2-29": dt.date(2024, 2, 29),
}
BAD = ["2026-01", "2026-1-1-1", "2026-02-30", "2026-13-1", "x-1-1", "", "2026-001-1", "20260-1-1",
       "0000-1-1", "2026--1", "2026-1- 5", "+026-1-1"]


def test_column_and_parameter_agree(spark):
    rows = [(r,) for r in [*GOOD, *BAD]]
    df = spark.createDataFrame(rows, "raw string")
    got = {r.raw: r.day for r in dates.normalise_dates(df, "raw").collect()}
    assert got == {**GOOD, **{b: None for b in BAD}}
    assert {r.raw for r in dates.rejected_dates(df, "raw").collect()} == set(BAD)
    for raw, day in GOOD.items():
        assert dates.parse_bound(raw) == day
    for raw in BAD:
        with pytest.raises(ValueError):
            dates.parse_bound(raw)


def test_range(spark):
    df = spark.createDataFrame([("2026-1-1", "2026-12-31"), ("2026-1-1", "soon")], "a string, b string")
    out = dates.normalise_range(df, "a", "b").orderBy(F.col("is_valid").desc()).collect()
    assert (out[0].range_start, out[0].range_end) == (dt.date(2026, 1, 1), dt.date(2026, 12, 31))
    assert [r.is_valid for r in out] == [True, False]
