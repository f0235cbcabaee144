"""Seconds -> minutes, hours and percent, rounded with integer arithmetic.

Integer arithmetic gives the same digits on every engine and in every row order;
halves round up.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def int_div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def minutes(seconds: Column) -> Column:
    """Whole minutes."""
    return int_div(seconds, 60)


def hours(seconds: Column) -> Column:
    """Hours to two places."""
    return int_div(seconds * 100 + 1800, 3600) / F.lit(100.0)


def percent(part: Column, total: Column) -> Column:
    """Share of ``total`` in percent to one place; 0 when the total is 0."""
    return F.when(
        total > 0, int_div(part * 2000 + total, total * 2) / F.lit(10.0)
    ).otherwise(F.lit(0.0))
