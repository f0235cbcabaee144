"""Time per activity category."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dwell.functions.dates import parse_bound
from dwell.functions.units import hours, int_div, minutes, percent
from dwell.operators.rules import DEFAULT_CATEGORIES, OTHER, Rules, category_list, with_rule_label
from dwell.plans.reports import Date, between_dates, closed, usage_by_title

# Scores (name, window_title, ...) rows and adds ``model_label``; NULL where it has none.
Model = Callable[[DataFrame], DataFrame]


def label_titles(
    usage: DataFrame,
    categories: Rules = DEFAULT_CATEGORIES,
    model: Model | None = None,
    match: str = "substring",
) -> DataFrame:
    """Add ``category`` to one-row-per-title usage, by categories or by a rule table; the
    model sees only rows no rule hits."""
    ruled = with_rule_label(usage, categories, "name", "window_title", match)
    if model is None:
        return ruled.fillna({"category": OTHER})
    hit = ruled.filter(F.col("category").isNotNull())
    missed = ruled.filter(F.col("category").isNull()).drop("category")
    scored = model(missed).withColumn("category", F.coalesce("model_label", F.lit(OTHER)))
    return hit.unionByName(scored.select(*hit.columns))


def zero_fill(spark: SparkSession, per_category: DataFrame, categories: Rules) -> DataFrame:
    """Every category in rule order with its measures, 0 where there are none."""
    zero = F.lit(0).cast("long")
    return (
        category_list(spark, categories).join(per_category, "category", "left")
        .withColumn("seconds", F.coalesce("seconds", zero))
        .withColumn("session_count", F.coalesce("session_count", zero))
    )


def _seconds_by_category(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("category").agg(
        F.sum("seconds").alias("seconds"), F.sum("session_count").alias("session_count")
    )


def range_stats(
    spark: SparkSession,
    sessions: DataFrame,
    apps: DataFrame,
    start: Date,
    end: Date,
    categories: Rules = DEFAULT_CATEGORIES,
    model: Model | None = None,
    match: str = "substring",
) -> DataFrame:
    """Closed sessions of a range per category, with shares and totals.

    Sessions are summed per (app, title) before labelling: the label depends on nothing
    else, so each distinct title is labelled once.
    """
    usage = usage_by_title(closed(between_dates(sessions, start, end)), apps)
    filled = zero_fill(spark, _seconds_by_category(label_titles(usage, categories, model, match)), categories)
    # One row per category, so the frame over all of them is a handful of rows.
    total = F.sum("seconds").over(Window.partitionBy())
    return (
        filled.withColumn("total", total)
        .orderBy("position")
        .select(
            "category",
            minutes(F.col("seconds")).alias("minutes"),
            hours(F.col("seconds")).alias("hours"),
            percent(F.col("seconds"), F.col("total")).alias("percentage"),
            "session_count",
            "color",
            minutes(F.col("total")).alias("total_minutes"),
            hours(F.col("total")).alias("total_hours"),
        )
    )


def day_stats(spark, sessions, apps, day: Date, **options) -> DataFrame:
    return range_stats(spark, sessions, apps, day, day, **options)


def week_stats(spark, sessions, apps, start: Date, **options) -> DataFrame:
    """Seven days from ``start``."""
    first = parse_bound(start)
    return range_stats(spark, sessions, apps, first, first + dt.timedelta(days=6), **options)


def sorted_nonzero(stats: DataFrame) -> DataFrame:
    """The category table: largest share first, categories below a minute left out."""
    return stats.filter(F.col("minutes") > 0).orderBy(F.col("percentage").desc(), "category")


def top_in_category(
    sessions: DataFrame,
    apps: DataFrame,
    start: Date,
    end: Date,
    category: str,
    limit: int = 10,
    categories: Rules = DEFAULT_CATEGORIES,
    model: Model | None = None,
    prelimit: bool = False,
) -> DataFrame:
    """Longest-used titles of a category.

    ``prelimit`` ranks all titles first and keeps those of the category among the top
    ``limit``, which can give fewer rows.
    """
    usage = usage_by_title(between_dates(sessions, start, end), apps)
    order = (F.col("seconds").desc(), "name", "window_title")
    if prelimit:
        ranked = label_titles(usage.orderBy(*order).limit(limit), categories, model)
        top = ranked.filter(F.col("category") == category).orderBy(*order)
    else:
        labelled = label_titles(usage, categories, model)
        top = labelled.filter(F.col("category") == category).orderBy(*order).limit(limit)
    return top.select(
        F.col("name").alias("app"),
        F.col("window_title").alias("window"),
        minutes(F.col("seconds")).alias("minutes"),
        hours(F.col("seconds")).alias("hours"),
        "session_count",
    )


def compare_days(
    spark: SparkSession,
    sessions: DataFrame,
    apps: DataFrame,
    day_a: Date,
    day_b: Date,
    categories: Rules = DEFAULT_CATEGORIES,
    model: Model | None = None,
    match: str = "substring",
) -> DataFrame:
    """Hours per category on two days and their difference, from one pass."""
    a, b = F.lit(parse_bound(day_a)), F.lit(parse_bound(day_b))
    both = closed(sessions.filter((F.col("start_date") == a) | (F.col("start_date") == b)))
    zero = F.lit(0).cast("long")

    def on(day, seconds):
        return F.when(F.col("start_date") == day, F.col(seconds)).otherwise(zero)

    per_key = both.groupBy("app_id", "window_title").agg(
        F.sum(on(a, "duration_seconds")).alias("seconds_a"),
        F.sum(on(b, "duration_seconds")).alias("seconds_b"),
    )
    named = per_key.join(apps.select("app_id", "name"), "app_id")
    sums = label_titles(named, categories, model, match).groupBy("category").agg(
        F.sum("seconds_a").alias("seconds_a"), F.sum("seconds_b").alias("seconds_b")
    )

    def hundredths(seconds):
        return int_div(F.coalesce(F.col(seconds), zero) * 100 + 1800, 3600)

    return (
        category_list(spark, categories).join(sums, "category", "left")
        .withColumn("_a", hundredths("seconds_a"))
        .withColumn("_b", hundredths("seconds_b"))
        .orderBy("position")
        .select(
            "category",
            (F.col("_a") / F.lit(100.0)).alias("hours_a"),
            (F.col("_b") / F.lit(100.0)).alias("hours_b"),
            ((F.col("_b") - F.col("_a")) / F.lit(100.0)).alias("difference"),
        )
    )
