"""Preparing labelled examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwell.functions.text import strip
from dwell.functions.units import percent
from dwell.operators.rules import DEFAULT_CATEGORIES, OTHER, literal_rows

DEFAULT_LABELS = (*(c.name for c in DEFAULT_CATEGORIES), OTHER)


def strict_label(label: Column, labels: Sequence[str] = DEFAULT_LABELS) -> Column:
    """A label outside the set is ``other``."""
    return F.when(label.isin(list(labels)), label).otherwise(OTHER)


def loose_label(answer: Column, labels: Sequence[str] = DEFAULT_LABELS) -> Column:
    """First label of the set that occurs in a free-text answer, else ``other``.

    NULL where there is no answer; such examples are to be dropped.
    """
    text = F.lower(strip(answer))
    found = F.coalesce(*[F.when(text.contains(l), F.lit(l)) for l in labels], F.lit(OTHER))
    return F.when(answer != "", found)


def dedup_keep_first(
    examples: DataFrame, order: str, keys: Sequence[str] = ("process_name", "window_title", "label")
) -> DataFrame:
    """One example per key, the one with the smallest ``order``, which is a unique number.

    The smallest number of each key is a hash aggregate of a number: copies are combined
    before the shuffle, so a key with very many copies costs one row per task.  Examples
    then meet those numbers on ``order``, which spreads them evenly whatever their keys.
    Copies of a whole row count once.
    """
    first = examples.groupBy(*keys).agg(F.min(order).alias("_first"))
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys]
    met = examples.alias("e").join(first.alias("f"), [F.col(f"e.{order}") == F.col("f._first"), *same], "left_semi")
    return met.distinct()


def label_distribution(examples: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """Count and percent per label, by label.

    With ``labels`` every one of them is present and all others count as ``other``.
    """
    label = F.col("label") if labels is None else strict_label(F.col("label"), labels)
    counts = examples.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("count"))
    if labels is not None:
        spark = examples.sparkSession
        every = literal_rows(spark, [(l,) for l in dict.fromkeys((*labels, OTHER))], "label string")
        counts = every.join(counts, "label", "left").fillna({"count": 0})
    # One row per label.
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("label", "count", percent(F.col("count"), total).alias("percentage")).orderBy("label")


def union_batches(batches: Sequence[DataFrame]) -> DataFrame:
    """Concatenate batches, numbering them from 1."""
    out = None
    for number, batch in enumerate(batches, 1):
        part = batch.withColumn("batch", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return out


def batch_progress(batched: DataFrame) -> DataFrame:
    """Examples per batch and so far; the running sum is over one row per batch."""
    counts = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("count"))
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("cumulative", F.sum("count").over(so_far)).orderBy("batch")


_PREFIX = 4  # hex digits: 65,536 buckets per label


def stratified_split(
    examples: DataFrame,
    key: str,
    labels: Sequence[str] = DEFAULT_LABELS,
    test_parts: int = 5,
    seed: int = 42,
) -> DataFrame:
    """Add ``is_test``: exactly floor(n / test_parts) examples of each label.

    Examples are ranked by a hash of the key.  Instead of ranking every label as one
    group, the counts per hash prefix tell which prefix the cut falls into; only the
    examples with that prefix, about 1 in 65,536, are ranked.
    """
    stratum = strict_label(F.col("label"), labels)
    # A missing key is a key like any other; the mark tells it from an empty one.
    text = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), text))
    hashed = examples.withColumn("_stratum", stratum).withColumn("_digest", digest).withColumn(
        "_prefix", F.substring("_digest", 1, _PREFIX)
    )
    by_prefix = Window.partitionBy("_stratum").orderBy("_prefix")
    counts = hashed.groupBy("_stratum", "_prefix").agg(F.count(F.lit(1)).alias("n"))
    cuts = (
        counts
        .withColumn("upto", F.sum("n").over(by_prefix.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("quota", F.floor(F.sum("n").over(Window.partitionBy("_stratum")) / test_parts))
        .filter(F.col("upto") > F.col("quota"))
        .groupBy("_stratum")
        .agg(
            F.min("_prefix").alias("_cut"),
            F.min_by(F.col("quota") - (F.col("upto") - F.col("n")), "_prefix").alias("_left"),
        )
    )
    # At most len(labels) + 1 rows.
    placed = hashed.join(F.broadcast(cuts), "_stratum")
    clear = placed.filter(F.col("_prefix") != F.col("_cut")).withColumn(
        "is_test", F.col("_prefix") < F.col("_cut")
    )
    ranked = Window.partitionBy("_stratum").orderBy("_digest", key)
    edge = placed.filter(F.col("_prefix") == F.col("_cut")).withColumn(
        "is_test", F.row_number().over(ranked) <= F.col("_left")
    )
    return clear.unionByName(edge).select(*examples.columns, "is_test")


def class_weights(examples: DataFrame) -> DataFrame:
    """Balanced weight n / (k * n_label) per label; one row per label."""
    counts = examples.groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    every = Window.partitionBy()
    n, k = F.sum("count").over(every), F.count(F.lit(1)).over(every)
    return counts.select("label", "count", (n / (k * F.col("count"))).alias("weight"))


def with_class_weights(examples: DataFrame, labels: Sequence[str] = DEFAULT_LABELS) -> DataFrame:
    """Add ``weight``.  Labels are held to the given set, which bounds the broadcast."""
    held = examples.withColumn("label", strict_label(F.col("label"), labels))
    return held.join(F.broadcast(class_weights(held).drop("count")), "label")
