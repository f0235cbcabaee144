"""Evaluation of predictions: frames with ``label`` and ``predicted``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

OTHER = "unlisted"


def pair_counts(predictions: DataFrame) -> DataFrame:
    """(label, predicted, n): everything below works on these few rows."""
    return predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def accuracy(predictions: DataFrame) -> DataFrame:
    hit = F.sum((F.col("label") == F.col("predicted")).cast("long"))
    total = F.count(F.lit(1))
    return predictions.agg(hit.alias("correct"), total.alias("total")).select(
        "correct", "total",
        F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0).alias("accuracy"),
    )


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, and their two averages.

    A class without predictions (or without examples) scores 0.
    """
    pairs = pair_counts(predictions)
    sides = pairs.select(F.col("label").alias("class"), F.col("n").alias("support"),
                         F.lit(0).cast("long").alias("chosen"),
                         F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    sides = sides.unionByName(
        pairs.select(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"),
                     F.col("n").alias("chosen"), F.lit(0).cast("long").alias("hit"))
    )
    sums = sides.groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("chosen").alias("chosen"), F.sum("hit").alias("hit")
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    per_class = sums.select(
        "class",
        ratio(F.col("hit"), F.col("chosen")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(F.col("hit") * 2, F.col("support") + F.col("chosen")).alias("f1"),
        "support",
    )
    measures = ("precision", "recall", "f1")
    macro = per_class.agg(
        F.lit("macro avg").alias("class"), *[F.avg(m).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    weighted = per_class.agg(
        F.lit("weighted avg").alias("class"),
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    rows = per_class.unionByName(macro).unionByName(weighted)
    return rows.select("class", *[F.round(m, 6).alias(m) for m in measures], "support")


def confusion(predictions: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per label, one column per predicted label, ``unlisted`` for any other.

    Labels are those given and those that occur on the true side; a label without an
    example gets a row of zeros.
    """
    spark = predictions.sparkSession
    if OTHER in labels:
        raise ValueError(f"{OTHER} is the column for predictions outside the list")
    column = F.when(F.col("predicted").isin(list(labels)), F.col("predicted")).otherwise(OTHER)
    given = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label"))
    pairs = predictions.groupBy("label", column.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    zeros = given.select("label", F.lit(OTHER).alias("predicted"), F.lit(0).cast("long").alias("n"))
    return (
        pairs.unionByName(zeros).groupBy("label").pivot("predicted", [*labels, OTHER])
        .agg(F.sum("n")).fillna(0).orderBy("label")
    )


def confusion_pairs(predictions: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """(label, predicted, n) over all pairs of labels that occur on either side or are given."""
    spark = predictions.sparkSession
    seen = predictions.select("label").union(predictions.select("predicted")).distinct()
    if labels:
        seen = seen.union(spark.range(1).select(F.explode(F.array(*map(F.lit, labels))))).distinct()
    # One row that holds the set of labels: its size is that of the label set.
    every = seen.agg(F.collect_set("label").alias("all"))
    zeros = every.select(F.explode("all").alias("label"), "all").select(
        "label", F.explode("all").alias("predicted"), F.lit(0).cast("long").alias("n")
    )
    pairs = predictions.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return pairs.unionByName(zeros).groupBy("label", "predicted").agg(F.sum("n").alias("n"))

