"""A text classifier without iterations: the mean TF-IDF vector of each label.

A document gets the label whose mean vector has the largest product with its own.  The
fit is one aggregate and the same in every run, so its results can be checked with SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from dwell.functions.text import app_title
from dwell.operators.features import MAX_TERMS, term_weights, weigh_terms

# Scores that agree to so many places are equal; the smaller label is taken.
PLACES = 9


@dataclass(frozen=True)
class Centroids:
    weight_of: dict[str, float]
    means: DataFrame  # (label, term, mean): max_terms rows a label at most
    fallback: str | None  # for documents without a known term


def fit_centroids(examples: DataFrame, max_terms: int = MAX_TERMS) -> Centroids:
    """Fit on (label, text)."""
    weight_of = term_weights(examples, "text", max_terms=max_terms)
    sizes = examples.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    sums = weigh_terms(examples, ["label"], "text", weight_of).groupBy("label", "term").agg(F.sum("weight").alias("_sum"))
    # One row per label.
    means = sums.join(F.broadcast(sizes), "label").select("label", "term", (F.col("_sum") / F.col("_n")).alias("mean"))
    return Centroids(weight_of, means, sizes.agg(F.min("label").alias("least")).collect()[0]["least"])


def predict_labels(model: Centroids, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Documents with ``predicted``; ``key`` is unique."""
    known = weigh_terms(docs, [key], text, model.weight_of)
    means = model.means.withColumnRenamed("label", "_label")
    scores = known.join(means, "term").groupBy(key, "_label").agg(
        F.round(F.sum(F.col("weight") * F.col("mean")), PLACES).alias("_score")
    )
    best = scores.groupBy(key).agg(
        F.array_min(F.collect_list(F.struct((-F.col("_score")).alias("s"), "_label")))["_label"].alias("predicted")
    )
    found = docs.join(best, key, "left")
    return found.fillna({"predicted": model.fallback}) if model.fallback is not None else found


def as_fallback(model: Centroids) -> Callable[[DataFrame], DataFrame]:
    """For reports: adds ``model_label`` to rows of (name, window_title), NULL for rows
    without a known term."""
    plain = replace(model, fallback=None)

    def label(rows: DataFrame) -> DataFrame:
        text = app_title(F.col("name"), F.col("window_title"))
        # One row per title, as in usage tables: the text is the key.
        titles = rows.select(text.alias("text")).distinct()
        found = predict_labels(plain, titles.withColumn("_key", F.col("text")), "_key")
        named = found.select("_key", F.col("predicted").alias("model_label"))
        return rows.withColumn("_key", text).join(named, "_key", "left").drop("_key")

    return label
