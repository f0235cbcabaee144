"""Proof that a fitted classifier is the one its training data ask for.

At the minimum of a regularised multinomial loss the gradient vanishes: for every label and
feature, what the examples of the label hold of the feature equals what the model expects
there plus the pull of the penalty.  Both sides are sums over the training data, so the
state of a fit is checked by one aggregate, whatever the number of iterations it took.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from dwell.operators.models import model_labels

INTERCEPT = "(intercept)"
# Largest gradient entry, as a share of all weight, at which a fit counts as settled.
SETTLED = 1e-3


class Certificate(NamedTuple):
    rows: int
    objective: float  # mean loss and penalty
    gradient_norm: float
    largest: float  # entry of the gradient
    # label, feature, observed, expected, penalty: sums over the weighted examples
    moments: DataFrame


def certify(model: PipelineModel, prepared: DataFrame, weight: str | None = None) -> Certificate:
    """Check a fitted pipeline on its training rows (``label``, its input and ``weight``).

    One aggregate over the examples, after a look whether there is any.  Tasks add up one
    vector per label and side; what reaches the driver has the size of the model.  A label
    the model does not know is an error.  Without examples the sums are 0 and the
    objective is the penalty alone.
    """
    spark = prepared.sparkSession
    labels = model_labels(model)
    fitted = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    reg = fitted.getOrDefault("regParam")
    share = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    scored = model.transform(prepared).select(
        "features", F.col("label_index").cast("int").alias("own"), share.alias("w"),
        vector_to_array("probability").alias("p"),
    )
    total = Summarizer.metrics("sum")
    sides = []
    for k in range(len(labels)):
        for name, part in (("observed", (F.col("own") == k).cast("double")), ("expected", F.col("p")[k])):
            weighed = F.col("w") * part
            sides.append(vector_to_array(total.summary(F.col("features"), weighed)["sum"]).alias(f"{name}{k}"))
            sides.append(F.coalesce(F.sum(weighed), F.lit(0.0)).alias(f"{name}_all{k}"))
    loss = -F.log(F.greatest(F.get(F.col("p"), F.col("own")), F.lit(1e-300)))
    if scored.isEmpty():
        found = None
    else:
        found = scored.agg(
            F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * loss).alias("loss"), *sides
        ).collect()[0]
    names = _feature_names(model, fitted.numFeatures)
    coefficients, mass = fitted.coefficientMatrix.toArray(), found["w"] if found else 0.0
    rows, squares, largest = [], 0.0, 0.0
    for k, label in enumerate(labels):
        observed = [*found[f"observed{k}"], found[f"observed_all{k}"]] if found else [0.0] * (len(names) + 1)
        expected = [*found[f"expected{k}"], found[f"expected_all{k}"]] if found else [0.0] * (len(names) + 1)
        pull = [*(reg * mass * coefficients[k]).tolist(), 0.0]
        for name, a, b, c in zip([*names, INTERCEPT], observed, expected, pull):
            slope = (b + c - a) / mass if mass else 0.0
            squares, largest = squares + slope * slope, max(largest, abs(slope))
            if a or b or c:
                rows.append((label, name, float(a), float(b), float(c)))
    penalty = reg / 2 * float((coefficients ** 2).sum())
    return Certificate(
        found["n"] if found else 0, (found["loss"] / mass if mass else 0.0) + penalty, squares ** 0.5, largest,
        spark.createDataFrame(rows, "label string, feature string, observed double, expected double, penalty double"),
    )


def _feature_names(model: PipelineModel, size: int) -> list[str]:
    """Terms of a vocabulary, else numbers of hashed features."""
    for stage in model.stages:
        if isinstance(stage, CountVectorizerModel):
            return list(stage.vocabulary)
    return [str(i) for i in range(size)]


def settled(certificate: Certificate, limit: float = SETTLED) -> DataFrame:
    """The moments of the training data, and whether the fit meets each of them."""
    mass = certificate.moments.where(F.col("feature") == INTERCEPT).agg(F.sum("observed").alias("mass")).scalar()
    slope = F.abs(F.col("expected") + F.col("penalty") - F.col("observed"))
    return certificate.moments.withColumn("is_settled", slope <= F.lit(limit) * mass)
