"""Text classifiers on ``pyspark.ml``."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark import SparkContext, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import (
    CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer, StringIndexer,
    StringIndexerModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame, functions as F

from dwell.functions.text import app_title
from dwell.operators.features import vocabulary, with_one_two_grams, with_subwords
from dwell.operators.softmax import fit_blocks, subword_blocks
from dwell.operators.training import DEFAULT_LABELS, with_class_weights

MAX_TERMS = 1000
SUBWORD_BUCKETS = 200_000


def _label_indexer() -> StringIndexer:
    return StringIndexer(
        inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="error"
    )


@contextmanager
def _kept(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
    """Keep a training frame for the passes of a fit; lost blocks are computed again."""
    df = df.persist(level)
    try:
        yield df
    finally:
        df.unpersist()


# Non-zero features a task holds, and the most tasks of a pass.
_FEATURES_PER_TASK = 2_000_000
_MOST_TASKS = 50_000


def _balanced(vectors: DataFrame, features: int) -> DataFrame:
    """Even partitions for the many passes over the vectors: by their non-zero features,
    and one for every core at least."""
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return vectors.repartition(max(cores, min(_MOST_TASKS, features // _FEATURES_PER_TASK)))


# Characters of a task of the subword fit.  A task counts each word once per block of texts
# and sends one dense gradient (labels x buckets) a pass, so it holds much more than that.
_CHARS_PER_TASK = 24_000_000


def _by_length(examples: DataFrame, text: str) -> DataFrame:
    """Even partitions by characters, and one for every core at least."""
    cores = examples.sparkSession.sparkContext.defaultParallelism
    chars = examples.agg(F.sum(F.length(text).cast("long")).alias("chars")).collect()[0]["chars"] or 0
    return examples.repartition(max(cores, min(_MOST_TASKS, chars // _CHARS_PER_TASK)))


def _counted(df: DataFrame, grams: str = "grams") -> tuple[int, int]:
    """Rows, and features of all rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(grams).cast("long")).alias("features")).collect()[0]
    return row["n"], row["features"] or 0


# ---- TF-IDF + logistic regression -----------------------------------------

def tfidf_input(df: DataFrame, text: str = "text") -> DataFrame:
    return with_one_two_grams(df, text)


def fit_tfidf_features(grams: DataFrame, max_terms: int = MAX_TERMS) -> PipelineModel:
    """1-2-grams -> unit-length vectors of tf * (ln((1+n)/(1+df)) + 1).

    The vocabulary, at most ``max_terms`` rows, becomes part of the model.
    """
    rows = vocabulary(grams, "grams", False, max_terms=max_terms).collect()
    if not rows:
        raise ValueError("no term is frequent enough")
    counter = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in rows], inputCol="grams", outputCol="tf"
    )
    idf = [math.log((1.0 + r["n_docs"]) / (1.0 + r["df"])) + 1.0 for r in rows]
    weight = ElementwiseProduct(inputCol="tf", outputCol="tfidf", scalingVec=Vectors.dense(idf))
    return PipelineModel(stages=[counter, weight, Normalizer(inputCol="tfidf", outputCol="features", p=2.0)])


def fit_tfidf_logreg(
    examples: DataFrame,
    labels: Sequence[str] = DEFAULT_LABELS,
    max_iter: int = 1000,
    max_terms: int = MAX_TERMS,
    tol: float = 1e-6,
) -> PipelineModel:
    """Multinomial logistic regression with balanced class weights on TF-IDF vectors.

    ``tol`` bounds the relative change of the objective in a step, which is small long
    before the gradient is; ``certificates.certify`` tells what gradient was reached.
    """
    prepared = tfidf_input(with_class_weights(examples, labels))
    with _kept(prepared.select("label", "weight", "grams")) as train:
        features = fit_tfidf_features(train, max_terms)
        indexer = _label_indexer().fit(train)
        n, size = _counted(train)
        vectors = indexer.transform(features.transform(train))
        with _kept(_balanced(vectors.select("features", "label_index", "weight"), size)) as vectors:
            regression = LogisticRegression(
                featuresCol="features", labelCol="label_index", weightCol="weight",
                family="multinomial", maxIter=max_iter, tol=tol, regParam=1.0 / max(1, n),
                standardization=False,
            ).fit(vectors)
    return PipelineModel(stages=[*features.stages, indexer, regression])


# ---- subwords + softmax ---------------------------------------------------

def subword_input(df: DataFrame, text: str = "text") -> DataFrame:
    return with_subwords(df, text)


def fit_subword_softmax(
    examples: DataFrame, max_iter: int = 200, buckets: int = SUBWORD_BUCKETS, reg: float = 1e-4
) -> PipelineModel:
    """Linear softmax on hashed words, word n-grams and character n-grams.

    The loss is that of ``LogisticRegression`` on the vectors of ``subword_input``; it is
    minimised over numbers of words, see ``softmax``.
    """
    hashing = HashingTF(inputCol="grams", outputCol="hashed", numFeatures=buckets)
    unit = Normalizer(inputCol="hashed", outputCol="features", p=2.0)
    indexer = _label_indexer().fit(examples)
    even = _by_length(indexer.transform(examples).select("label_index", "text"), "text")
    blocks = subword_blocks(even, "label_index", "text", buckets)
    regression = LogisticRegression(
        featuresCol="features", labelCol="label_index", family="multinomial",
        maxIter=max_iter, regParam=reg, standardization=False,
    )
    fitted = _fitted(regression, *fit_blocks(blocks, len(indexer.labels), buckets, reg, max_iter))
    return PipelineModel(stages=[hashing, unit, indexer, fitted])


def _fitted(regression: LogisticRegression, coefficients: np.ndarray, intercepts: np.ndarray) -> LogisticRegressionModel:
    """The model of a regression with coefficients that were found elsewhere."""
    context = SparkContext.getOrCreate()
    matrix = _py2java(context, DenseMatrix(*coefficients.shape, coefficients.ravel(), isTransposed=True))
    made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        regression.uid, matrix.compressed(), _py2java(context, Vectors.dense(intercepts)), len(intercepts), True
    )
    return regression._copyValues(LogisticRegressionModel(made))


# ---- scoring --------------------------------------------------------------

def model_labels(model: PipelineModel) -> list[str]:
    return next(list(s.labels) for s in model.stages if isinstance(s, StringIndexerModel))


def _without_indexer(model: PipelineModel) -> PipelineModel:
    return PipelineModel(stages=[s for s in model.stages if not isinstance(s, StringIndexerModel)])


def score(model: PipelineModel, prepared: DataFrame, k: int = 1) -> DataFrame:
    """Add ``top``: the k most probable labels as (label, probability), best first."""
    names = F.array(*[F.lit(l) for l in model_labels(model)])
    pairs = F.zip_with(
        names, vector_to_array("probability"),
        lambda label, p: F.struct((-p).alias("minus"), label.alias("label")),
    )
    best = F.slice(F.array_sort(pairs), 1, k)
    top = F.transform(
        best, lambda s: F.struct(s["label"].alias("label"), (-s["minus"]).alias("probability"))
    )
    scored = _without_indexer(model).transform(prepared)
    kept = [c for c in prepared.columns if c != "grams"]
    return scored.select(*kept, top.alias("top"))


def score_rows(model: PipelineModel, prepared: DataFrame, k: int) -> DataFrame:
    """One row per label and text, with its rank."""
    scored = score(model, prepared, k)
    kept = [c for c in scored.columns if c != "top"]
    return scored.select(*kept, F.posexplode_outer("top")).select(
        *kept, (F.col("pos") + 1).alias("rank"), F.col("col.label").alias("predicted"),
        F.col("col.probability").alias("probability"),
    )


def as_fallback(
    model: PipelineModel, prepare: Callable[[DataFrame], DataFrame]
) -> Callable[[DataFrame], DataFrame]:
    """The model as a fallback labeller of (name, window_title) rows."""
    def label(titles: DataFrame) -> DataFrame:
        texts = titles.withColumn("text", app_title(F.col("name"), F.col("window_title")))
        scored = score(model, prepare(texts), 1)
        return scored.withColumn("model_label", F.col("top")[0]["label"]).drop("top", "text")

    return label


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
