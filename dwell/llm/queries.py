"""The operators over their whole tables, as registered queries, and their SQL."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import dwell
from dwell.llm import (
    bpe, codes, counts, hamming, language, mixture, pii, pii_examples, quality, records, resample, simhash, toxicity, warc,
)
from dwell.sources.storage import fresh_folder
from dwell.sources.tables import read_table

MULTI = "byte_bpe_multi_50k.tiktoken"
BYTES = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2
K, STEP = 10, 50

Query = Callable[[SparkSession, str], DataFrame]

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Tasks import it by name, also where it is not installed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(dwell.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="dwell-code-"), "dwell.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("dwell", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return read_table(spark, folder, "documents")


def encode_digests(docs: DataFrame) -> DataFrame:
    """Encode, decode the ids, and give both as digests."""
    path = public_tokenizers.path(MULTI)
    encoded = bpe.encode_texts(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    return encoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_digests(_docs(spark, folder))


def op2_records(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_folder(spark, "records")
    index = records.write_records(_docs(spark, folder), path, public_tokenizers.path(BYTES), END_ID)
    read = records.read_records(index.select("doc_id", "start", "n_tokens", "file", "offset", "length", "id_bytes"), path)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, folder))


def op4_hamming(spark: SparkSession, folder: str) -> DataFrame:
    return hamming.search_every(read_table(spark, folder, "embeddings"), STEP, K)


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    history = warc.capture_history(read_table(spark, folder, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    path = public_tokenizers.path(PIECES)
    out = language.held_out(F.col("doc_id"))
    model = language.fit_languages(docs.where(~out), path)
    return language.predict_language(docs, model, path).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def learnable_labels(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "labels").where(~toxicity.held_out(F.col("doc_id")))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    machine = toxicity.fit_toxicity(docs, learnable_labels(spark, folder))
    return toxicity.score_toxicity(docs, machine).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix_documents(read_table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(_docs(spark, folder))


def op10_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.count_tokens(_docs(spark, folder), public_tokenizers.path(PIECES))


def op11_codes(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return codes.encode_vectors(read_table(spark, folder, "embeddings"))


def op12_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(_docs(spark, folder), read_table(spark, folder, "benchmark"))


def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = _docs(spark, folder)
    return pii.find_personal_data(docs, pii.fit_field(pii_examples.example_table(spark)))


def all_queries() -> dict[str, Query]:
    made = (op1_bpe, op2_records, op3_simhash, op4_hamming, op5_warc, op6_language, op7_toxicity, op8_mixture,
            op9_quality, op10_counts, op11_codes, op12_resample, op13_pii)
    return {fn.__name__: fn for fn in made}
