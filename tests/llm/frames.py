"""Awkward documents that every operator must take."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

# Extra columns are named like results of the operators.
NAMES = ("doc_id", "text", "lang", "source", "ids", "kept", "fingerprint", "size", "taken", "score", "_text")
SCHEMA = StructType([
    StructField(n, LongType() if n in ("doc_id", "size", "taken") else StringType()) for n in NAMES
])
PROSE = " ".join(f"word{i % 70}x{i * i % 97}" for i in range(120))
NOISE = "the quick brown fox jumps over the lazy dog " * 40
TEXTS = (
    None, "", " \t\n", "one", PROSE, PROSE, PROSE + " tail", NOISE, "a" * 30_000, "é漢字 😀 ​x\x00y", "x  y\n z\t",
    "line one\nline one\nline one\n" + PROSE, "# * $ % & | < >", "word " * 4000,
)


def rows():
    out = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, "i", "k", "f", i, None, "s", "t") for i, t in enumerate(TEXTS)]
    out.append((None, "no id", None, None, None, None, None, None, None, None, None))
    out.append(out[4])  # a repeated row
    return out


def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
