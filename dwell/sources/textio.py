"""Line formats: labelled JSON lines, model answers, delimited and prefixed text, CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from dwell.functions.text import DELIMITER, app_title, has_text, strip
from dwell.schemas import ANSWER_ITEMS, LABELLED

LABEL_PREFIX = "__label__"


# ---- readers --------------------------------------------------------------

def read_labelled_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) per line; blank lines skipped, a malformed line fails the read."""
    lines = spark.read.text(path).filter(has_text(F.col("value")))
    item = F.from_json("value", LABELLED, {"mode": "FAILFAST"})
    return lines.select(item.alias("item")).select("item.text", "item.label")


def parse_messy_lines(lines: DataFrame, labels: Sequence[str], line: str = "value") -> DataFrame:
    """Examples out of generated lines; blanks, fences, comments and bad JSON are dropped.

    A label outside ``labels`` becomes ``other``.
    """
    stripped = lines.withColumn("_line", strip(F.col(line)))
    kept = stripped.filter(
        (F.col("_line") != "") & ~F.col("_line").startswith("```") & ~F.col("_line").startswith("#")
    )
    item = F.from_json("_line", LABELLED, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys("_line")
    rest = [c for c in lines.columns if c != line]
    return (
        kept.filter(F.array_contains(keys, "label"))
        .select(*rest, item.alias("_item"))
        .filter(
            F.col("_item.process_name").isNotNull() & F.col("_item.window_title").isNotNull()
        )
        .select(
            *rest,
            F.col("_item.process_name").alias("process_name"),
            F.col("_item.window_title").alias("window_title"),
            F.when(F.col("_item.label").isin(list(labels)), F.col("_item.label"))
            .otherwise("other").alias("label"),
            app_title(F.col("_item.process_name"), F.col("_item.window_title")).alias("text"),
        )
    )


def read_messy_jsonl(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame:
    return parse_messy_lines(spark.read.text(path), labels)


def parse_answer_arrays(answers: DataFrame, labels: Sequence[str], answer: str = "value") -> DataFrame:
    """One row per element of the JSON array inside each free-text answer.

    The array is the text from the first ``[`` to the last ``]``; answers without a
    readable array give no rows.
    """
    array_text = F.regexp_extract(F.col(answer), r"(?s)\[.*\]", 0)
    rest = [c for c in answers.columns if c != answer]
    items = answers.select(*rest, F.explode_outer(F.from_json(array_text, ANSWER_ITEMS)).alias("_item"))
    text = F.coalesce(F.col("_item.text"), F.lit(""))
    label = F.lower(F.coalesce(F.col("_item.label"), F.lit("other")))
    parts = F.split(text, r" \| ", 2)
    return items.filter(F.col("_item").isNotNull()).select(
        *rest,
        parts[0].alias("process_name"),
        F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("window_title"),
        F.when(label.isin(list(labels)), label).otherwise("other").alias("label"),
        text.alias("text"),
    )


def read_answer_arrays(spark: SparkSession, path: str, labels: Sequence[str]) -> DataFrame:
    """Answers stored as one file each, as whole texts."""
    answers = spark.read.text(path, wholetext=True)
    return parse_answer_arrays(answers, labels)


def parse_delimited(lines: DataFrame, strict: bool = True, line: str = "value") -> DataFrame:
    """``app | title`` lines, split at the first separator.

    ``strict`` drops lines without a separator; otherwise they get an empty title.
    """
    stripped = lines.withColumn("_line", strip(F.col(line))).filter(F.col("_line") != "")
    if strict:
        stripped = stripped.filter(F.col("_line").contains(DELIMITER))
    parts = F.split("_line", r" \| ", 2)
    rest = [c for c in lines.columns if c != line]
    return stripped.select(
        *rest,
        parts[0].alias("process_name"),
        F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("window_title"),
    )


def read_delimited(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_delimited(spark.read.text(path), strict)


# ---- writers --------------------------------------------------------------

def delimited_lines(sessions: DataFrame, apps: DataFrame) -> DataFrame:
    """Sessions as ``app | title`` lines in start order (a range-partitioned sort)."""
    return (
        sessions.join(apps.select("app_id", "name"), "app_id")
        .orderBy("start_time", "device_id", "session_seq")
        .select(app_title(F.col("name"), F.col("window_title")).alias("value"))
    )


def write_delimited(sessions: DataFrame, apps: DataFrame, path: str) -> None:
    """Line breaks inside titles become spaces, so that one line stays one session."""
    one_line = F.translate(F.col("value"), "\r\n", "  ")
    delimited_lines(sessions, apps).select(one_line.alias("value")).write.text(path)


def write_jsonl(examples: DataFrame, path: str) -> None:
    examples.write.option("ignoreNullFields", "false").json(path)


def prefixed_lines(examples: DataFrame) -> DataFrame:
    """``__label__<label> <text>`` with line breaks turned into spaces."""
    return examples.select(
        F.concat(
            F.lit(LABEL_PREFIX), F.col("label"), F.lit(" "), F.translate("text", "\r\n", "  ")
        ).alias("value")
    )


def write_prefixed(examples: DataFrame, path: str) -> None:
    prefixed_lines(examples).write.text(path)


def read_prefixed(spark: SparkSession, path: str) -> DataFrame:
    value = F.col("value")
    rest = F.substr(value, F.lit(len(LABEL_PREFIX) + 1))
    parts = F.split(rest, " ", 2)
    return spark.read.text(path).select(parts[0].alias("label"), parts[1].alias("text"))


def write_report_csv(report: DataFrame, path: str) -> None:
    report.write.option("header", True).csv(path)


def read_report_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
