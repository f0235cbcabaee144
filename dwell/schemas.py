"""Explicit schemas; nothing in the package relies on schema inference."""

from __future__ import annotations

from pyspark.sql import types as T

# One poll of the foreground window.  ``seq`` orders polls that share a ``ts``.
# ``is_stop`` marks the poll at which tracking was switched off.
SAMPLES = T.StructType([
    T.StructField("device_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("app", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("is_stop", T.BooleanType(), False),
])

APPS = T.StructType([
    T.StructField("app_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("executable_path", T.StringType()),
    T.StructField("first_seen", T.TimestampNTZType()),
    T.StructField("last_seen", T.TimestampNTZType()),
])

# A session is identified by its device and the ``seq`` of the poll that opened it.
SESSIONS = T.StructType([
    T.StructField("device_id", T.LongType(), False),
    T.StructField("session_seq", T.LongType(), False),
    T.StructField("app_id", T.StringType(), False),
    T.StructField("window_title", T.StringType(), False),
    T.StructField("start_time", T.TimestampNTZType(), False),
    T.StructField("end_time", T.TimestampNTZType()),
    T.StructField("duration_seconds", T.LongType()),
    T.StructField("is_foreground", T.BooleanType()),
    T.StructField("start_date", T.DateType()),
])

LABELLED = T.StructType([
    T.StructField("process_name", T.StringType()),
    T.StructField("window_title", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("text", T.StringType()),
])

ANSWER_ITEMS = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.StringType()),
]))

RULES = T.StructType([
    T.StructField("priority", T.IntegerType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("color", T.StringType()),
])
