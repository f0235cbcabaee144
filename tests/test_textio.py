import json

from pyspark.sql import functions as F

from dwell.functions import text as tx
from dwell.sources import textio as io

LABELS = ("learning", "social", "other")


def test_messy_lines(spark, tmp_path):
    good = {"process_name": "a", "window_title": "t \n x", "label": "social"}
    lines = [
        json.dumps(good), "  " + json.dumps({**good, "label": "novel"}) + "  ", "", "   ", "```json", "# note",
        json.dumps(good)[:20], json.dumps({"process_name": "a", "label": "social"}),
        json.dumps({**good, "label": None}), "[1, 2]", "text",
    ]
    path = tmp_path / "messy.txt"
    path.write_text("\n".join(lines), encoding="utf-8")
    got = [tuple(r) for r in io.read_messy_jsonl(spark, str(path), LABELS).collect()]
    want = ("a", "t \n x")
    assert got == [
        (*want, "social", "a | t \n x"), (*want, "other", "a | t \n x"), (*want, "other", "a | t \n x")
    ]


def test_answer_arrays(spark, tmp_path):
    (tmp_path / "a.txt").write_text(
        'Sure:\n```json\n[{"text": "qq | a | b", "label": "SOCIAL"},\n {"text": "alone"}, {"label": "x"}]\n```',
        encoding="utf-8")
    (tmp_path / "b.txt").write_text("no array here", encoding="utf-8")
    (tmp_path / "c.txt").write_text('[{"text": "cut', encoding="utf-8")
    got = {tuple(r) for r in io.read_answer_arrays(spark, str(tmp_path), LABELS).collect()}
    assert got == {
        ("qq", "a | b", "social", "qq | a | b"), ("alone", "", "other", "alone"), ("", "", "other", ""),
    }


def test_delimited(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text("a | t | u\n\n  b | v  \nno separator\n", encoding="utf-8")
    strict = [tuple(r) for r in io.read_delimited(spark, str(path)).collect()]
    assert strict == [("a", "t | u"), ("b", "v")]
    lenient = [tuple(r) for r in io.read_delimited(spark, str(path), strict=False).collect()]
    assert lenient == [*strict, ("no separator", "")]


def test_round_trips(spark, tmp_path):
    rows = [("a", "t\nu", "social", "a | t\nu"), ("b", "v", "learning", "b | v"), ("c", None, "other", "c | ")]
    df = spark.createDataFrame(rows, io.LABELLED)
    io.write_jsonl(df, str(tmp_path / "j"))
    got = {tuple(r) for r in io.read_labelled_jsonl(spark, str(tmp_path / "j")).collect()}
    assert got == {(r[3], r[2]) for r in rows}
    io.write_prefixed(df, str(tmp_path / "p"))
    got = {tuple(r) for r in io.read_prefixed(spark, str(tmp_path / "p")).collect()}
    assert got == {(r[2], r[3].replace("\n", " ")) for r in rows}
    report = df.select("label", "process_name")
    io.write_report_csv(report, str(tmp_path / "c"))
    assert io.read_report_csv(spark, str(tmp_path / "c"), report.schema).count() == 3


def test_ignored_and_blank_titles(spark):
    rows = [("system",), ("My Desktop",), ("desktop",), (" ",), ("　",), ("\x1f",), (None,), ("x",)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    out = df.select(
        tx.is_ignored(t).alias("d"), tx.is_ignored(t, tx.CONFIGURED_IGNORED).alias("c"), tx.has_text(t).alias("h")
    ).collect()
    assert [r.d for r in out] == [False, True, False, False, False, False, False, False]
    assert [r.c for r in out] == [True, True, False, False, False, False, False, False]
    assert [r.h for r in out] == [True, True, True, False, False, False, False, True]
