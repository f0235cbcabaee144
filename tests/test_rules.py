import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dwell.operators import rules as ru
from dwell.plans import categories as ca
from test_reports import make

# Application, title and category.
CASES = [
    ("chrome", "YouTube - 音乐播放", "entertainment"), ("WeChat", "微信聊天窗口", "social"),
    ("explorer", "我的文件夹", "system"), ("Code", "Python项目 - Visual Studio Code", "coding"),
    ("bilibili", "哔哩哔哩 - 学习视频", "learning"), ("钉钉", "工作群聊天", "documentation"),
    ("QQ", "聊天窗口", "social"), ("chrome", "抖音 - 娱乐短视频", "other"),
    ("terminal", "PowerShell终端", "system"), ("notepad", "记事本 - 未知文档", "learning"),
    ("outlook", "Slack", "documentation"), ("x", "", "other"),
]


def test_cases(spark):
    df = spark.createDataFrame(CASES, "app string, title string, want string")
    out = df.select("want", ru.classify(F.col("app"), F.col("title")).alias("got")).collect()
    assert [r.got for r in out] == [r.want for r in out]


def test_substring_and_word(spark):
    df = spark.createDataFrame([("a", "my password"), ("a", "Word - report")], "app string, title string")
    app, title = F.col("app"), F.col("title")
    rows = df.select(ru.classify(app, title).alias("s"), ru.classify(app, title, match="word").alias("w")).collect()
    assert [(r.s, r.w) for r in rows] == [("documentation", "other"), ("documentation", "documentation")]


def test_table_form_equals_expression(spark):
    rng = random.Random(3)
    alphabet = "abcxyz. 学习\\E$(ÄÖ😀"
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    texts = [(word(rng.randint(0, 4)), word(rng.randint(0, 20))) for _ in range(400)] + [(None, "abc")]
    categories = [
        ru.Category(f"c{i}", tuple(w for w in (word(rng.randint(1, 5)) for _ in range(6)) if w.strip()), "#0")
        for i in range(6)
    ]
    df = spark.createDataFrame(texts, "app string, title string")
    expr = df.distinct().select(
        "app", "title", ru.classify(F.col("app"), F.col("title"), categories).alias("category"))
    table = ru.classify_by_table(df, ru.rules_table(spark, categories))
    assert sorted(map(str, table.collect())) == sorted(map(str, expr.collect()))
    assert expr.filter("category <> 'other'").count() > 50


def test_custom_rules(spark, tmp_path):
    more = ru.with_keywords(ru.DEFAULT_CATEGORIES, "coding", ["rust"])
    more = ru.with_category(more, ru.Category("shopping", ("taobao",), "#FF69B4"))
    df = spark.createDataFrame([("a", "rust book"), ("a", "Taobao")], "app string, title string")
    got = [r[0] for r in df.select(ru.classify(F.col("app"), F.col("title"), more)).collect()]
    assert got == ["coding", "shopping"]
    ru.rules_table(spark, more).write.json(str(tmp_path / "rules"))
    rules = ru.read_rules(spark, str(tmp_path / "rules"))
    extra = spark.createDataFrame([(0, "first", "book", "#1")], rules.schema)
    table = ru.classify_by_table(df, ru.add_rules(rules, extra))
    assert {(r.title, r.category) for r in table.collect()} == {("rust book", "first"), ("Taobao", "shopping")}


def _many_rules(spark, extra=()):
    """More keywords than are read into expressions; those of the cases among them."""
    rows = [(i, c.name, k, c.color) for i, c in enumerate(ru.DEFAULT_CATEGORIES) for k in c.keywords]
    rows += [(7, "filler", f"no such keyword {i}", "#000000") for i in range(400)]
    return spark.createDataFrame([*rows, *extra], ru.RULES)


def test_large_rule_tables_in_the_reports(spark, tmp_path):
    """Rules of any size as a table operand give what the same rules give as categories."""
    rows = [(app, title, AT + dt.timedelta(days=i % 5), 60 * (i + 1)) for i, (app, title, _) in enumerate(CASES) if title]
    sessions, apps = make(spark, rows * 3)
    _many_rules(spark).write.json(str(tmp_path / "rules"))
    rules = ru.read_rules(spark, str(tmp_path / "rules"))
    assert ru.few_categories(rules) is None
    categories = (*ru.DEFAULT_CATEGORIES, ru.Category("filler", ("no such keyword",), "#000000"))

    def both(report):
        plain, table = (report(c).collect() for c in (categories, rules))
        assert plain == table and plain
        return plain

    both(lambda c: ca.range_stats(spark, sessions, apps, DAY, "2026-1-30", categories=c))
    assert len(both(lambda c: ca.top_in_category(sessions, apps, DAY, "2026-1-30", "social", 10, categories=c))) > 0
    both(lambda c: ca.compare_days(spark, sessions, apps, DAY, "2026-1-27", c))
    model = lambda df: df.withColumn("model_label", F.lit("learning"))
    with_model = both(lambda c: ca.compare_days(spark, sessions, apps, DAY, "2026-1-27", c, model))
    assert {r.category: r.hours_a + r.hours_b for r in with_model}["other"] == 0


def test_what_is_exploded(spark):
    """Only ids and the runs that keywords are filed under; a tenth of all runs at most."""
    texts = spark.createDataFrame([(a, t) for a, t, _ in CASES] + [("app", f"an ordinary title {i}") for i in range(300)], "app string, title string")
    keyed = texts.select(ru._text_id(F.col("app"), F.col("title")).alias("id"), ru.folded_text(F.col("app"), F.col("title")).alias("text"))
    filed = ru.file_keywords(keyed, _many_rules(spark))
    runs = ru.text_runs(keyed, filed)
    assert runs.columns == ["id", "run"]
    every = keyed.select(F.explode(ru._runs_of(F.col("text"), [1, 2, 3]))).count()
    assert runs.count() < every / 100 and "title" not in {r.keyword for r in filed.collect()}
    assert not filed.filter("keyword like 'no such%'").count()  # some of their runs occur nowhere


def test_more_runs_than_are_held_in_memory(spark, monkeypatch):
    df = spark.createDataFrame([(a, t) for a, t, _ in CASES], "app string, title string")
    want = sorted(map(str, ru.classify_by_table(df, _many_rules(spark)).collect()))
    monkeypatch.setattr(ru, "MEMORY_RUNS", 5)
    assert sorted(map(str, ru.classify_by_table(df, _many_rules(spark)).collect())) == want
    assert {(a, c) for a, _, c in CASES} == {(r.app, r.category) for r in ru.classify_by_table(df, _many_rules(spark)).collect()}


def test_empty_keywords_are_refused(spark):
    df = spark.createDataFrame([("a", "b")], "app string, title string")
    with pytest.raises(ValueError):
        ru.rule_label(F.col("app"), F.col("title"), (ru.Category("c", ("",), "#0"),))
    with pytest.raises(Exception, match="empty keyword"):
        ru.classify_by_table(df, _many_rules(spark, [(0, "c", "", "#0")])).collect()
    none = ru.rules_table(spark, ru.DEFAULT_CATEGORIES).filter("false")
    assert [r.category for r in ru.classify_by_table(df, none).collect()] == ["other"]


DAY = "2026-1-26"
AT = dt.datetime(2026, 1, 26, 9)


def test_range_stats(spark):
    sessions, apps = make(spark, [
        ("code", "a", AT, 5400), ("qq", "chat", AT, 1800), ("zz", "zz", AT, 59), ("qq", "open", AT, None),
    ])
    rows = ca.day_stats(spark, sessions, apps, DAY).collect()
    assert [r.category for r in rows] == [*(c.name for c in ru.DEFAULT_CATEGORIES), "other"]
    by = {r.category: r for r in rows}
    assert (by["coding"].minutes, by["coding"].hours, by["coding"].session_count) == (90, 1.5, 1)
    assert by["social"].session_count == 1  # the open one is left out
    assert by["other"].color == "#999999" and by["learning"].minutes == 0
    assert by["coding"].percentage == 74.4 and by["coding"].total_minutes == 120
    assert [r.category for r in ca.sorted_nonzero(ca.day_stats(spark, sessions, apps, DAY)).collect()] == [
        "coding", "social"]


def test_zero_total_keeps_the_schema(spark):
    sessions, apps = make(spark, [("code", "a", AT, 60)])
    rows = ca.day_stats(spark, sessions, apps, "2020-1-1").collect()
    assert len(rows) == 7 and all(r.percentage == 0.0 and r.total_hours == 0.0 for r in rows)


def test_week_is_seven_days(spark):
    sessions, apps = make(spark, [("code", "a", AT + dt.timedelta(days=d), 3600) for d in range(9)])
    rows = ca.week_stats(spark, sessions, apps, DAY).collect()
    assert {r.total_minutes for r in rows} == {420}


def test_top_in_category_limits_after_the_filter(spark):
    rows = [("zz", f"t{i}", AT, 1000 + i) for i in range(5)] + [("code", f"c{i}", AT, 10 + i) for i in range(5)]
    sessions, apps = make(spark, rows)
    top = ca.top_in_category(sessions, apps, DAY, DAY, "coding", 3).collect()
    assert [r.window for r in top] == ["c4", "c3", "c2"]
    assert ca.top_in_category(sessions, apps, DAY, DAY, "coding", 3, prelimit=True).count() == 0
    assert ca.top_in_category(sessions, apps, DAY, DAY, "coding", 7, prelimit=True).count() == 2


def test_model_sees_only_unmatched_titles(spark):
    sessions, apps = make(spark, [("code", "a", AT, 60), ("zz", "one", AT, 60), ("zz", "two", AT, 60)])
    seen = []

    def model(df):
        seen.extend(r.window_title for r in df.collect())
        return df.withColumn("model_label", F.when(F.col("window_title") == "one", "social"))

    by = {r.category: r for r in ca.day_stats(spark, sessions, apps, DAY, model=model).collect()}
    assert sorted(seen) == ["one", "two"]
    assert (by["social"].session_count, by["other"].session_count, by["coding"].session_count) == (1, 1, 1)


def test_compare_days(spark):
    sessions, apps = make(spark, [("code", "a", AT, 3600), ("code", "b", AT + dt.timedelta(days=4), 5400)])
    by = {r.category: r for r in ca.compare_days(spark, sessions, apps, DAY, "2026-1-30").collect()}
    assert (by["coding"].hours_a, by["coding"].hours_b, by["coding"].difference) == (1.0, 1.5, 0.5)
    assert by["social"].difference == 0.0
