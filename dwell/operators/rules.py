"""Ordered keyword rules: the first category with a keyword in the text wins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dwell.functions.text import quoted
from dwell.schemas import RULES
from dwell.sources.storage import fresh_folder

OTHER = "other"
OTHER_COLOR = "#999999"


@dataclass(frozen=True)
class Category:
    name: str
    keywords: tuple[str, ...]
    color: str


# Categories in rule order, their keywords and chart colours.  The long
# list of game titles is not shipped; add it from a file with ``read_rules``.
DEFAULT_CATEGORIES = (
    Category("documentation", (
        "excel", "word", "feishu", "飞书", "outlook", "slack", "文献", "论文", "jira",
        "confluence", "notion", "钉钉", "dingtalk",
    ), "#FF6B6B"),
    Category("coding", ("code", "visual studio", "pycharm", "github", "gitlab"), "#D4CDC9"),
    Category("learning", (
        "jupyter", "python", "coursera", "udemy", "stackoverflow", "documentation",
        "tutorial", "deepseek", "edpuzzle", "github pages", "学习", "教程", "文档",
    ), "#4ECDC4"),
    Category("social", (
        "wechat", "qq", "outlook", "gmail", "telegram", "discord", "weixin", "teams",
        "meeting", "slack", "whatsapp", "messenger", "微信", "QQ",
    ), "#45B7D1"),
    Category("entertainment", (
        "youtube", "netflix", "steam", "game", "spotify", "music", "twitch", "游戏",
    ), "#FFA07A"),
    Category("system", (
        "explorer", "windows", "settings", "system", "cmd", "powershell", "terminal",
        "文件", "设置", "资源管理器",
    ), "#95E1D3"),
)


def with_keywords(categories: Sequence[Category], name: str, keywords: Iterable[str]) -> tuple[Category, ...]:
    """Add keywords to one category."""
    return tuple(
        replace(c, keywords=c.keywords + tuple(keywords)) if c.name == name else c
        for c in categories
    )


def with_category(categories: Sequence[Category], category: Category) -> tuple[Category, ...]:
    """Append a category, or put new keywords in the place of an existing one's."""
    if any(c.name == category.name for c in categories):
        return tuple(category if c.name == category.name else c for c in categories)
    return (*categories, category)


def folded_text(app: Column, title: Column) -> Column:
    return F.lower(F.concat(F.coalesce(app, F.lit("")), F.lit(" "), F.coalesce(title, F.lit(""))))


def _hit(text: Column, keywords: Sequence[str], match: str) -> Column:
    folded = list(dict.fromkeys(k.lower() for k in keywords))
    if "" in folded:
        raise ValueError("empty keyword")
    if match == "word":
        alternatives = "|".join(quoted(k) for k in folded)
        return text.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{alternatives})(?![\p{{L}}\p{{N}}_])")
    # A loop over a constant array: several times faster than one long alternation, and
    # unlike a chain of ORs it stays small however long the list is.
    return F.exists(F.array(*[F.lit(k) for k in folded]), lambda k: F.contains(text, k))


def rule_label(
    app: Column, title: Column, categories: Sequence[Category] = DEFAULT_CATEGORIES, match: str = "substring"
) -> Column:
    """Category by rule, NULL without a hit.  ``match='word'`` asks for whole words."""
    if match not in ("substring", "word"):
        raise ValueError(match)
    rules = [c for c in categories if c.keywords]
    if not rules:
        return F.lit(None).cast("string")

    def first_hit(text: Column) -> Column:
        chain = F
        for category in rules:
            chain = chain.when(_hit(text, category.keywords, match), F.lit(category.name))
        return chain

    # Passing the folded text through a one-element array folds it once for all tests.
    return F.transform(F.array(folded_text(app, title)), first_hit)[0]


def classify(
    app: Column, title: Column, categories: Sequence[Category] = DEFAULT_CATEGORIES, match: str = "substring"
) -> Column:
    return F.coalesce(rule_label(app, title, categories, match), F.lit(OTHER))


# ---- rules as a table -----------------------------------------------------

# What reports take as rules: categories in order, or a table of them.
Rules = Sequence[Category] | DataFrame

# A rule table with at most so many keywords is read into expressions.
FEW_KEYWORDS = 256
# At most so many character runs are looked up in memory by each task.
MEMORY_RUNS = 20_000
# Length of the character runs that keywords are filed under.
RUN = 3


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few given rows as literals of the plan, so that their size is known to it."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    items = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*items).cast(f"array<struct<{schema}>>")))


def rules_table(spark: SparkSession, categories: Sequence[Category] = DEFAULT_CATEGORIES) -> DataFrame:
    rows = [
        (priority, c.name, keyword, c.color)
        for priority, c in enumerate(categories) for keyword in c.keywords
    ]
    return literal_rows(spark, rows, "priority int, category string, keyword string, color string")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines {priority, category, keyword, color}."""
    return spark.read.schema(RULES).json(path)


def add_rules(rules: DataFrame, extra: DataFrame) -> DataFrame:
    return rules.unionByName(extra)


def _text_id(app: Column, title: Column) -> Column:
    """A text's key: what is exploded and shuffled in its place."""
    parts = [F.coalesce(F.concat(F.lit("\x01"), c), F.lit("\x02")) for c in (app, title)]
    return F.unhex(F.md5(F.concat(*parts)))


def _runs_of(text: Column, lengths: Sequence[int]) -> Column:
    """All distinct runs of these lengths, 1 to RUN, in a text; linear in its length."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    every, runs = [], chars
    for n in range(1, max(lengths) + 1):
        if n > 1:  # one character more; beyond the end it is NULL
            runs = F.zip_with(runs, F.slice(chars, F.lit(n), F.greatest(F.size(chars), F.lit(1))), lambda r, c: F.concat(r, c))
        if n in lengths:
            every.append(runs)
    return F.array_distinct(F.array_compact(F.concat(*every)))


def _exploded(texts: DataFrame, found: Sequence[str] | None) -> DataFrame:
    """(id, run) for the runs that keywords have; ``None``: too many to look them up in memory."""
    if found is not None and not found:
        return texts.select("id", F.lit("").alias("run")).limit(0)
    lengths = range(1, RUN + 1) if found is None else sorted({len(r) for r in found})
    runs = texts.select("id", _runs_of(F.col("text"), lengths).alias("_runs"))
    # One expression text: thousands of literal columns would take seconds to build.
    kept = "_runs" if found is None else f"filter(_runs, r -> r IN ({', '.join(map(_literal, found))}))"
    return runs.select("id", F.explode(F.expr(kept)).alias("run"))


def _literal(text: str) -> str:
    """A text as an SQL literal."""
    units = text.encode("utf-16-be")
    codes = (int.from_bytes(units[i:i + 2], "big") for i in range(0, len(units), 2))
    return "'" + "".join(f"\\u{code:04x}" for code in codes) + "'"


def _few(rows: DataFrame, limit: int) -> list | None:
    """The rows, or ``None`` if there are more than the limit."""
    held = rows.limit(limit + 1).collect()
    return held if len(held) <= limit else None


def _checked(rules: DataFrame) -> DataFrame:
    keyword = F.when(F.col("keyword") == "", F.raise_error(F.lit("empty keyword"))).otherwise(F.lower("keyword"))
    return rules.filter("keyword is not null").select(keyword.alias("keyword"), "priority", "category").distinct()


def file_keywords(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(run, keyword, priority, category): each keyword under its rarest run in the texts.

    ``texts``: (id, text), each text once.  A keyword with a run that no text has cannot
    occur and is left out.
    """
    keyed = _checked(rules)
    size = F.least(F.length("keyword"), F.lit(RUN))
    inside = F.transform(
        F.sequence(F.lit(1), F.length("keyword") - size + 1), lambda i: F.substr(F.col("keyword"), i, size)
    )
    spread = keyed.select("keyword", F.explode(F.array_distinct(inside)).alias("run")).distinct()
    found = _few(spread.select("run").distinct(), MEMORY_RUNS)
    known = [r["run"] for r in found] if found is not None else None
    # Counted where the texts are: what is shuffled is one number per run and task.
    counts = _exploded(texts, known).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rated = spread.join(counts, "run", "left").groupBy("keyword").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("best")
    )
    return keyed.join(rated.filter("best.n > 0"), "keyword").select(F.col("best.run").alias("run"), "keyword", "priority", "category")


def text_runs(texts: DataFrame, filed: DataFrame) -> DataFrame:
    """(id, run) for the runs that keywords are filed under; the text stays where it is."""
    found = _few(filed.select("run").distinct(), MEMORY_RUNS)
    known = [r["run"] for r in found] if found is not None else None
    return _exploded(texts, known)


def match_table(texts: DataFrame, rules: DataFrame, app: str = "app", title: str = "title") -> DataFrame:
    """Add ``category``: that of the first rule with a keyword in (app, title), else NULL.

    A keyword can only occur where its rarest run of characters occurs.  Ids of texts and
    keywords meet in an equi-join on those runs, and only such pairs are compared, so a
    rule table of any size stays off a row-by-row comparison with every text.
    """
    spark = texts.sparkSession
    keyed = texts.withColumns({"_id": _text_id(F.col(app), F.col(title)), "_text": folded_text(F.col(app), F.col(title))})
    path = fresh_folder(spark, "texts")  # read three times
    keyed.write.parquet(path)
    stored = spark.read.schema(keyed.schema).parquet(path)
    each = stored.groupBy(F.col("_id").alias("id")).agg(F.first("_text").alias("text"))
    filed = file_keywords(each, rules)
    few = _few(filed, MEMORY_RUNS)
    if few:
        filed = spark.createDataFrame(pa.Table.from_pylist([r.asDict() for r in few]), filed.schema)
    # One short list per text that may have a hit.
    candidates = text_runs(each, filed).join(filed, "run").groupBy("id").agg(
        F.collect_set(F.struct("priority", "category", "keyword")).alias("_rules")
    )
    hits = F.filter("_rules", lambda c: F.contains(F.col("_text"), c["keyword"]))
    return stored.join(candidates, F.col("_id") == F.col("id"), "left").withColumn(
        "category", F.array_min(hits)["category"]
    ).drop("_id", "id", "_text", "_rules")


def classify_by_table(texts: DataFrame, rules: DataFrame, app: str = "app", title: str = "title") -> DataFrame:
    """Distinct (app, title) with the category of the first matching rule, or ``other``."""
    return match_table(texts.select(app, title).distinct(), rules, app, title).fillna({"category": OTHER})


def few_categories(rules: Rules) -> tuple[Category, ...] | None:
    """Rules as categories in order if they have at most ``FEW_KEYWORDS`` keywords."""
    if not isinstance(rules, DataFrame):
        return tuple(rules)
    held = _few(rules.filter("keyword is not null"), FEW_KEYWORDS)
    if held is None:
        return None
    grouped: dict[tuple, list] = {}
    for row in sorted(held, key=lambda r: (r["priority"], r["category"])):
        grouped.setdefault((row["priority"], row["category"]), []).append(row)
    return tuple(Category(name, tuple(r["keyword"] for r in rows), rows[0]["color"]) for (_, name), rows in grouped.items())


def with_rule_label(texts: DataFrame, rules: Rules, app: str, title: str, match: str = "substring") -> DataFrame:
    """Add ``category`` by rule, NULL without a hit, from categories or a rule table of any size."""
    categories = few_categories(rules)
    if categories is not None:
        return texts.withColumn("category", rule_label(F.col(app), F.col(title), categories, match))
    if match != "substring":
        raise ValueError(f"at most {FEW_KEYWORDS} keywords can be matched as whole words")
    return match_table(texts, rules, app, title)


def category_list(spark: SparkSession, categories: Rules = DEFAULT_CATEGORIES) -> DataFrame:
    """(position, category, color) for every category and ``other``."""
    last = (1 << 30, OTHER, OTHER_COLOR)
    schema = "position int, category string, color string"
    if isinstance(categories, DataFrame):
        listed = categories.groupBy("category").agg(F.min("priority").alias("position"), F.min("color").alias("color"))
        return listed.select("position", "category", "color").unionByName(literal_rows(spark, [last], schema))
    rows = [(i, c.name, c.color) for i, c in enumerate(categories)]
    return literal_rows(spark, [*rows, last], schema)
