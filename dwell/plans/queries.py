"""The registered queries: each operator over the given tables as a whole.

Reports read the usage tables that ``event_usage`` derives from ``events`` and ``pages``
once per application and stores by start date.  Formats are written to a fresh folder
and read back.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dwell.functions import dates, text as tx
from dwell.functions.clock import wall_clock
from dwell.operators import apps as ap
from dwell.operators import centroids as ce
from dwell.operators import certificates as cf
from dwell.operators import evaluation as ev
from dwell.operators import features as ft
from dwell.operators import maintenance as mt
from dwell.operators import models as md
from dwell.operators import rules as ru
from dwell.operators import sessions as se
from dwell.operators import training as tr
from dwell.plans import categories as ca
from dwell.plans import reports as rp
from dwell.sources import tables as tb
from dwell.sources import textio as io
from dwell.sources.storage import fresh_folder, spread
from dwell.streaming import sessionize as ss
from dwell.streaming import usage as us

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-15"
START, END = "2024-01-08", "2024-01-14"
DAY_A, DAY_B = "2024-01-08", "2024-01-12"

# Keywords that occur in the urls and event types of the tables; some overlap.
DATA_CATEGORIES = (
    ru.Category("documentation", ("/de/", ".HTML"), "#FF6B6B"),
    ru.Category("coding", ("error", "spam-farm"), "#D4CDC9"),
    ru.Category("learning", ("blog.", "/es/"), "#4ECDC4"),
    ru.Category("social", ("signup", "utm_source"), "#45B7D1"),
    ru.Category("entertainment", ("www.", "view"), "#FFA07A"),
    ru.Category("system", ("?page", "no such text"), "#95E1D3"),
)
UNUSED_CATEGORY = ru.Category("shopping", ("no such shop",), "#FF69B4")
EXTRA_KEYWORDS = ("m.", "purchase")

# Categories of the rules made from page addresses, and their places among the others.
SAVED, CLICKED, LATER = (-1, "saved", "#8A8AFF"), (50, "clicked", "#FF8A8A"), (99, "later", "#8AFF8A")

LABELS = ("learning", "social", "other")

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _table(spark, folder, name):
    return tb.read_table(spark, folder, name)


def _hot(spark, folder):
    return tb.event_hot_devices(spark, folder)


# ---- inputs derived from the tables ---------------------------------------

def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a label as examples."""
    label = (
        F.when(F.col("quality") == 0, "other").when(F.col("toxic") == 1, "social").otherwise("learning")
    )
    docs = spread(_table(spark, folder, "documents").select("doc_id", "source", "text", "n_chars"))
    return docs.join(_table(spark, folder, "labels"), "doc_id").select(
        "doc_id",
        F.col("source").alias("process_name"),
        F.col("text").alias("window_title"),
        label.alias("label"),
        tx.app_title(F.col("source"), F.col("text")).alias("text"),
        "n_chars",
    )


def titled_examples(spark: SparkSession, folder: str) -> DataFrame:
    """One short example per event: event type, url and the category by rule."""
    return tb.event_samples(spark, folder).select(
        F.col("seq").alias("example_id"),
        F.col("app").alias("process_name"),
        F.col("title").alias("window_title"),
        ru.classify(F.col("app"), F.col("title"), DATA_CATEGORIES).alias("label"),
        tx.app_title(F.col("app"), F.col("title")).alias("text"),
    )


_predicted: dict[tuple[str, str], str] = {}


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out documents with the label a fitted model gives them, stored once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _predicted:
        train, test = _split(spark, folder)
        made = ce.predict_labels(ce.fit_centroids(train), test, "doc_id").select("doc_id", "label", "predicted")
        _predicted[key] = _written(spark, "predictions", made.write.parquet)
    return spark.read.schema("doc_id long, label string, predicted string").parquet(_predicted[key])


_rule_files: dict[tuple, str] = {}


def written_rules(spark: SparkSession, categories) -> DataFrame:
    """Categories as a rule file, written once per application, that is read back."""
    key = (spark.sparkContext.applicationId, categories)
    if key not in _rule_files:
        rules = ru.rules_table(spark, categories)
        _rule_files[key] = _written(spark, "rules", lambda p: rules.coalesce(1).write.json(p))
    return ru.read_rules(spark, _rule_files[key])


def page_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A rule file with two keywords for each page beside the usual ones."""
    address = F.regexp_replace("url", "^[a-z]+://", "")
    kept = F.pmod("page_id", F.lit(5)) == 0

    def rule(place, keyword):
        priority, name, color = place
        return F.struct(F.lit(priority).alias("priority"), F.lit(name).alias("category"), keyword.alias("keyword"), F.lit(color).alias("color"))

    by_address = F.when(kept, rule(SAVED, address)).otherwise(rule(LATER, address))
    by_click = rule(CLICKED, F.concat(F.lit("Click "), F.col("url")))
    made = _table(spark, folder, "pages").select(F.inline(F.array(by_address, by_click)))
    base = ru.with_category(ru.with_keywords(DATA_CATEGORIES, "learning", EXTRA_KEYWORDS), UNUSED_CATEGORY)
    rules = ru.add_rules(ru.rules_table(spark, base), made)
    return ru.read_rules(spark, _written(spark, "rules", lambda p: rules.write.json(p)))


_EXAMPLE = ("process_name", "window_title", "label", "text")
_SESSION_KEY = ("device_id", "session_seq", "window_title", "start_time", "end_time", "duration_seconds")


def _written(spark, purpose, write) -> str:
    path = fresh_folder(spark, purpose)
    write(path)
    return path


# ---- sources and sinks ----------------------------------------------------

@query
def src_samples(spark, folder):
    return tb.event_samples(spark, folder).select("device_id", "ts", "seq", "app", "title")


@query
def src_sessions(spark, folder):
    sessions, apps = tb.event_usage(spark, folder)
    return ap.with_app(sessions, apps).select("name", *_SESSION_KEY, "is_foreground", "start_date")


@query
def src_labelled_jsonl(spark, folder):
    examples = labelled(spark, folder).select(*_EXAMPLE)
    path = _written(spark, "labelled", lambda p: io.write_jsonl(examples, p))
    return io.read_labelled_jsonl(spark, path)


@query
def src_messy_jsonl(spark, folder):
    line = F.to_json(F.struct("process_name", "window_title", "label"))
    kind = F.pmod("doc_id", F.lit(7))
    messy = labelled(spark, folder).withColumn(
        "label", F.when(kind == 0, "mystery").otherwise(F.col("label"))
    ).select(
        F.when(kind == 3, F.substring(line, 1, 25))
        .when(kind == 5, F.concat(F.lit("# "), line))
        .when(kind == 6, F.concat(F.lit("```\n\n  "), line, F.lit("  \n```")))
        .otherwise(line).alias("value")
    )
    path = _written(spark, "messy", messy.write.text)
    return io.read_messy_jsonl(spark, path, LABELS)


@query
def src_json_array(spark, folder):
    items = F.to_json(F.array(
        F.struct("text", "label"),
        F.struct(F.col("process_name").alias("text"), F.lit("NOVEL").alias("label")),
        F.struct(F.col("process_name").alias("text"), F.upper("label").alias("label")),
    ))
    answers = labelled(spark, folder).select(
        "doc_id", F.concat(F.lit("Here they are:\n"), items, F.lit("\nDone.")).alias("value")
    )
    return io.parse_answer_arrays(answers, LABELS)


@query
def src_delimited(spark, folder):
    sessions, apps = tb.event_usage(spark, folder)
    path = _written(spark, "delimited", lambda p: io.write_delimited(sessions, apps, p))
    return io.read_delimited(spark, path)


@query
def sink_delimited(spark, folder):
    sessions, apps = tb.event_usage(spark, folder)
    path = _written(spark, "delimited", lambda p: io.write_delimited(sessions, apps, p))
    return spark.read.text(path)


@query
def sink_jsonl(spark, folder):
    examples = labelled(spark, folder).select(*_EXAMPLE)
    path = _written(spark, "jsonl", lambda p: io.write_jsonl(examples, p))
    return spark.read.schema(io.LABELLED).json(path)


@query
def sink_prefixed_train_text(spark, folder):
    path = _written(spark, "prefixed", lambda p: io.write_prefixed(labelled(spark, folder), p))
    return spark.read.text(path)


@query
def table_counts(spark, folder):
    return tb.table_counts({name: _table(spark, folder, name) for name in tb.TABLES})


@query
def sink_sessions(spark, folder):
    built = se.build_sessions(
        tb.event_samples(spark, folder), tb.EVENT_MAX_GAP, tb.EVENT_IGNORED, _hot(spark, folder)
    ).withColumn("app_id", ap.app_key(F.col("app")))
    path = _written(spark, "sessions", lambda p: tb.write_sessions(built, p))
    return tb.read_sessions(spark, path).select(*_SESSION_KEY, "start_date")


@query
def sink_append(spark, folder):
    """Samples arrive in stretches of time; each is added to what is stored already."""
    path, after = fresh_folder(spark, "loads"), None
    for i, stretch in enumerate(_stretches(tb.event_samples(spark, folder))):
        load = f"part-{i}"
        usage = tb.append_usage(spark, stretch, path, load, after, tb.EVENT_MAX_GAP, tb.EVENT_IGNORED, _hot(spark, folder))
        after = load
    return ap.with_app(*usage).select("name", *_SESSION_KEY, "start_date")


@query
def sink_report_csv(spark, folder):
    stats = cls_range_stats(spark, folder)
    path = _written(spark, "csv", lambda p: io.write_report_csv(stats, p))
    return io.read_report_csv(spark, path, stats.schema)


# ---- filters and projections ----------------------------------------------

@query
def flt_ignore_titles(spark, folder):
    samples = tb.event_samples(spark, folder)
    return samples.filter(~tx.is_ignored(F.col("title"), tb.EVENT_IGNORED)).select(
        "device_id", "seq", "app", "title"
    )


@query
def flt_valid_sample(spark, folder):
    samples = tb.event_samples(spark, folder)
    return samples.filter(tx.is_valid_sample(F.col("app"), F.col("title"))).select(
        "device_id", "seq", "app", "title"
    )


@query
def flt_date_eq(spark, folder):
    return rp.on_date(tb.event_usage(spark, folder).sessions, AS_OF).select(*_SESSION_KEY)


@query
def flt_date_range(spark, folder):
    return rp.between_dates(tb.event_usage(spark, folder).sessions, START, END).select(*_SESSION_KEY)


@query
def flt_last_n_days(spark, folder):
    return rp.last_days(tb.event_usage(spark, folder).sessions, AS_OF, 7).select(*_SESSION_KEY)


@query
def flt_closed(spark, folder):
    return rp.closed(tb.event_usage(spark, folder).sessions).select(*_SESSION_KEY)


@query
def flt_open(spark, folder):
    return rp.still_open(tb.event_usage(spark, folder).sessions).select(*_SESSION_KEY)


@query
def flt_nonzero(spark, folder):
    sessions, apps = tb.event_usage(spark, folder)
    return rp.nonzero(rp.by_title(sessions, apps, START, END))


@query
def flt_foreground(spark, folder):
    """Visible windows other than the foreground one; here an event of low value is one."""
    events, pages = _table(spark, folder, "events"), _table(spark, folder, "pages")
    windows = tb.samples_from_events(events, pages, keep=("value",))
    return rp.background_windows(
        windows.withColumn("is_foreground", F.col("value") >= 10.0), tb.EVENT_IGNORED
    ).select("seq", "process_name", "window_title")


@query
def prj_usage_units(spark, folder):
    sessions = tb.event_usage(spark, folder).sessions
    return rp.usage_units(sessions).select("device_id", "session_seq", "minutes", "hours")


@query
def prj_text(spark, folder):
    samples = tb.event_samples(spark, folder)
    app, title = F.col("app"), F.col("title")
    return samples.select(
        "seq", tx.app_title(app, title).alias("text"), tx.app_title(app, title, " ").alias("plain_text")
    )


@query
def prj_time_features(spark, folder):
    sessions, apps = tb.event_usage(spark, folder)
    return rp.time_features(ap.with_app(sessions, apps)).select(
        "device_id", "session_seq", F.col("name").alias("process"), "window_title",
        "duration_minutes", "hour_of_day", "day_of_week",
    )


# ---- joins ----------------------------------------------------------------

@query
def join_session_app(spark, folder):
    sessions, apps = tb.event_usage(spark, folder)
    return ap.with_app(sessions, apps).select("device_id", "session_seq", "name", "duration_seconds")


@query
def lookup_session(spark, folder):
    sessions, apps = tb.event_usage(spark, folder)
    by_key = ap.lookup_session(sessions, apps, 46, 1)
    return by_key.unionByName(ap.current_sessions(sessions, apps, 46))


@query
def join_rules_first_match(spark, folder):
    texts = tb.event_samples(spark, folder).select("app", "title")
    return ru.classify_by_table(texts, written_rules(spark, DATA_CATEGORIES))


@query
def rpt_zero_fill(spark, folder):
    sessions, apps = tb.event_usage(spark, folder)
    categories = ru.with_category(DATA_CATEGORIES, UNUSED_CATEGORY)
    return ca.day_stats(spark, sessions, apps, AS_OF, categories=categories).select(
        "category", "minutes", "session_count", "color"
    )


# ---- reports --------------------------------------------------------------

@query
def rpt_day_total(spark, folder):
    return rp.day_total(tb.event_usage(spark, folder).sessions, AS_OF)


@query
def rpt_day_by_app(spark, folder):
    return rp.day_by_app(*tb.event_usage(spark, folder), AS_OF)


@query
def rpt_recent(spark, folder):
    return rp.recent(*tb.event_usage(spark, folder), 10)


@query
def rpt_top_apps(spark, folder):
    return rp.top_apps(*tb.event_usage(spark, folder), AS_OF, 1, 3)


@query
def rpt_daily(spark, folder):
    return rp.daily(tb.event_usage(spark, folder).sessions, AS_OF, 7)


@query
def rpt_timeline(spark, folder):
    return rp.timeline(*tb.event_usage(spark, folder), AS_OF)


@query
def rpt_range_by_app(spark, folder):
    return rp.range_by_app(*tb.event_usage(spark, folder), START, END)


@query
def rpt_range_count(spark, folder):
    return rp.range_count(tb.event_usage(spark, folder).sessions, START, END)


@query
def rpt_range_top10(spark, folder):
    return rp.day_top(*tb.event_usage(spark, folder), AS_OF, 10)


@query
def rpt_range_top20(spark, folder):
    return rp.range_top(*tb.event_usage(spark, folder), START, END, 20)


@query
def rpt_by_title(spark, folder):
    return rp.by_title(*tb.event_usage(spark, folder), START, END)


@query
def rpt_distinct_titles(spark, folder):
    return rp.distinct_titles(*tb.event_usage(spark, folder), "click")


@query
def rpt_raw_sessions(spark, folder):
    return rp.raw_sessions(*tb.event_usage(spark, folder), START, END)


@query
def rpt_hour_histogram(spark, folder):
    return rp.hour_histogram(*tb.event_usage(spark, folder), AS_OF)


@query
def rpt_compare_days(spark, folder):
    return ca.compare_days(
        spark, *tb.event_usage(spark, folder), DAY_A, DAY_B, written_rules(spark, DATA_CATEGORIES)
    )


# ---- sessionization -------------------------------------------------------

@query
def ses_detect_sleep(spark, folder):
    return se.detect_sleep(tb.event_samples(spark, folder), tb.EVENT_MAX_GAP, _hot(spark, folder))


@query
def ses_islands(spark, folder):
    return se.number_islands(
        tb.event_samples(spark, folder), tb.EVENT_MAX_GAP, _hot(spark, folder)
    ).select("device_id", "seq", "ts", "island")


@query
def ses_changes(spark, folder):
    return se.window_changes(
        tb.event_samples(spark, folder), tb.EVENT_MAX_GAP, tb.EVENT_IGNORED, _hot(spark, folder)
    )


@query
def ses_build(spark, folder):
    return se.build_sessions(
        tb.event_samples(spark, folder), tb.EVENT_MAX_GAP, tb.EVENT_IGNORED, _hot(spark, folder)
    )


@query
def ses_close_at(spark, folder):
    sessions = tb.event_usage(spark, folder).sessions
    at = dt.datetime(2024, 2, 1)
    return se.close_open_sessions(sessions, wall_clock(at)).select(*_SESSION_KEY)


# ---- categories -----------------------------------------------------------

@query
def cls_rules(spark, folder):
    app, title = F.col("app"), F.col("title")
    return tb.event_samples(spark, folder).select(
        "seq",
        ru.classify(app, title, DATA_CATEGORIES).alias("category"),
        ru.classify(app, title).alias("default_category"),
        ru.classify(app, title, DATA_CATEGORIES, match="word").alias("word_category"),
    )


@query
def cls_fallback(spark, folder):
    sessions, apps = tb.event_usage(spark, folder)
    examples = titled_examples(spark, folder).filter(F.col("label") != "other")
    distinct = tr.dedup_keep_first(examples, "example_id")
    usage = rp.usage_by_title(rp.between_dates(sessions, START, END), apps)
    return ca.label_titles(usage, DATA_CATEGORIES, ce.as_fallback(ce.fit_centroids(distinct)))


@query
def cls_range_stats(spark, folder):
    rules = written_rules(spark, DATA_CATEGORIES)
    return ca.range_stats(spark, *tb.event_usage(spark, folder), START, END, categories=rules)


@query
def cls_day_stats(spark, folder):
    return ca.day_stats(spark, *tb.event_usage(spark, folder), AS_OF, categories=DATA_CATEGORIES)


@query
def cls_week_stats(spark, folder):
    return ca.week_stats(spark, *tb.event_usage(spark, folder), AS_OF, categories=DATA_CATEGORIES)


@query
def cls_top_in_category(spark, folder):
    return ca.top_in_category(
        *tb.event_usage(spark, folder), START, END, "learning", 10, DATA_CATEGORIES
    )


@query
def cls_top_prelimit(spark, folder):
    return ca.top_in_category(
        *tb.event_usage(spark, folder), START, END, "learning", 30, DATA_CATEGORIES, prelimit=True
    )


@query
def cls_sorted_nonzero(spark, folder):
    return ca.sorted_nonzero(cls_range_stats(spark, folder)).select(
        "category", "minutes", "hours", "percentage", "session_count"
    )


@query
def cls_custom_rules(spark, folder):
    rules = page_rules(spark, folder)
    return ca.range_stats(spark, *tb.event_usage(spark, folder), START, END, categories=rules)


# ---- training data --------------------------------------------------------

@query
def trn_label_normalise(spark, folder):
    turns = _table(spark, folder, "conversations")
    return turns.select(
        "conv_id", "turn",
        tr.strict_label(F.col("role"), ("user", "system")).alias("strict_label"),
        tr.loose_label(F.col("text"), ("ouche", "tion", "ch")).alias("loose_label"),
    )


@query
def trn_dedup_keep_first(spark, folder):
    return tr.dedup_keep_first(titled_examples(spark, folder), "example_id")


@query
def trn_label_distribution(spark, folder):
    return tr.label_distribution(labelled(spark, folder), ("learning", "social", "coding"))


@query
def trn_batch_union(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "lang")
    batches = [docs.filter(F.col("lang") == lang) for lang in ("de", "en", "es", "fr")]
    return tr.batch_progress(tr.union_batches(batches))


@query
def trn_tokens(spark, folder):
    docs = spread(_table(spark, folder, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", ft.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query
def trn_tfidf(spark, folder):
    docs = spread(_table(spark, folder, "documents").select("doc_id", "text"))
    weights = ft.tfidf(docs, "doc_id", "text")
    return weights.select("doc_id", "term", "tf", F.round("weight", 6).alias("weight"))


@query
def trn_subword_features(spark, folder):
    docs = spread(_table(spark, folder, "documents").select("doc_id", "text"))
    return ft.with_subwords(docs, "text", different="n_distinct").select(
        "doc_id", F.size("grams").alias("n_features"), "n_distinct",
    )


@query
def trn_stratified_split(spark, folder):
    return tr.stratified_split(labelled(spark, folder), "doc_id", LABELS).select(
        "doc_id", "label", "is_test"
    )


@query
def trn_class_weights(spark, folder):
    return tr.class_weights(labelled(spark, folder))


# ---- models and evaluation ------------------------------------------------

_splits: dict[tuple[str, str], str] = {}


def _split(spark, folder):
    """Training and held-out examples, stored once per application: a fit reads them many
    times, and each time the texts would be joined, shuffled and ranked again."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _splits:
        examples = labelled(spark, folder).select("doc_id", "label", "text")
        made = tr.stratified_split(examples, "doc_id", LABELS)
        _splits[key] = _written(spark, "split", made.write.parquet)
    marked = spark.read.schema("doc_id long, label string, text string, is_test boolean").parquet(_splits[key])
    return marked.filter(~F.col("is_test")), marked.filter("is_test")


@query
def mdl_tfidf_logreg(spark, folder):
    train, test = _split(spark, folder)
    model = md.fit_tfidf_logreg(train, LABELS)
    return md.score_rows(model, md.tfidf_input(test), 1).drop("text", "is_test")


@query
def mdl_subword_softmax(spark, folder):
    train, test = _split(spark, folder)
    model = md.fit_subword_softmax(train)
    return md.score_rows(model, md.subword_input(test), 1).drop("text", "is_test")


@query
def mdl_score_topk(spark, folder):
    train, test = _split(spark, folder)
    model = md.fit_tfidf_logreg(train, LABELS)
    return md.score_rows(model, md.tfidf_input(test), 3).drop("text", "is_test")


@query
def mdl_save_load(spark, folder):
    train, test = _split(spark, folder)
    model = md.fit_tfidf_logreg(train, LABELS)
    path = _written(spark, "model", lambda p: md.save_model(model, p))
    return md.score_rows(md.load_model(path), md.tfidf_input(test), 1).drop("text", "is_test")


@query
def mdl_certificate(spark, folder):
    """The gradient of the fit on its training data: what SQL says of the data, met or not."""
    train, _ = _split(spark, folder)
    model = md.fit_tfidf_logreg(train, LABELS)
    found = cf.certify(model, md.tfidf_input(tr.with_class_weights(train, LABELS)), "weight")
    return cf.settled(found).select("label", "feature", F.round("observed", 6).alias("observed"), "is_settled")


@query
def evl_accuracy(spark, folder):
    return ev.accuracy(predictions(spark, folder))


@query
def evl_class_report(spark, folder):
    return ev.class_report(predictions(spark, folder))


@query
def evl_confusion(spark, folder):
    """Two of the three labels are listed; predictions of the third still count."""
    return ev.confusion(predictions(spark, folder), LABELS[:2])


# ---- maintenance and dates ------------------------------------------------

@query
def mnt_upsert_apps(spark, folder):
    sessions, apps = tb.event_usage(spark, folder)
    named = ap.with_app(sessions, apps)
    existing = ap.apps_seen(named.filter(F.col("start_date") < F.lit(AS_OF).cast("date")), "name")
    seen = ap.apps_seen(rp.between_dates(named, START, "2024-01-20"), "name")
    return ap.upsert_apps(existing, seen).select("name", "executable_path", "first_seen", "last_seen")


def _purged(spark, folder, start, end):
    """A stored copy of the sessions after deleting a date range from it."""
    path = fresh_folder(spark, "purge")
    tb.write_sessions(tb.event_usage(spark, folder).sessions, path)
    count = mt.purge_stored(spark, path, start, end)
    return tb.read_sessions(spark, path).select(
        "device_id", "session_seq", "start_date", F.lit(count).cast("long").alias("deleted_count")
    )


@query
def mnt_purge_day(spark, folder):
    return _purged(spark, folder, AS_OF, AS_OF)


@query
def mnt_purge_range(spark, folder):
    return _purged(spark, folder, "2024/1/8", "2024.1.14")


def typed_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Event dates in the spellings users type, good and bad."""
    ts = F.col("ts")
    year, month, day = (f(ts).cast("string") for f in (F.year, F.month, F.dayofmonth))
    kind = F.pmod("event_id", F.lit(8))
    raw = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 1, F.concat_ws("-", year, month, day))
        .when(kind == 2, F.concat_ws("/", year, month, day))
        .when(kind == 3, F.concat_ws(".", year, month, day))
        .when(kind == 4, F.concat_ws("-", year, month))
        .when(kind == 5, F.concat_ws("-", year, month, day, day))
        .when(kind == 6, F.concat_ws("/", year, F.lit("2"), F.dayofmonth(ts) + 5))
        .otherwise(F.concat_ws("-", year, F.lit("x"), day))
    )
    return _table(spark, folder, "events").select("event_id", "ts", raw.alias("raw"))


@query
def dat_normalise(spark, folder):
    typed = dates.normalise_dates(typed_dates(spark, folder), "raw")
    return typed.select("event_id", "raw", "day")


@query
def dat_normalise_range(spark, folder):
    ends = typed_dates(spark, folder).withColumn("raw_end", F.date_format("ts", "yyyy/M/d"))
    return dates.normalise_range(ends, "raw", "raw_end").select(
        "event_id", "range_start", "range_end", "is_valid"
    )


# ---- streaming ------------------------------------------------------------

def _finish(stream_query) -> int:
    stream_query.awaitTermination()
    return ss.last_batch(stream_query)


BATCHES = 4


def _stretches(samples: DataFrame) -> list[DataFrame]:
    """The samples cut into stretches of time, in order."""
    span = samples.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()[0]
    if span["lo"] is None:
        return [samples]
    cuts = [wall_clock(span["lo"] + (span["hi"] - span["lo"]) * i / BATCHES) for i in range(1, BATCHES)]
    after = [F.lit(True), *(F.col("ts") >= c for c in cuts)]
    before = [*(F.col("ts") < c for c in cuts), F.lit(True)]
    return [samples.where(a & b) for a, b in zip(after, before)]


def _run_stream(spark, samples, **options) -> ss.SessionStream:
    """Samples arrive stretch by stretch; after each one the stream starts again and
    takes up where it left off."""
    path, root = fresh_folder(spark, "samples"), fresh_folder(spark, "stream")
    held = samples.persist()
    for stretch in _stretches(held):
        stretch.write.mode("append").parquet(path)
        job = ss.SessionStream(spark, root, tb.EVENT_MAX_GAP, tb.EVENT_IGNORED, **options)
        _finish(job.start(spark.readStream.schema(samples.schema).parquet(path)))
    held.unpersist()
    return job


def _sessions_of(job: ss.SessionStream) -> DataFrame:
    return job.closed_sessions().unionByName(job.open_sessions())


_streamed: dict[tuple[str, str], str] = {}


@query
def str_sessionize(spark, folder):
    job = _run_stream(spark, tb.event_samples(spark, folder))
    _streamed[spark.sparkContext.applicationId, folder] = job.root
    return _sessions_of(job)


def _changes(spark, folder) -> DataFrame:
    """The changes that ``str_sessionize`` has written, as a stream of several batches."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _streamed:
        str_sessionize(spark, folder)
    files = len(spark.read.schema(ss.STORED).parquet(f"{_streamed[key]}/changes").inputFiles())
    return us.read_changes(spark, _streamed[key], max(1, files // BATCHES))


@query
def str_sleep_timer(spark, folder):
    return _sessions_of(_run_stream(spark, tb.event_samples(spark, folder), idle_close=True))


@query
def str_stop(spark, folder):
    """Tracking stops on every device a minute after its last poll."""
    samples = tb.event_samples(spark, folder)
    stops = samples.groupBy("device_id").agg(
        (F.max("ts") + F.expr("INTERVAL '60' SECOND")).alias("ts"), F.max("seq").alias("seq")
    ).select(
        "device_id", "ts", "seq", F.lit("").alias("app"), F.lit("").alias("title"),
        F.lit(True).alias("is_stop"),
    )
    return _sessions_of(_run_stream(spark, samples.unionByName(stops)))


def _session_stream(spark, folder):
    tb.event_usage(spark, folder)
    path = f"{tb.stored_path(spark, folder)}/sessions"
    files = len(spark.read.schema(us.SESSIONS).parquet(path).inputFiles())
    return us.read_session_stream(spark, path, max(1, files // BATCHES))


@query
def str_daily_usage(spark, folder):
    job = us.LiveTotals(spark, fresh_folder(spark, "live"), "name")
    _finish(job.start(us.changes_by_app(_changes(spark, folder))))
    return job.read()


@query
def str_category_usage(spark, folder):
    job = us.LiveTotals(spark, fresh_folder(spark, "live"), "category")
    _finish(job.start(us.changes_by_category(_changes(spark, folder), DATA_CATEGORIES)))
    return job.read()


@query
def str_upsert_apps(spark, folder):
    apps = tb.event_usage(spark, folder).apps
    job = us.LiveApps(spark, fresh_folder(spark, "apps"))
    named = us.by_app(_session_stream(spark, folder), apps)
    last = _finish(job.start(named.withColumnRenamed("name", "app")))
    return job.read(last).select("name", "executable_path", "first_seen", "last_seen")
