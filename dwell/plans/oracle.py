"""The same results in plain SQL, for comparison with the registered queries.

Each text is written from the rules and not from the Spark plans: sessions, for example,
come from window functions over whole devices.
"""

from __future__ import annotations

SAMPLES = """samples AS (
  SELECT e.user_id AS device_id, e.ts, e.event_id AS seq, e.event_type AS app,
         coalesce(p.url, '') AS title, e.value
  FROM events e LEFT JOIN pages p
    ON p.page_id = CAST(json_extract_string(e.props, '$.k') AS BIGINT))"""

POLLS = f"""{SAMPLES},
polls AS (
  SELECT *, lag(ts) OVER w AS prev_ts,
         CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS gap
  FROM samples WINDOW w AS (PARTITION BY device_id ORDER BY ts, seq)),
islands AS (
  SELECT *, CAST(sum(gap) OVER (PARTITION BY device_id ORDER BY ts, seq
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island
  FROM polls)"""

SESSIONS = f"""{POLLS},
bounds AS (
  SELECT *, max(ts) OVER (PARTITION BY device_id, island) AS island_end,
         max(island) OVER (PARTITION BY device_id) AS last_island
  FROM islands),
valid AS (
  SELECT *, lag(app) OVER w AS prev_app, lag(title) OVER w AS prev_title,
         row_number() OVER w AS rn
  FROM bounds WHERE app <> '' AND trim(title) <> '' AND NOT contains(title, '/fr/')
  WINDOW w AS (PARTITION BY device_id, island ORDER BY ts, seq)),
changes AS (
  SELECT * FROM valid
  WHERE rn = 1 OR prev_app IS DISTINCT FROM app OR prev_title IS DISTINCT FROM title),
ended AS (
  SELECT *, coalesce(lead(ts) OVER (PARTITION BY device_id, island ORDER BY ts, seq),
                     CASE WHEN island < last_island THEN island_end END) AS end_ts
  FROM changes),
cut AS (
  SELECT device_id, seq AS session_seq, app, title AS window_title,
         CAST(date_trunc('second', ts) AS TIMESTAMP) AS start_time,
         CAST(date_trunc('second', end_ts) AS TIMESTAMP) AS end_time
  FROM ended),
sessions AS (
  SELECT *, coalesce(date_diff('second', start_time, end_time), 0) AS duration_seconds,
         true AS is_foreground, CAST(start_time AS DATE) AS start_date
  FROM cut)"""

LABELLED = """labelled AS (
  SELECT d.doc_id, d.source AS process_name, d.text AS window_title,
         CASE WHEN l.quality = 0 THEN 'other' WHEN l.toxic = 1 THEN 'social' ELSE 'learning' END AS label,
         d.source || ' | ' || d.text AS text, d.n_chars
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

KEY = "device_id, session_seq, window_title, start_time, end_time, duration_seconds"
AS_OF = "DATE '2024-01-15'"
IN_RANGE = "start_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"


def _minutes(s: str) -> str:
    return f"CAST(({s}) // 60 AS BIGINT)"


def _hours(s: str) -> str:
    return f"((CAST({s} AS BIGINT) * 100 + 1800) // 3600) / 100.0::DOUBLE"


def _contains_any(text: str, words) -> str:
    quoted = [w.replace("'", "''") for w in words]
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in quoted) + ")"


RULES = (
    ("documentation", ("/de/", ".html")),
    ("coding", ("error", "spam-farm")),
    ("learning", ("blog.", "/es/")),
    ("social", ("signup", "utm_source")),
    ("entertainment", ("www.", "view")),
    ("system", ("?page", "no such text")),
)
COLORS = {
    "documentation": "#FF6B6B", "coding": "#D4CDC9", "learning": "#4ECDC4", "social": "#45B7D1",
    "entertainment": "#FFA07A", "system": "#95E1D3", "shopping": "#FF69B4", "other": "#999999",
}
CUSTOM_RULES = tuple(
    (name, words + ("m.", "purchase")) if name == "learning" else (name, words)
    for name, words in RULES
) + (("shopping", ("no such shop",)),)


def _category(app: str, title: str, rules=RULES) -> str:
    text = f"lower({app} || ' ' || {title})"
    whens = " ".join(f"WHEN {_contains_any(text, words)} THEN '{name}'" for name, words in rules)
    return f"CASE {whens} ELSE 'other' END"


def _word_category(app: str, title: str) -> str:
    """Whole-word matching, by padding every character that is not part of a word."""
    import re

    text = f"lower({app} || ' ' || {title})"
    edge = r"[^\p{L}\p{N}_]"

    def hit(word):
        return f"regexp_matches({text}, '(^|{edge}){re.escape(word)}({edge}|$)')"

    whens = " ".join(
        f"WHEN {' OR '.join(hit(w) for w in words)} THEN '{name}'" for name, words in RULES
    )
    return f"CASE {whens} ELSE 'other' END"


def _category_rows(rules) -> str:
    rows = [f"({i}, '{n}', '{COLORS[n]}')" for i, n in enumerate([*(r[0] for r in rules), "other"])]
    return f"categories(position, category, color) AS (VALUES {', '.join(rows)})"


def _stats(where: str, rules=RULES, columns: str | None = None, tail: str = "") -> str:
    columns = columns or f"""category, {_minutes('seconds')} AS minutes, {_hours('seconds')} AS hours,
  CASE WHEN total > 0 THEN ((seconds * 2000 + total) // (total * 2)) / 10.0::DOUBLE
       ELSE 0.0::DOUBLE END AS percentage,
  session_count, color, {_minutes('total')} AS total_minutes, {_hours('total')} AS total_hours"""
    return f"""WITH {SESSIONS}, {_category_rows(rules)},
labelled_sessions AS (
  SELECT {_category('app', 'window_title', rules)} AS category, duration_seconds
  FROM sessions WHERE end_time IS NOT NULL AND {where}),
sums AS (
  SELECT c.category, c.color, CAST(coalesce(sum(s.duration_seconds), 0) AS BIGINT) AS seconds,
         count(s.duration_seconds) AS session_count
  FROM categories c LEFT JOIN labelled_sessions s ON s.category = c.category GROUP BY ALL),
totals AS (SELECT *, CAST(sum(seconds) OVER () AS BIGINT) AS total FROM sums)
SELECT {columns} FROM totals {tail}"""


_RULE_ROWS = ", ".join(
    "({}, '{}', '{}', '{}')".format(i, name, word.replace("'", "''"), COLORS[name])
    for i, (name, words) in enumerate(CUSTOM_RULES) for word in words
)
# Two rules for each page beside the others; every title is compared with every keyword.
PAGE_STATS = f"""WITH {SESSIONS},
rules AS (
  SELECT * FROM (VALUES {_RULE_ROWS}) v(priority, category, keyword, color)
  UNION ALL SELECT CASE WHEN page_id % 5 = 0 THEN -1 ELSE 99 END, CASE WHEN page_id % 5 = 0 THEN 'saved' ELSE 'later' END,
                   regexp_replace(url, '^[a-z]+://', ''), CASE WHEN page_id % 5 = 0 THEN '#8A8AFF' ELSE '#8AFF8A' END FROM pages
  UNION ALL SELECT 50, 'clicked', 'Click ' || url, '#FF8A8A' FROM pages),
usage AS (
  SELECT app, window_title, sum(duration_seconds) AS seconds, count(*) AS n
  FROM sessions WHERE end_time IS NOT NULL AND {IN_RANGE} GROUP BY ALL),
best AS (
  SELECT app, window_title, min(priority) AS priority
  FROM usage, rules WHERE contains(lower(app || ' ' || window_title), lower(keyword)) GROUP BY ALL),
categories AS (SELECT DISTINCT priority, category, color FROM rules UNION ALL SELECT 1000, 'other', '#999999'),
sums AS (
  SELECT c.category, c.color, CAST(coalesce(sum(u.seconds), 0) AS BIGINT) AS seconds,
         CAST(coalesce(sum(u.n), 0) AS BIGINT) AS session_count
  FROM categories c LEFT JOIN (
    SELECT u.*, coalesce(b.priority, 1000) AS priority FROM usage u LEFT JOIN best b USING (app, window_title)) u
    ON u.priority = c.priority GROUP BY ALL),
totals AS (SELECT *, CAST(sum(seconds) OVER () AS BIGINT) AS total FROM sums)
SELECT category, {_minutes('seconds')} AS minutes, {_hours('seconds')} AS hours,
  CASE WHEN total > 0 THEN ((seconds * 2000 + total) // (total * 2)) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS percentage,
  session_count, color, {_minutes('total')} AS total_minutes, {_hours('total')} AS total_hours
FROM totals"""


def _by_app(where: str, limit: str = "", prefix: str = "") -> str:
    return f"""WITH {SESSIONS}
SELECT app AS name, {_hours('sum(duration_seconds)')} AS {prefix}hours,
       {_minutes('sum(duration_seconds)')} AS {prefix}minutes
FROM sessions WHERE {where} GROUP BY app
ORDER BY sum(duration_seconds) DESC, app {limit}"""


def _by_title(where: str, having: str = "", tail: str = "") -> str:
    return f"""SELECT app, window_title AS "window", {_minutes('sum(duration_seconds)')} AS minutes,
       {_hours('sum(duration_seconds)')} AS hours, count(*) AS session_count
FROM sessions WHERE {where} GROUP BY app, window_title {having} {tail}"""


def _sessions(columns: str, where: str = "true", tail: str = "") -> str:
    return f"WITH {SESSIONS} SELECT {columns} FROM sessions WHERE {where} {tail}"


ACTIVITY = f"app AS process, window_title, start_time, {_minutes('duration_seconds')} AS duration_minutes"

TYPED = """typed AS (
  SELECT event_id, ts, CASE event_id % 8
    WHEN 0 THEN strftime(ts, '%Y-%m-%d')
    WHEN 1 THEN year(ts) || '-' || month(ts) || '-' || day(ts)
    WHEN 2 THEN year(ts) || '/' || month(ts) || '/' || day(ts)
    WHEN 3 THEN year(ts) || '.' || month(ts) || '.' || day(ts)
    WHEN 4 THEN year(ts) || '-' || month(ts)
    WHEN 5 THEN year(ts) || '-' || month(ts) || '-' || day(ts) || '-' || day(ts)
    WHEN 6 THEN year(ts) || '/2/' || (day(ts) + 5)
    ELSE year(ts) || '-x-' || day(ts) END AS raw
  FROM events),
cleaned AS (
  SELECT *, CASE WHEN event_id % 8 < 4 THEN CAST(ts AS DATE)
                 WHEN event_id % 8 = 6 AND day(ts) + 5 <= CASE WHEN year(ts) % 4 = 0 THEN 29 ELSE 28 END
                   THEN make_date(year(ts), 2, day(ts) + 5) END AS day
  FROM typed)"""

DEFAULT_RULES = (
    ("documentation", ("excel", "word", "feishu", "飞书", "outlook", "slack", "文献", "论文", "jira",
                       "confluence", "notion", "钉钉", "dingtalk")),
    ("coding", ("code", "visual studio", "pycharm", "github", "gitlab")),
    ("learning", ("jupyter", "python", "coursera", "udemy", "stackoverflow", "documentation", "tutorial",
                  "deepseek", "edpuzzle", "github pages", "学习", "教程", "文档")),
    ("social", ("wechat", "qq", "outlook", "gmail", "telegram", "discord", "weixin", "teams", "meeting",
                "slack", "whatsapp", "messenger", "微信")),
    ("entertainment", ("youtube", "netflix", "steam", "game", "spotify", "music", "twitch", "游戏")),
    ("system", ("explorer", "windows", "settings", "system", "cmd", "powershell", "terminal", "文件",
                "设置", "资源管理器")),
)

TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"

TFIDF = f"""WITH docs AS (SELECT doc_id, {TERMS} AS t FROM documents),
grams AS (
  SELECT doc_id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
  FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term
  HAVING count(*) >= 2 AND count(*) * 10 <= (SELECT n FROM n) * 8
  ORDER BY cf DESC, term LIMIT 1000),
raw AS (
  SELECT doc_id, term, tf,
         tf * (ln((1.0::DOUBLE + (SELECT n FROM n)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w
  FROM tf JOIN vocab USING (term))
SELECT doc_id, term, tf, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""

SUBWORDS = r"""WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word FROM docs),
marked AS (SELECT doc_id, '<' || word || '>' AS m FROM words),
feats AS (
  SELECT doc_id, word AS g FROM words
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM docs
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM docs
  UNION ALL
  SELECT doc_id, m[i:i + n - 1] AS g
  FROM marked, (VALUES (3), (4), (5), (6)) lengths(n), unnest(range(1, greatest(len(m) - n + 2, 1))) starts(i))
SELECT d.doc_id, CAST(count(g) AS INTEGER) AS n_features, CAST(count(DISTINCT g) AS INTEGER) AS n_distinct
FROM documents d LEFT JOIN feats f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""

TOKENS = r"""WITH t AS (
  SELECT doc_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\x0b\p{L}\p{N}_]'),
                             lambda x: x NOT IN ('-', '|', '.', '。')) AS t
  FROM documents)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM t"""

EXAMPLES = f"""{SAMPLES},
examples AS (
  SELECT seq AS example_id, app AS process_name, title AS window_title,
         {_category('app', 'title')} AS label, app || ' | ' || title AS text
  FROM samples)"""

LIVE = """SELECT start_date AS date, {key}, {hours} AS hours, {minutes} AS minutes, count(*) AS session_count
FROM ({inner}) GROUP BY start_date, {key}"""


def _live(key: str, expr: str) -> str:
    body = LIVE.format(
        key=key, hours=_hours("sum(duration_seconds)"), minutes=_minutes("sum(duration_seconds)"),
        inner=f"SELECT *, {expr} AS {key} FROM sessions",
    )
    return f"WITH {SESSIONS} {body}"


APPS = f"""WITH {SESSIONS}
SELECT app AS name, CAST(NULL AS VARCHAR) AS executable_path,
       min(start_time) AS first_seen, max(start_time) AS last_seen
FROM sessions"""

FULL = f"{KEY}, app, is_foreground, start_date"

DAY_HOURS = (
    "(CAST(coalesce(sum(CASE WHEN start_date = DATE '{}' THEN duration_seconds END), 0) AS BIGINT)"
    " * 100 + 1800) // 3600"
)

# Mean TF-IDF vectors of the labels on one part of split(id, label, text, is_test), and the
# label that is nearest to each row of the other part.
NEAREST = f"""held_terms AS (SELECT id, label, is_test, {TERMS} AS t FROM split),
grams AS (
  SELECT id, label, is_test,
         unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term FROM held_terms),
tf AS (SELECT id, label, is_test, term, count(*) AS tf FROM grams GROUP BY ALL),
n AS (SELECT count(*) AS n FROM split WHERE NOT is_test),
vocab AS (
  SELECT term, count(*) AS df, sum(tf) AS cf FROM tf WHERE NOT is_test GROUP BY term
  HAVING count(*) >= 2 AND count(*) * 10 <= (SELECT n FROM n) * 8 ORDER BY cf DESC, term LIMIT 1000),
raw AS (
  SELECT id, label, is_test, term,
         tf * (ln((1.0::DOUBLE + (SELECT n FROM n)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w
  FROM tf JOIN vocab USING (term)),
unit AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM raw),
sizes AS (SELECT label, count(*) AS n FROM split WHERE NOT is_test GROUP BY label),
means AS (
  SELECT label, term, sum(u) / any_value(n) AS m FROM unit JOIN sizes USING (label) WHERE NOT is_test GROUP BY label, term),
scores AS (
  SELECT unit.id, means.label, round(sum(u * m), 9) AS s
  FROM unit JOIN means ON unit.term = means.term WHERE is_test GROUP BY unit.id, means.label),
best AS (
  SELECT * FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY s DESC, label) AS place FROM scores)
  WHERE place = 1)"""

PREDICTED = f"""{LABELLED},
split AS (
  SELECT doc_id AS id, label, text,
         5 * row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id)
           <= count(*) OVER (PARTITION BY label) AS is_test
  FROM labelled),
{NEAREST},
predictions AS (
  SELECT split.id AS doc_id, split.label, coalesce(best.label, (SELECT min(label) FROM sizes)) AS predicted
  FROM split LEFT JOIN best ON best.id = split.id WHERE is_test)"""

# Rules first; titles that no rule hits get the nearest label of the titles that one hits.
FALLBACK = f"""WITH {SESSIONS},
usage AS (
  SELECT app, window_title, sum(duration_seconds)::BIGINT AS seconds, count(*) AS session_count,
         {_category('app', 'window_title')} AS category
  FROM sessions WHERE {IN_RANGE} GROUP BY app, window_title),
examples AS (SELECT DISTINCT app, title, {_category('app', 'title')} AS label FROM samples),
split AS (
  SELECT 'e' || app || ' ' || title AS id, label, app || ' | ' || title AS text, false AS is_test
  FROM examples WHERE label <> 'other'
  UNION ALL
  SELECT 'u' || app || ' ' || window_title, NULL, app || ' | ' || window_title, true FROM usage WHERE category = 'other'),
{NEAREST}
SELECT app AS name, window_title, seconds, session_count,
       CASE WHEN category = 'other' THEN coalesce(best.label, 'other') ELSE category END AS category
FROM usage LEFT JOIN best ON best.id = 'u' || app || ' ' || window_title"""

# Weighted sums of the training data by label and term, which a settled fit meets.
MOMENTS = f"""WITH {PREDICTED},
weights AS (
  SELECT label, n, (SELECT sum(n) FROM sizes)::DOUBLE / ((SELECT count(*) FROM sizes) * n)::DOUBLE AS w FROM sizes),
sums AS (SELECT label, term, sum(u) AS s FROM unit WHERE NOT is_test GROUP BY label, term)
SELECT label, term AS feature, round(coalesce(s, 0) * w, 6) AS observed, true AS is_settled
FROM weights CROSS JOIN vocab LEFT JOIN sums USING (label, term)
UNION ALL SELECT label, '(intercept)', round(n * w, 6), true FROM weights"""

PAIRS = f"""WITH {PREDICTED},
classes AS (SELECT label AS class FROM predictions UNION SELECT predicted FROM predictions),
sums AS (
  SELECT class,
         (SELECT count(*) FROM predictions WHERE label = class) AS support,
         (SELECT count(*) FROM predictions WHERE predicted = class) AS chosen,
         (SELECT count(*) FROM predictions WHERE predicted = class AND label = class) AS hit
  FROM classes),
per_class AS (
  SELECT class, CASE WHEN chosen > 0 THEN hit / chosen::DOUBLE ELSE 0 END AS "precision",
         CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0 END AS recall,
         CASE WHEN support + chosen > 0 THEN hit * 2 / (support + chosen)::DOUBLE ELSE 0 END AS f1,
         support
  FROM sums),
rows_ AS (
  SELECT * FROM per_class
  UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per_class
  UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
                   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per_class)
SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM rows_"""


def all_sql() -> dict[str, str]:
    tables = (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
    )
    sql = {
        "src_samples": f"WITH {SAMPLES} SELECT device_id, ts, seq, app, title FROM samples",
        "src_sessions": _sessions(f"app AS name, {KEY}, is_foreground, start_date"),
        "src_labelled_jsonl": f"WITH {LABELLED} SELECT text, label FROM labelled",
        "src_messy_jsonl": f"""WITH {LABELLED}
SELECT process_name, window_title,
       CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE label END AS label, text
FROM labelled WHERE doc_id % 7 NOT IN (3, 5)""",
        "src_json_array": f"""WITH {LABELLED}
SELECT doc_id, process_name, window_title, label, text FROM labelled
UNION ALL SELECT doc_id, process_name, '', 'other', process_name FROM labelled
UNION ALL SELECT doc_id, process_name, '', label, process_name FROM labelled""",
        "src_delimited": _sessions("app AS process_name, window_title"),
        "sink_delimited": _sessions("app || ' | ' || window_title AS value"),
        "sink_jsonl": f"WITH {LABELLED} SELECT process_name, window_title, label, text FROM labelled",
        "sink_prefixed_train_text": f"""WITH {LABELLED}
SELECT '__label__' || label || ' ' || translate(text, chr(13) || chr(10), '  ') AS value FROM labelled""",
        "table_counts": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in tables
        ),
        "sink_sessions": _sessions(f"{KEY}, start_date"),
        "sink_append": _sessions(f"app AS name, {KEY}, start_date"),
        "sink_report_csv": _stats(IN_RANGE),
        "flt_ignore_titles": f"""WITH {SAMPLES} SELECT device_id, seq, app, title FROM samples
WHERE NOT contains(title, '/fr/')""",
        "flt_valid_sample": f"""WITH {SAMPLES} SELECT device_id, seq, app, title FROM samples
WHERE app <> '' AND trim(title) <> ''""",
        "flt_date_eq": _sessions(KEY, f"start_date = {AS_OF}"),
        "flt_date_range": _sessions(KEY, IN_RANGE),
        "flt_last_n_days": _sessions(KEY, f"start_date >= {AS_OF} - 7"),
        "flt_closed": _sessions(KEY, "end_time IS NOT NULL"),
        "flt_open": _sessions(KEY, "end_time IS NULL"),
        "flt_nonzero": f"""WITH {SESSIONS}, report AS ({_by_title(IN_RANGE)})
SELECT * FROM report WHERE minutes > 0 OR hours > 0""",
        "flt_foreground": f"""WITH {SAMPLES}
SELECT seq, app AS process_name, title AS window_title FROM samples
WHERE NOT value >= 10.0 AND trim(title) <> '' AND NOT contains(title, '/fr/')""",
        "prj_usage_units": _sessions(
            f"device_id, session_seq, {_minutes('duration_seconds')} AS minutes, "
            f"{_hours('duration_seconds')} AS hours"
        ),
        "prj_text": f"""WITH {SAMPLES}
SELECT seq, app || ' | ' || title AS text, app || ' ' || title AS plain_text FROM samples""",
        "prj_time_features": _sessions(
            "device_id, session_seq, app AS process, window_title, "
            "duration_seconds / 60.0::DOUBLE AS duration_minutes, "
            "CAST(hour(start_time) AS INTEGER) AS hour_of_day, "
            "CAST(isodow(start_time) - 1 AS INTEGER) AS day_of_week"
        ),
        "join_session_app": _sessions("device_id, session_seq, app AS name, duration_seconds"),
        "lookup_session": f"""WITH {SESSIONS},
found AS (SELECT app AS name, window_title, start_time, device_id, session_seq, end_time FROM sessions)
SELECT * EXCLUDE (end_time) FROM found WHERE device_id = 46 AND session_seq = 1
UNION ALL SELECT * EXCLUDE (end_time) FROM found WHERE device_id = 46 AND end_time IS NULL""",
        "join_rules_first_match": f"""WITH {SAMPLES}
SELECT DISTINCT app, title, {_category('app', 'title')} AS category FROM samples""",
        "rpt_zero_fill": _stats(
            f"start_date = {AS_OF}", RULES + (("shopping", ("no such shop",)),),
            f"category, {_minutes('seconds')} AS minutes, session_count, color",
        ),
        "rpt_day_total": f"""WITH {SESSIONS}
SELECT {_hours('coalesce(sum(duration_seconds), 0)')} AS total_hours,
       {_minutes('coalesce(sum(duration_seconds), 0)')} AS total_minutes
FROM sessions WHERE start_date = {AS_OF}""",
        "rpt_day_by_app": _by_app(f"start_date = {AS_OF}"),
        "rpt_recent": _sessions(
            ACTIVITY, tail="ORDER BY start_time DESC, app, device_id, session_seq LIMIT 10"
        ),
        "rpt_top_apps": _by_app(f"start_date >= {AS_OF} - 1", "LIMIT 3", "total_"),
        "rpt_daily": f"""WITH {SESSIONS}
SELECT start_date AS date, {_hours('sum(duration_seconds)')} AS total_hours,
       {_minutes('sum(duration_seconds)')} AS total_minutes
FROM sessions WHERE start_date >= {AS_OF} - 7 GROUP BY start_date ORDER BY start_date""",
        "rpt_timeline": _sessions(ACTIVITY, f"start_date = {AS_OF}", "ORDER BY start_time, app"),
        "rpt_range_by_app": _by_app(IN_RANGE),
        "rpt_range_count": _sessions("count(*) AS session_count", IN_RANGE),
        "rpt_range_top10": _by_app(f"start_date = {AS_OF}", "LIMIT 10"),
        "rpt_range_top20": _by_app(IN_RANGE, "LIMIT 20"),
        "rpt_by_title": f"WITH {SESSIONS} {_by_title(IN_RANGE)}",
        "rpt_distinct_titles": _sessions("DISTINCT window_title", "app = 'click'"),
        "rpt_raw_sessions": _sessions(
            "app AS process, window_title, start_time, end_time, duration_seconds",
            f"end_time IS NOT NULL AND {IN_RANGE}",
        ),
        "rpt_hour_histogram": f"""WITH {SESSIONS}
SELECT CAST(hour(start_time) AS INTEGER) AS hour_of_day, count(*) AS session_count
FROM sessions WHERE start_date = {AS_OF} GROUP BY 1""",
        "rpt_compare_days": f"""WITH {SESSIONS}, {_category_rows(RULES)},
labelled_sessions AS (
  SELECT {_category('app', 'window_title')} AS category, start_date, duration_seconds
  FROM sessions WHERE end_time IS NOT NULL),
sums AS (
  SELECT c.category, {DAY_HOURS.format('2024-01-08')} AS a, {DAY_HOURS.format('2024-01-12')} AS b
  FROM categories c LEFT JOIN labelled_sessions s ON s.category = c.category GROUP BY c.category)
SELECT category, a / 100.0::DOUBLE AS hours_a, b / 100.0::DOUBLE AS hours_b,
       (b - a) / 100.0::DOUBLE AS difference FROM sums""",
        "ses_detect_sleep": f"""WITH {POLLS}
SELECT device_id, prev_ts AS sleep_start, ts AS wake_time FROM polls WHERE gap = 1""",
        "ses_islands": f"WITH {POLLS} SELECT device_id, seq, ts, island FROM islands",
        "ses_changes": f"WITH {SESSIONS} SELECT device_id, ts, seq, app, title FROM changes",
        "ses_build": _sessions(FULL),
        "ses_close_at": _sessions(
            "device_id, session_seq, window_title, start_time, "
            "coalesce(end_time, TIMESTAMP '2024-02-01 00:00:00') AS end_time, "
            "date_diff('second', start_time, coalesce(end_time, TIMESTAMP '2024-02-01 00:00:00'))"
            " AS duration_seconds"
        ),
        "cls_rules": f"""WITH {SAMPLES}
SELECT seq, {_category('app', 'title')} AS category,
       {_category('app', 'title', DEFAULT_RULES)} AS default_category,
       {_word_category('app', 'title')} AS word_category
FROM samples""",
        "cls_fallback": FALLBACK,
        "cls_range_stats": _stats(IN_RANGE),
        "cls_day_stats": _stats(f"start_date = {AS_OF}"),
        "cls_week_stats": _stats(f"start_date BETWEEN {AS_OF} AND {AS_OF} + 6"),
        "cls_top_in_category": f"""WITH {SESSIONS} {_by_title(
            IN_RANGE + " AND " + _category('app', 'window_title') + " = 'learning'", "",
            "ORDER BY sum(duration_seconds) DESC, app, window_title LIMIT 10")}""",
        "cls_top_prelimit": f"""WITH {SESSIONS}, top AS ({_by_title(
            IN_RANGE, "", "ORDER BY sum(duration_seconds) DESC, app, window_title LIMIT 30")})
SELECT * FROM top WHERE {_category('app', '"window"')} = 'learning'""",
        "cls_sorted_nonzero": "SELECT category, minutes, hours, percentage, session_count FROM ("
        + _stats(IN_RANGE) + ") WHERE minutes > 0",
        "cls_custom_rules": PAGE_STATS,
        "trn_label_normalise": """SELECT conv_id, turn,
  CASE WHEN role IN ('user', 'system') THEN role ELSE 'other' END AS strict_label,
  CASE WHEN text <> '' THEN CASE WHEN contains(lower(text), 'ouche') THEN 'ouche'
       WHEN contains(lower(text), 'tion') THEN 'tion'
       WHEN contains(lower(text), 'ch') THEN 'ch' ELSE 'other' END END AS loose_label
FROM conversations""",
        "trn_dedup_keep_first": f"""WITH {EXAMPLES},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY process_name, window_title, label ORDER BY example_id) AS rn
  FROM examples)
SELECT example_id, process_name, window_title, label, text FROM ranked WHERE rn = 1""",
        "trn_label_distribution": f"""WITH {LABELLED},
held AS (SELECT CASE WHEN label IN ('learning', 'social', 'coding') THEN label ELSE 'other' END AS label FROM labelled),
n AS (SELECT count(*) AS n FROM held),
every(label) AS (VALUES ('learning'), ('social'), ('coding'), ('other'))
SELECT e.label, count(h.label) AS count,
       ((count(h.label) * 2000 + (SELECT n FROM n)) // ((SELECT n FROM n) * 2)) / 10.0::DOUBLE AS percentage
FROM every e LEFT JOIN held h ON e.label = h.label GROUP BY e.label""",
        "trn_batch_union": """WITH numbered AS (
  SELECT CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'es' THEN 3 ELSE 4 END AS batch
  FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')),
counts AS (SELECT batch, count(*) AS count FROM numbered GROUP BY batch)
SELECT batch, count, CAST(sum(count) OVER (ORDER BY batch) AS BIGINT) AS cumulative FROM counts""",
        "trn_tokens": TOKENS,
        "trn_tfidf": TFIDF,
        "trn_subword_features": SUBWORDS,
        "trn_stratified_split": f"""WITH {LABELLED},
ranked AS (
  SELECT doc_id, label,
         row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS rn,
         count(*) OVER (PARTITION BY label) AS n
  FROM labelled)
SELECT doc_id, label, 5 * rn <= n AS is_test FROM ranked""",
        "trn_class_weights": f"""WITH {LABELLED},
counts AS (SELECT label, count(*) AS count FROM labelled GROUP BY label)
SELECT label, count, CAST(sum(count) OVER () AS BIGINT) / (count(*) OVER () * count)::DOUBLE AS weight FROM counts""",
        "mdl_certificate": MOMENTS,
        "evl_accuracy": f"""WITH {PREDICTED}
SELECT count(*) FILTER (WHERE label = predicted) AS correct, count(*) AS total,
       count(*) FILTER (WHERE label = predicted) / count(*)::DOUBLE AS accuracy FROM predictions""",
        "evl_class_report": PAIRS,
        "evl_confusion": f"""WITH {PREDICTED}
SELECT label, count(*) FILTER (WHERE predicted = 'learning') AS learning,
       count(*) FILTER (WHERE predicted = 'social') AS social,
       count(*) FILTER (WHERE predicted NOT IN ('learning', 'social')) AS unlisted
FROM predictions GROUP BY label""",
        "mnt_upsert_apps": f"""{APPS} WHERE start_date < {AS_OF}
   OR start_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-20' GROUP BY app""",
        "mnt_purge_day": _sessions(
            f"device_id, session_seq, start_date, "
            f"(SELECT count(*) FROM sessions WHERE start_date = {AS_OF}) AS deleted_count",
            f"start_date <> {AS_OF}",
        ),
        "mnt_purge_range": _sessions(
            f"device_id, session_seq, start_date, "
            f"(SELECT count(*) FROM sessions WHERE {IN_RANGE}) AS deleted_count",
            f"NOT ({IN_RANGE})",
        ),
        "dat_normalise": f"WITH {TYPED} SELECT event_id, raw, day FROM cleaned",
        "dat_normalise_range": f"""WITH {TYPED}
SELECT event_id, day AS range_start, CAST(ts AS DATE) AS range_end, day IS NOT NULL AS is_valid FROM cleaned""",
        "str_sessionize": _sessions(FULL),
        "str_sleep_timer": f"""WITH {SESSIONS},
last_poll AS (SELECT device_id, max(ts) AS last_ts FROM samples GROUP BY device_id),
timed AS (
  SELECT s.* EXCLUDE (end_time, duration_seconds),
         CASE WHEN s.end_time IS NOT NULL THEN s.end_time
              WHEN last_ts + INTERVAL 12 HOUR < (SELECT max(ts) FROM samples)
                THEN CAST(date_trunc('second', last_ts) AS TIMESTAMP) END AS end_time
  FROM sessions s JOIN last_poll p ON s.device_id = p.device_id)
SELECT device_id, session_seq, window_title, start_time, end_time,
       coalesce(date_diff('second', start_time, end_time), 0) AS duration_seconds,
       app, is_foreground, start_date FROM timed""",
        "str_stop": f"""WITH {SESSIONS},
last_poll AS (SELECT device_id, max(ts) + INTERVAL 60 SECOND AS stop_ts FROM samples GROUP BY device_id),
stopped AS (
  SELECT s.* EXCLUDE (end_time, duration_seconds),
         coalesce(s.end_time, CAST(date_trunc('second', stop_ts) AS TIMESTAMP)) AS end_time
  FROM sessions s JOIN last_poll p ON s.device_id = p.device_id)
SELECT device_id, session_seq, window_title, start_time, end_time,
       date_diff('second', start_time, end_time) AS duration_seconds,
       app, is_foreground, start_date FROM stopped""",
        "str_daily_usage": _live("name", "app"),
        "str_category_usage": _live("category", _category("app", "window_title")),
        "str_upsert_apps": f"{APPS} GROUP BY app",
    }
    return sql
