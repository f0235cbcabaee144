"""Text expressions for samples and labelled lines."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

# Titles that are never recorded, without and with a configuration.
DEFAULT_IGNORED = ("Program Manager", "Desktop", "Settings", "系统", "桌面")
CONFIGURED_IGNORED = (
    "Program Manager", "Desktop", "Settings", "系统", "system", "桌面", "Desktop",
    "Microsoft Text Input Application",
)

# Every character a Unicode-aware strip removes.
_BLANKS = "\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

DELIMITER = " | "


def any_of(conditions: Iterable[Column]) -> Column:
    """OR of any number of conditions, as a balanced tree so that long lists stay shallow."""
    level = list(conditions)
    if not level:
        return F.lit(False)
    while len(level) > 1:
        pairs = [a | b for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[2 * len(pairs):]
    return level[0]


def has_text(col: Column) -> Column:
    """True for a value with at least one non-blank character; never NULL."""
    return F.coalesce(col.rlike(f"[^{_BLANKS}]"), F.lit(False))


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{_BLANKS}]+|[{_BLANKS}]+$", "")


def is_ignored(title: Column, keywords: Sequence[str] = DEFAULT_IGNORED) -> Column:
    """Case-sensitive containment of any keyword; never NULL."""
    return F.coalesce(any_of(title.contains(k) for k in dict.fromkeys(keywords)), F.lit(False))


def is_valid_sample(app: Column, title: Column) -> Column:
    """A sample that can open a session: non-empty app, non-blank title."""
    return F.coalesce(app != "", F.lit(False)) & has_text(title)


def app_title(app: Column, title: Column, delimiter: str = DELIMITER) -> Column:
    return F.concat(F.coalesce(app, F.lit("")), F.lit(delimiter), F.coalesce(title, F.lit("")))


def quoted(literal: str) -> str:
    """``literal`` as a Java regular expression that matches exactly itself."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in literal)
