"""Quality rules by repetition coverage (operator 9).

Words get 64-bit hashes, and rolling hashes of several n-gram lengths follow from them in
numpy over a whole slice of texts.  A text fails if too many of its characters lie inside
n-grams or lines that repeat earlier ones, or in one frequent n-gram.  An (n+1)-gram can
only repeat where both n-grams in it do, so every length looks only at what the length
before left.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, LongType, StructField

from dwell.llm.texts import ASCII_SPACES, map_texts, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
# The published thresholds for the share of word characters in the most
# frequent n-gram.
TOP_SHARE = {2: 0.20, 3: 0.18, 4: 0.16}
# Share of word characters allowed in n-grams and in lines that repeat earlier ones.  One
# boilerplate line twice in a page of 50 words is about a quarter and passes.
REPEATED_LENGTHS = (5, 6, 7, 8, 9, 10)
REPEATED_SHARE = 0.30
LINE_SHARE = 0.30
BASE_WINDOW = 3

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Slice:
    """All words of a slice of texts side by side."""

    def __init__(self, texts: list[str]):
        words = [words_of(t) for t in texts]
        self.n = np.fromiter(map(len, words), np.int64, len(texts))
        total = int(self.n.sum())
        self.ends = np.cumsum(self.n)
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        flat = [w for ws in words for w in ws]
        self.hash = np.fromiter(map(hash, flat), np.int64, total).view(np.uint64)
        self.size = np.fromiter(map(len, flat), np.int64, total)
        self.before = np.concatenate([[0], np.cumsum(self.size)])
        self.chars = self.per_doc(self.size)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.ends] - sums[self.ends - self.n]

    def covered(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Marks of the words inside windows of this length at these starts."""
        marks = np.zeros(len(self.doc) + 1, np.int64)
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + length, -1)
        return np.cumsum(marks[:-1]) > 0

    def repeats(self):
        """For n = 2, 3, ...: starts of the windows found twice or more in their text, a
        number for each that equal windows share, and whether it repeats an earlier one."""
        # The first word's hash carries the text, so windows of two texts never agree.
        rolling = self.hash + self.doc.astype(np.uint64) * _STEP * np.uint64(977)
        starts = np.arange(len(self.doc))
        last = self.ends[self.doc] if len(self.doc) else starts
        n = 1
        while True:
            n += 1
            starts = starts[starts + n <= last[starts]]
            rolling_here = rolling[starts] * _STEP + self.hash[starts + n - 1]
            rolling = np.zeros_like(rolling)
            rolling[starts] = rolling_here
            order = np.argsort(rolling_here, kind="stable")
            ranked = rolling_here[order]
            same = np.zeros(len(ranked), bool)
            if len(ranked):
                same[1:] = ranked[1:] == ranked[:-1]
            again = same.copy()
            again[:-1] |= same[1:]
            kind = np.cumsum(~same)[again]
            found = starts[order[again]]
            back = np.argsort(found)
            starts = found[back]
            yield n, starts, kind[back], same[again][back]
            # A longer window can repeat only where both windows of this length do.
            marked = np.zeros(len(self.doc) + 1, bool)
            marked[starts] = True
            starts = starts[marked[starts + 1]]


def _lines(text: str) -> tuple[int, int]:
    """Lines that equal an earlier one, and the word characters in them."""
    lines = text.split("\n")
    if len(lines) < 2 or len(set(lines)) == len(lines):
        return 0, 0
    number = chars = 0
    for line, count in Counter(lines).items():
        if count > 1 and line.strip(ASCII_SPACES):
            number += count - 1
            chars += (count - 1) * (len(line) - sum(line.count(c) for c in ASCII_SPACES))
    return number, chars


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    """The base measures and the repetition verdict of each text."""
    part = _Slice(texts)
    out = {"n_words": part.n, "word_chars": part.chars}
    out["n_symbols"] = np.array([sum(t.count(c) for c in SYMBOLS) for t in texts], np.int64)
    lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 2)
    out["n_dup_lines"] = lines[:, 0]
    bad = lines[:, 1] > LINE_SHARE * part.chars
    for n, starts, kind, later in part.repeats():
        if n == BASE_WINDOW:
            out["n_repeat_words"] = part.per_doc(part.covered(starts, n))
        if n in TOP_SHARE and len(starts):
            # Most frequent window: occurrences times its characters.
            kinds, first, count = np.unique(kind, return_index=True, return_counts=True)
            at = starts[first]
            inside = (part.before[at + n] - part.before[at]) * count
            most = np.zeros(len(texts), np.int64)
            np.maximum.at(most, part.doc[at], inside)
            bad |= most > TOP_SHARE[n] * part.chars
        if n in REPEATED_LENGTHS and len(starts):
            inside = part.per_doc(np.where(part.covered(starts[later], n), part.size, 0))
            bad |= inside > REPEATED_SHARE * part.chars
        if n >= max(REPEATED_LENGTHS):
            break
    base = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    return out | {"base_failed": base, "kept": ~base & ~bad}


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  verdict: str = "kept") -> DataFrame:
    """Kept columns, the measures, ``base_failed`` and a verdict column per text.

    A null, empty or blank text has no words and fails the base rules.  Rows are judged
    one by one, so repeated rows get equal results and an empty table gives none.
    """
    added = [StructField(c, LongType()) for c in COLUMNS]
    added += [StructField("base_failed", BooleanType()), StructField(verdict, BooleanType())]

    def start():
        def work(texts):
            found = measure(texts)
            return [pa.array(found[c].astype(np.int64)) for c in COLUMNS] + [
                pa.array(found["base_failed"]), pa.array(found["kept"])
            ]

        return work

    return map_texts(docs, text, keep, added, start)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes, with their columns as they were."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    judged = quality_rules(plain, f"c{names.index(text)}", tuple(plain.columns))
    return judged.where(F.col("kept")).select(*plain.columns).toDF(*names)
