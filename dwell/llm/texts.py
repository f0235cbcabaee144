"""What the text operators share: Arrow batches in bounded slices, and word tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

# Characters handled at a time inside a task; a longer text is a slice of its own.
SLICE_CHARS = 4_000_000
# Words a table keeps, and the longest word it keeps.
TABLE_WORDS = 350_000
LONG_WORD = 200

ASCII_SPACES = " \t\n\x0b\x0c\r"
_SPACE_RUN = re.compile(r" (?=\s|\Z)")

# Takes the texts of a slice, returns one Arrow array per added column.
Work = Callable[[list[str]], Sequence[pa.Array]]


def words_of(text: str) -> list[str]:
    """The matches of ``[^\\x20\\x09-\\x0D]+``."""
    for char in ASCII_SPACES[1:]:
        if char in text:
            text = text.replace(char, " ")
    words = text.split(" ")
    return list(filter(None, words)) if "  " in text or text[:1] in " " or text[-1] == " " else words


def word_keys(text: str) -> list[str]:
    """Cut a text into pieces that a byte-level pattern never joins, as table keys.

    A cut lies before a space that a non-space follows: the pattern gives that space to
    the word after it.  A key leaves that space out; only the first piece has none, and
    its key starts with a space instead, which no other key does.
    """
    parts = text.split(" ")
    if _SPACE_RUN.search(text):
        glued = parts[:1]
        for part in parts[1:]:
            if not part or part[0].isspace():
                glued[-1] += " " + part
            else:
                glued.append(part)
        parts = glued
    parts[0] = " " + parts[0]
    return parts


def piece_of(key: str) -> str:
    """The text behind a key of ``word_keys``."""
    return key[1:] if key.startswith(" ") else " " + key


class WordTable:
    """Values of distinct words, worked out in bulk and kept while there is room.

    ``solve`` maps a list of distinct words to their values.  With ``fold``, words that
    fold to the same form share a value, and only forms are kept.  Only speed depends on
    what is kept: when the table is full it starts again from the words of the last slice.
    """

    def __init__(self, solve: Callable[[list[str]], Iterable], limit: int = TABLE_WORDS,
                 fold: Callable[[str], str] | None = None):
        self.solve = solve
        self.limit = limit
        self.fold = fold
        self.known: dict[str, object] = {}
        self.last: set[str] = set()

    def fill(self, texts: list[list[str]]) -> dict:
        """Values of at least the words of these texts."""
        words = set(chain.from_iterable(texts))
        if self.fold is None:
            return self._fill(words)
        forms = dict(zip(words, map(self.fold, words)))
        known = self._fill(set(forms.values()))
        return {word: known[form] for word, form in forms.items()}

    def _fill(self, words: set[str]) -> dict:
        if len(self.known) > self.limit:
            recent = {w: self.known[w] for w in self.last if len(w) <= LONG_WORD}
            self.known = recent if len(recent) <= self.limit // 2 else {}
        missing = list(words.difference(self.known))
        self.known.update(zip(missing, self.solve(missing)))
        self.last = words
        return self.known


def hash_number(*columns: str) -> Column:
    """A fixed number from 0 up to 1 for a row, for samples by smallest hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sample_share(wanted: int, rows: int) -> float:
    """The share of numbers below which about half as many rows again as wanted lie.

    Taking the smallest of those then gathers rows in proportion to the sample, however
    many partitions there are.
    """
    return min(1.0, (1.5 * wanted + 300) / max(1, rows))


def slices(batch: pa.RecordBatch, column: int, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about so many bytes of text at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + chars, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_texts(
    df: DataFrame, text: str, keep: Sequence[str], added: Sequence[StructField], start: Callable[[], Work]
) -> DataFrame:
    """Keep some columns and add others worked out from a text column (null: empty).

    ``start`` runs once per task.  Rows stay in place: nothing is shuffled, and a task
    holds one Arrow batch and the words of one slice of it.
    """
    schema = StructType([df.schema[c] for c in keep] + list(added))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            last = batch.num_columns - 1
            for part in slices(batch, last):
                found = work([t or "" for t in part.column(last).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:last], *found], names=names)

    columns = [F.col(f"`{c}`") for c in keep]
    return df.select(*columns, F.col(f"`{text}`").cast("string").alias("_text")).mapInArrow(run, schema)
