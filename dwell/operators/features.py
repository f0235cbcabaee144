"""Text features: tokens, TF-IDF weights, subword n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# Marks that are not tokens.
DROPPED_MARKS = ("-", "|", ".", "。")

_HAN = r"\p{IsHan}"
_WORD = r"[\p{L}\p{N}_]"


def _han_bigrams(text: Column) -> Column:
    """Write each run of Han characters as its overlapping character pairs."""
    has_han = text.rlike(_HAN)
    paired = F.regexp_replace(text, rf"({_HAN})(?=({_HAN}))", " $1$2 ")
    without_last = F.regexp_replace(paired, rf"(?<={_HAN}{_HAN} ){_HAN}(?!{_HAN})", "")
    apart = F.regexp_replace(without_last, rf"(?<!{_HAN})({_HAN}{{1,2}})(?!{_HAN})", " $1 ")
    return F.when(has_han, apart).otherwise(text)


def tokens(text: Column) -> Column:
    """Words and single marks, without blanks and the four dropped marks."""
    spaced = _han_bigrams(text)
    found = F.regexp_extract_all(spaced, F.lit(rf"({_WORD}+|[^\s\p{{L}}\p{{N}}_])"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*DROPPED_MARKS))


def terms(text: Column) -> Column:
    """Lower-case words of two or more characters, in order."""
    return F.regexp_extract_all(
        _han_bigrams(F.lower(text)), F.lit(rf"({_WORD}{{2,}})"), F.lit(1)
    )


def _pair_up(left: Column, right: Column, shift: int, joiner: str = " ") -> Column:
    """Each run of ``left`` with the word of ``right`` that follows it."""
    count = F.greatest(F.size(right) - shift, F.lit(0))
    return F.zip_with(
        F.slice(left, F.lit(1), count),
        F.slice(right, F.lit(shift + 1), count),
        lambda a, b: F.concat(a, F.lit(joiner), b),
    )


# The functions below add one column per step.  A step that reads an earlier one several
# times then reads its value, and does not compute it again.

def with_one_two_grams(df: DataFrame, text: str, out: str = "grams") -> DataFrame:
    """Add the terms of a text and the pairs of neighbouring terms."""
    return (
        df.withColumn("_terms", terms(F.col(text)))
        .withColumn(out, F.concat("_terms", _pair_up(F.col("_terms"), F.col("_terms"), 1)))
        .drop("_terms")
    )


# Words that a task counts at once.
_SLICE_WORDS = 1_000_000


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.DictionaryArray]]:
    """Parts of a batch, whose last column holds words: the rows, the row of every word, and
    the words by number.  A part has a bounded number of words, or one row."""
    sizes = batch.columns[-1].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + _SLICE_WORDS, "right")))
        part = batch.slice(at, end - at)
        yield part, np.repeat(np.arange(end - at), sizes[at:end]), part.columns[-1].flatten().dictionary_encode()
        at = end


def _codes(
    row: np.ndarray, words: pa.DictionaryArray, pairs: bool, among: pa.Array | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every word, and of every pair of neighbours: the code of word i is
    i, that of a pair (i, j) is (i + 1) * n + j for n different words.  With ``among`` only
    terms made of those words."""
    ids = words.indices.to_numpy().astype(np.int64)
    wanted = np.ones(len(ids), bool)
    if among is not None:
        wanted = pc.is_in(words.dictionary, among).to_numpy(zero_copy_only=False)[ids]
    if not pairs:
        return row[wanted], ids[wanted]
    near = np.flatnonzero((row[1:] == row[:-1]) & wanted[1:] & wanted[:-1])
    coded = (ids[near] + 1) * len(words.dictionary) + ids[near + 1]
    return np.concatenate([row[wanted], row[near]]), np.concatenate([ids[wanted], coded])


def _per_row(row: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different codes of each row and how often they occur, ordered by code."""
    # A slice of many rows has at most a million words, so these products stay below 2^63.
    rows = int(row.max()) + 1 if len(row) else 1
    keys = np.sort(codes * rows + row)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    codes, row = np.divmod(keys[first], rows)
    return row, codes, np.diff(np.append(first, len(keys)))


def _spelled(codes: np.ndarray, words: pa.Array) -> pa.Array:
    """The terms of codes."""
    texts, n = words.to_pylist(), len(words)
    return pa.array(
        [texts[c] if c < n else f"{texts[c // n - 1]} {texts[c % n]}" for c in codes.tolist()], pa.string()
    )


def count_terms(docs: DataFrame, words: str, pairs: bool, among: Sequence[str] | None = None) -> DataFrame:
    """(term, df, cf) of the words of an array column and, with ``pairs``, of neighbours;
    with ``among`` only of terms made of those words.

    Tasks count the terms of many documents at a time as numbers; only sums per term and
    slice become rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = None if among is None else pa.array(among, pa.string())
        for batch in batches:
            for _, row, found in _slices(batch):
                _, codes, tf = _per_row(*_codes(row, found, pairs, some))
                first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
                df = np.diff(np.append(first, len(codes)))
                cf = np.add.reduceat(tf, first) if len(first) else tf
                yield pa.RecordBatch.from_arrays(
                    [_spelled(codes[first], found.dictionary), pa.array(df, pa.int64()), pa.array(cf, pa.int64())],
                    names=["term", "df", "cf"],
                )

    parts = docs.select(words).mapInArrow(run, "term string, df long, cf long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


# The most terms of a vocabulary.
MAX_TERMS = 1000


# ---- TF-IDF ---------------------------------------------------------------

# Words handed to the driver to tell which of them are frequent.
_CANDIDATES = 20_000


def _reaching(
    docs: DataFrame, words: str, n_docs: int, min_df: int, max_df_tenths: int, max_terms: int
) -> list[str] | None:
    """The words as frequent as the last one of a vocabulary of words; None for all words,
    if there are too few for one or too many of these."""
    head = count_terms(docs, words, False).orderBy(F.col("cf").desc(), "term").limit(_CANDIDATES).collect()
    fit = [r["cf"] for r in head if r["df"] >= min_df and r["df"] * 10 <= n_docs * max_df_tenths]
    if not 0 < max_terms <= len(fit):
        return None
    least = fit[max_terms - 1]
    if len(head) == _CANDIDATES and head[-1]["cf"] >= least:
        return None
    return [r["term"] for r in head if r["cf"] >= least]


def vocabulary(
    docs: DataFrame, words: str, pairs: bool, min_df: int = 2, max_df_tenths: int = 8, max_terms: int = 1000
) -> DataFrame:
    """(term, df, cf, n_docs) of the most frequent terms, see ``count_terms``.

    The counts are combined before the shuffle, which carries terms and never
    (document, term) pairs.  A pair is no more frequent than either of its words, so words
    are counted first and pairs only of those words that reach the last place of a
    vocabulary of words.  Most pairs of a large corpus occur once and are never spelled.
    """
    n_docs = docs.count()
    among = _reaching(docs, words, n_docs, min_df, max_df_tenths, max_terms) if pairs else None
    return (
        count_terms(docs, words, pairs, among)
        .withColumn("n_docs", F.lit(n_docs).cast("long"))
        .filter((F.col("df") >= min_df) & (F.col("df") * 10 <= F.col("n_docs") * max_df_tenths))
        .orderBy(F.col("cf").desc(), "term")
        .limit(max_terms)
    )


def term_weights(
    docs: DataFrame, text: str, min_df: int = 2, max_df_tenths: int = 8, max_terms: int = 1000
) -> dict[str, float]:
    """Inverse document frequency of the most frequent terms, ``max_terms`` at most."""
    words = docs.select(terms(F.col(text)).alias("_terms"))
    idf = F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1.0
    vocab = vocabulary(words, "_terms", True, min_df, max_df_tenths, max_terms)
    return {r["term"]: r["idf"] for r in vocab.select("term", idf.alias("idf")).collect()}


def weigh_terms(docs: DataFrame, keep: Sequence[str], text: str, weight_of: dict[str, float]) -> DataFrame:
    """Sparse rows (``keep``, term, tf, weight) with unit length per document.

    Works on the rows of a task: other terms are dropped as numbers before anything is
    sorted, and the length is a sum over the row's own terms, so nothing is shuffled.
    """
    kept = docs.select(*keep)
    known = sorted(weight_of)
    schema = StructType([
        *kept.schema.fields, StructField("term", StringType()), StructField("tf", LongType()), StructField("weight", DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, split = pa.array(known, pa.string()), [term.split(" ") for term in known]
        parts_of = pa.array(sorted({w for words in split for w in words}), pa.string())
        weights = np.array([weight_of[term] for term in known], float)
        for batch in batches:
            for part, row, found in _slices(batch):
                number, n = {w: i for i, w in enumerate(found.dictionary.to_pylist())}, len(found.dictionary)
                places, wanted = [], []
                for place, words in enumerate(split):
                    ids = [number.get(w) for w in words]
                    if None not in ids:
                        places.append(place)
                        wanted.append(ids[0] if len(ids) == 1 else (ids[0] + 1) * n + ids[1])
                if not wanted:
                    continue
                order = np.argsort(wanted)
                wanted, places = np.array(wanted)[order], np.array(places)[order]
                row, codes = _codes(row, found, True, parts_of)
                at = np.minimum(np.searchsorted(wanted, codes), len(wanted) - 1)
                hit = wanted[at] == codes
                row, term, tf = _per_row(row[hit], places[at[hit]])
                raw = tf * weights[term]
                length = np.sqrt(np.bincount(row, raw * raw, part.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(row)) for c in part.columns[:-1]), spelled.take(pa.array(term)),
                     pa.array(tf, pa.int64()), pa.array(raw / length[row])],
                    names=schema.names,
                )

    return docs.select(*keep, terms(F.col(text)).alias("_terms")).mapInArrow(run, schema)


def tfidf(
    docs: DataFrame, key: str, text: str, min_df: int = 2, max_df_tenths: int = 8, max_terms: int = 1000
) -> DataFrame:
    """Sparse TF-IDF rows (key, term, tf, weight) with unit length per document.

    The first pass counts terms and hands the vocabulary, at most ``max_terms`` rows, to
    the driver; the second weighs the terms of each row.
    """
    return weigh_terms(docs, [key], text, term_weights(docs, text, min_df, max_df_tenths, max_terms))


# ---- subwords -------------------------------------------------------------

# Bytes of text that a task works on at once, and n-grams of it that it hands on at once.
_SUBWORD_BYTES = 2_000_000
_SUBWORD_GRAMS = 500_000


def _spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` or less, or of one row."""
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + most, "right")))
        yield at, end
        at = end


def _runs(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one run after another."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(start.max(initial=0)) + total) < 2**31 else np.int64
    found = np.repeat((start - ends + count).astype(kind), count)
    found += np.arange(total, dtype=kind)
    return found


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Small numbers that tell keys apart."""
    return pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)


def _different(row: np.ndarray, codes: np.ndarray, rows: int) -> np.ndarray:
    """How many different codes each row has."""
    n = int(codes.max(initial=0)) + 1
    kind = np.uint32 if rows * n < 2**32 else np.int64
    keys = np.sort(row.astype(kind) * kind(n) + codes.astype(kind))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.searchsorted(keys, (np.arange(rows) * n).astype(kind))
    return np.diff(np.append(0, np.cumsum(new))[np.append(starts, len(keys))])


class _Characters:
    """The characters of an array of words, whose runs can be cut out and numbered."""

    def __init__(self, words: pa.StringArray):
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        self.data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        # Where each character begins, and the end; characters before each word.
        self.begins = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        self.upto = np.searchsorted(self.begins, offsets)
        self.lengths = np.diff(self.upto)

    def counts(self, n: int) -> np.ndarray:
        """How many runs of ``n`` characters each word has."""
        return np.maximum(self.lengths - n + 1, 0)

    def ngrams(self, n: int) -> pa.StringArray:
        """These runs, word by word."""
        return self.cut(_runs(self.upto[:-1], self.counts(n)), n)

    def cut(self, first: np.ndarray, n: int) -> pa.StringArray:
        """The runs of ``n`` characters from the given ones on."""
        size = self.begins[first + n] - self.begins[first]
        ends = np.append(0, np.cumsum(size)).astype(np.int32)
        found = self.data[_runs(self.begins[first], size)]
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(found))

    def numbers(self, high: int) -> Iterator[np.ndarray]:
        """For 1 to ``high`` characters a number for each of the runs, equal for equal ones: that
        of a run is told by that of the run without its last character, and by this one."""
        size, padded = np.diff(self.begins), np.append(self.data, np.zeros(3, np.uint8)).astype(np.int64)
        char = _ranks(sum((padded[self.begins[:-1] + i] << 8 * i) * (size > i) for i in range(4)))
        code, several = char.copy(), int(char.max(initial=0)) + 1
        for n in range(1, high + 1):
            first = _runs(self.upto[:-1], self.counts(n))
            if n > 1:
                code[first] = _ranks(code[first] * several + char[first + n - 1])
            yield code[first]


def _count_different(
    row: np.ndarray, ids: np.ndarray, chars: _Characters, low: int, high: int, rows: int
) -> np.ndarray:
    """How many n-grams of each row differ, by the row and the number of every word and by the
    characters of the numbered words, set in ``<>``.

    N-grams of unlike kinds differ, but for a word as long as some n-grams, which is one of
    them.  Pairs and threes are told apart by their words; a word adds the others once to a row.
    """
    pair = ids.copy()
    pair[:-1] = _ranks(ids[:-1] * len(chars.lengths) + ids[1:])
    two, three = (np.flatnonzero(row[n:] == row[:-n]) for n in (1, 2))
    amount = _different(row[two], pair[two], rows)
    amount += _different(row[three], pair[three] * len(chars.lengths) + ids[three + 2], rows)
    once_row, once, _ = _per_row(row, ids)
    other = (chars.lengths - 2 < low) | (chars.lengths - 2 > high)
    amount += np.bincount(once_row[other[once]], minlength=rows)
    for n, codes in enumerate(chars.numbers(high), 1):
        if n >= low:
            count = chars.counts(n)
            runs = _runs((np.cumsum(count) - count)[once], count[once])
            amount += _different(np.repeat(once_row, count[once]), codes[runs], rows)
    return amount


def _split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the text of each."""
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    row = np.repeat(np.arange(len(texts)), split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    return words.filter(full), row[full.to_numpy(zero_copy_only=False)]


def _subwords(texts: pa.Array, low: int, high: int, count_different: bool, most: int) -> Iterator[pa.StructArray]:
    """The n-grams of each text and, if asked for, how many of them differ, in parts that hold
    ``most`` n-grams or less, or one text.

    Character n-grams are cut once per different word.  The n-grams of a text are runs of
    numbers until their texts are taken by number.
    """
    words, row = _split_words(texts)
    sizes = np.bincount(row, minlength=len(texts))
    upto = np.append(0, np.cumsum(sizes))
    place = np.arange(len(row))

    # N-grams of each kind, and the run of them that each word of a text adds.
    numbered = words.dictionary_encode()
    spelled, ids = numbered.dictionary, numbered.indices.to_numpy().astype(np.int64)
    chars = _Characters(pc.binary_join_element_wise("<", spelled, ">", ""))
    sources, starts, counts = [spelled], [ids], [np.ones_like(ids)]
    for n in (2, 3):
        has = place + n <= upto[row + 1]
        near = [words.take(pa.array(np.flatnonzero(has) + i)) for i in range(n)]
        sources.append(pc.binary_join_element_wise(*near, " "))
        starts.append(np.cumsum(has) - has)
        counts.append(has.astype(np.int64))
    for n in range(low, high + 1):
        count = chars.counts(n)
        sources.append(chars.ngrams(n))
        starts.append((np.cumsum(count) - count)[ids])
        counts.append(count[ids])

    # Ordered by row, then kind, then place of the word.
    kinds, at = len(sources), 0
    start, count = np.empty(kinds * len(row), np.int64), np.empty(kinds * len(row), np.int64)
    for kind in range(kinds):
        here = (kinds - 1) * upto[row] + kind * sizes[row] + place
        start[here], count[here] = starts[kind] + at, counts[kind]
        at += len(sources[kind])
    ends = np.append(0, np.cumsum(count))[kinds * upto]
    source, nulls = pa.concat_arrays(sources), texts.is_null().to_numpy(zero_copy_only=False)
    amount = np.zeros(len(texts), np.int64)
    if count_different:
        amount = _count_different(row, ids, chars, low, high, len(texts))
    for low_row, high_row in _spans(np.diff(ends), most):
        here = slice(kinds * upto[low_row], kinds * upto[high_row])
        grams = source.take(pa.array(_runs(start[here], count[here])))
        null = pa.array(nulls[low_row:high_row])
        yield pa.StructArray.from_arrays([
            pa.ListArray.from_arrays(pa.array(ends[low_row : high_row + 1] - ends[low_row], pa.int32()), grams, mask=null),
            pa.array(amount[low_row:high_row], pa.int32(), mask=nulls[low_row:high_row]),
        ], ["grams", "different"])


def with_subwords(
    df: DataFrame, text: str, out: str = "grams", low: int = 3, high: int = 6, different: str | None = None
) -> DataFrame:
    """Add words, word 2- and 3-grams, and character n-grams of words set in ``<>``; under
    the name ``different``, if given, how many of them differ.

    Works on many rows of a task at a time; nothing is shuffled.
    """
    size, most = _SUBWORD_BYTES, _SUBWORD_GRAMS

    @F.arrow_udf("grams array<string>, different int")
    def build(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pc.binary_length(batch).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, end in _spans(sizes, size):
                yield from _subwords(batch.slice(at, end - at), low, high, different is not None, most)

    made = df.withColumn("_made", build(F.make_valid_utf8(text))).withColumn(out, F.col("_made.grams"))
    if different is not None:
        made = made.withColumn(different, F.col("_made.different"))
    return made.drop("_made")
