"""Language identification by segmentation-marginalised unigrams (operator 6).

Each language has probabilities for the pieces of one fixed public vocabulary.  The
probability of a word is the sum over all of its segmentations into pieces, which a
forward pass works out position by position; a text's log-probability is the sum over its
words.  The piece probabilities are fitted by expectation maximisation: the expected
number of times a piece occurs, over all segmentations of the words of a language, comes
from a forward and a backward pass.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from dwell.llm.counts import MARK, read_pieces
from dwell.llm.texts import WordTable, hash_number, map_texts, sample_share, slices, words_of
from dwell.sources.storage import fresh_folder

UNKNOWN = "und"
# Documents per language that the model is fitted on, those with the smallest hashes.
MAX_DOCS = 4000
ROUNDS = 2
SMOOTHING = 0.05
# Plain words kept by a worker process, with their scores.
WORDS = 600_000
# Words up to this length are worked out together with others of their length.  Longer ones
# go position by position, and their probabilities are rescaled on the way.
SHORT = 24
# Long words that go together, and piece numbers looked up for them at a time.
TOGETHER = 256
LOOKED_UP = 1_000_000
# Below this a prefix's probability becomes one, and its logarithm is kept beside it.
TINY = 1e-60
# Languages a model may hold: it goes to every task, with one number per piece of each.
MAX_LANGUAGES = 500


class LanguageModel(NamedTuple):
    key: str
    languages: list[str]
    log_prior: np.ndarray  # one per language
    pieces: np.ndarray  # probability of each piece in each language
    floor: np.ndarray  # probability of a character outside the vocabulary


@lru_cache(maxsize=1)
def _index(path: str) -> PieceIndex:
    return PieceIndex({piece: i for i, piece in enumerate(read_pieces(path))})


def plain(word: str) -> str:
    """The letters of a word in lower case: what is scored."""
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


class PieceIndex:
    """The piece vocabulary by 64-bit polynomial hashes, looked up for many strings at once."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    BITS = 18

    def __init__(self, vocabulary: dict[str, int]):
        self.size = len(vocabulary)
        self.longest = max(map(len, vocabulary))
        base, mask = int(self.BASE), (1 << 64) - 1
        hashes = []
        for piece in vocabulary:
            h = 0
            for char in piece:
                h = (h * base + ord(char)) & mask
            hashes.append(h)
        keys = np.array(hashes, np.uint64)
        if len(np.unique(keys)) < self.size:
            raise ValueError("two pieces share a hash")
        numbers = np.fromiter(vocabulary.values(), np.int32, self.size)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        ranked = bucket[order]
        turn = np.arange(self.size) - np.searchsorted(ranked, ranked)
        self.count = np.bincount(bucket, minlength=1 << self.BITS).astype(np.int8)
        self.keys = np.zeros((int(turn.max()) + 1, 1 << self.BITS), np.uint64)
        self.numbers = np.full(self.keys.shape, -1, np.int32)
        self.keys[turn, ranked] = keys[order]
        self.numbers[turn, ranked] = numbers[order]

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes ^ (hashes >> np.uint64(29))) * self.BASE >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers, -1 where there is no such piece."""
        out = np.full(len(hashes), -1, np.int32)
        bucket = self._bucket(hashes)
        rows = np.flatnonzero(self.count[bucket])
        for keys, numbers in zip(self.keys, self.numbers):
            hit = rows[keys[bucket[rows]] == hashes[rows]]
            hit = hit[numbers[bucket[hit]] >= 0]
            out[hit] = numbers[bucket[hit]]
        return out


class Lattice:
    """The segmentations of words of one length, as piece numbers by start and end."""

    def __init__(self, words: list[str], index: PieceIndex):
        size = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), size).T.astype(np.uint64)
        self.size, self.arcs = size, {}
        for start in range(size):
            rolling = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(size, start + index.longest) + 1):
                rolling = rolling * index.BASE + points[end - 1]
                found = index.find(rolling)
                if end == start + 1:
                    found[found < 0] = index.size  # any single character can be spelled
                if (found >= 0).any():
                    self.arcs[start, end] = found

    def forward(self, table: np.ndarray) -> list[np.ndarray]:
        """Probability of every prefix, per word and language."""
        out = [np.ones((len(next(iter(self.arcs.values()))), table.shape[1]), table.dtype)]
        for end in range(1, self.size + 1):
            total = 0
            for start in range(end):
                if (start, end) in self.arcs:
                    total = total + out[start] * table[self.arcs[start, end]]
            out.append(total)
        return out

    def backward(self, table: np.ndarray) -> list[np.ndarray]:
        """Probability of every suffix, per word and language."""
        out = [None] * self.size + [np.ones((len(next(iter(self.arcs.values()))), table.shape[1]), table.dtype)]
        for start in range(self.size - 1, -1, -1):
            total = 0
            for end in range(start + 1, self.size + 1):
                if (start, end) in self.arcs:
                    total = total + table[self.arcs[start, end]] * out[end]
            out[start] = total
        return out


def _by_length(words: list[str]) -> dict[int, list[int]]:
    """Numbers of the short words, by length."""
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if len(word) <= SHORT:
            groups.setdefault(len(word), []).append(i)
    return groups


def _long(words: list[str]) -> list[int]:
    """Numbers of the other words, the longest first."""
    return sorted((i for i, word in enumerate(words) if len(word) > SHORT), key=lambda i: -len(words[i]))


def pieces_by_end(words: list[str], index: PieceIndex, start: int, stop: int) -> np.ndarray:
    """Numbers of the pieces that end at some positions of words, by word, end and length
    less one; -1 where there is none.  Words are filled up with characters of code 0."""
    reach = index.longest - 1
    before = min(start, reach)
    text = "".join(w[start - before:stop].ljust(stop - start + before, "\0") for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)
    out = np.full((len(words), stop - start, index.longest), -1, np.int32)
    rolling = np.zeros_like(points)
    for more in range(min(index.longest, points.shape[1])):
        power = np.uint64(pow(int(index.BASE), more, 1 << 64))
        rolling[:, more:] += points[:, :points.shape[1] - more] * power
        first = max(more, before)  # a piece must not begin before the text it is cut from
        found = index.find(rolling[:, first:].ravel()).reshape(len(words), -1)
        out[:, first - before:, more] = found
    alone = out[:, :, 0]
    alone[alone < 0] = index.size
    return out


def _step(size: int, index: PieceIndex) -> int:
    return max(1, LOOKED_UP // (size * index.longest))


def long_words(words: list[str], index: PieceIndex, table: np.ndarray) -> np.ndarray:
    """Log-probabilities of words sorted by falling length, per word and language.

    Only the prefixes that a piece can still begin at are held.
    """
    lengths = np.array([len(w) for w in words])
    out = np.empty((len(words), table.shape[1]))
    scale = np.zeros_like(out)
    ahead = np.zeros((len(words), index.longest, table.shape[1]))  # the latest prefix first
    ahead[:, 0] = 1
    start = 0
    while start < lengths[0]:
        live = int((lengths > start).sum())
        stop = min(int(lengths[0]), start + _step(live, index))
        pieces = pieces_by_end(words[:live], index, start, stop)
        for end in range(start, stop):
            live = int(np.searchsorted(-lengths, -end))  # words longer than ``end``
            total = np.einsum("wlk,wlk->wk", ahead[:live], table[pieces[:live, end - start]])
            ahead[:live, 1:] = ahead[:live, :-1].copy()
            ahead[:live, 0] = total
            if total.min() < TINY:
                factor = np.where(total < TINY, total, 1.0)
                ahead[:live] /= factor[:, None]
                scale[:live] += np.log(factor)
            done = np.flatnonzero(lengths[:live] == end + 1)
            out[done] = np.log(ahead[done, 0]) + scale[done]
        start = stop
    return out


def long_expected(word: str, index: PieceIndex, chance: np.ndarray) -> np.ndarray:
    """Expected occurrences of every piece in one long word, by the probabilities of the
    pieces in its language; the numbers of pieces as in ``pieces_by_end``."""
    size, reach = len(word), index.longest
    step = _step(1, index)
    # Probabilities of prefixes and suffixes, as a number and the logarithm of a factor.
    front, front_log = np.ones(size + 1), np.zeros(size + 1)
    back, back_log = np.ones(size + 1 + reach), np.zeros(size + 1 + reach)
    back[size + 1:] = 0
    ahead, scale = np.zeros(reach), 0.0
    ahead[0] = 1
    for start in range(0, size, step):
        stop = min(size, start + step)
        for at, row in enumerate(chance[pieces_by_end([word], index, start, stop)[0]], start + 1):
            total = ahead @ row
            ahead[1:] = ahead[:-1].copy()
            ahead[0] = total
            if total < TINY:
                ahead /= total
                scale += np.log(total)
            front[at], front_log[at] = ahead[0], scale
    whole = np.log(front[size]) + front_log[size]
    expected = np.zeros(len(chance))
    behind, scale = np.zeros(reach), 0.0
    behind[0] = 1
    for start in reversed(range(0, size, step)):
        stop = min(size, start + step)
        by_end = pieces_by_end([word], index, start, min(size, stop + reach - 1))[0]
        rows = np.arange(stop - start)[:, None] + np.arange(reach)
        inside = rows < len(by_end)
        pieces = np.where(inside, by_end[np.minimum(rows, len(by_end) - 1), np.arange(reach)], -1)  # by their start
        likely = chance[pieces]
        for at in range(stop - 1, start - 1, -1):
            total = behind @ likely[at - start]
            behind[1:] = behind[:-1].copy()
            behind[0] = total
            if total < TINY:
                behind /= total
                scale += np.log(total)
            back[at], back_log[at] = behind[0], scale
        ends = np.arange(start, stop)[:, None] + np.arange(1, reach + 1)
        factor = np.exp(front_log[start:stop, None] + back_log[ends] - whole)
        share = front[start:stop, None] * likely * back[ends] * factor
        real = pieces >= 0
        expected += np.bincount(pieces[real], share[real], len(chance))
    return expected


def _padded(model: LanguageModel) -> np.ndarray:
    """Probabilities with a row for unknown characters and, last, a row of zeros for the
    piece number -1 of pieces that do not exist."""
    return np.vstack([model.pieces, model.floor, np.zeros_like(model.floor)])


class Scorer:
    """Log-probabilities of plain words in every language."""

    def __init__(self, model: LanguageModel, index: PieceIndex):
        self.table = _padded(model)
        self.index = index

    def marked(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.table.shape[1]))
        for rows in _by_length(words).values():
            for at in range(0, len(rows), 20_000):
                some = rows[at:at + 20_000]
                lattice = Lattice([words[i] for i in some], self.index)
                out[some] = np.log(lattice.forward(self.table)[-1])
        rows = _long(words)
        for at in range(0, len(rows), TOGETHER):
            some = rows[at:at + TOGETHER]
            out[some] = long_words([words[i] for i in some], self.index, self.table)
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """The row of each plain word, packed; the empty word has zeros."""
        sums = self.marked([MARK + w for w in words if w])
        packed = iter([row.tobytes() for row in sums.astype(np.float32)])
        none = np.zeros(self.table.shape[1], np.float32).tobytes()
        return [next(packed) if w else none for w in words]


# ---- fitting ---------------------------------------------------------------------

def _sample(docs: DataFrame, sizes: dict[str, int], doc_id: str, text: str, lang: str, max_docs: int) -> DataFrame:
    """The documents of each language with the smallest hashes, by a bounded join."""
    shares = {name: sample_share(max_docs, n) for name, n in sizes.items()}
    share = F.element_at(F.from_json(F.lit(json.dumps(shares)), "map<string,double>"), F.col(lang).cast("string"))
    slim = docs.where(F.col(lang).isNotNull()).select(doc_id, lang).withColumn("_h", hash_number(doc_id))
    order = Window.partitionBy(lang).orderBy("_h", doc_id)
    near = slim.where(F.col("_h") < share)
    chosen = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_docs).select(doc_id)
    return docs.where(F.col(lang).isNotNull()).select(doc_id, text, lang).join(F.broadcast(chosen.distinct()), doc_id)


def _word_counts(sample: DataFrame, text: str, lang: str) -> DataFrame:
    """Plain words, marked, with the number of times each language has them."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 0):
                counts: dict[str, Counter] = {}
                for t, name in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counts.setdefault(name, Counter()).update(words_of(t or ""))
                for name, words in counts.items():
                    found: Counter = Counter()
                    for word, n in words.items():
                        if letters := plain(word):
                            found[MARK + letters] += n
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())],
                        names=["lang", "word", "n"],
                    )

    rows = sample.select(F.col(text).cast("string"), F.col(lang).cast("string"))
    counted = rows.mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(counts: DataFrame, path: str, model: LanguageModel) -> DataFrame:
    """Expected occurrences of every piece in every language (-1: spelled characters)."""
    languages = list(model.languages)

    def run(batches):
        index = _index(path)
        table = _padded(model)
        size = index.size
        total = np.zeros((size + 1, len(languages)))
        number = {name: i for i, name in enumerate(languages)}
        for batch in batches:
            names, words, n = (batch.column(i).to_pylist() for i in range(3))
            lang = np.array([number[x] for x in names])
            weight = np.array(n, float)
            for rows in _by_length(words).values():
                for at in range(0, len(rows), 20_000):
                    some = np.array(rows[at:at + 20_000])
                    lattice = Lattice([words[i] for i in some], index)
                    ahead, back = lattice.forward(table), lattice.backward(table)
                    own, line = lang[some], np.arange(len(some))
                    scale = weight[some] / ahead[-1][line, own]
                    for (start, end), piece in lattice.arcs.items():
                        share = ahead[start][line, own] * table[piece, own] * back[end][line, own] * scale
                        np.add.at(total, (piece[piece >= 0], own[piece >= 0]), share[piece >= 0])
            for i in _long(words):
                total[:, lang[i]] += weight[i] * long_expected(words[i], index, table[:, lang[i]])[:-1]
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])],
            names=["piece", "lang", "n"],
        )

    found = counts.mapInArrow(run, "piece int, lang int, n double")
    return found.groupBy("piece", "lang").agg(F.sum("n").alias("n"))


def fit_languages(docs: DataFrame, pieces_path: str, doc_id: str = "doc_id", text: str = "text",
                  lang: str = "lang", max_docs: int = MAX_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """Fit piece probabilities on at most ``max_docs`` documents of each language.

    Rows without a language are ignored; if none is left the model has no language.  The
    driver gets one number per piece and language, never texts or words.
    """
    spark = docs.sparkSession
    priors = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).count()
    sizes = {r["lang"]: r["count"] for r in priors.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    shape = (_index(pieces_path).size, len(languages))
    prior = np.array([sizes[x] for x in languages], float)
    model = LanguageModel(
        uuid.uuid4().hex, languages, np.log(prior / max(1, prior.sum())),
        np.full(shape, 1 / (shape[0] + 1)), np.full(len(languages), 1 / (shape[0] + 1)),
    )
    if not languages:
        return model
    folder = fresh_folder(spark, "language-words")
    _word_counts(_sample(docs, sizes, doc_id, text, lang, max_docs), text, lang).write.parquet(folder)
    counts = spark.read.schema("lang string, word string, n long").parquet(folder)
    for _ in range(rounds):
        total = np.full((shape[0] + 1, shape[1]), SMOOTHING)
        for piece, name, n in _expected(counts, pieces_path, model).collect():
            total[piece, name] += n
        total /= total.sum(axis=0)
        # The mass of unknown characters is shared out among many of them.
        model = model._replace(pieces=total[:-1], floor=total[-1] / 1000)
    return model


# ---- prediction -------------------------------------------------------------------

_TABLES: dict[str, WordTable] = {}


def _scores_of(model: LanguageModel, path: str) -> WordTable:
    """The word table of a worker process, for the model it used last."""
    if model.key not in _TABLES:
        _TABLES.clear()
        _TABLES[model.key] = WordTable(Scorer(model, _index(path)).words, WORDS, plain)
    return _TABLES[model.key]


def predict_language(docs: DataFrame, model: LanguageModel, pieces_path: str, text: str = "text",
                     keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, ``lang_pred`` and ``score``, the probability of that language.

    A null text, a text without a letter, or a model without languages gives ``und`` with
    score 0.  Of equally probable languages the first by name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value
        table = _scores_of(model, pieces_path)

        def work(texts):
            size = len(model.languages)
            if not size:
                return [pa.array([UNKNOWN] * len(texts)), pa.array([0.0] * len(texts))]
            words = [words_of(t) if t else [] for t in texts]
            known = table.fill(words)
            place = dict(zip(known, range(len(known))))
            flat = list(map(place.__getitem__, chain.from_iterable(words)))
            rows = np.frombuffer(b"".join(known.values()), np.float32).reshape(-1, size)
            # Words times rows, summed per text: the words of a text follow each other.
            counts = np.array([len(ws) for ws in words])
            total = np.zeros((len(texts), size))
            full = np.flatnonzero(counts)
            if len(full):
                starts = (np.cumsum(counts) - counts)[full]
                total[full] = np.add.reduceat(rows.astype(np.float64)[flat], starts, axis=0)
            # A word with letters has a probability below one in any language.
            empty = (total == 0).all(axis=1)
            total += model.log_prior
            odds = np.exp(total - total.max(axis=1, keepdims=True))
            best = odds.argmax(axis=1)
            score = odds[np.arange(len(texts)), best] / odds.sum(axis=1)
            names = [UNKNOWN if e else model.languages[i] for e, i in zip(empty, best.tolist())]
            return [pa.array(names, pa.string()), pa.array(np.where(empty, 0.0, score))]

        return work

    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return map_texts(docs, text, keep, added, start)


def held_out(doc_id: Column) -> Column:
    """Documents the model must not learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
