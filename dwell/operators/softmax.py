"""Linear softmax on hashed subwords, fitted over numbers of words.

The feature vector of a text counts hashed words, word 2- and 3-grams and character n-grams
and has unit length.  Most of its entries are character n-grams; these follow from the words,
and those that begin at one place of a word from the longest of them.  A block of texts
therefore keeps the buckets of every different longest n-gram once, every different word as a
run of such n-grams, and for each word and each bucket of a 2- or 3-gram the texts it is in.
A pass sums weights per n-gram, word and text, and takes the slopes back the same way: the
same sums as over the vectors, in a fraction of their entries.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from dwell.operators.features import _Characters, _runs, _spans, _split_words

# Bytes of text in a block, and numbers that a task looks up, hashes or sorts at once.
_BLOCK_BYTES = 12_000_000
_AT_ONCE = 100_000
_HASHED_AT_ONCE = 250_000
_SORTED_AT_ONCE = 1_000_000


class Runs(NamedTuple):
    """Rows of numbers, one after another."""
    size: np.ndarray
    number: np.ndarray


class Block(NamedTuple):
    label: np.ndarray
    scale: np.ndarray  # 1 / length of the counted vector, 0 without words
    texts: Runs  # where each bucket, then each word, occurs
    words: Runs  # for each word a bucket, or from ``buckets`` on an n-gram
    grams: Runs  # buckets of each n-gram and of the shorter ones it begins with


# ---- hashing --------------------------------------------------------------

def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _mixed(k: np.ndarray) -> np.ndarray:
    return _rotated(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def _hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each run of bytes, as ``HashingTF`` has it: MurmurHash3 with seed 42."""
    found = np.empty(len(start), np.int32)
    for at in range(0, len(start), _HASHED_AT_ONCE):
        long, first = size[at : at + _HASHED_AT_ONCE], start[at : at + _HASHED_AT_ONCE]
        order = np.argsort(long, kind="stable")[::-1]
        long, first = long[order], first[order]
        low = int(first.min())
        near = np.append(data[low : int((first + long).max())], np.zeros(4, np.uint8))
        fours = np.ndarray(len(near) - 3, "<u4", near, 0, (1,)).astype(np.uint32)
        first, whole = first - low, long >> 2
        h = np.full(len(long), 42, np.uint32)
        # Longest first: those with a next four bytes are at the head.
        for step, n in enumerate(np.searchsorted(-whole, -np.arange(1, int(whole[0]) + 1), "right").tolist()):
            h[:n] = _rotated(h[:n] ^ _mixed(fours[first[:n] + 4 * step]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        rest = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF], np.uint32)[long & 3]
        h ^= _mixed(fours[first + 4 * whole] & rest)
        h ^= long.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        found[at + order] = h.view(np.int32) % np.int32(buckets)
    return found


# ---- blocks ---------------------------------------------------------------

def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size, dtype=np.int64) - size


class _Spelled:
    """Numbers as buckets: a bucket is itself, from ``buckets`` on a row of ``inner``."""

    def __init__(self, inner: Runs, buckets: int):
        own = np.arange(buckets, dtype=np.int32)
        self.start = np.append(own, buckets + _starts(inner.size))
        self.count = np.append(np.ones_like(own), inner.size.astype(np.int32))
        self.bucket = np.append(own, inner.number)

    def __call__(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many buckets each number has, and all buckets."""
        count = self.count[number]
        return count, self.bucket[_runs(self.start[number], count)]


def _squared_lengths(texts: Runs, spelled: _Spelled, buckets: int) -> np.ndarray:
    """Sum of squared counts of the buckets of each text."""
    upto = np.append(0, np.cumsum(texts.size))
    many = spelled.count[texts.number]
    total, long = np.zeros(len(texts.size)), np.diff(np.append(0, np.cumsum(many, dtype=np.int64))[upto])
    for low, high in _spans(long, _SORTED_AT_ONCE):
        here = slice(upto[low], upto[high])
        if long[low] > _SORTED_AT_ONCE:  # one long text
            counts = np.zeros(buckets)
            for at, end in _spans(many[here], _SORTED_AT_ONCE):
                counts += np.bincount(spelled(texts.number[here][at:end])[1], minlength=buckets)
            total[low] = (counts * counts).sum()
            continue
        count, found = spelled(texts.number[here])
        row = np.repeat(np.repeat(np.arange(high - low), texts.size[low:high]), count)
        kind = np.uint32 if (high - low) * buckets < 2**32 else np.int64
        keys = np.sort(row.astype(kind) * kind(buckets) + found.astype(kind))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        count = np.diff(np.append(first, len(keys))).astype(float)
        total[low:high] = np.bincount((keys[first] // kind(buckets)).astype(np.intp), count * count, high - low)
    return total


def _turned(runs: Runs, length: int) -> Runs:
    """The rows in which each number below ``length`` occurs."""
    rows = len(runs.size)
    keys = runs.number * rows
    keys += np.repeat(np.arange(rows, dtype=np.int32), runs.size)
    keys.sort()
    size = np.diff(np.searchsorted(keys, np.arange(length + 1) * rows))
    keys %= max(1, rows)
    return Runs(size.astype(np.int32), keys.astype(np.uint16 if rows <= 2**16 else np.int32))


def _longest(words: pa.Array, buckets: int, low: int, high: int) -> tuple[Runs, Runs]:
    """Words as runs of the longest n-gram from each place on, and the buckets of these."""
    chars = _Characters(pc.binary_join_element_wise("<", words, ">", ""))
    begin, end = chars.begins[chars.upto[:-1] + 1], chars.begins[chars.upto[1:] - 1]
    # Of ``high`` characters, and at the end of a word all shorter ones.
    firsts = [(high, _runs(chars.upto[:-1], chars.counts(high)))] if high >= low else []
    ends = [(n, np.flatnonzero(chars.lengths >= n)) for n in range(high - 1, low - 1, -1)]
    firsts += [(n, chars.upto[1:][has] - n) for n, has in ends]
    cut = [chars.cut(first, n) for n, first in firsts]
    numbered = pa.concat_arrays([pa.array([], pa.string()), *cut]).dictionary_encode()
    ids = numbered.indices.to_numpy().astype(np.int64) + buckets

    full = chars.counts(high) if high >= low else np.zeros(len(chars.lengths), np.int64)
    size = 1 + full + sum((chars.lengths >= n).astype(np.int64) for n, _ in ends)
    place, at = _starts(size), 0
    number = np.empty(int(size.sum()), np.int32)
    number[place] = _hashed(chars.data, begin, end - begin, buckets)
    if firsts:
        at = len(firsts[0][1])
        number[_runs(place + 1, full)] = ids[:at]
        place = place + 1 + full
    for _, has in ends:
        number[place[has]] = ids[at : at + len(has)]
        place[has] += 1
        at += len(has)

    grams = _Characters(numbered.dictionary)
    size_of = grams.lengths - low + 1
    place, found = _starts(size_of), np.empty(int(size_of.sum()), np.int32)
    for n in range(low, high + 1):
        has = np.flatnonzero(grams.lengths >= n)
        begin = grams.begins[grams.upto[has]]
        found[place[has] + n - low] = _hashed(grams.data, begin, grams.begins[grams.upto[has] + n] - begin, buckets)
    return Runs(size.astype(np.int32), number), Runs(size_of.astype(np.int32), found)


def _block(label: np.ndarray, texts: pa.Array, buckets: int, low: int, high: int) -> Block:
    split, row = _split_words(texts)
    numbered = split.dictionary_encode()
    words, grams = _longest(numbered.dictionary, buckets, low, high)

    # Words one after another with a blank between: neighbours are runs of these bytes.
    line = pc.binary_join_element_wise(split, "", " ")
    offsets = np.frombuffer(line.buffers()[1], np.int32)[line.offset : line.offset + len(line) + 1].astype(np.int64)
    data = np.frombuffer(line.buffers()[2] or b"", np.uint8)
    sizes = np.bincount(row, minlength=len(texts))
    kinds = [sizes, np.maximum(sizes - 1, 0), np.maximum(sizes - 2, 0)]
    size = sum(kinds)
    number, place = np.empty(int(size.sum()), np.int64), _starts(size)
    number[_runs(place, sizes)] = numbered.indices.to_numpy().astype(np.int64) + buckets
    for n in (2, 3):
        place = place + kinds[n - 2]
        first = np.flatnonzero(row[n - 1 :] == row[: max(0, len(row) - n + 1)])
        begin = offsets[first]
        number[_runs(place, kinds[n - 1])] = _hashed(data, begin, offsets[first + n] - 1 - begin, buckets)
    runs = Runs(size, number)
    count, found = _Spelled(grams, buckets)(words.number)
    ends = np.append(0, np.cumsum(count, dtype=np.int64))[np.append(0, np.cumsum(words.size, dtype=np.int64))]
    squares = _squared_lengths(runs, _Spelled(Runs(np.diff(ends), found), buckets), buckets)
    scale = np.divide(1.0, np.sqrt(squares), out=np.zeros(len(squares)), where=squares > 0)
    return Block(label, scale, _turned(runs, buckets + len(words.size)), words, grams)


def _blocks(rows: Iterable[tuple[float, str]], buckets: int, low: int, high: int) -> Iterator[Block]:
    labels, texts, held = [], [], 0

    def made() -> Block:
        return _block(np.array(labels, np.int64), pa.array(texts, pa.string()), buckets, low, high)

    for label, text in rows:
        if text is None:
            raise ValueError("an example has no text")
        size = len(text.encode())
        if texts and held + size > _BLOCK_BYTES:
            yield made()
            labels, texts, held = [], [], 0
        labels.append(int(label))
        texts.append(text)
        held += size
    if texts:
        yield made()


# Blocks are kept in pieces, as a JVM's heap is no good at arrays of many megabytes.
_PIECE_BYTES = 400_000


def _pieces(blocks: Iterable[Block]) -> Iterator[tuple[bool, bytes]]:
    """The bytes of blocks, and whether a block ends there."""
    for block in blocks:
        whole = pickle.dumps(block, pickle.HIGHEST_PROTOCOL)
        for at in range(0, len(whole), _PIECE_BYTES):
            yield at + _PIECE_BYTES >= len(whole), whole[at : at + _PIECE_BYTES]
        pa.default_memory_pool().release_unused()


def _joined(pieces: Iterable[tuple[bool, bytes]]) -> Iterator[Block]:
    held = []
    for ends, piece in pieces:
        held.append(piece)
        if ends:
            whole, held = b"".join(held), []
            yield pickle.loads(whole)


def subword_blocks(examples: DataFrame, label: str, text: str, buckets: int, low: int = 3, high: int = 6) -> RDD:
    """The examples of each partition as blocks in pieces, with the features of ``with_subwords``."""
    rows = examples.select(F.col(label), F.make_valid_utf8(text)).rdd
    return rows.mapPartitions(lambda part: _pieces(_blocks(part, buckets, low, high)))


# ---- passes ---------------------------------------------------------------

def _gathered(tables: np.ndarray, runs: Runs) -> np.ndarray:
    """Per table the sum over each row of numbers."""
    # Two tables are looked up at once, as the parts of complex numbers.
    odd = np.zeros((len(tables) % 2, tables.shape[1]))
    both = np.concatenate([tables, odd])
    paired = both[0::2] + 1j * both[1::2]
    found, upto = np.zeros((len(paired), len(runs.size)), complex), np.append(0, np.cumsum(runs.size, dtype=np.int64))
    for at, end in _spans(runs.size, _AT_ONCE):
        here = runs.number[upto[at] : upto[end]].astype(np.intp)
        full = at + np.flatnonzero(runs.size[at:end])
        for table, out in zip(paired, found):
            if len(full):
                out[full] = np.add.reduceat(table[here], upto[full] - upto[at])
    return np.stack([found.real, found.imag], 1).reshape(-1, len(runs.size))[: len(tables)]


def _scattered(values: np.ndarray, runs: Runs, length: int) -> np.ndarray:
    """Per row of values the sum by number, each row of numbers with its value."""
    found, upto = np.zeros((len(values), length)), np.append(0, np.cumsum(runs.size, dtype=np.int64))
    # As many at once as there are sums: adding these up is then the lesser part.
    for at, end in _spans(runs.size, max(length, _AT_ONCE)):
        here = runs.number[upto[at] : upto[end]].astype(np.intp)
        for value, out in zip(values, found):
            out += np.bincount(here, np.repeat(value[at:end], runs.size[at:end]), length)
    return found


def _margins(block: Block, weights: np.ndarray) -> np.ndarray:
    grams = np.concatenate([weights, _gathered(weights, block.grams)], 1)
    words = np.concatenate([weights, _gathered(grams, block.words)], 1)
    return _scattered(words, block.texts, len(block.scale)) * block.scale


def _slopes(block: Block, residuals: np.ndarray, buckets: int) -> np.ndarray:
    words = _gathered(residuals * block.scale, block.texts)
    grams = _scattered(words[:, buckets:], block.words, buckets + len(block.grams.size))
    return words[:, :buckets] + grams[:, :buckets] + _scattered(grams[:, buckets:], block.grams, buckets)


def _label_sums(blocks: Iterable[Block], labels: int, buckets: int) -> np.ndarray:
    """Per label the sum of its vectors, and its number of texts in the last place."""
    total = np.zeros((labels, buckets + 1))
    for block in blocks:
        own = (block.label == np.arange(labels)[:, None]).astype(float)
        total[:, :-1] += _slopes(block, own, buckets)
        total[:, -1] += own.sum(1)
    return total


def _loss_and_slopes(blocks: Iterable[Block], weights: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Per label but the last the slope by bucket and by offset, as one array with the loss in
    the last place.  Weights and slopes of all labels add up to 0, so the last one follows."""
    total, loss = np.zeros((len(weights), weights.shape[1] + 1)), 0.0
    for block in blocks:
        margin = _margins(block, weights) + offset[:, None]
        margin = np.concatenate([margin, -margin.sum(0, keepdims=True)])
        margin -= margin.max(0)
        odds = np.exp(margin)
        mass, each = odds.sum(0), np.arange(len(block.label))
        loss += float((np.log(mass) - margin[block.label, each]).sum())
        residual = odds / mass
        residual[block.label, each] -= 1.0
        total[:, :-1] += _slopes(block, residual[:-1], weights.shape[1])
        total[:, -1] += residual[:-1].sum(1)
    return np.append(total.ravel(), loss)


# Sums of tasks that one task or the driver adds up at a time.
_FAN_IN = 32


def _added(parts: RDD) -> np.ndarray:
    """The sum of one array per partition, in the order of partitions whatever ends first."""
    numbered = parts.mapPartitionsWithIndex(lambda i, part: [(i, sum(part))])
    n = parts.getNumPartitions()
    while n > _FAN_IN:
        n = -(-n // _FAN_IN)
        numbered = numbered.map(lambda x: (x[0] // _FAN_IN, x)).groupByKey(n).mapValues(
            lambda found: sum(array for _, array in sorted(found, key=lambda x: x[0]))
        )
    return sum(array for _, array in sorted(numbered.collect(), key=lambda x: x[0]))


# ---- fit ------------------------------------------------------------------

# Steps that tell the curvature of the loss.
_MEMORY = 20


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """On one core: the others belong to tasks, and threads that wait for more work hold them."""
    return float(np.einsum("i,i", a, b))


def _direction(slope: np.ndarray, steps: deque) -> np.ndarray:
    """Downhill by the curvature of the last steps (L-BFGS)."""
    found, shares = -slope, []
    for s, y, sy in reversed(steps):
        shares.append(_dot(s, found) / sy)
        found -= shares[-1] * y
    if steps:
        _, y, sy = steps[-1]
        found *= sy / np.einsum("i,i", y, y, dtype=float)
    for (s, y, sy), share in zip(steps, reversed(shares)):
        found += (share - _dot(y, found) / sy) * s
    return found


def minimum(
    cost: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, near: float, max_iter: int
) -> np.ndarray:
    """Where the slope of a smooth convex function is no longer than ``near``, in at most
    ``max_iter`` steps, or where rounding leaves no way down.  Steps meet the Wolfe conditions."""
    value, slope = cost(x)
    steps: deque = deque(maxlen=_MEMORY)
    for _ in range(max_iter):
        if _dot(slope, slope) <= near * near:
            break
        way = _direction(slope, steps)
        fall = _dot(way, slope)
        low, high, t = 0.0, np.inf, 1.0
        for _ in range(30):
            there, steepness = cost(x + t * way)
            if not there <= value + 1e-4 * t * fall:
                high = t
            elif _dot(way, steepness) < 0.9 * fall:
                low = t
            else:
                break
            t = (low + high) / 2 if high < np.inf else 2 * t
        if not there < value:
            break
        s, y = t * way, steepness - slope
        sy = _dot(s, y)
        if sy > 0:
            # These only point the way; half their size is exact enough.
            steps.append((s.astype(np.float32), y.astype(np.float32), sy))
        x, value, slope = x + s, there, steepness
    return x


# How far any margin of a fitted model may be from that at the minimum.
MARGIN = 0.1


def fit_blocks(
    blocks: RDD, labels: int, buckets: int, reg: float, max_iter: int
) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercepts at the minimum of mean loss and ``reg`` / 2 times the
    squared coefficients.

    The loss curves by ``reg`` or more in each direction and a text has unit length, so with a
    slope of ``MARGIN`` * ``reg`` no margin is off by more than ``MARGIN``.  The intercept is
    taken at the mean vector, where it depends least on the coefficients.
    """
    context = blocks.context
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums = _added(blocks.mapPartitions(lambda part: [_label_sums(_joined(part), labels, buckets)]))
        texts = sums[:, -1]
        n, mean = texts.sum(), sums[:, :-1].sum(0) / max(1.0, texts.sum())
        if not n:
            raise ValueError("no example to learn from")

        def at_mean(x: np.ndarray) -> np.ndarray:
            return np.einsum("ij,j->i", x[:, :-1], mean)

        def cost(flat: np.ndarray) -> tuple[float, np.ndarray]:
            x = flat.reshape(labels, buckets + 1)
            sent = context.broadcast((x[:-1, :-1], x[:-1, -1] - at_mean(x)[:-1]))
            try:
                found = _added(blocks.mapPartitions(lambda part: [_loss_and_slopes(_joined(part), *sent.value)]))
            finally:
                sent.destroy()
            slope = found[:-1].reshape(labels - 1, buckets + 1) / n
            slope[:, :-1] -= slope[:, -1:] * mean
            slope = np.concatenate([slope, -slope.sum(0, keepdims=True)])
            slope[:, :-1] += reg * x[:, :-1]
            return found[-1] / n + reg / 2 * (x[:, :-1] ** 2).sum(), slope.ravel()

        start = np.zeros((labels, buckets + 1))
        start[:, -1] = np.log1p(texts) - np.log1p(texts).mean()
        x = minimum(cost, start.ravel(), MARGIN * reg, max_iter).reshape(start.shape)
    finally:
        blocks.unpersist()
    return x[:, :-1], x[:, -1] - at_mean(x)
