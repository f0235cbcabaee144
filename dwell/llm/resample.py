"""Importance resampling towards a target distribution.

Hashed word n-grams are counted over all documents and over the texts of the target; the
log ratio of the two, per bucket, is the gain of a feature.  A document's weight is the
mean gain of its features, noise from its id makes it a score, and the highest scores are
drawn without replacement.

* Buckets.  A task works on the bytes of its Arrow batches: words are runs of bytes, the
  checksum of a pair of words follows from those of the two words, and bucket counts are
  one array per task.
* Cutoff.  Scores are stored once.  Exact count jobs over the stored numbers narrow the
  cutoff down, score first, then id, then what is left of equal ids, so nothing is sorted
  or collected however many rows share a score.
* Ranks.  Only drawn rows are sorted, in ranges of equal numbers of rows.

Results in odd cases: a null text has no features and weight 0; a null id counts as an
empty one for the noise and comes after all others; rows with equal ids are documents of
their own, each drawn or not, in the order of their numbers of features; without rows,
target or features every gain and weight is defined and nothing fails.  Extra columns are
not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from dwell.functions.units import int_div
from dwell.sources.storage import fresh_folder

BUCKETS = 10_000
SEED = 7
PERCENT = 25
MIN_WORDS = 20

# Bytes of text worked on at a time; only a longer word makes a piece longer.
PIECE_BYTES = 4_000_000
# Words beyond this many bytes get their checksum one by one.
SHORT_WORD = 32
# Thresholds counted in one job.
WAYS = 64
# Drawn rows in one range, about.
RANGE_ROWS = 1_000_000

_KEEP = np.zeros(256, bool)
_KEEP[0x30:0x3A] = _KEEP[0x41:0x5B] = _KEEP[0x61:0x7B] = _KEEP[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# ---- checksums of words and pairs of words ------------------------------------------

@lru_cache(maxsize=1)
def _step() -> np.ndarray:
    """The register after one more byte, by its lowest byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[length][byte place][byte]: a register moved on by so many zero bytes."""
    out = np.empty((SHORT_WORD + 2, 4, 256), np.uint32)
    for place in range(4):
        out[0, place] = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
    for n in range(1, SHORT_WORD + 2):
        before = out[n - 1]
        out[n] = _step()[before & 255] ^ (before >> np.uint32(8))
    return out


def _moved(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    flat = _shifts().reshape(-1)
    base = lengths.astype(np.int64) * 1024
    found = flat[base + (sums & 255)]
    for place in (1, 2, 3):
        found ^= flat[base + 256 * place + ((sums >> np.uint32(8 * place)) & 255)]
    return found


def _word_sums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: int | None = None) -> np.ndarray:
    """crc32 of each word, or of a byte and the word; words are at most SHORT_WORD long."""
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    if first is not None:
        state = _step()[(state ^ np.uint32(first)) & 255] ^ (state >> np.uint32(8))
    order = np.argsort(-lengths, kind="stable")
    at, state = starts[order], state[order]
    longer = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    for i, n in enumerate(longer):  # the first n words have more than i bytes
        live = state[:n]
        state[:n] = _step()[(live ^ data[at[:n] + i]) & 255] ^ (live >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


@dataclass
class Features:
    """Buckets of the features of a run of bytes, with the document of each."""

    buckets: np.ndarray
    docs: np.ndarray
    words: np.ndarray  # document of each word


def features(data: np.ndarray, doc_starts: np.ndarray, before: bytes | None = None) -> tuple[Features, bytes | None]:
    """Words and pairs of words of texts laid end to end.

    ``before`` is the last word of the piece before, which belongs to the same text; the
    last word is handed back for the next piece.
    """
    data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _KEEP[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cut = doc_starts[doc_starts < len(data)]
    begins[cut] = inside[cut]  # a text never goes on with a word of the one before it
    starts = np.flatnonzero(begins)
    ends_at = np.flatnonzero(inside[:-1] & (~inside[1:] | np.append(begins[1:], False))) + 1
    lengths = ends_at - starts
    docs = np.searchsorted(doc_starts, starts, side="right") - 1

    short = lengths <= SHORT_WORD
    alone, spaced = (np.empty(len(starts), np.uint32) for _ in range(2))
    alone[short] = _word_sums(data, starts[short], lengths[short])
    spaced[short] = _word_sums(data, starts[short], lengths[short], 0x20)
    raw = data.tobytes() if not short.all() else b""
    for i in np.flatnonzero(~short):
        alone[i] = zlib.crc32(raw[starts[i]:ends_at[i]])

    same = docs[1:] == docs[:-1]
    first, second = np.flatnonzero(same), np.flatnonzero(same) + 1
    quick = short[second]
    pairs = np.empty(len(first), np.uint32)
    pairs[quick] = _moved(alone[first[quick]], lengths[second[quick]] + 1) ^ spaced[second[quick]]
    for i in np.flatnonzero(~quick):
        pairs[i] = zlib.crc32(b" " + raw[starts[second[i]]:ends_at[second[i]]], int(alone[first[i]]))
    sums, owners = [alone, pairs], [docs, docs[first]]
    if before is not None and len(starts) and docs[0] == 0:
        joined = zlib.crc32(b" " + data[starts[0]:ends_at[0]].tobytes(), zlib.crc32(before))
        sums.append(np.array([joined], np.uint32))
        owners.append(docs[:1])
    last = data[starts[-1]:ends_at[-1]].tobytes() if len(starts) else before
    return Features((np.concatenate(sums) % np.uint32(BUCKETS)).astype(np.int64), np.concatenate(owners), docs), last


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, Features]]:
    """(first row, rows, features) over a column of texts; a long text comes in pieces."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if len(texts) == 0:
        return
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1)
        begin, end = int(offsets[row]), int(offsets[to])
        if to > row + 1 or end - begin <= PIECE_BYTES:
            yield row, to - row, features(data[begin:end], offsets[row:to] - begin)[0]
        else:
            before = None
            while begin < end:
                stop = min(end, begin + PIECE_BYTES)
                while stop < end and _KEEP[data[stop]]:  # not inside a word
                    more = np.flatnonzero(~_KEEP[data[stop:stop + 65_536]])
                    stop = min(end, stop + (int(more[0]) if len(more) else 65_536))
                found, before = features(data[begin:stop], np.zeros(1, np.int64), before)
                yield row, 1, found
                begin = stop
        row = to


# ---- counts, gains, scores -----------------------------------------------------------

def _texts(df: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text")


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all rows fall in each bucket; BUCKETS numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, found in _pieces(batch.column(0)):
                total += np.bincount(found.buckets, minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    sums = df.select(_texts(df, text)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for row in sums.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: Sequence[int], target: Sequence[int]) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and source."""
    s_all, t_all = float(sum(map(int, source)) + BUCKETS), float(sum(map(int, target)) + BUCKETS)
    ratios = (((t + 1.0) * s_all) / ((s + 1.0) * t_all) for s, t in zip(map(int, source), map(int, target)))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weigh(df: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight) for every row; rows stay in place."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for row, rows, found in _pieces(batch.column(1)):
                part = slice(row, row + rows)
                n_words[part] += np.bincount(found.words, minlength=rows)
                n_features[part] += np.bincount(found.docs, minlength=rows)
                # Sums of whole numbers far below 2**53: exact in doubles.
                total[part] += np.bincount(found.docs, gains[found.buckets], minlength=rows).astype(np.int64)
            weight = np.where(n_features > 0, total // np.maximum(n_features, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (n_words, n_features, weight))],
                names=[key, "n_words", "n_features", "weight"],
            )

    schema = f"`{key}` {kind}, n_words long, n_features long, weight long"
    return df.select(F.col(f"`{key}`"), _texts(df, text)).mapInArrow(run, schema)


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, fixed by seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


# ---- cutoff and ranks ----------------------------------------------------------------

def find_cutoff(rows: DataFrame, keys: Sequence[str], wanted: int) -> list[tuple[str, int]]:
    """The last of the ``wanted`` (one at least) first rows, in ascending order of integer columns.

    No sort: each job counts the rows in WAYS parts of the interval that holds the cutoff,
    exactly, until it has shrunk to one number.  Then the rows that share the number are
    told apart by the next column.  The last column should be unique; columns that decide
    nothing are left out.
    """
    found: list[tuple[str, int]] = []
    for key in keys:
        ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()[0]
        low, high = ends["lo"], ends["hi"]
        inside, equal = rows, None
        while low < high or equal is None:
            step = -(-(high - low + 1) // WAYS)
            # Wider than a long: ids from both ends of its range.
            number = F.col(key).cast("decimal(20,0)") if high - low >= 1 << 62 else F.col(key)
            part = int_div(number - F.lit(low).cast("decimal(20,0)"), step) if high - low >= 1 << 62 else int_div(number - low, step)
            counts = {r["p"]: r["n"] for r in inside.groupBy(part.cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
            for p in sorted(counts):  # WAYS of them at most
                equal = counts[p]
                if equal >= wanted:
                    break
                wanted -= equal
            low, high = low + p * step, min(high, low + (p + 1) * step - 1)
            inside = inside.where(F.col(key).between(low, high))
        found.append((key, low))
        if equal == wanted:
            break
        rows = inside
    return found


def _first(cutoff: Sequence[tuple[str, int]]) -> Column:
    """Rows up to and with the cutoff."""
    key, value = cutoff[-1]
    chosen = F.col(key) <= value
    for key, value in reversed(cutoff[:-1]):
        chosen = (F.col(key) < value) | ((F.col(key) == value) & chosen)
    return chosen


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        extra = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "_part", "_at"])
        at += n


def rank_rows(rows: DataFrame, keys: Sequence[str], count: int, folder: str) -> DataFrame:
    """Rows with ``rank`` from 1 in the order of the keys, which are unique together.

    One range shuffle; each range is sorted and numbered for itself and written, and the
    numbers of rows of the ranges before it are added when it is read.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_ROWS))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    numbered.mapInArrow(_number, f"{kinds}, _part int, _at long").write.parquet(folder)
    stored = spark.read.schema(f"{kinds}, _part int, _at long").parquet(folder)
    sizes = {r["_part"]: r["n"] for r in stored.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, so_far = [], 0
    for part in range(max(sizes, default=0) + 1):
        offsets.append(so_far)
        so_far += sizes.get(part, 0)
    # One number per range.
    before = spark.range(len(offsets)).select(
        F.col("id").cast("int").alias("_part"),
        F.element_at(F.lit(np.array(offsets, np.int64)), (F.col("id") + 1).cast("int")).alias("_before"),
    )
    return stored.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Every document with its weight, score and, if drawn, its rank.

    Of the documents with at least ``min_words`` words, ``percent`` per cent (rounded
    down) are drawn: those with the highest scores, ties to the smaller integer key.
    Returns (key, n_features, weight, score, rank); undrawn documents have no rank.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "resample")
    gains = bucket_gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    score = F.col("weight") + noise(F.col(f"`{key}`"), seed)
    scored = weigh(docs, gains, key, text).select(
        F.col(f"`{key}`").cast("long").alias("key"), "n_words", "n_features", "weight", score.alias("score"),
        F.monotonically_increasing_id().alias("row"),
    )
    scored.write.parquet(f"{folder}/scores")
    stored = spark.read.schema(scored.schema).parquet(f"{folder}/scores").select(
        "*", (F.col("n_words") >= min_words).alias("eligible"), (-F.col("score")).alias("down"),
        F.col("key").isNull().cast("int").alias("last"), F.coalesce("key", F.lit(0)).alias("id"),
    )
    names = [F.col("key").cast(docs.schema[key].dataType).alias(key), "n_features", "weight", "score"]
    wanted = percent * stored.where("eligible").count() // 100
    keys = ["down", "last", "id", "n_features", "row"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if wanted <= 0:
        return stored.select(*names, no_rank)
    drawn = F.col("eligible") & _first(find_cutoff(stored.where("eligible"), keys, wanted))
    ranked = rank_rows(stored.where(drawn), keys, wanted, f"{folder}/drawn")
    return ranked.select(*names, "rank").unionByName(stored.where(~drawn).select(*names, no_rank))
