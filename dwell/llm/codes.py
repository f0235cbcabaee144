"""Product codes of vectors: a codebook per part of the vector, fitted by rounds of means.

A vector is cut into equal parts; a part's code is the nearest entry of its codebook.
Assigning goes by norm-of-sum bounds: for each part of each vector a task keeps the
distance to its entry and to the nearest other one, both with the round in which they
were measured.  The codebooks of all rounds are kept, so what the bounds have lost since
is the true net displacement of the entries between the two rounds, and not the sum of
their steps.  Only where the bounds cannot tell, the distance to the own entry is
measured again, and only where that is not enough, all entries are.

All numbers are integers; distances that decide are exact.  Vectors and bounds are written
to the shared folder once a round, so a lost executor costs its tasks and no round.

Results in odd cases: rows whose vector is null or has a null or non-finite component are
left out; so are vectors of another length than most (ties: the shorter); a length that
the parts do not divide is filled up with zeros.  Scaled components beyond 2**27 count as
that.  Null ids come after all others.  Equal ids are rows of their own; among them the
smaller vector comes first where the codebooks start.  With fewer rows than entries the
codebooks are smaller.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dwell.sources.storage import fresh_folder

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 27
# Vectors compared with all entries at a time.
BLOCK = 8192
# Products of components up to this size add up exactly in doubles.
EXACT = 1 << 22
# A bound must tell by more than doubles can be off by.
MARGIN = 1e-5
# Labels with more rows than this are broadcast; at most rows / HOT_ROWS can be.
HOT_ROWS = 200_000
SMALL_LABELS = 100_000

_STATE = "code binary, own array<double>, other array<double>, own_round binary, other_round binary"


# ---- distances -----------------------------------------------------------------------

def _all_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, points by entries."""
    if max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)) <= EXACT // points.shape[1]:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return (p * p).sum(1)[:, None] - 2.0 * (p @ e.T) + (e * e).sum(1)[None, :]
    out = np.zeros((len(points), len(entries)), np.int64)
    for d in range(points.shape[1]):
        out += (points[:, d, None] - entries[None, :, d]) ** 2
    return out


def _own_distance(points: np.ndarray, entries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return ((points - entries[codes]) ** 2).sum(1)


class Displacements:
    """How far the entries of one part have moved between two rounds."""

    def __init__(self, history: Sequence[np.ndarray]):
        now = history[-1].astype(np.float64)
        moved = [np.sqrt(((now - then) ** 2).sum(1)) for then in history]
        self.each = np.array(moved)  # [round][entry]
        order = np.argsort(-self.each, axis=1)
        rows = np.arange(len(moved))
        self.farthest = order[:, 0]
        self.most = self.each[rows, order[:, 0]]
        # The most any entry but the farthest has moved.
        self.next = self.each[rows, order[:, 1]] if len(now) > 1 else np.zeros(len(moved))

    def others(self, rounds: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.where(self.farthest[rounds] == codes, self.next[rounds], self.most[rounds])


def assign_part(
    points: np.ndarray, history: Sequence[np.ndarray], codes: np.ndarray, own: np.ndarray, other: np.ndarray,
    own_round: np.ndarray, other_round: np.ndarray,
) -> dict[str, int]:
    """Bring codes, bounds and stamps of one part up to the last round, in place.

    Returns how many parts each test settled.
    """
    now, entries = len(history) - 1, history[-1]
    if now == 0:
        open_ = np.arange(len(points))
        told = {"bounds": 0, "own": 0}
    else:
        gone = Displacements(history)
        floor = other - gone.others(other_round, codes) - MARGIN
        open_ = np.flatnonzero(~(own + gone.each[own_round, codes] + MARGIN < floor))
        told = {"bounds": len(points) - len(open_)}
        own[open_] = np.sqrt(_own_distance(points[open_], entries, codes[open_]))
        own_round[open_] = now
        still = open_[~(own[open_] + MARGIN < floor[open_])]
        told["own"] = len(open_) - len(still)
        open_ = still
    for at in range(0, len(open_), BLOCK):
        rows = open_[at:at + BLOCK]
        distances = _all_distances(points[rows], entries)
        best = distances.argmin(1)  # ties: the lower index
        line = np.arange(len(rows))
        codes[rows], own[rows], own_round[rows] = best, np.sqrt(distances[line, best]), now
        if len(entries) > 1:
            distances = distances.astype(np.float64)
            distances[line, best] = np.inf
            other[rows] = np.sqrt(distances.min(1))
        else:
            other[rows] = np.inf
        other_round[rows] = now
    return told | {"scanned": len(open_)}


# ---- Arrow ---------------------------------------------------------------------------

def _matrix(column: pa.Array, kind) -> np.ndarray:
    width = len(column.flatten()) // max(1, len(column))
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _bytes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts).copy()


def _lists(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.reshape(-1)))


def _packed(matrix: np.ndarray) -> pa.Array:
    raw, n = matrix.astype(np.uint8).tobytes(), matrix.shape[1]
    return pa.array([raw[i:i + n] for i in range(0, len(raw), n)], pa.binary())


def _assigned(rows: DataFrame, history: Sequence[np.ndarray], first: bool) -> DataFrame:
    """Rows with codes and bounds for the last codebooks; ``history``: [round][part][entry]."""
    parts = len(history[0])
    by_part = [[books[p] for books in history] for p in range(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            points = _matrix(batch.column(2), np.int64)
            width = points.shape[1] // parts
            if first:
                codes, stamps = np.zeros((n, parts), np.int64), np.zeros((2, n, parts), np.uint8)
                own, other = np.zeros((n, parts)), np.zeros((n, parts))
            else:
                codes = _bytes(batch.column(3), parts).astype(np.int64)
                own, other = (_matrix(batch.column(i), np.float64) for i in (4, 5))
                stamps = np.array([_bytes(batch.column(i), parts) for i in (6, 7)])
            for p in range(parts):
                columns = [np.ascontiguousarray(a[:, p]) for a in (codes, own, other, *stamps)]
                assign_part(np.ascontiguousarray(points[:, p * width:(p + 1) * width]), by_part[p], *columns)
                for whole, column in zip((codes, own, other, *stamps), columns):
                    whole[:, p] = column
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], _packed(codes), _lists(own), _lists(other), *map(_packed, stamps)],
                names=["id", "label", "ints", "code", "own", "other", "own_round", "other_round"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    return rows.mapInArrow(run, f"{kinds}, {_STATE}")


def _part_sums(rows: DataFrame, parts: int, width: int, entries: int) -> DataFrame:
    """(part, entry, n, sums): combined inside each task, then by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            points, codes = _matrix(batch.column(0), np.int64), _bytes(batch.column(1), parts).astype(np.int64)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                sorted_ = codes[order, p]
                begins = np.flatnonzero(np.diff(sorted_, prepend=-1))
                inside = points[order, p * width:(p + 1) * width]
                sums[p, sorted_[begins]] += np.add.reduceat(inside, begins, axis=0)
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
             _lists(sums[part, entry])], names=["part", "entry", "n", "sums"],
        )

    partial = rows.select("ints", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    columns = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)]
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *columns)


# ---- fitting -------------------------------------------------------------------------

def scaled_vectors(df: DataFrame, key: str, vector: str, label: str, parts: int) -> DataFrame:
    """(id, label, ints): whole numbers floor(SCALE * x) of the rows that count."""
    v = F.col(f"`{vector}`")
    number = lambda x: F.lit(float(SCALE)) * x.cast("double")
    # Floors of large numbers would overflow a long, so they are cut down first.
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(number(x), F.lit(-float(LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    kept = df.where(v.isNotNull()).where(finite & (F.size(v) > 0)).select(
        F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), whole.alias("ints")
    )
    common = kept.groupBy(F.size("ints").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not common:
        return kept
    size = common[0]["size"]
    kept = kept.where(F.size("ints") == size)
    if size % parts:
        kept = kept.withColumn("ints", F.concat("ints", F.array_repeat(F.lit(0), parts - size % parts)))
    return kept


def _first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    start = rows.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()  # at most ``entries`` rows
    whole = np.array([r["ints"] for r in start], np.int64)
    return np.split(whole, parts, axis=1)


def _next_books(books: Sequence[np.ndarray], sums: Sequence) -> list[np.ndarray]:
    """Componentwise floors of the means; entries nothing was assigned to stay."""
    new = [b.copy() for b in books]
    width = books[0].shape[1]
    for row in sums:
        new[row["part"]][row["entry"]] = [row[f"s{d}"] // row["n"] for d in range(width)]
    return new


def books_digest(books: Sequence[np.ndarray]) -> str:
    numbers = ",".join(str(int(x)) for part in books for entry in part for x in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def fit_codes(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, list[list[np.ndarray]]]:
    """Rows (id, label, ints, code and bounds) under the final codebooks, and the codebooks
    of every round.  A code is one byte per part, so ``entries`` is 256 at most."""
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    spark, folder = df.sparkSession, fresh_folder(df.sparkSession, "codes")
    plain = scaled_vectors(df, key, vector, label, parts)
    plain.write.parquet(f"{folder}/vectors")
    rows = spark.read.schema(plain.schema).parquet(f"{folder}/vectors")
    if not rows.take(1):
        return _assigned(rows, [[np.zeros((1, 1), np.int64)] * parts], True), []
    history = [_first_books(rows, parts, entries)]
    size, width = len(history[0][0]), history[0][0].shape[1]
    for done in range(rounds + 1):
        made = _assigned(rows, history, done == 0)
        made.write.parquet(f"{folder}/round-{done}")
        rows = spark.read.schema(made.schema).parquet(f"{folder}/round-{done}")
        if done < rounds:
            history.append(_next_books(history[-1], _part_sums(rows, parts, width, size).collect()))
    return rows, history


def _errors(rows: DataFrame, books: Sequence[np.ndarray]) -> DataFrame:
    """(id, label, code as hex, error): exact squared distances to the assigned entries."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            points, codes = _matrix(batch.column(2), np.int64), _bytes(batch.column(3), parts).astype(np.int64)
            width = points.shape[1] // parts
            error = sum(_own_distance(points[:, p * width:(p + 1) * width], books[p], codes[:, p]) for p in range(parts))
            hexes = pa.array([c.hex() for c in batch.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], hexes, pa.array(error)], names=["id", "label", "code", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2])
    return rows.select("id", "label", "ints", "code").mapInArrow(run, f"{kinds}, code string, error long")


def _with_label_sums(rows: DataFrame, hot_rows: int) -> DataFrame:
    """Adds ``label_error``.  Few labels are broadcast; of many, those with more than
    ``hot_rows`` rows are, and the rest meet in a shuffle in which no label is large."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumnRenamed("label", "_label")

    def joined(part: DataFrame, side: DataFrame) -> DataFrame:
        return part.join(side, F.col("label").eqNullSafe(F.col("_label"))).drop("_label", "_n")

    if sums.limit(SMALL_LABELS + 1).count() <= SMALL_LABELS:
        return joined(rows, F.broadcast(sums))
    hot = F.broadcast(sums.where(F.col("_n") > hot_rows))
    large = joined(rows, hot)
    rest = rows.join(hot, F.col("label").eqNullSafe(F.col("_label")), "left_anti")
    return large.unionByName(joined(rest, sums.where(F.col("_n") <= hot_rows).hint("merge")))


def encode_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for every row that counts.

    ``code`` has two hex digits a part; ``error`` is the squared distance to the decoded
    vector; ``label_error`` is its sum over the rows with the same label, nulls together.
    """
    spark: SparkSession = df.sparkSession
    rows, history = fit_codes(df, key, vector, label, parts, entries, rounds)
    books = history[-1] if history else [np.zeros((1, 1), np.int64)] * parts
    scored, folder = _errors(rows, books), fresh_folder(spark, "codes")
    scored.write.parquet(folder)
    stored = spark.read.schema(scored.schema).parquet(folder)
    digest: Column = F.lit(books_digest(books))
    return _with_label_sums(stored, HOT_ROWS).select(
        F.col("id").alias(key), "code", "error", "label_error", digest.alias("codebooks_sha256")
    )
