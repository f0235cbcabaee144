"""Exact top-k search of binary codes by incremental multi-index hashing (operator 4).

Codes are cut into segments, and one index per segment maps its value to the codes that
have it.  The search looks up every value of a query's segments within a radius that
grows by one in each round and verifies the whole Hamming distance of what it finds.  A
code not found after radius r differs by more than r bits in every segment, so once the
k-th verified distance is within ``segments * (r + 1) - 1`` the answer is proven; only
queries without proof go on.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dwell.sources.storage import fresh_folder

BITS = 64
# Longest segment: its masks are literals of the plan, and there are at most 2 ** 16.
MAX_SEGMENT = 16


def sign_code(vector: str, bits: int = BITS) -> Column:
    """The signs of a vector as a code in one long: bit i is set where component i is
    positive.  Missing components are not; a null vector has no code.  A vector with more
    than ``bits`` components, 64 at most, is refused: none is cut."""
    if not 0 < bits <= BITS:
        raise ValueError(f"a code has 1 to {BITS} bits")
    terms = [
        F.when(F.get(F.col(f"`{vector}`"), F.lit(i)) > 0, F.lit(_signed(1 << i)).cast("long")).otherwise(F.lit(0).cast("long"))
        for i in range(bits)
    ]
    # A balanced tree keeps the expression shallow.
    while len(terms) > 1:
        terms = [a.bitwiseOR(b) for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2:]
    long = F.raise_error(F.lit(f"a vector has more than {bits} components")).cast("long")
    return F.when(F.size(f"`{vector}`") > bits, long).when(F.col(f"`{vector}`").isNotNull(), terms[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def segments(bits: int, codes: int) -> list[tuple[int, int]]:
    """Start and length of the segments: about as long as the number of codes is in bits."""
    size = min(MAX_SEGMENT, max(4, int(math.log2(max(2, codes)))))
    count = math.ceil(bits / size)
    cuts = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _value(code: Column, start: int, size: int) -> Column:
    return F.shiftrightunsigned(code, start).bitwiseAND(F.lit((1 << size) - 1))


def _masks(size: int, radius: int) -> Column:
    """All values with so many bits set, as a literal array."""
    found = [sum(1 << b for b in bits) for bits in combinations(range(size), radius)]
    return F.split(F.lit(",".join(map(str, found))), ",").cast("array<long>")


def _lookup(segment: int, start: int, size: int, radius: int) -> Column:
    """The entries of one segment's index at this distance from a query."""
    own = _value(F.col("query"), start, size)
    return F.transform(
        _masks(size, radius), lambda m: F.struct(F.lit(segment).alias("segment"), own.bitwiseXOR(m).alias("value"))
    )


def top_k(queries: DataFrame, base: DataFrame, k: int, bits: int = BITS) -> DataFrame:
    """The k nearest rows of ``base`` to every query: query_id, rank, vec_id, distance.

    Both sides have ``vec_id`` and a long ``code``; rows with neither null take part.
    Ties go to the smaller id, and repeated rows of ``base`` are separate results.  Fewer
    than k rows in ``base`` are all returned.

    Rows with the same code are one entry, so a code that very many rows share costs no
    more than any other; only its k smallest ids can be results.  Every round is written
    to the shared folder.
    """
    spark = base.sparkSession
    folder = fresh_folder(spark, "hamming")

    def stored(frame: DataFrame, name: str, schema: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    rows = base.select("vec_id", "code").dropna()
    first = Window.partitionBy("code").orderBy("vec_id")
    members = stored(
        rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("code", F.col("vec_id").cast("long").alias("vec_id"), "n"),
        "members", "code long, vec_id long, n int",
    )
    codes = members.groupBy("code").agg(F.min("vec_id").alias("least"), F.max("n").alias("n"))
    count = members.where("n = 1").count()
    cut = segments(bits, count)
    index = stored(
        codes.select("*", F.explode(F.array(*[
            F.struct(F.lit(i).alias("segment"), _value(F.col("code"), a, size).alias("value")) for i, (a, size) in enumerate(cut)
        ])).alias("s")).select("s.segment", "s.value", "code", "least", "n"),
        "index", "segment int, value long, code long, least long, n int",
    )
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).dropna()
    none = F.lit(bits + 1)
    active = stored(asked.select("query").distinct().withColumn("bound", none), "active-0", "query long, bound int")
    best = None
    done = []
    state_schema = "query long, code long, distance int, least long, n int"
    for radius in range(max(size for _, size in cut) + 1):
        lookups = [_lookup(i, a, size, radius) for i, (a, size) in enumerate(cut) if radius <= size]
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int")
        hits = None
        for lookup in lookups:
            some = active.select("query", "bound", F.explode(lookup).alias("s")).select("query", "bound", "s.segment", "s.value")
            hits = some if hits is None else hits.unionByName(some)
        found = (
            # Spark underrates the exploded lookups and would send them everywhere.
            hits.hint("merge").join(index, ["segment", "value"])
            .withColumn("distance", distance).where(F.col("distance") <= F.col("bound"))
            .select("query", "code", "distance", "least", "n").distinct()
        )
        if best is not None:
            found = found.unionByName(best.join(active, "query", "left_semi")).distinct()
        ranked = Window.partitionBy("query").orderBy("distance", "least")
        best = stored(
            found.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k).drop("r"), f"best-{radius}", state_schema
        )
        # The distance at which the codes found so far hold k rows.
        upto = Window.partitionBy("query").orderBy("distance", "least").rowsBetween(Window.unboundedPreceding, 0)
        reach = (
            best.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") >= k)
            .groupBy("query").agg(F.min("distance").alias("bound"))
        )
        proven = len(cut) * (radius + 1) - 1
        bounds = active.drop("bound").join(reach, "query", "left").select("query", F.coalesce("bound", none).alias("bound"))
        bounds = stored(bounds, f"bounds-{radius}", "query long, bound int")
        finished = bounds.where(F.col("bound") <= proven)
        done.append(best.join(finished, "query", "left_semi"))
        active = bounds.where(F.col("bound") > proven)
        if active.isEmpty():
            break
    else:
        done.append(best.join(active, "query", "left_semi"))  # everything has been looked at
    nearest = done[0]
    for more in done[1:]:
        nearest = nearest.unionByName(more)
    final = Window.partitionBy("query").orderBy("distance", "vec_id")
    # Of one code only the k smallest ids are stored, so a query meets at most k * k rows.
    ranked = (
        nearest.select("query", "code", "distance").join(members.select("code", "vec_id"), "code")
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    )
    return asked.join(ranked, "query").select("query_id", "rank", "vec_id", "distance")


def search_every(vectors: DataFrame, step: int = 50, k: int = 10, bits: int = BITS) -> DataFrame:
    """Search for the rows whose id is divisible by ``step`` among all rows of a table of
    vectors (vec_id, embedding), by the signs of their components."""
    coded = vectors.select("vec_id", sign_code("embedding", bits).alias("code"))
    return top_k(coded.where(F.col("vec_id") % step == 0), coded, k, bits)
