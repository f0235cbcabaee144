"""Mixing sources to target weights by min-cost flow (operator 8).

Documents may belong to several sources.  They are aggregated by membership pattern, the
set of their sources; a flow then routes the size of every pattern to the quotas of its
sources, where each further repetition of a pattern costs more than the one before.  The
flow sees one node per pattern and source, whatever the number of documents.  Inside a
pattern whole repetitions take every document, and a seeded order says which documents
are taken once more.
"""

from __future__ import annotations

import json
from collections import deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType

from dwell.sources.storage import fresh_folder

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3
SEED = 42
# Patterns the driver routes; they do not grow with the documents.
MAX_PATTERNS = 5000
# Leading hexadecimal digits of the order: the buckets its running sums are kept in.
DIGITS = 4


# ---- targets -----------------------------------------------------------------------

def capped_shares(sizes: list[int], weights: list[int], times: int = REPEATS) -> list[float]:
    """Share out the sum of the sizes by weight, at most ``times`` its size to each.

    What a source cannot take is shared out again by weight until none is above.
    """
    left, open_ = sum(sizes), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * left > times * sizes[i] * weight}
        if not over:
            for i in open_:
                out[i] = weights[i] * left / weight
            break
        for i in over:
            out[i] = float(times * sizes[i])
        left -= sum(times * sizes[i] for i in over)
        open_ -= over
    return out


# ---- flow --------------------------------------------------------------------------

def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = REPEATS) -> list[dict]:
    """How much of each pattern goes to each of its sources.

    The most that fits is routed, and of all ways to do so one with the least repetition:
    copy k of a pattern costs k - 1 per word.  Shortest augmenting paths; every one fills
    an arc, so their number does not depend on the sizes.
    """
    sources = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, s))
    start, end = 0, 1 + len(patterns) + len(sources)
    place = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    heads: list[int] = []
    room: list[int] = []
    cost: list[int] = []
    arcs: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            arcs[x].append(len(heads))
            heads.append(y)
            room.append(c)
            cost.append(p)
        return len(heads) - 2

    routes = []
    for i, (members, size) in enumerate(patterns, 1):
        for copy in range(repeats):
            arc(start, i, size, copy)
        routes.append({s: arc(i, place[s], repeats * size, 0) for s in members})
    for s in sources:
        arc(place[s], end, quotas.get(s, 0), 0)
    while True:
        far = [None] * (end + 1)
        by = [-1] * (end + 1)
        far[start] = 0
        queue, queued = deque([start]), {start}
        while queue:
            node = queue.popleft()
            queued.discard(node)
            for a in arcs[node]:
                to = heads[a]
                if room[a] and (far[to] is None or far[node] + cost[a] < far[to]):
                    far[to], by[to] = far[node] + cost[a], a
                    if to not in queued:
                        queue.append(to)
                        queued.add(to)
        if far[end] is None:
            return [{s: room[a ^ 1] for s, a in found.items()} for found in routes]
        path, node = [], end
        while node != start:
            path.append(by[node])
            node = heads[by[node] ^ 1]
        amount = min(room[a] for a in path)
        for a in path:
            room[a] -= amount
            room[a ^ 1] += amount


# ---- documents ---------------------------------------------------------------------

def word_count(text: str) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def sources_of(docs: DataFrame, source: str) -> Column:
    """The sources of a document: an array column as it is, any other value as the only one.

    A null or empty array is the source null.
    """
    if not isinstance(docs.select(F.col(f"`{source}`")).schema[0].dataType, ArrayType):
        return F.array(F.col(f"`{source}`").cast("string"))
    found = F.col(f"`{source}`").cast("array<string>")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(None).cast("string")))


def pattern_of(sources: Column) -> Column:
    """A key for the set of sources of a document; null is a source like any other."""
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def seeded_order(doc_id: str, seed: int) -> Column:
    """A fixed random order of documents; rows with the same id share their place."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))))


class Mix(NamedTuple):
    plan: DataFrame  # pattern, copies of every document, cut: the last place taken once more
    sizes: dict  # by source: the size of the documents in it
    targets: dict  # by source
    flows: list[tuple[tuple, dict]]  # by pattern: what goes to each of its sources
    keys: list[str]  # the patterns as the plan has them, in the same order


def plan_mix(slim: DataFrame, weigh, seed: int = SEED, repeats: int = REPEATS) -> Mix:
    """Plan a mix of documents given as (pattern, size, place).

    ``weigh`` maps the sizes by source to targets by source.  Sums per pattern and bucket
    are all that is shuffled.  Rows with the same place stay or go together.
    """
    spark = slim.sparkSession
    per_bucket = slim.groupBy("pattern", F.substring("place", 1, DIGITS).alias("bucket")).agg(F.sum("size").alias("size"))
    folder = fresh_folder(spark, "mix-buckets")
    per_bucket.write.parquet(folder)
    per_bucket = spark.read.schema("pattern string, bucket string, size long").parquet(folder)
    sums = per_bucket.groupBy("pattern").agg(F.sum("size").alias("size")).orderBy("pattern").limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = [(tuple(json.loads(r["pattern"])), r["size"]) for r in sums]
    sizes: dict = {}
    for members, size in patterns:
        for s in members:
            sizes[s] = sizes.get(s, 0) + size
    targets = weigh(sizes)
    flows = route(patterns, {s: int(t + 0.5) for s, t in targets.items()}, repeats)
    wanted = []
    for r, flow in zip(sums, flows):
        copies, rest = divmod(sum(flow.values()), r["size"]) if r["size"] else (0, 0)
        wanted.append((r["pattern"], copies, rest))
    asked = spark.createDataFrame(wanted, "pattern string, copies long, rest long")
    running = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        per_bucket.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .join(F.broadcast(asked), "pattern")
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))
        .select("pattern", "bucket", (F.col("rest") - F.col("before")).alias("left"))
    )
    # Only the one bucket of a pattern that the cut falls into is ranked.
    inside = (
        slim.withColumn("bucket", F.substring("place", 1, DIGITS)).join(F.broadcast(edges), ["pattern", "bucket"])
        .groupBy("pattern", "place").agg(F.sum("size").alias("size"), F.max("left").alias("left"))
    )
    running = Window.partitionBy("pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        inside.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .where(2 * F.col("before") + F.col("size") <= 2 * F.col("left"))
        .groupBy("pattern").agg(F.max("place").alias("last"))
    )
    cuts = {r["pattern"]: r["last"] or r["bucket"] for r in edges.join(last, "pattern", "left").collect()}
    rows = [(p, copies, cuts.get(p, "") if rest else "") for p, copies, rest in wanted]
    plan = spark.createDataFrame(rows, "pattern string, copies long, cut string")
    return Mix(plan, sizes, targets, [(p, f) for (p, _), f in zip(patterns, flows)], [r["pattern"] for r in sums])


def times_taken() -> Column:
    """How often the mix takes a document: over its row joined with the plan."""
    return F.col("copies") + (F.col("place") <= F.col("cut")).cast("long")


def weights_in_turn(sizes: dict) -> dict:
    """Sources by code point, null last, weigh 1, 2, 3, 1, ...; shares of everything."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    shares = capped_shares([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])
    return dict(zip(names, shares))


def mix_documents(docs: DataFrame, weigh=weights_in_turn, doc_id: str = "doc_id", source: str = "source",
                  text: str = "text", seed: int = SEED) -> DataFrame:
    """Per document its id, ``size`` in words, the ``source_size`` and ``target`` of its
    source, and ``taken``, the words the mix takes of it with repetitions.

    ``source`` may be an array of sources: such a document counts in the size of each, its
    words go where the flow routes its pattern, and ``source_size`` and ``target`` are sums
    over its sources.  A null or empty text has size 0 and adds nothing; texts of any length
    are counted whole.  Rows with the same id, or without one, stay or go together.  Reruns
    agree; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    folder = fresh_folder(spark, "mix-sizes")
    docs.select(
        F.col(doc_id).alias("doc_id"), word_count(text).alias("size"),
        pattern_of(sources_of(docs, source)).alias("pattern"), seeded_order(doc_id, seed).alias("place"),
    ).write.parquet(folder)
    slim = spark.read.schema(f"doc_id {kind}, size long, pattern string, place string").parquet(folder)
    mix = plan_mix(slim, weigh, seed)
    facts = spark.createDataFrame(
        [(k, sum(mix.sizes[s] for s in p), float(sum(mix.targets[s] for s in p))) for k, (p, _) in zip(mix.keys, mix.flows)],
        "pattern string, source_size long, target double",
    )
    numbered = mix.plan.join(facts, "pattern")
    return slim.join(F.broadcast(numbered), "pattern").select(
        F.col("doc_id").alias(doc_id), "size", "source_size", "target", (F.col("size") * times_taken()).alias("taken")
    )


def repeat_documents(docs: DataFrame, weigh=weights_in_turn, doc_id: str = "doc_id", source: str = "source",
                     text: str = "text", seed: int = SEED) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, columns as they were.

    Sources, texts and ids are taken as in ``mix_documents``; an empty table gives no rows.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {c: f"c{names.index(c)}" for c in (doc_id, source, text)}
    keyed = plain.withColumns({
        "pattern": pattern_of(sources_of(plain, at[source])),
        "place": seeded_order(at[doc_id], seed),
    })
    mix = plan_mix(keyed.select("pattern", word_count(at[text]).alias("size"), "place"), weigh, seed)
    taken = keyed.join(F.broadcast(mix.plan), "pattern").withColumn("times", times_taken().cast("int"))
    return taken.select(*plain.columns, F.explode(F.array_repeat(F.lit(1), F.col("times")))).select(*plain.columns).toDF(*names)
