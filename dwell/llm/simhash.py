"""Near-duplicates by SimHash fingerprints and BK-trees (operator 3).

Distinct fingerprints within a few bits of each other are linked and the links closed to
components.  Fingerprints are cut into more blocks than bits may differ, so linked ones
agree in at least one block: a shard holds the fingerprints that agree in one block, and
every link lies inside a shard.  Each shard is searched with BK-trees, whose children are
keyed by their integer Hamming distance to the parent, following only the edges within
the radius.  A crowded shard is divided again by the bits it does not share; what still
exceeds the limit is cut into parts, and a tree is built for every pair of parts.  Trees
go where their shard is and are not broadcast, as nothing bounds their number.

A shard reports one link per fingerprint, to the smallest one it reaches there, and not
all of its pairs, so groups of copies of any size stay linear.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from dwell.llm.graph import components
from dwell.llm.texts import map_texts
from dwell.sources.storage import fresh_folder

BITS = 64
SEED = 42
WORDS = 3
MAX_BITS = 3
# Members of a shard, or of a part of it, that one tree holds.
SHARD = 2048


# ---- fingerprints ------------------------------------------------------------------

def fingerprint(text: str, words: int = WORDS) -> int:
    """The SimHash of a text: per bit the majority over its word shingles, with repeats.

    ASCII letters are lower-cased and words are separated by ASCII white space.  A text
    with fewer words is one shingle; one without words has the fingerprint 0.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    hashes = np.array([digest(s, SEED) for s in shingles], ">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 name: str = "fingerprint") -> DataFrame:
    """Kept columns and the fingerprint of every whole text (null: empty) as a long."""

    def start():
        return lambda texts: [pa.array([_signed(fingerprint(t)) for t in texts], pa.int64())]

    return map_texts(docs, text, keep, [StructField(name, LongType())], start)


# ---- trees -------------------------------------------------------------------------

class BKTree:
    """Fingerprints by Hamming distance; a child's key is its distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        if not new:
            return
        node = 0
        while True:
            distance = (self.values[node] ^ value).bit_count()
            below = self.children[node].get(distance)
            if below is None:
                self.children[node][distance] = new
                return
            node = below

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the members within the radius, in the order they were added."""
        if not self.values:
            return []
        found, stack = [], [0]
        values, children = self.values, self.children
        while stack:
            node = stack.pop()
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            below = children[node]
            if len(below) <= 2 * radius + 1:
                stack.extend(c for d, c in below.items() if abs(d - distance) <= radius)
            else:
                stack.extend(c for d in range(distance - radius, distance + radius + 1) if (c := below.get(d)) is not None)
        return found


def _links(members: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """One link per linked member, to the smallest member it reaches."""
    root = list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tree = BKTree()
    for i, value in enumerate(members):
        for j in tree.within(value, radius):
            a, b = sorted((find(i), find(j)), key=members.__getitem__)
            root[b] = a
        tree.add(value)
    for i, value in enumerate(members):
        to = members[find(i)]
        if to != value:
            yield value, to


# ---- shards ------------------------------------------------------------------------

def _ranges(bits: Iterable[int], count: int) -> list[list[int]]:
    bits = list(bits)
    return [list(map(int, part)) for part in np.array_split(np.array(bits), count)]


def _pick(column, low: int, size: int):
    return F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << size) - 1))


def _shards(prints: DataFrame, radius: int) -> DataFrame:
    """Every fingerprint once per block: ``shard`` names the block and its bits."""
    blocks = _ranges(range(BITS), radius + 1)
    keys = [
        F.struct(F.lit(b).alias("block"), _pick(F.col("fp"), bits[0], len(bits)).alias("bits"))
        for b, bits in enumerate(blocks)
    ]
    return prints.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.block", "k.bits")


def _divided(crowded: DataFrame, radius: int) -> DataFrame:
    """Members of crowded shards, once per block of the bits their shard does not share."""
    blocks = _ranges(range(BITS), radius + 1)
    out = None
    for b, shared in enumerate(blocks):
        rest = [bit for bit in range(BITS) if bit not in shared]
        # Blocks of neighbouring bits: the rest falls into runs that the shared bits cut.
        parts = []
        for part in _ranges(rest, radius + 1):
            value = F.lit(0).cast("long")
            at = 0
            while at < len(part):
                to = at
                while to + 1 < len(part) and part[to + 1] == part[to] + 1:
                    to += 1
                value = value.bitwiseOR(F.shiftleft(_pick(F.col("fp"), part[at], to - at + 1), at))
                at = to + 1
            parts.append(value)
        keys = [F.struct(F.lit(i).alias("part"), v.alias("value")) for i, v in enumerate(parts)]
        some = crowded.where(F.col("block") == b).select("fp", "block", "bits", F.explode(F.array(*keys)).alias("k"))
        some = some.select("fp", "block", "bits", "k.part", "k.value")
        out = some if out is None else out.unionByName(some)
    return out


def link_fingerprints(prints: DataFrame, radius: int = MAX_BITS, shard: int = SHARD) -> DataFrame:
    """Links (src, dst) whose closure joins all fingerprints within the radius.

    ``prints`` has distinct longs in ``fp``.  Links grow with the members of shards, at
    most one per member of each.
    """
    spark = prints.sparkSession
    members = _shards(prints, radius)
    counts = members.groupBy("block", "bits").count().where("count > 1")
    folder = fresh_folder(spark, "simhash-shards")
    counts.write.parquet(folder)
    counts = spark.read.schema("block int, bits long, count long").parquet(folder)
    key = ["block", "bits"]
    plain = members.join(counts.where(F.col("count") <= shard).drop("count"), key, "left_semi").select(
        "fp", F.concat_ws(":", *key).alias("shard"), F.lit(0).alias("a"), F.lit(0).alias("b")
    )
    searched = plain
    if not counts.where(F.col("count") > shard).isEmpty():
        crowded = members.join(counts.where(F.col("count") > shard).drop("count"), key, "left_semi")
        fine = _divided(crowded, radius)
        key = ["block", "bits", "part", "value"]
        sizes = fine.groupBy(*key).count().where("count > 1")
        # Members of what is still too large go into parts; each pair of parts is a search
        # of its own, so nothing is left out and no search exceeds the limit.
        cut = fine.join(sizes, key).withColumn("parts", F.ceil(F.col("count") / (shard / 2)).cast("int"))
        cut = cut.withColumn("parts", F.when(F.col("count") <= shard, 1).otherwise(F.col("parts")))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        cut = cut.withColumn("own", own).select(
            "fp", F.concat_ws(":", *key).alias("shard"), "own",
            F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"),
        )
        searched = plain.unionByName(cut.select("fp", "shard", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))
    dealt = searched.repartition("shard", "a", "b").sortWithinPartitions("shard", "a", "b", "fp")
    return _search(dealt, radius)


def _search(dealt: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, src, dst = None, [], [], []

        def search():
            if len(members) > 1:
                for s, t in _links(members, radius):
                    src.append(_signed(s))
                    dst.append(_signed(t))

        def out():
            made = pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
            src.clear()
            dst.clear()
            return made

        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64).tolist()
            for value, *here in zip(prints, *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if here != key:
                    search()
                    key, members = here, []
                members.append(value)
            if len(src) > 100_000:
                yield out()
        search()
        yield out()

    return dealt.select("fp", "shard", "a", "b").mapInArrow(run, "src long, dst long").distinct()


# ---- components ----------------------------------------------------------------------

def _rooted(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Rows of distinct fingerprints ``fp`` with the ``root`` of their component."""
    roots = components(link_fingerprints(distinct.select("fp"), max_bits))  # node, root
    return distinct.join(roots, distinct.fp == roots.node, "left").select(
        *(distinct[c] for c in distinct.columns), F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Per row the id, the fingerprint (16 hexadecimal digits) and ``component_id``, the
    smallest id reachable over links of at most ``max_bits`` differing bits.

    Texts without words have the fingerprint 0 and link like any other.  Rows without an
    id get their component, but name one only if no row of it has an id (then it is
    null).  Repeated rows stay.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "simhash")
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = slim.select("doc_id").schema.add("fingerprint", "long")
    fingerprints(slim).write.parquet(f"{folder}/prints")
    rows = spark.read.schema(schema).parquet(f"{folder}/prints")
    smallest = rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least"))
    smallest.write.parquet(f"{folder}/distinct")
    distinct = spark.read.schema(f"fp long, least {schema['doc_id'].dataType.simpleString()}").parquet(f"{folder}/distinct")
    rooted = _rooted(distinct, max_bits)
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(firsts, "root").select("fp", "component_id")
    return rows.join(classes, rows.fingerprint == classes.fp).select(
        F.col("doc_id").alias(doc_id),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with its columns as they were.

    It is the one with the smallest id; rows without an id come last, and rows that share
    an id go by a hash of all columns.  So no component is left out, whether its ids are
    missing, repeated with unlike texts, or found in other components too.
    """
    spark = docs.sparkSession
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    # Rows go by their content, as ids need not tell them apart.  Hashes skip nulls, so
    # the second one is told where they are.
    missing = [F.col(c).isNull() for c in plain.columns]
    content = {"a": F.xxhash64(*plain.columns), "b": F.xxhash64(F.lit(SEED), *missing, *plain.columns)}
    keyed = plain.withColumns(content)
    folder = fresh_folder(spark, "simhash-first")
    slim = keyed.select(F.col(f"c{names.index(doc_id)}").alias("doc_id"), F.col(f"c{names.index(text)}").alias("text"), "a", "b")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    # The smallest by fingerprint, then by component: both are combined before a shuffle.
    firsts = fingerprints(slim, keep=("doc_id", "a", "b")).groupBy(F.col("fingerprint").alias("fp")).agg(F.min(order).alias("first"))
    firsts.write.parquet(folder)
    firsts = spark.read.schema(firsts.schema).parquet(folder)
    picked = _rooted(firsts, max_bits).groupBy("root").agg(F.min("first").alias("first")).select("first.a", "first.b")
    # Equal rows are combined before the shuffle that the join reads too.
    rows = keyed.dropDuplicates(["a", "b"]).join(picked, ["a", "b"], "left_semi")
    return rows.select(*plain.columns).toDF(*names)
