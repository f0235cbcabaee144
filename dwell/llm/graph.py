"""Connected components over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dwell.sources.storage import fresh_folder

# Rounds come to about the logarithm of the longest chain; more means an endless loop.
MAX_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (src, dst); the root is the smallest node.

    Alternates two steps until nothing changes: every node's larger neighbours, then its
    smaller ones, are linked to its smallest neighbour.  Chains halve in each round, and
    the links end as stars around the roots.  Neighbours are only ever combined by
    minimum, so a node with very many of them needs no room; each round is written to the
    shared folder, which cuts the lineage and survives lost executors.
    """
    spark = links.sparkSession
    folder = fresh_folder(spark, "components")
    kind = links.schema["src"].dataType.simpleString()
    schema = f"src {kind}, dst {kind}"

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    larger_first = links.where("src <> dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")
    )
    edges = stored(larger_first.distinct(), "links-0")
    for round_ in range(1, MAX_ROUNDS + 1):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        # Large star: larger neighbours go to the smallest of the node's neighbourhood.
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        # Small star: the node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        pairs = large.join(least, "src")
        small = pairs.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(
            least.select("src", F.col("m").alias("dst"))
        ).distinct()
        new = stored(small, f"links-{round_}")
        sign = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("src", "dst")).alias("x")]
        if new.agg(*sign).collect() == edges.agg(*sign).collect():
            return new.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(
                new.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
            )
        edges = new
    raise RuntimeError("components did not settle")
