"""Connected components by alternating large-star and small-star over edge tables.

Each star is a group-by that keeps one minimum for each node and a join of the
edges with those minima. The minima are written before they are joined, so both
sides of the join are plain exchanges and a node with very many edges is split
over tasks. Loops and null ends are left out; repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.storage import Scratch

#: Rounds after which something must be wrong: the number needed grows with the logarithm of the largest component.
MOST_ROUNDS = 60


def settled(edges: DataFrame) -> bool:
    """Every node that points anywhere points to one node, which points nowhere: then both stars leave the table as it is."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    both = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return both.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))).isEmpty()


def large_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """Join every larger neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    path = scratch.put(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-min")
    least = scratch.spark.read.parquet(path)
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = scratch.put(moved.where("u <> v").distinct(), "large")
    return scratch.spark.read.parquet(out), [path, out]


def small_star(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """Join a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    path = scratch.put(down.groupBy("u").agg(F.min("v").alias("m")), "small-min")
    least = scratch.spark.read.parquet(path)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = scratch.put(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    return scratch.spark.read.parquet(out), [path, out]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): each node that has an edge and isn't the least of its component, with that least node. ``edges`` has long columns u and v."""
    clean = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    held = scratch.put(clean.distinct(), "edges")
    now, old = scratch.spark.read.schema("u long, v long").parquet(held), [held]
    for _ in range(MOST_ROUNDS):
        spread, first = large_star(now, scratch)
        now, second = small_star(spread, scratch)
        scratch.drop(*old, *first, second[0])
        old = second[1:]
        if settled(now):
            return now
    raise RuntimeError("components did not settle")
