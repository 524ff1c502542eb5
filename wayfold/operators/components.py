"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import checkpointed


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")


def _small_star(e: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are tied to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of all nodes that have an edge to another; root is the least node of the component.

    Repeated edges, either direction and loops are allowed; null ends are ignored. Rounds grow with the logarithm of
    the longest path. Each round is checkpointed and moves as many rows as there are edges; none goes to the driver.
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = checkpointed(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (r["n"], r["h"]) == state:
            break
        state = (r["n"], r["h"])
        if not r["n"]:
            break
        e = checkpointed(_small_star(_large_star(e).distinct()).distinct())
    pairs = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pairs.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
