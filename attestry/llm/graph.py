"""Connected components of an undirected edge list, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours of a node are hung on the smallest node it sees.

    `edges` holds (u, v) with u > v. Large: every greater neighbour; small: every smaller one and the node."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, u: str, v: str, name: str = "component") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Alternates large and small stars until the edges no longer change: a logarithmic number of
    rounds in the size of a component, linear work in each, and nothing but a checksum on the driver.
    """
    now = settle(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "edges")
    print_of = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]
    before = now.agg(*print_of).first()
    while before["n"]:
        now = settle(_star(_star(now, True), False), "edges")
        after = now.agg(*print_of).first()
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias(name))
    return now.select(F.col("u").alias("node"), F.col("v").alias(name)).union(roots)
