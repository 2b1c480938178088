"""Connected components of an edge list: hook to the smallest neighbour, contract, repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node of each component, for every node with an edge to another.

    Each round hangs every node on the smallest of its neighbours (if smaller than itself), follows the hooks to their end by
    doubling, and draws the edges anew between the ends; what is left of a component at least halves. Rounds, and doublings in a
    round, are logarithmic. Nodes hung in earlier rounds find their last root by one join a round, backwards. Only row counts
    reach the driver."""
    now = settle(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "graph-edges")
    hung = []
    while now.limit(1).count():
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up, moved = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "graph-parents"), True
        while moved:
            above = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
            up = settle(up.join(above, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "graph-parents")
            moved = up.filter("moved").limit(1).count() > 0
            up = up.drop("moved")
        hung.append(up)
        left, right = (up.select(F.col("u").alias(c), F.col("p").alias(f"_{c}")) for c in ("u", "v"))
        now = settle(now.join(left, "u").join(right, "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).filter("u <> v").distinct(), "graph-edges")
    if not hung:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("component")).limit(0)
    root = hung[-1].select(F.col("u").alias("node"), F.col("p").alias("component"))
    for up in reversed(hung[:-1]):
        further = root.select(F.col("node").alias("p"), "component")
        root = up.join(further, "p", "left").select(F.col("u").alias("node"), F.coalesce("component", "p").alias("component"))
    return root
