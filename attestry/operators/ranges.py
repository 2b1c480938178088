"""Points in intervals and overlapping intervals, by dyadic nodes instead of range joins.

An interval of whole numbers is a union of at most two nodes (level, index) per level, a node being the numbers with one value
of `number >> level`; a point lies in one node of each level. An interval of any width therefore costs some 2 log2(width) rows,
and a point as many as there are levels in use, at most 64: nothing is ever listed number by number before it is known to exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 63


def dyadic(low: str, high: str) -> Column:
    """The nodes of an interval as an array of (level, index); empty if the interval is, or an end is null."""
    none = "CAST(array() AS ARRAY<STRUCT<level: INT, node: BIGINT>>)"
    take = "array_compact(array(IF(s.lo <= s.hi AND s.lo & 1 = 1, named_struct('level', k, 'node', s.lo), NULL), IF(s.lo <= s.hi AND s.hi & 1 = 0, named_struct('level', k, 'node', s.hi), NULL)))"
    # an odd low end and an even high end are nodes of their own; the rest is halved (a lone even number counts once, as high end)
    step = f"named_struct('lo', shiftright(s.lo + (s.lo & 1), 1), 'hi', shiftright(s.hi - 1 + (s.hi & 1), 1), 'nodes', concat(s.nodes, {take}))"
    start = f"named_struct('lo', CAST({low} AS BIGINT), 'hi', CAST({high} AS BIGINT), 'nodes', {none})"
    return F.expr(f"coalesce(aggregate(sequence(0, {LEVELS}), {start}, (s, k) -> IF(s.lo <= s.hi, {step}, s), s -> s.nodes), {none})")


def spread(intervals: DataFrame, low: str, high: str) -> DataFrame:
    """A row per interval and node: the interval's columns, `level` and `node`."""
    return intervals.select("*", F.inline(dyadic(low, high)))


def _ancestors(points: DataFrame, point: str, levels: DataFrame) -> DataFrame:
    """A row per point and level in use; `levels` has at most 64 rows."""
    used = levels.agg(F.collect_set("level").alias("_levels"))
    return points.join(F.broadcast(used)).withColumn("level", F.explode("_levels")).drop("_levels").withColumn(
        "node", F.expr(f"shiftright(CAST({point} AS BIGINT), level)"))


def covering(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, newest: str) -> DataFrame:
    """For each point the covering interval with the highest `newest` (null if none). Of a node only its newest interval can win."""
    nodes = spread(intervals, low, high).groupBy("level", "node").agg(F.max_by(F.struct(*intervals.columns), newest).alias("_hit"))
    spots = _ancestors(points.select(point).filter(F.col(point).isNotNull()).distinct(), point, nodes)
    best = spots.join(nodes, ["level", "node"]).groupBy(point).agg(F.max_by("_hit", F.col(f"_hit.{newest}")).alias("_hit"))
    return points.join(best, point, "left").select(*points.columns, "_hit.*")


def complete(intervals: DataFrame, milestones: DataFrame) -> DataFrame:
    """The intervals (seq, from_ms, to_ms) of which every milestone is stored, exactly once: by counts per node."""
    nodes = spread(intervals.select("seq", "from_ms", "to_ms"), "from_ms", "to_ms")
    stored = milestones.groupBy("idx").agg(F.count(F.lit(1)).alias("_copies"))
    counts = _ancestors(stored, "idx", nodes).groupBy("level", "node").agg(F.count(F.lit(1)).alias("_stored"), F.sum("_copies").alias("_rows"))
    whole = F.col("to_ms") - F.col("from_ms") + 1
    held = nodes.join(counts, ["level", "node"]).groupBy("seq", "from_ms", "to_ms").agg(F.sum("_stored").alias("_stored"), F.sum("_rows").alias("_rows"))
    return held.filter((F.col("_stored") == whole) & (F.col("_rows") == whole)).select("seq", "from_ms", "to_ms")


def members(intervals: DataFrame, milestones: DataFrame) -> DataFrame:
    """The milestones of complete intervals with their place in each: as many rows as `complete` has counted."""
    need = intervals.select("seq", "from_ms", "to_ms", F.explode(F.sequence("from_ms", "to_ms")).alias("idx"))
    return need.join(milestones.select("idx", "id"), "idx").withColumn("place", F.col("idx") - F.col("from_ms"))


def overlapping(intervals: DataFrame, low: str, high: str, start: int | None = None, end: int | None = None) -> DataFrame:
    if start is not None:
        intervals = intervals.filter(F.col(high) >= start)
    if end is not None:
        intervals = intervals.filter(F.col(low) <= end)
    return intervals
