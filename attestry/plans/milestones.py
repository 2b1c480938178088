"""The milestone audit: order, hashes, continuity and inclusion root per milestone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import anchors, merkle


def audit(blocks: DataFrame, milestones: DataFrame, committed: DataFrame, expected_id: Column, *,
          algorithm: str = "sha256") -> DataFrame:
    """Per milestone with blocks: are positions complete, do blocks hash to their ids, does the cone give the
    committed root (ms_index, inclusion_root), and does the milestone follow the one before."""
    cone = anchors.cone_check(blocks, expected_id)
    roots = merkle.roots(blocks, ["ms_index"], "wf_index", "block_id", algorithm=algorithm)
    breaks = anchors.continuity(milestones).select(F.col("idx").alias("ms_index"), "problem")
    known = milestones.select(F.col("idx").alias("ms_index"), F.lit(True).alias("_known"))
    df = (cone.join(roots.select("ms_index", "root"), "ms_index", "left").join(committed, "ms_index", "left")
          .join(breaks, "ms_index", "left").join(known, "ms_index", "left"))
    root_ok = F.col("in_order") & F.coalesce(F.col("root") == F.col("inclusion_root"), F.lit(False))
    return df.select("ms_index", "n", "in_order", (F.col("bad_hashes") == 0).alias("hashes_ok"), root_ok.alias("root_ok"),
                     F.col("problem").alias("continuity"), F.col("_known").isNull().alias("missing"))
