"""Status transitions of submissions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import vocabulary as V
from . import ordered

OUTCOMES = ("CONTENT_VERIFIED", "CONTENT_MISMATCH", "NOT_FOUND", "ORPHANED")
BEFORE_CONFIRMED = ("RECEIVED", "SUBMITTED", "SOLID", "ORPHANED")


def current_status(lifecycle: DataFrame, key: str = "block_id") -> DataFrame:
    """Latest status by (at_ms, id) and first confirmation time; a late transition overrides nothing newer."""
    return (lifecycle.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.max_by("status", F.struct("at_ms", "id")).alias("status"),
                 F.min(F.when(F.col("status") == "CONFIRMED", F.col("at_ms"))).alias("confirmed_at_ms")))


def message_status(messages: DataFrame, lifecycle: DataFrame, submissions: DataFrame) -> DataFrame:
    """A message's own status, else the latest transition of its block or of its submission."""
    by_sub = (lifecycle.filter("block_id IS NULL").drop("block_id")
              .join(submissions.filter("block_id IS NOT NULL").select("sub_id", "block_id"), "sub_id"))
    every = lifecycle.filter("block_id IS NOT NULL").unionByName(by_sub.select(*lifecycle.columns))
    latest = current_status(every).select("block_id", F.col("status").alias("_latest"))
    own = F.col("status") if "status" in messages.columns else F.lit(None).cast("string")
    return messages.join(latest, "block_id", "left").withColumn("status", F.coalesce(own, "_latest")).drop("_latest")


def transitions_to_write(proposed: DataFrame) -> DataFrame:
    """Each non-outcome status once per block; an outcome only when it differs from the status before."""
    by_time = ordered.Order(("at_ms", "id"), "at_ms", "id")
    seen = ordered.scan(proposed, ["block_id"], by_time, {"_before": ordered.last(F.col("status"))})
    first = proposed.groupBy("block_id", "status").agg(F.min(F.struct("at_ms", "id")).alias("_first"))
    is_outcome = F.col("status").isin(*OUTCOMES)
    keep = F.when(is_outcome, ~F.col("status").eqNullSafe(F.col("_before"))).otherwise(
        F.struct("at_ms", "id") == F.col("_first"))
    return seen.join(first, ["block_id", "status"]).filter(keep).select(*proposed.columns)


def submission_transitions(submissions: DataFrame) -> DataFrame:
    """RECEIVED for each submission, and SUBMITTED once it has a block id."""
    rows = submissions.select("sub_id", "block_id", F.col("received_at_ms").alias("at_ms"), F.expr(
        "explode(filter(array(struct(0 AS step, 'RECEIVED' AS status), struct(1 AS step, 'SUBMITTED' AS status)),"
        " s -> s.step = 0 OR block_id IS NOT NULL))").alias("s"))
    return rows.select("sub_id", "block_id", "s.step", "s.status", "at_ms")


def confirmations(lifecycle: DataFrame, messages: DataFrame) -> DataFrame:
    """CONFIRMED for blocks a milestone references whose latest status is not past it."""
    now = current_status(lifecycle).filter(F.col("status").isin(*BEFORE_CONFIRMED))
    hits = now.join(messages.filter("ms_index IS NOT NULL").select("block_id", "ms_index", "ts"), "block_id")
    return hits.select("block_id", F.lit("CONFIRMED").alias("status"), (F.col("ts") * 1000).alias("at_ms"), "ms_index",
                       F.when(F.col("status") == "ORPHANED", F.lit("ORPHANED")).alias("after"))


def state_since(log: DataFrame, keys: list[str], state: str = "state", at: str = "at_ms", tie: str = "id") -> DataFrame:
    """Per key the current state and the time it was first reached without a break."""
    by_time = ordered.Order((at, tie), at, tie)
    seen = ordered.scan(log, keys, by_time, {"_before": ordered.last(F.col(state))})
    change = F.when(~F.col(state).eqNullSafe(F.col("_before")), F.struct(at, tie))
    return (seen.groupBy(*keys).agg(F.max_by(state, F.struct(at, tie)).alias(state), F.max(change).alias("_since"))
            .select(*keys, state, F.col(f"_since.{at}").alias("since_ms")))


def orphaned(submissions: DataFrame, validations: DataFrame, as_of_ms: int, timeout_s: int = V.ORPHAN_S) -> DataFrame:
    """Submitted blocks no milestone referenced within the timeout, on definitive answers only.

    At least one definitive answer lies inside the window and one at or after its end."""
    key = H.packed(F.col("block_id")).alias("_id")
    answers = (validations.select(key, "checked_at_ms", "is_solid", "referenced_by_ms").join(submissions.select(key, "received_at_ms"), "_id")
               .withColumn("_end", F.col("received_at_ms") + timeout_s * 1000)
               .groupBy("_id", "received_at_ms").agg(
        F.max(F.col("referenced_by_ms").isNotNull() & (F.col("checked_at_ms") <= F.col("_end"))).alias("confirmed"),
        F.count_if(F.col("checked_at_ms") < F.col("_end")).alias("inside"),
        F.count_if(F.col("checked_at_ms") >= F.col("_end")).alias("after"),
        F.count(F.lit(1)).alias("answered"), F.max("is_solid").alias("solid")))
    late = F.col("received_at_ms") + timeout_s * 1000 <= as_of_ms
    found = answers.filter(late & ~F.col("confirmed") & (F.col("inside") > 0) & (F.col("after") > 0))
    return found.select(H.unpacked(F.col("_id")).alias("block_id"), *[c for c in found.columns if c != "_id"])


def first_submission(submissions: DataFrame) -> DataFrame:
    """The time from which messages without a submission can be told: nothing was received before."""
    return submissions.agg(F.min("received_at_ms").alias("baseline_ms"))
