"""Stored copies against the ledger: missing rows, altered content, unsubmitted writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import hashing as H
from . import ordered
from .lifecycle import OUTCOMES


def candidate_blocks(content_checks: DataFrame, submissions: DataFrame, messages: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Every block any table says is held or was checked."""
    parts = [content_checks.filter("result = 'MATCH'"), submissions, messages, lifecycle.filter("status = 'CONTENT_VERIFIED'")]
    ids = [p.select("block_id").filter("block_id IS NOT NULL") for p in parts]
    out = ids[0]
    for p in ids[1:]:
        out = out.union(p)
    return out.distinct()


def reverify_candidates(content_checks: DataFrame, submissions: DataFrame, messages: DataFrame, lifecycle: DataFrame,
                        alerts: DataFrame) -> DataFrame:
    """Candidate blocks with every stored copy, whether they were verified once, and their latest outcome.

    `submissions` and `messages` hold (block_id, tag, data); outcomes written for tampering do not count.
    `block_key` is the packed id, by which the rows are dealt.
    """
    key = H.packed(F.col("block_id")).alias("block_key")
    at = {"verified": F.lit(False), "said": F.lit(None), "place": F.lit(None), "sub": F.lit(None), "msg": F.lit(None)}
    kinds = {"verified": "boolean", "said": "string", "place": "struct<at_ms: bigint, id: bigint>",
             "sub": "struct<sub_id: string, tag: string, data: string>", "msg": "struct<tag: string, data: string>"}
    row = lambda df, **told: df.filter("block_id IS NOT NULL").select(key, *[c.cast(kinds[n]).alias(n) for n, c in {**at, **told}.items()])
    counts = ~F.col("cause").eqNullSafe(F.lit("DB_TAMPER")) if "cause" in lifecycle.columns else F.lit(True)
    # each table is dealt once by block, with all that it tells; of a block there is one submission and one message
    told = (row(content_checks.filter("result = 'MATCH'"), verified=F.lit(True))
            .unionByName(row(lifecycle.filter(F.col("status").isin(*OUTCOMES)), verified=F.col("status") == "CONTENT_VERIFIED",
                             said=F.when(counts, F.col("status")), place=F.when(counts, F.struct("at_ms", "id"))))
            .unionByName(row(submissions, sub=F.struct("sub_id", "tag", "data"))).unionByName(row(messages, msg=F.struct("tag", "data"))))
    held = told.groupBy("block_key").agg(F.bool_or("verified").alias("verified_once"), F.max_by("said", "place").alias("outcome"),
                                         F.collect_list("sub").alias("_subs"), F.collect_list("msg").alias("_msgs"))
    held = held.filter(F.col("verified_once") | (F.size("_subs") > 0) | (F.size("_msgs") > 0))
    raised = (alerts.filter(F.col("rule").isin("CONTENT_MISMATCH", "NOT_FOUND", "ORPHANED") & (
        F.col("severity") == F.when(F.col("rule") == "ORPHANED", "high").otherwise("critical")))
        .groupBy(key).agg(F.collect_set("rule").alias("_raised")))
    df = held.withColumn("_sub", F.explode_outer("_subs")).withColumn("_msg", F.explode_outer("_msgs")).join(raised, "block_key", "left")
    return df.select("block_key", H.unpacked(F.col("block_key")).alias("block_id"), "verified_once", "outcome", F.col("_sub.sub_id").alias("sub_id"), F.col("_sub").isNotNull().alias("has_submission"),
                     F.col("_sub.tag").alias("sub_tag"), F.col("_sub.data").alias("sub_data"), F.col("_msg").isNotNull().alias("has_message"),
                     F.col("_msg.tag").alias("msg_tag"), F.col("_msg.data").alias("msg_data"),
                     F.coalesce(F.array_contains("_raised", F.col("outcome")), F.lit(False)).alias("outcome_alerted"))


def tampered(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per stored field that differs from the ledger's content (block_id, tag, data, ms_index).

    Compares hashes of the content, and carries the values only for the fields that differ. A block
    never verified counts only once confirmed; a verified block without any copy is "content removed".
    """
    key = H.packed(F.col("block_id")).alias("block_key")
    real = ledger.select(key, F.col("tag").alias("l_tag"), F.col("data").alias("l_data"), F.col("ms_index").alias("l_ms"))
    candidates = candidates if "block_key" in candidates.columns else candidates.select("*", key)
    df = candidates.join(real, "block_key").filter(F.col("verified_once") | F.col("l_ms").isNotNull())
    sub = F.col("has_submission") & ~(F.col("outcome_alerted"))
    held = (F.col("has_submission") & (F.col("sub_tag").isNotNull() | F.col("sub_data").isNotNull())) | (
        F.col("has_message") & (F.col("msg_tag").isNotNull() | F.col("msg_data").isNotNull()))
    gone = F.col("verified_once") & ~held

    def entry(name, active, expected, actual):
        return F.when(active & ~expected.eqNullSafe(actual), F.struct(
            F.lit(name).alias("field"), expected.alias("expected"), actual.alias("actual")))

    fields = F.array_compact(F.array(
        entry("submissions.tag", sub, F.col("l_tag"), F.col("sub_tag")),
        entry("submissions.data", sub, F.col("l_data"), F.col("sub_data")),
        entry("messages.tag", F.col("has_message"), F.col("l_tag"), F.col("msg_tag")),
        entry("messages.data", F.col("has_message"), F.col("l_data"), F.col("msg_data"))))
    none = F.array(F.struct(F.lit("content").alias("field"), F.col("l_data").alias("expected"), F.lit(None).cast("string").alias("actual")))
    rows = df.withColumn("_f", F.explode(F.when(gone, none).otherwise(fields)))
    reason = F.when(gone, "content removed").otherwise("stored copy differs from the ledger")
    return rows.select("block_id", reason.alias("reason"), "_f.*")


def content_check(received: DataFrame, ledger: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Received (block_id, tag, data) against the block served: result and the fields that differ.

    `ledger` holds block_id, raw, payload_type, tag, data; a block it does not hold is NOT_FOUND."""
    key = H.packed(F.col("block_id")).alias("_id")
    served = ledger.select(key, "raw", "payload_type", F.col("tag").alias("l_tag"), F.col("data").alias("l_data"), F.lit(True).alias("_served"))
    df = received.select(key, "tag", "data").join(served, "_id", "left").withColumn("block_id", H.unpacked(F.col("_id")))
    plain = F.col("payload_type") == 5
    fields = F.array_compact(F.array(
        F.when(H.block_id(F.col("raw"), algorithm) != F.col("block_id"), "blockId"),
        F.when(~plain, "payload"), F.when(plain & (F.col("l_tag") != F.col("tag")), "tag"),
        F.when(plain & (F.col("l_data") != F.col("data")), "data")))
    result = F.when(F.col("_served").isNull(), "NOT_FOUND").when(F.size(fields) == 0, "MATCH").otherwise("MISMATCH")
    first = F.when(plain & (F.col("l_data") != F.col("data")), C.first_difference(F.col("data"), F.col("l_data")))
    return df.select("block_id", result.alias("result"), F.when(F.col("_served"), F.array_join(fields, ",")).alias("fields"), first.alias("first_diff"))


def shadow_candidates(messages: DataFrame, submissions: DataFrame, alerts: DataFrame, since_ms: int | None, until_ms: int,
                      exempt_tags: Sequence[str] = ()) -> DataFrame:
    """Confirmed messages no submission names and no SHADOW alert marks, confirmed in [since, until].

    Without `since_ms` the first submission ever received is the baseline."""
    df = (messages.filter("ms_index IS NOT NULL").filter(F.col("tag").isNull() | ~F.col("tag").isin(*exempt_tags))
          .withColumn("confirmed_ms", F.coalesce("confirmed_at_ms", F.col("ts") * 1000)).filter(F.col("confirmed_ms") <= until_ms))
    if since_ms is None:
        base = submissions.agg(F.min("received_at_ms").alias("baseline_ms"))  # one row
        df = df.join(F.broadcast(base)).filter(F.col("confirmed_ms") >= F.col("baseline_ms"))
    else:
        df = df.filter(F.col("confirmed_ms") >= since_ms).withColumn("baseline_ms", F.lit(since_ms).cast("bigint"))
    key = H.packed(F.col("block_id"))
    df = df.withColumn("_id", key)
    named = submissions.filter("block_id IS NOT NULL").select(key.alias("_id"))
    marked = alerts.filter("rule = 'SHADOW' AND block_id IS NOT NULL").select(key.alias("_id"))
    rest = [H.unpacked(F.col("_id")).alias(c) if c == "block_id" else F.col(c) for c in df.columns if c != "_id"]
    return df.join(named, "_id", "left_anti").join(marked, "_id", "left_anti").select(*rest)


def missing_messages(ledger_blocks: DataFrame, messages: DataFrame) -> DataFrame:
    """Confirmed tagged blocks of the ledger without a stored message."""
    key = H.packed(F.col("block_id")).alias("_id")
    lost = ledger_blocks.select(key).distinct().join(messages.select(key), "_id", "left_anti")
    return lost.select(H.unpacked(F.col("_id")).alias("block_id"))


def message_detail(messages: DataFrame, submissions: DataFrame, validations: DataFrame, content_checks: DataFrame) -> DataFrame:
    """Messages with their submission and latest checks; submissions without a message stay, not indexed."""
    s = submissions.filter("block_id IS NOT NULL").select("block_id", "sub_id", "source", F.col("tag").alias("sub_tag"))
    m = messages.select("block_id", "tag", "verdict", F.lit(True).alias("indexed"))
    v = validations.groupBy("block_id").agg(F.max_by(F.struct("is_solid", "inclusion_state"), F.struct("checked_at_ms", "id")).alias("_v"))
    c = content_checks.groupBy("block_id").agg(F.max_by("result", F.struct("checked_at_ms", "id")).alias("content"))
    df = m.join(s, "block_id", "full_outer").join(v, "block_id", "left").join(c, "block_id", "left")
    return df.select("block_id", F.coalesce("indexed", F.lit(False)).alias("indexed"), F.coalesce("tag", "sub_tag").alias("tag"),
                     "verdict", "sub_id", "source", C.solid_ok(F.col("_v.is_solid"), F.col("_v.inclusion_state")).alias("solid"), "content")


def latest_per_block(log: DataFrame, n: int = 1) -> DataFrame:
    return ordered.latest(log, ["block_id"], F.col("checked_at_ms").desc(), F.col("id").desc(), n=n)


def not_stored(ledger: DataFrame, stored: DataFrame, key: str = "block_id") -> DataFrame:
    """Ids on the ledger that are not among the stored ones."""
    return ledger.select(key).join(stored.select(key), key, "left_anti").distinct()
