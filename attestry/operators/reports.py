"""Counts, flows and the audit report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from . import ranges, search


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table. Each count is a separate aggregate, so no table is read for another."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def ie_activity(messages: DataFrame) -> DataFrame:
    return (messages.filter("ie_id IS NOT NULL").groupBy("ie_id")
            .agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
                 F.max("ms_index").alias("last_ms_index")))


def ie_list(messages: DataFrame, latest: DataFrame) -> DataFrame:
    """Elements with their activity and the latest score."""
    heads = latest.select("ie_id", "score", F.col("block_id").alias("score_block_id"), F.col("ts").alias("score_ts"))
    return ie_activity(messages).join(heads, "ie_id", "left")


def flows(messages: DataFrame) -> DataFrame:
    """Flow summaries by issuer, element, service component and correlation id, in one pass."""
    dims = [("issuer", "iss"), ("ie", "ie_id"), ("service", "service"), ("corr", "corr")]
    keyed = F.explode(F.array(*[F.struct(F.lit(d).alias("by"), F.col(c).alias("key")) for d, c in dims]))
    return (messages.select("ts", keyed.alias("f")).filter("f.key IS NOT NULL").groupBy("f.by", "f.key")
            .agg(F.count(F.lit(1)).alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


def payload_ratio(messages: DataFrame) -> DataFrame:
    df = messages.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("encrypted")).alias("plaintext"),
                      F.count_if(F.col("encrypted")).alias("encrypted"))
    return df.withColumn("ratio", F.when(F.col("total") > 0, F.col("plaintext") / F.col("total")).otherwise(0.0))


def verdict_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("verdict", "encrypted").agg(
        F.count(F.lit(1)).alias("n"), F.count("ms_index").alias("confirmed"))


def alert_groups(alerts: DataFrame) -> DataFrame:
    """Alerts by severity, by rule and in all, in one pass."""
    g = alerts.groupingSets([["severity"], ["rule"], []], "severity", "rule").agg(F.count(F.lit(1)).alias("n"))
    return g.select("severity", "rule", "n")


def milestone_window(milestones: DataFrame, ms_from: int | None, ms_to: int | None) -> DataFrame:
    """One row: the epoch-ms window [lo, hi) a milestone range covers, and whether it is known."""
    lo = F.min(F.when(F.col("idx") >= ms_from, F.col("ts"))) * 1000 if ms_from is not None else F.lit(None).cast("bigint")
    hi = F.min(F.when(F.col("idx") > ms_to, F.col("ts"))) * 1000 if ms_to is not None else F.lit(None).cast("bigint")
    known = (F.count_if(F.col("idx") >= ms_from) > 0) if ms_from is not None else F.lit(True)
    df = milestones.agg(F.count(F.lit(1)).alias("_n"), lo.alias("lo"), hi.alias("hi"), known.alias("known"))
    return df.drop("_n")


def report_alerts(alerts: DataFrame, messages: DataFrame, blocks: DataFrame, milestones: DataFrame, *,
                  ie: str | None = None, ms_from: int | None = None, ms_to: int | None = None) -> DataFrame:
    """Alerts in a range: those of a block by its milestone, the others by their time."""
    m = messages.select("block_id", F.col("ie_id").alias("_m_ie"), F.col("ms_index").alias("_m_ms"))
    b = blocks.select("block_id", F.col("ms_index").alias("_b_ms"))
    df = alerts.join(m, "block_id", "left").join(b, "block_id", "left")
    if ie is not None:
        df = df.filter((F.col("ie_id") == ie) | (F.col("_m_ie") == ie))
    if ms_from is not None or ms_to is not None:
        ms = F.coalesce("_m_ms", "_b_ms")
        inside = ms.isNotNull()
        inside = inside & (ms >= ms_from) if ms_from is not None else inside
        inside = inside & (ms <= ms_to) if ms_to is not None else inside
        df = df.join(F.broadcast(milestone_window(milestones, ms_from, ms_to)))  # one row
        timed = (F.col("known") & (F.col("lo").isNull() | (F.col("at_ms") >= F.col("lo")))
                 & (F.col("hi").isNull() | (F.col("at_ms") < F.col("hi"))))
        df = df.filter((F.col("block_id").isNotNull() & inside) | (F.col("block_id").isNull() & timed))
    return df.select(*alerts.columns)


def anchor_counts(anchors: DataFrame, ms_from: int | None = None, ms_to: int | None = None) -> DataFrame:
    """Anchors overlapping a range by status, and the newest of each status."""
    rows = ranges.overlapping(anchors, "from_ms", "to_ms", ms_from, ms_to)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("newest_seq"),
                                      F.max_by("ms_root", "seq").alias("newest_root"))


def proof_index(messages: DataFrame, *, ie=None, ms_from=None, ms_to=None, limit: int) -> DataFrame:
    """The first `limit` confirmed messages of a range, and whether more exist (`limit` is the report's own)."""
    rows = search.search(messages, ie=ie, ms_from=ms_from, ms_to=ms_to).filter("ms_index IS NOT NULL")
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    first = rows.orderBy("ms_index", "wf_index", "block_id").limit(limit)
    return first.join(F.broadcast(total)).withColumn("truncated", F.col("_n") > limit).drop("_n")


def _counted(df: DataFrame, key: str) -> DataFrame:
    """Sorted `name=count` map of a small domain (verdicts, severities, rules, statuses)."""
    per = df.groupBy(F.coalesce(F.col(key), F.lit("UNKNOWN")).alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return per.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("m"))


def audit_report(messages: DataFrame, alerts: DataFrame, blocks: DataFrame, milestones: DataFrame, anchors: DataFrame, *,
                 network: str, at_ms: int, ie=None, ms_from=None, ms_to=None, proof_limit: int) -> DataFrame:
    """The audit report of a range as one JSON document and its hash. Only fixed domains are collected."""
    rows = search.search(messages, ie=ie, ms_from=ms_from, ms_to=ms_to)
    totals = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if("encrypted").alias("encrypted"),
                      F.count("ms_index").alias("confirmed"))
    by_verdict = _counted(rows, "verdict").withColumnRenamed("m", "by_verdict")
    hits = report_alerts(alerts, messages, blocks, milestones, ie=ie, ms_from=ms_from, ms_to=ms_to)
    by_severity = _counted(hits, "severity").withColumnRenamed("m", "by_severity")
    by_rule = _counted(hits, "rule").withColumnRenamed("m", "by_rule")
    overlap = ranges.overlapping(anchors, "from_ms", "to_ms", ms_from, ms_to)
    by_status = _counted(overlap, "status").withColumnRenamed("m", "by_status")
    newest = overlap.agg(F.max_by(F.struct("seq", "from_ms", "to_ms", "status"), "seq").alias("latest"))
    entry = F.struct("block_id", "tag", "ie_id", "iss", "verdict", "ms_index", "wf_index")
    proofs = (proof_index(messages, ie=ie, ms_from=ms_from, ms_to=ms_to, limit=proof_limit)
              .agg(F.array_sort(F.collect_list(F.struct("ms_index", "wf_index", "block_id", entry.alias("e")))).alias("_p"))
              .select(F.transform("_p", lambda p: p["e"]).alias("proofs")))
    one = totals
    for part in (by_verdict, by_severity, by_rule, by_status, newest, proofs):
        one = one.join(F.broadcast(part))  # one row each
    whole = F.aggregate(F.map_values("by_severity"), F.lit(0).cast("bigint"), lambda a, v: a + v)
    doc = F.struct(
        F.lit(1).alias("v"), F.lit(network).alias("network"), F.lit(at_ms).cast("bigint").alias("generatedAt"),
        F.struct(F.lit(ms_from).cast("bigint").alias("msFrom"), F.lit(ms_to).cast("bigint").alias("msTo")).alias("range"),
        F.lit(ie).cast("string").alias("ie"),
        F.struct("total", "encrypted", (F.col("total") - F.col("encrypted")).alias("plaintext"), "confirmed",
                 F.col("by_verdict").alias("byVerdict")).alias("messages"),
        F.struct(whole.alias("total"), F.col("by_severity").alias("bySeverity"), F.col("by_rule").alias("byRule")).alias("alerts"),
        F.struct(F.col("by_status").alias("byStatus"), "latest").alias("anchors"),
        "proofs", (F.col("confirmed") > F.size("proofs")).alias("proofsTruncated"))
    return one.select(F.to_json(doc).alias("report")).withColumn("report_hash", H.canonical_hash(F.col("report")))


def put_reports(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New reports not stored yet, by content hash."""
    return new.dropDuplicates(["report_hash"]).join(stored.select("report_hash"), "report_hash", "left_anti")


def mark_anchored(reports: DataFrame, accepted: DataFrame) -> DataFrame:
    """Overlay accepted reports: (report_hash, block_id, anchored_at_ms), first acceptance wins."""
    first = accepted.groupBy("report_hash").agg(F.min_by(F.struct("block_id", "anchored_at_ms"), F.struct("anchored_at_ms", "block_id")).alias("_a"))
    return (reports.join(first, "report_hash", "left").withColumn("anchored", F.col("_a").isNotNull())
            .withColumn("block_id", F.col("_a.block_id")).withColumn("anchored_at_ms", F.col("_a.anchored_at_ms")).drop("_a"))


def milestone_counts(blocks: DataFrame, messages: DataFrame) -> DataFrame:
    """Per milestone: blocks, tagged blocks, and messages stored."""
    cone = blocks.groupBy("ms_index").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("payload_type") == 5).alias("tagged"))
    held = messages.groupBy("ms_index").agg(F.count(F.lit(1)).alias("messages"))
    return cone.join(held, "ms_index", "left").withColumn("messages", F.coalesce("messages", F.lit(0).cast("bigint")))


def ledger_clock(milestones: DataFrame, as_of_s: int, threshold_s: int = 120) -> DataFrame:
    df = milestones.agg(F.max_by("ts", "idx").alias("latest_ts"))
    return df.withColumn("status", F.when(F.col("latest_ts").isNull(), "empty")
                         .when(as_of_s - F.col("latest_ts") > threshold_s, "stalled").otherwise("ok"))


def blocks_with_alerts(alerts: DataFrame, rules: Sequence[str], among: DataFrame | None = None) -> DataFrame:
    """Blocks that carry an alert of any of the rules, with those rules; `among` (block_id) keeps only blocks of its own."""
    hits = alerts.filter(F.col("rule").isin(*rules) & F.col("block_id").isNotNull()).select("block_id", "rule")
    if among is not None:
        hits = hits.join(among.select("block_id"), "block_id", "left_semi")
    return hits.groupBy("block_id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def message_count(messages: DataFrame, ms_from: int, ms_to: int) -> DataFrame:
    """How many messages the milestones of a range reference."""
    return messages.filter(F.col("ms_index").between(ms_from, ms_to)).agg(F.count(F.lit(1)).alias("n"))


def highest_ids(alerts: DataFrame, messages: DataFrame, iss: str) -> DataFrame:
    """The last alert id (0 without alerts) and the last seq of an issuer (null without messages): where readers go on."""
    last = alerts.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("last_alert"))
    return last.join(F.broadcast(messages.filter(F.col("iss") == iss).agg(F.max("seq").alias("last_seq"))))  # one row each
