"""Trust-score series per element: latest, previous, jumps, drift, silence, lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocabulary as V
from . import documents, ordered
from .ordered import BY_POSITION, last


def valid_scores(messages: DataFrame, verdicts: Sequence[str] | None = V.PROVEN_VERDICTS) -> DataFrame:
    """Confirmed scores of a named element, of the given verdicts."""
    ok = F.col("score").between(0, 1) & F.col("ie_id").isNotNull() & F.col("ms_index").isNotNull()
    return messages.filter(ok if verdicts is None else ok & F.col("verdict").isin(*verdicts))


def latest_scores(messages: DataFrame, verdicts: Sequence[str] = V.PROVEN_VERDICTS,
                  alerts: DataFrame | None = None, exclude_rules: Sequence[str] = V.DISTRUST_RULES) -> DataFrame:
    """Per element its latest confirmed score; with `alerts`, skipping blocks that carry one of the rules."""
    rows = valid_scores(messages, verdicts)
    if alerts is not None:
        bad = alerts.filter(F.col("rule").isin(*exclude_rules) & F.col("block_id").isNotNull()).select("block_id")
        rows = rows.join(bad, "block_id", "left_anti")
    order = [F.col(c).desc() for c in BY_POSITION.cols]
    return ordered.latest(rows, ["ie_id"], *order).select("ie_id", "block_id", "score", "ts", "ms_index")


def with_previous_score(messages: DataFrame, eligible: Column, prefix: str = "previous", **how) -> DataFrame:
    """Add the score, block and time of the last eligible score of the element before each row."""
    value = F.struct(F.col("score").alias("score"), F.col("block_id").alias("block_id"), F.col("ts").alias("ts"))
    df = ordered.scan(messages, ["ie_id"], BY_POSITION, {"_prev": last(value, eligible)}, **how)
    return df.select(*messages.columns, *[F.col(f"_prev.{f}").alias(f"{prefix}_{f}") for f in ("score", "block_id", "ts")])


def score_eligible(verdicts: Sequence[str] = V.PROVEN_VERDICTS) -> Column:
    return F.coalesce(F.col("score").between(0, 1) & F.col("verdict").isin(*verdicts), F.lit(False))


def jumps(messages: DataFrame, threshold: float = V.JUMP, verdicts: Sequence[str] = V.PROVEN_VERDICTS) -> DataFrame:
    """Scores that moved by more than `threshold` from the previous trusted score (strictly more)."""
    df = with_previous_score(valid_scores(messages, verdicts), score_eligible(verdicts))
    return df.withColumn("delta", F.col("score") - F.col("previous_score")).filter(F.abs("delta") > threshold)


def trusted_flags(messages: DataFrame, policy: DataFrame, alerts: DataFrame | None, submissions: DataFrame) -> DataFrame:
    """Which scores may serve as a reference: `ref_proven`, and `ref_relayed` for relayed scores."""
    df = documents.with_trust(messages, policy, alerts, submissions)
    base = F.coalesce(F.col("score").between(0, 1), F.lit(False)) & ~F.col("distrusted")
    signed = base & F.col("may_write")
    proven = signed & (F.col("verdict") == "PRODUCER_SIGNED")
    relayed = (proven | (signed & (F.col("verdict") == "RELAY_ATTESTED"))
               | (base & (F.col("verdict") == V.UNSIGNED) & ~F.col("signature_required") & F.col("submitted")))
    return df.withColumn("ref_proven", F.coalesce(proven, F.lit(False))).withColumn("ref_relayed", F.coalesce(relayed, F.lit(False)))


def with_trusted_previous(flagged: DataFrame, **how) -> DataFrame:
    """Add the previous trusted score: proven references for proven rows, proven or relayed ones for the rest."""
    value = F.struct(F.col("score").alias("score"), F.col("block_id").alias("block_id"))
    df = ordered.scan(flagged, ["ie_id"], BY_POSITION, {
        "_p": last(value, F.col("ref_proven")), "_r": last(value, F.col("ref_relayed"))}, **how)
    own = F.when(F.col("trust") == "proven", F.col("_p")).otherwise(F.col("_r"))
    return df.select(*flagged.columns, own["score"].alias("previous_score"), own["block_id"].alias("previous_block_id"),
                     F.col("_p.score").alias("proven_score"), F.col("_p.block_id").alias("proven_block_id"))


def drops(flagged_with_previous: DataFrame, threshold: float = V.DROP) -> DataFrame:
    """Trusted scores at least `threshold` below the previous one (the threshold itself counts)."""
    gap = F.col("previous_score") - F.col("score")
    return flagged_with_previous.filter((F.col("trust") != "untrusted") & (gap >= threshold - V.EPS))


def security_events(messages: DataFrame, alerts: DataFrame, submissions: DataFrame, policy: DataFrame,
                    tags: Sequence[str] = V.SECURITY_TAGS) -> DataFrame:
    """Messages that may explain a score jump, with `corroborates` and why not."""
    verdicts = [*V.PROVEN_VERDICTS, V.UNSIGNED]
    df = messages.filter(F.col("tag").isin(*tags) & F.col("verdict").isin(*verdicts) & F.col("ie_id").isNotNull())
    df = documents.with_writer_rule(df, policy)
    df = documents.flag(df, "block_id", submissions.select("block_id"), "submitted")
    df = documents.flag(df, "block_id", alerts.filter("rule = 'SHADOW'").select("block_id"), "shadowed")
    proven = C.proven(F.col("verdict"))
    why = (F.when((F.col("kind") == V.ORCHESTRATOR_KIND) & ~F.coalesce(F.col("error_code") != 0, F.lit(False)), "no error")
           .when(proven, F.lit(None)).when(F.col("signature_required"), "verdict")
           .when(~F.col("submitted"), "never received").when(F.col("shadowed"), "shadowed"))
    return df.withColumn("why_not", why).withColumn("corroborates", F.col("why_not").isNull())


def events_in_window(probes: DataFrame, events: DataFrame, window_s: int = V.CORROBORATION_S) -> DataFrame:
    """Per probe row, how many events of its element lie before it and at most `window_s` back.

    Running counts at the window's two ends, so the work is linear: no probe is paired with events.
    """
    keys, cols = ["ie_id"], ["ts", "_at", *BY_POSITION.cols, "_side"]
    pos = [F.col(c) for c in BY_POSITION.cols]
    zero = F.lit(0).cast("bigint")
    events = events.select("ie_id", "ts", F.lit(1).alias("_at"), *pos, F.lit(1).alias("_side"),
                           F.lit(1).cast("bigint").alias("_n"), F.col("corroborates").cast("bigint").alias("_c"),
                           F.lit(None).cast("string").alias("_probe"), F.lit(0).alias("_sign"))
    ends = F.explode(F.array(
        F.struct(F.col("ts").alias("t"), F.lit(1).alias("at"), F.lit(1).alias("sign")),
        F.struct((F.col("ts") - window_s).alias("t"), F.lit(0).alias("at"), F.lit(-1).alias("sign"))))
    points = (probes.select("ie_id", *pos, F.col("block_id").alias("_probe"), ends.alias("w"))
              .select("ie_id", F.col("w.t").alias("ts"), F.col("w.at").alias("_at"), *pos, F.lit(0).alias("_side"),
                      zero.alias("_n"), zero.alias("_c"), "_probe", F.col("w.sign").alias("_sign")))
    order = ordered.Order(tuple(cols), "ts", "wf_index")
    both = ordered.scan(events.unionByName(points), keys, order, {
        "_events": ordered.total(F.col("_n")), "_good": ordered.total(F.col("_c"))})
    sums = (both.filter("_probe IS NOT NULL").groupBy(F.col("_probe").alias("block_id"))
            .agg(F.sum(F.col("_events") * F.col("_sign")).alias("events"), F.sum(F.col("_good") * F.col("_sign")).alias("corroborating")))
    return probes.join(sums, "block_id")


def drift(context: DataFrame, latest: DataFrame, epsilon: float = V.DRIFT_EPSILON) -> DataFrame:
    """Elements whose context score differs from the ledger's, or cannot be read."""
    df = context.select("ie_id", F.col("trust_score").alias("context_score")).join(
        latest.select("ie_id", "block_id", F.col("score").alias("ledger_score")), "ie_id")
    delta = F.round(F.col("context_score") - F.col("ledger_score"), 6)
    return (df.withColumn("delta", delta)
            .filter(F.col("context_score").isNull() | (F.abs(F.col("context_score") - F.col("ledger_score")) > epsilon)))


def drift_episodes(log: DataFrame, grace_s: int = V.DRIFT_GRACE_S) -> DataFrame:
    """Runs of consecutive diverging observations (ie_id, at_ms, id, diverging): start, end, first alert.

    An observation that agrees ends the run; a gap in the log neither starts nor ends one."""
    by_time = ordered.Order(("at_ms", "id"), "at_ms", "id")
    seen = ordered.scan(log, ["ie_id"], by_time, {"_was": last(F.col("diverging"))})
    starts = seen.withColumn("_start", F.when(F.col("diverging") & ~F.coalesce("_was", F.lit(False)), F.col("at_ms")))
    runs = ordered.scan(starts, ["ie_id"], by_time, {"_since": last(F.col("_start"), F.col("_start").isNotNull())})
    rows = runs.filter("diverging").withColumn("since_ms", F.coalesce("_start", "_since"))
    return rows.groupBy("ie_id", "since_ms").agg(
        F.max("at_ms").alias("until_ms"), F.count(F.lit(1)).alias("observations"),
        F.min(F.when(F.col("at_ms") - F.col("since_ms") > grace_s * 1000, F.col("at_ms"))).alias("alert_ms"))


def silent(latest: DataFrame, milestones: DataFrame, as_of_s: int, threshold_s: int = V.STALE_S) -> DataFrame:
    """Elements without a score for more than the threshold, on the ledger's clock."""
    clock = milestones.agg(F.max_by("ts", "idx").alias("_last")).select(F.least(F.lit(as_of_s), F.coalesce("_last", F.lit(as_of_s))).alias("_ref"))
    df = latest.join(F.broadcast(clock)).withColumn("silent_s", F.col("_ref") - F.col("ts"))
    return df.filter((F.col("ts") > 0) & (F.col("silent_s") > threshold_s)).drop("_ref")


def silences(messages: DataFrame, threshold_s: int = V.STALE_S) -> DataFrame:
    """Every stretch between two consecutive scores of an element longer than the threshold."""
    rows = valid_scores(messages)
    df = ordered.scan(rows, ["ie_id"], BY_POSITION, {"next_ts": last(F.col("ts"))}, backwards=True)
    return df.filter(F.col("next_ts") - F.col("ts") > threshold_s).select("ie_id", "block_id", "ts", "next_ts")


def lineage(messages: DataFrame, alerts: DataFrame, context: DataFrame, epsilon: float = V.DRIFT_EPSILON) -> DataFrame:
    """Every message about an element with its score and position in order, and per element the score
    the ledger vouches for (producer-signed, not distrusted) and whether the context drifts from it."""
    rows = messages.filter("ie_id IS NOT NULL")
    bad = alerts.filter(F.col("rule").isin(*V.DISTRUST_RULES)).select("block_id")
    rows = documents.flag(rows, "block_id", bad, "distrusted")
    vouched = (F.col("verdict") == "PRODUCER_SIGNED") & F.col("score").isNotNull() & ~F.col("distrusted")
    place = F.struct(*BY_POSITION.cols)
    heads = rows.groupBy("ie_id").agg(F.max_by("score", F.when(vouched, place)).alias("ledger_score"))
    heads = (heads.join(context.select("ie_id", "trust_score"), "ie_id", "left")
             .withColumn("drift", F.abs(F.col("trust_score") - F.col("ledger_score")) > epsilon))
    numbered = ordered.rank_by(rows, ["ie_id"], BY_POSITION, sizes=messages)
    return numbered.join(heads, "ie_id").select("ie_id", "position", "block_id", "verdict", "score", "ledger_score", "drift")


def overlays(alerts: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """Alerts and incidents of elements as marks on a time axis. With incidents, whose ids are text, all ids are."""
    none = F.lit(None).cast("bigint")
    marks = alerts.filter("ie_id IS NOT NULL").select(
        "ie_id", F.lit("alert").alias("kind"), "id", F.col("at_ms").alias("start_ms"), none.alias("end_ms"),
        F.col("rule").alias("label"), "severity", "block_id")
    if incidents is not None:
        marks = marks.withColumn("id", F.col("id").cast("string")).unionByName(incidents.filter("ie_id IS NOT NULL").select(
            "ie_id", F.lit("incident").alias("kind"), F.col("incident").alias("id"), F.col("opened_ms").alias("start_ms"),
            F.col("closed_ms").alias("end_ms"), F.col("title").alias("label"), "severity", F.col("closed_by").alias("block_id")))
    return marks
