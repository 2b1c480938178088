"""Integrity rules. Each rule is a function from tables to alerts; `RULES` lists them by name.

An alert is rule, severity, block_id, ie_id, at_ms, dedupe_key, evidence (JSON text). Times are
parameters (`as_of_ms`), never the wall clock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import hashing as H
from ..functions import vocabulary as V
from ..operators import anchors as A
from ..operators import chain, documents, lifecycle, ordered, reconcile, scores
from ..session import settle
from ..sources import loads


@dataclass
class Tables:
    """What the rules read. A rule whose tables are missing is skipped by `run`."""

    messages: DataFrame
    submissions: DataFrame
    alerts: DataFrame
    policy: DataFrame
    as_of_ms: int
    context: DataFrame | None = None
    milestones: DataFrame | None = None
    drift_log: DataFrame | None = None
    anchors: DataFrame | None = None
    records: DataFrame | None = None
    validations: DataFrame | None = None
    ledger: DataFrame | None = None
    candidates: DataFrame | None = None
    received: DataFrame | None = None


def alert(rows: DataFrame, rule: str | Column, at_ms: Column, evidence: dict[str, Column], *, block: str | None = "block_id",
          ie: str | None = "ie_id", dedupe: Column | None = None) -> DataFrame:
    text = F.lit(None).cast("string")
    name = F.lit(rule) if isinstance(rule, str) else rule
    severity = F.create_map(*[F.lit(x) for pair in V.SEVERITY_OF_RULE.items() for x in pair])[name]
    return rows.select(name.alias("rule"), severity.alias("severity"), (F.col(block) if block else text).alias("block_id"),
                       (F.col(ie) if ie else text).alias("ie_id"), at_ms.cast("bigint").alias("at_ms"),
                       (text if dedupe is None else dedupe).alias("dedupe_key"), C.evidence(**evidence).alias("evidence"))


def _at() -> Column:
    return F.col("ts") * 1000


def explained(t: Tables) -> DataFrame:
    """FORGED, UNAUTHORIZED_WRITER, MALFORMED, REVOKED_KEY and REPLAY verdicts, with what explains them."""
    rows = t.messages.filter(F.col("verdict").isin("FORGED", "UNAUTHORIZED_WRITER", "REPLAY", "MALFORMED", "REVOKED_KEY"))
    replays = rows.filter("verdict = 'REPLAY'")
    proven = t.messages.filter(C.proven(F.col("verdict")))
    place = F.struct("ms_index", "wf_index", "block_id")
    by_seq = proven.groupBy("iss", "seq").agg(F.min(place)["block_id"].alias("_seq_block"))
    by_nonce = proven.filter("nonce IS NOT NULL").groupBy("iss", "nonce").agg(F.min(place)["block_id"].alias("_nonce_block"))
    replays = replays.join(by_seq, ["iss", "seq"], "left").join(by_nonce, ["iss", "nonce"], "left")
    empty = F.lit(None).cast("string")
    rest = rows.filter("verdict <> 'REPLAY'").withColumn("_seq_block", empty).withColumn("_nonce_block", empty)
    rows = rest.unionByName(replays.select(*rest.columns)).join(F.broadcast(t.policy.select("tag", F.col("allowed").alias("_allowed"))), "tag", "left")
    reason = (F.when(F.col("verdict") == "UNAUTHORIZED_WRITER", F.concat(F.lit("policy lets others write "), "tag", F.lit(", not "), "iss"))
              .when(F.col("verdict") == "REVOKED_KEY", "the key was revoked by the end of that second")
              .when(F.col("_seq_block").isNotNull(), F.concat(F.lit("same seq as "), "_seq_block"))
              .when(F.col("_nonce_block").isNotNull(), F.concat(F.lit("same nonce as "), "_nonce_block"))
              .when(F.col("verdict") == "REPLAY", "a replay when it arrived")
              .when(F.col("verdict") == "MALFORMED", F.concat(F.lit("not a valid "), "kind", F.lit(" body")))
              .otherwise("no published key fits the signature"))
    if "reason" in rows.columns:
        reason = F.coalesce("reason", reason)
    return alert(rows, F.col("verdict"), _at(), {
        "tag": F.col("tag"), "iss": F.col("iss"), "kid": F.col("kid"), "seq": F.col("seq"), "nonce": F.col("nonce"), "iatMs": F.col("iat"),
        "includedAtMs": C.confirmed_ms(F.col("ts")), "earlierBlocks": F.array_distinct(F.array_compact(F.array("_seq_block", "_nonce_block"))),
        "allowed": F.when(F.col("verdict") == "UNAUTHORIZED_WRITER", C.cut_items(F.coalesce("_allowed", F.array().cast("array<string>")))),
        "reason": C.cut_text(reason)})


def unsigned(t: Tables) -> DataFrame:
    rows = documents.with_writer_rule(t.messages.filter(F.col("verdict") == V.UNSIGNED), t.policy).filter("signature_required")
    return alert(rows, "UNSIGNED", _at(), {"tag": F.col("tag"), "reason": F.lit("unsigned where the policy wants a signature")})


def _trusted_content(t: Tables) -> DataFrame:
    df = documents.with_writer_rule(t.messages, t.policy)
    return df.filter(C.proven(F.col("verdict")) | ((F.col("verdict") == V.UNSIGNED) & ~F.col("signature_required")))


def score_verdicts(policy: DataFrame) -> tuple[str, ...]:
    """Verdicts whose scores count: unsigned ones too unless the policy asks for signatures on scores."""
    rule = policy.filter(F.col("tag") == V.SCORE_KIND).select("require_signature", "legacy_grace").head()
    needs = rule is not None and rule["require_signature"] and not rule["legacy_grace"]
    return V.PROVEN_VERDICTS if needs else (*V.PROVEN_VERDICTS, V.UNSIGNED)


def drifted(t: Tables) -> DataFrame:
    """DRIFT from a log of observations (ie_id, at_ms, id, diverging): one alert per episode past the grace."""
    episodes = scores.drift_episodes(t.drift_log).filter(F.col("alert_ms").isNotNull())
    latest = scores.latest_scores(t.messages, score_verdicts(t.policy), t.alerts)
    rows = episodes.join(latest.select("ie_id", "block_id", "score"), "ie_id")
    return alert(rows, "DRIFT", F.col("alert_ms"), {
        "ledgerScore": F.col("score"), "ledgerBlockId": F.col("block_id"), "divergingSinceMs": F.col("since_ms"),
        "reason": F.lit("context and ledger hold different scores")},
        dedupe=F.concat(F.lit("since:"), F.col("since_ms").cast("string")))


def unknown_ie(t: Tables) -> DataFrame:
    rows = _trusted_content(t).filter("ie_id IS NOT NULL").join(t.context.select("ie_id"), "ie_id", "left_anti")
    first = ordered.latest(rows, ["ie_id"], *[F.col(c) for c in ordered.BY_POSITION.cols])
    return alert(first, "UNKNOWN_IE", _at(), {
        "ieId": F.col("ie_id"), "tag": F.col("tag"), "reason": F.lit("the context has no element with this id")})


def anomalies(t: Tables, threshold: float = V.JUMP, window_s: int = V.CORROBORATION_S) -> DataFrame:
    """Score jumps no security event of the element explains in the window before."""
    verdicts = score_verdicts(t.policy)
    rows = _trusted_content(t).filter("ie_id IS NOT NULL")
    df = scores.with_previous_score(rows, scores.score_eligible(verdicts), sizes=t.messages)
    df = df.filter(F.col("score").between(0, 1)).withColumn("delta", F.col("score") - F.col("previous_score"))
    df = df.filter(F.abs("delta") > threshold)
    events = scores.security_events(t.messages, t.alerts, t.submissions, t.policy)
    df = scores.events_in_window(df, events, window_s).filter("corroborating = 0")
    return alert(df, "ANOMALY", _at(), {
        "score": F.col("score"), "previousScore": F.col("previous_score"), "delta": F.round("delta", 6), "threshold": F.lit(threshold),
        "previousBlockId": F.col("previous_block_id"), "windowS": F.lit(window_s), "ignoredEvents": F.col("events"),
        "reason": F.lit("score moved with no corroborating security event for this element in the preceding window")})


def stale(t: Tables, threshold_s: int = V.STALE_S) -> DataFrame:
    latest = scores.latest_scores(t.messages, score_verdicts(t.policy))
    rows = scores.silent(latest, t.milestones, t.as_of_ms // 1000, threshold_s)
    return alert(rows, "STALE", F.lit(t.as_of_ms), {
        "lastScoreTsMs": F.col("ts") * 1000, "lastBlockId": F.col("block_id"), "silentS": F.col("silent_s"), "thresholdS": F.lit(threshold_s),
        "reason": F.concat(F.lit("no trust score on the ledger for "), F.col("silent_s").cast("string"), F.lit(" s"))},
        dedupe=F.concat(F.lit("window:"), F.col("ts").cast("string"), F.lit(f"+{threshold_s}")))


def anchor_alerts(t: Tables, grace_s: int = V.UNVERIFIABLE_GRACE_S, doc_kind: str | None = None) -> DataFrame:
    """ANCHOR_MISMATCH, and ANCHOR_UNVERIFIABLE past the grace (since `since_ms`, else the anchor's own time).

    With `doc_kind` the records carry all hashed fields, and their hashes are recomputed."""
    states = A.audit(t.anchors, t.records, t.milestones, doc_kind=doc_kind)
    since = F.col("since_ms") if "since_ms" in t.anchors.columns else F.col("at_ms")
    rows = states.join(t.anchors.select("seq", since.alias("since_ms"), F.col("checkpoint_hash").alias("mirror")), "seq")
    seq = F.col("seq").cast("string")
    bad = alert(rows.filter("state = 'mismatch'"), "ANCHOR_MISMATCH", F.lit(t.as_of_ms), {
        "seq": F.col("seq"), "from": F.col("from_ms"), "to": F.col("to_ms"), "recordRoot": F.col("record_root"),
        "recomputedRoot": F.col("recomputed_root"), "reason": F.when(F.col("detail") == "root",
            "the milestones of this window do not hash to the anchored root").when(
            F.col("detail") == "hash", "the recorded checkpoint does not hash to what it states").otherwise("the mirrored checkpoint differs from the recorded one")},
        block=None, ie=None, dedupe=F.when(F.col("detail") == "root", F.concat(F.lit("seq:"), seq, F.lit(":root:"), F.substr("recomputed_root", F.lit(3))))
        .when(F.col("detail") == "hash", F.concat(F.lit("seq:"), seq, F.lit(":hash:"), "mirror"))
        .otherwise(F.concat(F.lit("seq:"), seq, F.lit(":mirror:"), "mirror")))
    late = rows.filter((F.col("state") == "unverifiable") & (F.lit(t.as_of_ms) - F.col("since_ms") > grace_s * 1000))
    overdue = alert(late, "ANCHOR_UNVERIFIABLE", F.lit(t.as_of_ms), {
        "seq": F.col("seq"), "unverifiableSinceMs": F.col("since_ms"), "graceS": F.lit(grace_s), "detail": F.col("detail"),
        "reason": F.lit("this anchor could not be checked for longer than the grace period")}, block=None, ie=None,
        dedupe=F.concat(F.lit("seq:"), seq, F.lit(":since:"), F.col("since_ms").cast("string")))
    return bad.unionByName(overdue)


def clock_skew(t: Tables, limit_s: int = V.SKEW_S) -> DataFrame:
    rows = t.messages.filter(C.proven(F.col("verdict")) & C.clock_skewed(F.col("iat"), F.col("ts"), limit_s))
    skew = F.col("iat") - F.col("ts") * 1000
    return alert(rows, "CLOCK_SKEW", _at(), {
        "iatMs": F.col("iat"), "milestoneTsMs": _at(), "skewS": F.abs(skew) / 1000, "limitS": F.lit(limit_s),
        "reason": F.concat(F.lit("signed "), F.when(skew > 0, "after").otherwise("before"), F.lit(" the time of its milestone"))})


def chains(t: Tables) -> DataFrame:
    """CHAIN_FORK, else CHAIN_GAP, as seen when each message arrived."""
    linked = t.messages.select(*chain.PLACED, "prev", "ie_id")
    forks = settle(chain.siblings(linked, arrived=True), "forks")  # few rows, asked twice
    fork = alert(forks, "CHAIN_FORK", _at(), {
        "iss": F.col("iss"), "seq": F.col("seq"), "prev": F.col("prev"), "siblings": F.col("siblings"), "lastSibling": F.col("sibling"),
        "reason": F.lit("two successors of one block")})
    heads = chain.heads_on_arrival(linked.withColumn("prev", H.packed(F.col("prev")))).withColumn("prev", H.unpacked(F.col("prev")))
    heads = heads.filter("prev IS NOT NULL AND head_block IS NOT NULL AND head_block <> prev")
    gaps = heads.join(forks.select("block_id"), "block_id", "left_anti")
    gaps = documents.flag(gaps, "prev", t.messages.select(F.col("block_id")), "known")
    gap = alert(gaps, "CHAIN_GAP", _at(), {
        "iss": F.col("iss"), "seq": F.col("seq"), "prev": F.col("prev"), "expectedPrev": F.col("head_block"), "lastSeenSeq": F.col("head_seq"),
        "prevIndexed": F.col("known"), "reason": F.when(F.col("known"), "skips over later blocks")
        .otherwise("its predecessor is unknown")})
    return fork.unionByName(gap)


def orphaned(t: Tables) -> DataFrame:
    rows = lifecycle.orphaned(t.submissions, t.validations, t.as_of_ms)
    return alert(rows, "ORPHANED", F.lit(t.as_of_ms), {
        "answeredPolls": F.col("answered"), "solid": F.col("solid"), "timeoutS": F.lit(V.ORPHAN_S)}, ie=None)


def shadow(t: Tables, since_ms: int | None = None, exempt: tuple[str, ...] = ()) -> DataFrame:
    rows = reconcile.shadow_candidates(t.messages, t.submissions, t.alerts, since_ms, t.as_of_ms - V.SHADOW_GRACE_S * 1000, exempt)
    return alert(rows, "SHADOW", F.lit(t.as_of_ms), {
        "tag": F.col("tag"), "iss": F.col("iss"), "verdict": F.col("verdict"), "msIndex": F.col("ms_index"), "confirmedAtMs": F.col("confirmed_ms"),
        "baselineMs": F.col("baseline_ms"), "reason": F.lit("on the ledger without a submission")})


def content(t: Tables) -> DataFrame:
    """CONTENT_MISMATCH and NOT_FOUND: what was received against the block served (`ledger` with raw)."""
    rows = reconcile.content_check(t.received, t.ledger).filter("result <> 'MATCH'")
    name = F.when(F.col("result") == "NOT_FOUND", "NOT_FOUND").otherwise("CONTENT_MISMATCH")
    return alert(rows, name, F.lit(t.as_of_ms), {"fields": F.col("fields"), "firstDiffOffset": F.col("first_diff")}, ie=None)


def tampered(t: Tables) -> DataFrame:
    """DB_TAMPER: one alert per block and stored content that differs from the ledger."""
    rows = reconcile.tampered(t.candidates, t.ledger)
    one = rows.groupBy("block_id", "reason").agg(F.array_sort(F.collect_list(F.struct("field", "expected", "actual"))).alias("fields"))
    stored = F.sha2(F.to_json(F.transform("fields", lambda f: F.struct(f["field"].alias("f"), f["actual"].alias("a")))), 256)
    return alert(one, "DB_TAMPER", F.lit(t.as_of_ms), {"reason": F.col("reason"), "fields": F.transform("fields", lambda f: F.struct(
        f["field"].alias("field"), C.cut_text(f["expected"]).alias("expected"), C.cut_text(f["actual"]).alias("actual")))}, ie=None,
        dedupe=F.concat("block_id", F.lit(":"), stored))


def missing(t: Tables) -> DataFrame:
    rows = reconcile.missing_messages(t.ledger, t.messages)
    return alert(rows, "MISSING_IN_DB", F.lit(t.as_of_ms), {"reason": F.lit("on the ledger, not in the store")}, ie=None)


# name -> (rule, tables it needs beyond messages, submissions, alerts, policy)
RULES: dict[str, tuple[Callable[[Tables], DataFrame], tuple[str, ...]]] = {
    "explained": (explained, ()),
    "unsigned": (unsigned, ()),
    "unknown_ie": (unknown_ie, ("context",)),
    "anomaly": (anomalies, ()),
    "clock_skew": (clock_skew, ()),
    "chain": (chains, ()),
    "drift": (drifted, ("drift_log",)),
    "stale": (stale, ("milestones",)),
    "anchor": (anchor_alerts, ("anchors", "records", "milestones")),
    "shadow": (shadow, ()),
    "orphaned": (orphaned, ("validations",)),
    "content": (content, ("received", "ledger")),
    "tampered": (tampered, ("candidates", "ledger")),
    "missing": (missing, ("ledger",)),
}


def run(t: Tables, names: tuple[str, ...] | None = None) -> DataFrame:
    """Every rule whose tables are given; only alerts not stored yet, once each."""
    out = None
    for name, (rule, needs) in RULES.items():
        if (names is None or name in names) and all(getattr(t, n) is not None for n in needs):
            found = rule(t)
            out = found if out is None else out.unionByName(found)
    return loads.insert_alerts(t.alerts, out)
