"""Verdicts, rules, lifecycle and audits as whole jobs."""

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import lifecycle, ordered, reconcile
from ..plans import proofs, rules, verdicts
from .joins import AUDIT_SQL, DOC_KIND, HASHED_AUDIT_SQL, TAMPER_SQL, hashed_anchors, records
from .registry import query

AS_OF = 1706700000000
PROVEN = "verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED')"


def tables(t, **more):
    base = dict(messages=t.messages, submissions=t.submissions, alerts=t.shadow_alerts.unionByName(t.unsigned_alerts), policy=t.policy, as_of_ms=AS_OF)
    return rules.Tables(**{**base, **more})


SHORT = ["rule", "severity", "block_id", "ie_id", "dedupe_key"]


def signed_envelopes(t):
    return t.envelopes.select("block_id", "tag", F.col("envelope").alias("data"), "ms_index", "wf_index", "ts", (F.col("n") % 50 != 0).alias("sig_ok"),
                              (F.col("n") % 97 == 5).alias("too_deep"), "n")


@query("r0_verdict")
def r0(t):
    return verdicts.judge(signed_envelopes(t), t.policy, t.key_history).select("block_id", "verdict", "reason")


@query("r0_verdict_before_replay", """SELECT block_id, CASE WHEN n % 97 = 5 THEN 'MALFORMED' WHEN n % 13 = 0 THEN 'UNSIGNED_LEGACY' WHEN n % 53 = 0 OR n % 59 = 0 OR n % 61 = 0 OR (n % 83 = 0 AND n % 11 <> 0) THEN 'MALFORMED'
    WHEN n % 71 = 0 OR n % 50 = 0 THEN 'FORGED' WHEN iss = 'did:x:7' AND ts >= 1705449599 + 0 AND (ts + 1) * 1000 > 1704067200000 + 16 * 86400000 THEN 'REVOKED_KEY'
    WHEN NOT coalesce(list_contains(allowed, '*') OR list_contains(allowed, iss), FALSE) THEN 'UNAUTHORIZED_WRITER' ELSE 'open' END AS verdict FROM envelopes LEFT JOIN policy USING (tag)""")
def r0b(t):
    df = verdicts.judge(signed_envelopes(t), t.policy, t.key_history)
    late = F.col("verdict").isin("REPLAY", "PRODUCER_SIGNED", "RELAY_ATTESTED")
    return df.select("block_id", F.when(late, "open").otherwise(F.col("verdict")).alias("verdict"))


@query("r1_explained_verdicts", "SELECT rule, severity, block_id, ie_id, dedupe_key FROM verdict_alerts")
def r1(t):
    return rules.explained(tables(t)).select(*SHORT)


@query("r3_replay_alerts", f"""SELECT 'REPLAY' AS rule, 'high' AS severity, concat('again-', block_id) AS block_id, [block_id] AS earlier
    FROM messages WHERE {PROVEN} AND n % 19 = 0 AND seq = (SELECT count(*) FROM messages m WHERE m.iss = messages.iss AND m.n <= messages.n)""")
def r3(t):
    """Every nineteenth proven message is sent again: same seq and nonce, another block, a later milestone. The verdict is found, not planted."""
    own = chain_of(t)
    again = own.filter("n % 19 = 0").withColumns({"block_id": F.concat(F.lit("again-"), "block_id"), "ms_index": F.col("ms_index") + 100_000})
    both = own.unionByName(again)
    replays = verdicts.resolve_replays(both.withColumn("spends", F.lit(True))).select("block_id", F.lit("REPLAY").alias("_v"))
    judged = both.join(replays, "block_id", "left").withColumn("verdict", F.coalesce("_v", "verdict")).drop("_v")
    found = rules.explained(tables(t, messages=judged)).filter("rule = 'REPLAY'")
    return found.select("rule", "severity", "block_id", F.from_json(F.get_json_object("evidence", "$.earlierBlocks"), "array<string>").alias("earlier"))


def chain_of(t):
    """Proven messages that keep their place in their issuer's sequence (the fixture gives some the seq of the one before)."""
    place = t.messages.join(ordered.rank_by(t.messages.select("iss", "n"), ["iss"], ordered.Order(("n",), "n"), "_at"), ["iss", "n"])
    return place.filter(f"{PROVEN} AND seq = _at + 1").drop("_at")


@query("r4_unsigned", "SELECT 'UNSIGNED' AS rule, block_id, tag FROM messages WHERE verdict = 'UNSIGNED_LEGACY' AND tag = 'trust.score'")
def r4(t):
    a = rules.unsigned(tables(t))
    return a.select("rule", "block_id", F.get_json_object("evidence", "$.tag").alias("tag"))


LOG_SQL = f"""SELECT m.ie_id, m.ts * 1000 AS at_ms, m.n AS id, c.trust_score IS NULL OR abs(c.trust_score - m.score) > 0.3 AS diverging
    FROM messages m JOIN context_ie c USING (ie_id) WHERE m.score IS NOT NULL AND {PROVEN}"""
EPISODES_SQL = f"""WITH o AS ({LOG_SQL}), f AS (SELECT *, CASE WHEN diverging AND NOT coalesce(lag(diverging) OVER (PARTITION BY ie_id ORDER BY at_ms, id), FALSE) THEN 1 ELSE 0 END AS s FROM o),
    g AS (SELECT *, sum(s) OVER (PARTITION BY ie_id ORDER BY at_ms, id) AS run FROM f), h AS (SELECT ie_id, run, min(at_ms) AS since_ms, max(at_ms) AS until_ms, count(*) AS observations FROM g WHERE diverging GROUP BY ie_id, run)
    SELECT h.ie_id, since_ms, until_ms, observations, (SELECT min(at_ms) FROM g WHERE g.ie_id = h.ie_id AND g.run = h.run AND g.diverging AND at_ms - since_ms > 150000) AS alert_ms FROM h"""


def drift_log(t):
    m = t.messages.filter(f"score IS NOT NULL AND {PROVEN}").join(t.context_ie.select("ie_id", "trust_score"), "ie_id")
    return m.select("ie_id", (F.col("ts") * 1000).alias("at_ms"), F.col("n").alias("id"),
                    (F.col("trust_score").isNull() | (F.abs(F.col("trust_score") - F.col("score")) > 0.3)).alias("diverging"))


@query("w12_drift_episodes", EPISODES_SQL)
def w12(t):
    from ..operators import scores
    return scores.drift_episodes(drift_log(t))


@query("r5_drift", f"""SELECT 'DRIFT' AS rule, ie_id, concat('since:', CAST(since_ms AS VARCHAR)) AS dedupe_key, alert_ms AS at_ms FROM ({EPISODES_SQL})
    WHERE alert_ms IS NOT NULL AND ie_id IN (SELECT ie_id FROM messages WHERE score IS NOT NULL AND {PROVEN} AND block_id NOT IN (SELECT block_id FROM alerts WHERE rule IN ('SHADOW', 'UNSIGNED')))""")
def r5(t):
    return rules.drifted(tables(t, drift_log=drift_log(t))).select("rule", "ie_id", "dedupe_key", "at_ms")


TRUSTED = f"({PROVEN} OR (verdict = 'UNSIGNED_LEGACY' AND tag <> 'trust.score'))"


@query("r6_unknown_ie", f"""SELECT 'UNKNOWN_IE' AS rule, ie_id, block_id FROM (SELECT *, row_number() OVER (PARTITION BY ie_id ORDER BY ms_index, wf_index) AS rn FROM messages
    WHERE ie_id IS NOT NULL AND {TRUSTED} AND ie_id NOT IN (SELECT ie_id FROM context_ie)) WHERE rn = 1""")
def r6(t):
    return rules.unknown_ie(tables(t, context=t.context_ie)).select("rule", "ie_id", "block_id")


JUMP_SQL = f"""SELECT block_id, ie_id, score, pscore AS previous_score, score - pscore AS delta, ts, ms_index, wf_index FROM (SELECT *, lag(score) OVER (PARTITION BY ie_id ORDER BY ms_index, wf_index) AS pscore
    FROM messages WHERE score IS NOT NULL AND {PROVEN}) WHERE abs(score - pscore) > 0.3"""


@query("w2_jump", f"SELECT block_id, score, previous_score, delta FROM ({JUMP_SQL})")
def w2(t):
    from ..operators import scores
    return scores.jumps(t.messages).select("block_id", "score", "previous_score", "delta")


@query("r7_anomaly", f"""WITH j AS ({JUMP_SQL}), ev AS (SELECT * FROM messages WHERE tag = 'self-orchestrator' AND error_code <> 0 AND ({PROVEN} OR (verdict = 'UNSIGNED_LEGACY'
      AND block_id IN (SELECT block_id FROM submissions) AND block_id NOT IN (SELECT block_id FROM shadow_alerts))))
    SELECT 'ANOMALY' AS rule, block_id, ie_id FROM j WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.ie_id = j.ie_id AND ev.ts BETWEEN j.ts - 36000 AND j.ts AND (ev.ms_index, ev.wf_index) < (j.ms_index, j.wf_index))""")
def r7(t):
    return rules.anomalies(tables(t), window_s=36000).select("rule", "block_id", "ie_id")


@query("r8_stale", f"""WITH c AS (SELECT max(ts) AS ref FROM milestones), l AS (SELECT ie_id, max(ts) AS ts FROM messages WHERE score IS NOT NULL AND {PROVEN} GROUP BY ie_id)
    SELECT 'STALE' AS rule, ie_id, concat('window:', CAST(ts AS VARCHAR), '+120') AS dedupe_key FROM l, c WHERE ref - ts > 120""")
def r8(t):
    return rules.stale(tables(t, milestones=t.milestones)).select("rule", "ie_id", "dedupe_key")


@query("w13_silences", f"""SELECT ie_id, block_id, ts, next_ts FROM (SELECT *, lead(ts) OVER (PARTITION BY ie_id ORDER BY ms_index, wf_index) AS next_ts FROM messages WHERE score IS NOT NULL AND {PROVEN}) WHERE next_ts - ts > 120""")
def w13(t):
    from ..operators import scores
    return scores.silences(t.messages)


@query("r11_anchors", """WITH r AS (SELECT seq, ms_root, CASE WHEN seq % 11 = 3 THEN concat(checkpoint_hash, '0') ELSE checkpoint_hash END AS h FROM anchors WHERE seq % 13 <> 12),
    s AS (SELECT a.seq, a.at_ms, a.checkpoint_hash, w.root, CASE WHEN r.seq IS NULL THEN 'u' WHEN w.root <> r.ms_root THEN 'root' WHEN a.checkpoint_hash <> r.h THEN 'mirror' WHEN w.root IS NULL THEN 'u' END AS d
      FROM anchors a LEFT JOIN r USING (seq) LEFT JOIN (SELECT w AS seq, root FROM wtree_root) w USING (seq))
    SELECT CASE WHEN d = 'u' THEN 'ANCHOR_UNVERIFIABLE' ELSE 'ANCHOR_MISMATCH' END AS rule, CASE d WHEN 'u' THEN concat('seq:', CAST(seq AS VARCHAR), ':since:', CAST(at_ms AS VARCHAR))
      WHEN 'root' THEN concat('seq:', CAST(seq AS VARCHAR), ':root:', substr(root, 3)) ELSE concat('seq:', CAST(seq AS VARCHAR), ':mirror:', checkpoint_hash) END AS dedupe_key
    FROM s WHERE d IN ('root', 'mirror') OR (d = 'u' AND 1706700000000 - at_ms > 600000)""")
def r11(t):
    return rules.anchor_alerts(tables(t, anchors=t.anchors, records=records(t), milestones=t.milestones)).select("rule", "dedupe_key")


@query("r11_anchors_hashed", f"""SELECT CASE WHEN state = 'mismatch' THEN 'ANCHOR_MISMATCH' ELSE 'ANCHOR_UNVERIFIABLE' END AS rule, seq,
    CASE WHEN state = 'mismatch' THEN detail ELSE 'since' END AS what FROM ({HASHED_AUDIT_SQL}) WHERE state <> 'verified'""")
def r11b(t):
    shown, records_ = hashed_anchors(t)
    shown = shown.withColumn("at_ms", F.lit(0).cast("bigint"))
    found = rules.anchor_alerts(tables(t, anchors=shown, records=records_, milestones=t.milestones), doc_kind=DOC_KIND)
    part = F.split("dedupe_key", ":")
    return found.select("rule", part[1].cast("bigint").alias("seq"), part[2].alias("what"))


@query("r12_clock_skew", f"SELECT block_id, ie_id, abs(iat - ts * 1000) / 1000e0 AS skew_s FROM messages WHERE {PROVEN} AND abs(iat - ts * 1000) > 300000")
def r12(t):
    a = rules.clock_skew(tables(t))
    return a.select("block_id", "ie_id", F.get_json_object("evidence", "$.skewS").cast("double").alias("skew_s"))


def polls(t):
    """Two answered polls per submission; every sixth is never referenced."""
    ok = F.col("n") % 6 == 0
    at = F.explode(F.array(F.lit(1000), F.lit(70000)))
    return t.submissions.select("block_id", "n", "received_at_ms", at.alias("d")).select(
        "block_id", (F.col("received_at_ms") + F.col("d")).alias("checked_at_ms"), F.lit(True).alias("is_solid"),
        F.when(~ok, F.lit(7).cast("bigint")).alias("referenced_by_ms"))


@query("r13_orphaned", """SELECT 'ORPHANED' AS rule, block_id FROM submissions WHERE n % 6 = 0""")
def r13(t):
    return rules.orphaned(tables(t, validations=polls(t))).select("rule", "block_id")


@query("r14_shadow", """SELECT 'SHADOW' AS rule, block_id, ie_id FROM messages WHERE n % 23 = 0 AND confirmed_at_ms >= (SELECT min(received_at_ms) FROM submissions)
    AND confirmed_at_ms <= 1706700000000 - 30000""")
def r14(t):
    return rules.shadow(tables(t, alerts=t.unsigned_alerts)).select("rule", "block_id", "ie_id")


CHAIN_SQL = f"""WITH p AS (SELECT * FROM messages WHERE {PROVEN}), h AS (SELECT a.block_id, b.block_id AS head_block, row_number() OVER (PARTITION BY a.block_id ORDER BY b.seq DESC, b.ts DESC, b.block_id) AS rn
      FROM p a JOIN p b ON a.iss = b.iss AND b.seq < a.seq AND (b.ms_index, b.wf_index) < (a.ms_index, a.wf_index) WHERE a.prev IS NOT NULL),
    f AS (SELECT DISTINCT a.block_id FROM p a JOIN p b ON a.iss = b.iss AND a.prev = b.prev AND (b.ms_index, b.wf_index) < (a.ms_index, a.wf_index))
    SELECT 'CHAIN_FORK' AS rule, block_id FROM f UNION ALL SELECT 'CHAIN_GAP', p.block_id FROM p JOIN h ON h.block_id = p.block_id AND rn = 1
    WHERE head_block <> prev AND p.block_id NOT IN (SELECT block_id FROM f)"""


@query("r15_chain", CHAIN_SQL)
def r15(t):
    return rules.chains(tables(t)).select("rule", "block_id")


@query("r17_content", """SELECT CASE WHEN b.block_id IS NULL THEN 'NOT_FOUND' ELSE 'CONTENT_MISMATCH' END AS rule, s.block_id FROM stored_submissions s JOIN messages m USING (block_id)
    LEFT JOIN (SELECT * FROM blocks WHERE n % 89 <> 0) b USING (block_id) WHERE b.block_id IS NULL OR s.n % 101 = 0 OR s.data <> m.json""")
def r17(t):
    served = t.blocks.filter("n % 89 <> 0").join(t.ledger_content.select("block_id", "tag", "data"), "block_id")
    return rules.content(tables(t, received=t.stored_submissions.select("block_id", "tag", "data"), ledger=served)).select("rule", "block_id")


@query("r18_db_tamper", f"SELECT 'DB_TAMPER' AS rule, block_id FROM ({TAMPER_SQL}) GROUP BY block_id")
def r18(t):
    c = reconcile.reverify_candidates(t.content_checks, t.stored_submissions, t.stored_messages, t.lifecycle, t.alerts)
    return rules.tampered(tables(t, candidates=c, ledger=t.ledger_content)).select("rule", "block_id")


@query("r19_missing", "SELECT 'MISSING_IN_DB' AS rule, block_id FROM blocks WHERE block_id NOT IN (SELECT block_id FROM stored_messages)")
def r19(t):
    return rules.missing(tables(t, messages=t.stored_messages, ledger=t.blocks)).select("rule", "block_id")


@query("r20_distrust_overlay", "SELECT block_id, block_id IN (SELECT block_id FROM alerts WHERE rule IN ('SHADOW', 'UNSIGNED')) AS distrusted FROM messages")
def r20(t):
    from ..operators import documents
    return documents.distrusted(t.messages.select("block_id"), t.alerts)


@query("r21_rules_run", f"""SELECT rule, severity, count(*) AS n FROM (
    SELECT rule, severity FROM verdict_alerts UNION ALL SELECT rule, CASE rule WHEN 'CHAIN_FORK' THEN 'high' ELSE 'medium' END FROM ({CHAIN_SQL})
    UNION ALL SELECT 'CLOCK_SKEW', 'low' FROM messages WHERE {PROVEN} AND abs(iat - ts * 1000) > 300000) GROUP BY rule, severity""")
def r21(t):
    found = rules.run(tables(t), ("explained", "unsigned", "clock_skew", "chain"))
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


FIXED_RULES = {"ANOMALY": "medium", "UNSIGNED": "medium", "DRIFT": "medium", "ORPHANED": "high", "SHADOW": "high", "ANCHOR_MISMATCH": "critical", "CHAIN_FORK": "high",
               "CHAIN_GAP": "medium", "CONTENT_MISMATCH": "critical", "NOT_FOUND": "critical", "DB_TAMPER": "critical", "MISSING_IN_DB": "critical"}


@query("r21_rules_run_all", f"""WITH f AS (SELECT rule, severity FROM verdict_alerts UNION ALL SELECT rule, NULL FROM ({CHAIN_SQL})
    UNION ALL SELECT 'CLOCK_SKEW', NULL FROM messages WHERE {PROVEN} AND abs(iat - ts * 1000) > 300000
    UNION ALL SELECT rule, NULL FROM unsigned_alerts WHERE id % 20 <> 3
    UNION ALL SELECT 'UNKNOWN_IE', NULL FROM (SELECT DISTINCT ie_id FROM messages WHERE ie_id IS NOT NULL AND {TRUSTED} AND ie_id NOT IN (SELECT ie_id FROM context_ie))
    UNION ALL SELECT 'ANOMALY', NULL FROM ({JUMP_SQL}) j WHERE NOT EXISTS (SELECT 1 FROM messages ev WHERE ev.tag = 'self-orchestrator' AND ev.error_code <> 0 AND (ev.{PROVEN}
      OR (ev.verdict = 'UNSIGNED_LEGACY' AND ev.n % 23 <> 0)) AND ev.ie_id = j.ie_id AND ev.ts BETWEEN j.ts - 300 AND j.ts AND (ev.ms_index, ev.wf_index) < (j.ms_index, j.wf_index))
    UNION ALL SELECT 'DRIFT', NULL FROM ({EPISODES_SQL}) WHERE alert_ms IS NOT NULL
    UNION ALL SELECT 'STALE', NULL FROM (SELECT ie_id, max(ts) AS ts FROM messages WHERE score IS NOT NULL AND {PROVEN} GROUP BY ie_id) WHERE (SELECT max(ts) FROM milestones) - ts > 120
    UNION ALL SELECT CASE state WHEN 'mismatch' THEN 'ANCHOR_MISMATCH' ELSE 'ANCHOR_UNVERIFIABLE' END, NULL FROM ({AUDIT_SQL}) JOIN anchors USING (seq)
      WHERE state = 'mismatch' OR (state = 'unverifiable' AND {AS_OF} - at_ms > 600000)
    UNION ALL SELECT 'SHADOW', NULL FROM messages WHERE n % 23 = 0 AND confirmed_at_ms >= (SELECT min(received_at_ms) FROM submissions) AND confirmed_at_ms <= {AS_OF} - 30000
    UNION ALL SELECT 'ORPHANED', NULL FROM submissions WHERE n % 6 = 0
    UNION ALL SELECT 'CONTENT_MISMATCH', NULL FROM stored_submissions s JOIN messages m USING (block_id) WHERE s.n % 101 = 0 OR s.data <> m.json
    UNION ALL SELECT 'NOT_FOUND', NULL FROM stored_submissions WHERE n % 89 = 0
    UNION ALL SELECT 'DB_TAMPER', NULL FROM (SELECT DISTINCT block_id FROM ({TAMPER_SQL}))
    UNION ALL SELECT 'MISSING_IN_DB', NULL FROM blocks WHERE n % 97 = 0)
    SELECT rule, coalesce(severity, CASE {" ".join(f"WHEN rule = '{r}' THEN '{s}'" for r, s in FIXED_RULES.items())} ELSE 'low' END) AS severity, count(*) AS n FROM f GROUP BY 1, 2""")
def r21b(t):
    # all fourteen rules, with something to find for each; every second UNSIGNED alert is stored already
    content = t.served_blocks
    lost = content.filter("n % 97 = 0").withColumn("block_id", F.concat("block_id", F.lit("m")))
    received = t.stored_submissions.select("block_id", "tag", "data", "n")
    unknown = received.filter("n % 89 = 0").withColumn("block_id", F.concat("block_id", F.lit("r")))
    found = rules.run(tables(
        t, alerts=t.unsigned_alerts.filter("id % 20 = 3"), context=t.context_ie, milestones=t.milestones, drift_log=drift_log(t), anchors=t.anchors,
        records=records(t), validations=polls(t), ledger=content.unionByName(lost), received=received.unionByName(unknown).drop("n"),
        candidates=reconcile.reverify_candidates(t.content_checks, t.stored_submissions, t.stored_messages, t.lifecycle, t.alerts)))
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("r22_lifecycle_written", """SELECT block_id, status, at_ms FROM lifecycle""")
def r22(t):
    # every transition proposed twice: the second proposal of each is dropped
    again = t.lifecycle.withColumn("id", F.col("id") + 1_000_000_000).withColumn("at_ms", F.col("at_ms") + 1)
    proposed = t.lifecycle.unionByName(again).select("id", "block_id", "status", "at_ms")
    kept = lifecycle.transitions_to_write(proposed)
    return kept.select("block_id", "status", "at_ms")


@query("r22_confirmations", """SELECT m.block_id, ts * 1000 AS at_ms, ms_index FROM messages m JOIN (SELECT block_id, arg_max(status, at_ms) AS status FROM lifecycle GROUP BY block_id) l USING (block_id)
    WHERE l.status IN ('RECEIVED', 'SUBMITTED', 'SOLID', 'ORPHANED')""")
def r22b(t):
    return lifecycle.confirmations(t.lifecycle, t.messages).select("block_id", "at_ms", "ms_index")


@query("w10_status", """SELECT block_id, arg_max(status, at_ms) AS status, min(CASE WHEN status = 'CONFIRMED' THEN at_ms END) AS confirmed_at_ms FROM lifecycle GROUP BY block_id""")
def w10(t):
    return lifecycle.current_status(t.lifecycle)


STATE = "SELECT n AS id, ms_index % 30 AS seq, ts * 1000 AS at_ms, CASE WHEN n % 3 = 0 THEN 'verified' ELSE 'unverifiable' END AS state FROM messages"


@query("w11_state_since", f"""WITH s AS ({STATE}), c AS (SELECT *, state IS DISTINCT FROM lag(state) OVER (PARTITION BY seq ORDER BY at_ms, id) AS change FROM s)
    SELECT seq, arg_max(state, at_ms * 100000 + id) AS state, max(CASE WHEN change THEN at_ms END) AS since_ms FROM c GROUP BY seq""")
def w11(t):
    log = t.messages.selectExpr("n AS id", "ms_index % 30 AS seq", "ts * 1000 AS at_ms", "CASE WHEN n % 3 = 0 THEN 'verified' ELSE 'unverifiable' END AS state")
    return lifecycle.state_since(log, ["seq"])


@query("w3_trust_drop", f"""WITH f AS (SELECT m.*, coalesce(list_contains(allowed, '*') OR list_contains(allowed, iss), FALSE) AS may_write, m.block_id IN (SELECT block_id FROM alerts WHERE rule IN ('SHADOW', 'UNSIGNED')) AS bad
      FROM messages m LEFT JOIN policy USING (tag) WHERE ie_id IS NOT NULL), g AS (SELECT *, score IS NOT NULL AND NOT bad AND may_write AND verdict = 'PRODUCER_SIGNED' AS p, score IS NOT NULL AND NOT bad AND may_write AND {PROVEN} AS r FROM f),
    h AS (SELECT *, last_value(CASE WHEN p THEN score END IGNORE NULLS) OVER w AS pp, last_value(CASE WHEN r THEN score END IGNORE NULLS) OVER w AS pr FROM g
      WINDOW w AS (PARTITION BY ie_id ORDER BY ms_index, wf_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT block_id, score, CASE WHEN verdict = 'PRODUCER_SIGNED' THEN pp ELSE pr END AS previous_score FROM h
    WHERE r AND CASE WHEN verdict = 'PRODUCER_SIGNED' THEN pp ELSE pr END - score >= 0.2 - 1e-9""")
def w3(t):
    from ..operators import scores
    f = scores.trusted_flags(t.messages.filter("ie_id IS NOT NULL"), t.policy, t.alerts, t.submissions)
    return scores.drops(scores.with_trusted_previous(f, sizes=t.messages)).filter("score IS NOT NULL").select("block_id", "score", "previous_score")


CONE_SQL = """SELECT ms_index, count(*) AS n, min(p) = 0 AND max(p) = count(*) - 1 AND count(DISTINCT p) = count(*) AS in_order, count(*) FILTER (WHERE n % 101 = 0) AS bad_hashes
    FROM (SELECT ms_index, n, wf_index + CASE WHEN n % 53 = 0 THEN 1 ELSE 0 END AS p FROM blocks) GROUP BY ms_index"""


@query("w4_cone_order", CONE_SQL)
def w4(t):
    from ..operators import anchors
    moved = t.blocks.withColumn("wf_index", F.expr("wf_index + CASE WHEN n % 53 = 0 THEN 1 ELSE 0 END"))
    return anchors.cone_check(moved, H.block_id(F.col("raw")))


@query("w5_continuity", """SELECT idx, CASE WHEN NOT EXISTS (SELECT 1 FROM milestones b WHERE b.idx = a.idx - 1) THEN 'gap' ELSE 'prev' END AS problem FROM milestones a
    WHERE idx > 1 AND (idx % 1511 = 0 OR NOT EXISTS (SELECT 1 FROM milestones b WHERE b.idx = a.idx - 1))""")
def w5(t):
    from ..operators import anchors
    return anchors.continuity(t.milestones).select("idx", "problem")


@query("w6_windows", "SELECT seq - 1 AS \"window\", (seq - 1) * 720 + 1 AS from_ms, seq * 720 AS to_ms FROM windows GROUP BY seq HAVING count(*) = 720")
def w6(t):
    from ..operators import anchors
    return anchors.windows(t.milestones)


@query("w6_checkpoints", """SELECT r.w - 1 AS \"window\", root AS ms_root, (SELECT count(*) FROM messages WHERE (ms_index - 1) // 720 = r.w - 1) AS msg_count,
    (SELECT arg_min(id, idx) FROM windows WHERE seq = r.w) AS from_id FROM wtree_root r""")
def w6b(t):
    from ..operators import anchors
    return anchors.checkpoints(t.milestones, t.messages, network="n", domain="d", policy_hash="0x0").select("window", "ms_root", "msg_count", "from_id")


@query("w7_checkpoint_chain", """SELECT seq, seq % 4 <> 0 AS linked FROM anchors""")
def w7(t):
    from ..operators import anchors
    a = t.anchors.withColumn("prev_hash", F.expr("CASE WHEN seq % 4 = 0 THEN 'x' WHEN seq > 1 THEN concat('0x', sha2(concat('h', seq - 1), 256)) END"))
    return anchors.chain_breaks(a).select("seq", "linked")


@query("w7_checkpoint_hashes", """WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY r.w) AS k, r.w - 1 AS win,
      concat('{"domain":"d","from":{"id":"', (SELECT arg_min(id, idx) FROM windows WHERE seq = r.w), '","index":', (r.w - 1) * 720 + 1, '},"kind":"ledger.checkpoint","msRoot":"', root,
        '","msgCount":', (SELECT count(*) FROM messages WHERE (ms_index - 1) // 720 = r.w - 1), ',"network":"n","policyHash":"0x0","prev":') AS head,
      concat(',"to":{"id":"', (SELECT arg_max(id, idx) FROM windows WHERE seq = r.w), '","index":', r.w * 720, '},"v":1}') AS tail FROM wtree_root r),
    h AS (SELECT k, win, CAST(NULL AS VARCHAR) AS prev, concat('0x', sha256(concat(head, 'null', tail))) AS hash FROM c WHERE k = 1
      UNION ALL SELECT c.k, c.win, h.hash, concat('0x', sha256(concat(head, '"', h.hash, '"', tail))) FROM h JOIN c ON c.k = h.k + 1)
    SELECT win AS "window", prev, hash AS checkpoint_hash FROM h""")
def w7b(t):
    from ..operators import anchors
    made = anchors.checkpoints(t.milestones, t.messages, network="n", domain="d", policy_hash="0x0")
    return anchors.chained(made, DOC_KIND).select("window", "prev", "checkpoint_hash")


@query("w8_replays", """SELECT a.block_id FROM messages a WHERE EXISTS (SELECT 1 FROM messages b WHERE b.iss = a.iss AND b.seq = a.seq AND (b.ms_index, b.wf_index) < (a.ms_index, a.wf_index))""")
def w8(t):
    rows = t.messages.withColumn("spends", F.lit(True))
    return verdicts.resolve_replays(rows).select("block_id")


@query("w9_issuer_head", """SELECT sub_id, coalesce(seq > top, TRUE) AS accepted, top AS head_seq FROM (SELECT *, max(seq) OVER (PARTITION BY iss ORDER BY received_at_ms, sub_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM submissions)""")
def w9(t):
    from ..operators import chain
    return chain.issuer_heads(t.submissions).select("sub_id", "accepted", "head_seq")


@query("w14_lineage", f"""WITH m AS (SELECT *, block_id IN (SELECT block_id FROM alerts WHERE rule IN ('SHADOW', 'UNSIGNED')) AS bad FROM messages WHERE ie_id IS NOT NULL),
    h AS (SELECT ie_id, arg_max(score, ms_index * 100000 + wf_index) FILTER (WHERE score IS NOT NULL AND verdict = 'PRODUCER_SIGNED' AND NOT bad) AS ledger_score FROM m GROUP BY ie_id)
    SELECT m.ie_id, row_number() OVER (PARTITION BY m.ie_id ORDER BY ms_index, wf_index, block_id) - 1 AS position, block_id, verdict, score, ledger_score, abs(trust_score - ledger_score) > 0.01 AS drift
    FROM m JOIN h USING (ie_id) LEFT JOIN context_ie c USING (ie_id)""")
def w14(t):
    from ..operators import scores
    return scores.lineage(t.messages, t.alerts, t.context_ie)


@query("r23_milestone_audit", """WITH c AS (SELECT ms_index, count(*) AS n, count(*) FILTER (WHERE n % 101 = 0) AS bad FROM blocks GROUP BY ms_index)
    SELECT c.ms_index, c.n, bad = 0 AS hashes_ok, c.ms_index % 17 <> 0 AS root_ok, m.idx IS NULL AS missing FROM c LEFT JOIN milestones m ON m.idx = c.ms_index""")
def r23(t):
    from ..plans import milestones
    from ..operators import merkle
    roots = merkle.roots(t.messages, ["ms_index"], "wf_index", "block_id").select("ms_index", F.when(
        F.col("ms_index") % 17 == 0, "0x00").otherwise(F.col("root")).alias("inclusion_root"))
    return milestones.audit(t.blocks, t.milestones, roots, H.block_id(F.col("raw"))).select("ms_index", "n", "hashes_ok", "root_ok", "missing")


def proof_rows(t, **more):
    from ..operators import merkle
    roots = merkle.roots(t.messages, ["ms_index"], "wf_index", "block_id").select(F.col("ms_index").alias("idx"), F.col("root").alias("inclusion_root"))
    ms = t.milestones.join(roots, "idx", "left")
    return proofs.proof_table(t.blocks, ms, t.anchors, **more)


@query("r24_proofs", """SELECT b.block_id, b.n % 101 <> 0 AS consistent, CASE WHEN a.status = 'anchored' AND a.seq % 5 <> 0 AND w.root IS NOT NULL THEN a.seq END AS anchor_seq
    FROM blocks b JOIN milestones m ON m.idx = b.ms_index LEFT JOIN anchors a ON b.ms_index BETWEEN a.from_ms AND a.to_ms LEFT JOIN (SELECT w AS seq, root FROM wtree_root) w USING (seq)""")
def r24(t):
    return proof_rows(t).select("block_id", "consistent", "anchor_seq")


@query("r25_proof_audit", """SELECT b.block_id, b.n % 101 <> 0 AS block_hash, CASE WHEN b.n % 101 = 0 OR b.ms_index % 3 = 0 THEN 'INVALID' WHEN a.status = 'anchored' AND a.seq % 5 <> 0 AND w.root IS NOT NULL THEN 'VALID' ELSE 'PARTIAL' END AS overall
    FROM blocks b JOIN milestones m ON m.idx = b.ms_index LEFT JOIN anchors a ON b.ms_index BETWEEN a.from_ms AND a.to_ms LEFT JOIN (SELECT w AS seq, root FROM wtree_root) w USING (seq)""")
def r25(t):
    sigs = t.milestones.select(F.col("idx").alias("ms_index"), F.explode(F.array(F.lit("k0"), F.lit("k1"))).alias("pk")).withColumn("ok", (F.col("ms_index") % 3 != 0) | (F.col("pk") == "k0"))
    pinned = t.spark.createDataFrame([("k0",), ("k1",)], "pk string")
    p = proof_rows(t).withColumn("envelope_ok", F.lit(True))
    return proofs.audit_proofs(p, sigs, pinned, t.anchors, 2).select("block_id", "block_hash", "overall")


@query("r25_proof_audit_envelope", """WITH e AS (SELECT block_id, CASE WHEN n % 97 = 5 THEN FALSE WHEN n % 13 = 0 THEN NULL WHEN n % 53 = 0 OR n % 59 = 0 OR n % 61 = 0 OR (n % 83 = 0 AND n % 11 <> 0)
      OR n % 71 = 0 OR n % 50 = 0 OR (iss = 'did:x:7' AND (ts + 1) * 1000 > 1704067200000 + 16 * 86400000) THEN FALSE ELSE TRUE END AS ok FROM envelopes)
    SELECT b.block_id, e.ok AS envelope, CASE WHEN b.n % 101 = 0 OR b.ms_index % 3 = 0 OR NOT e.ok THEN 'INVALID'
      WHEN a.status = 'anchored' AND a.seq % 5 <> 0 AND w.root IS NOT NULL AND e.ok THEN 'VALID' ELSE 'PARTIAL' END AS overall
    FROM blocks b JOIN milestones m ON m.idx = b.ms_index JOIN e ON e.block_id = b.block_id LEFT JOIN anchors a ON b.ms_index BETWEEN a.from_ms AND a.to_ms
    LEFT JOIN (SELECT w AS seq, root FROM wtree_root) w USING (seq)""")
def r25b(t):
    sigs = t.milestones.select(F.col("idx").alias("ms_index"), F.explode(F.array(F.lit("k0"), F.lit("k1"))).alias("pk")).withColumn("ok", (F.col("ms_index") % 3 != 0) | (F.col("pk") == "k0"))
    pinned = t.spark.createDataFrame([("k0",), ("k1",)], "pk string")
    p = proof_rows(t, envelopes=proofs.envelope_step(signed_envelopes(t), t.key_history))
    return proofs.audit_proofs(p, sigs, pinned, t.anchors, 2).select("block_id", "envelope", "overall")


@query("r26_admission", """WITH s AS (SELECT *, verdict IN ('FORGED') AS early, verdict = 'MALFORMED' AS bad, NOT coalesce(list_contains(allowed, '*') OR list_contains(allowed, iss), FALSE) AS denied FROM messages LEFT JOIN policy USING (tag) WHERE received_at_ms IS NOT NULL),
    o AS (SELECT *, max(CASE WHEN NOT bad THEN seq END) OVER (PARTITION BY iss ORDER BY received_at_ms, concat('s', nonce) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s WHERE NOT early AND NOT denied)
    SELECT concat('s', s.nonce) AS sub_id, CASE WHEN s.early THEN 'FORGED' WHEN s.denied THEN 'UNAUTHORIZED_WRITER' WHEN o.seq <= o.top THEN 'REPLAY' WHEN s.bad THEN 'MALFORMED' END AS refused_as
    FROM s LEFT JOIN o USING (block_id)""")
def r26(t):
    m = t.messages.filter("received_at_ms IS NOT NULL").select("block_id", "verdict", "nonce")
    s = t.submissions.select("sub_id", "block_id", "received_at_ms", "tag", "iss", "seq").join(m, "block_id")
    s = s.withColumn("early", F.when(F.col("verdict") == "FORGED", "FORGED")).withColumn("revoked_at_ms", F.lit(None).cast("bigint"))
    s = s.withColumn("schema_ok", F.col("verdict") != "MALFORMED").drop("verdict", "block_id")
    return verdicts.screen(s, t.policy, as_of_ms=AS_OF).select("sub_id", "refused_as")


@query("r27_scorecard_classes", """SELECT class, count(*) AS trials, CAST(20 AS BIGINT) AS planned, count(*) FILTER (WHERE detected) AS detected FROM trials WHERE NOT failed GROUP BY class""")
def r27(t):
    from ..operators import scoring
    from .aggregates import answer_key
    ran, _ = scoring.scored(t.trials)
    return scoring.per_class(ran, answer_key(t).select("class", "planned")).select("class", "trials", "planned", "detected")
