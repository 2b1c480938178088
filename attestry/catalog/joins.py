"""Joins of the ledger's tables."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocabulary as V
from ..operators import anchors, chain, keys, lifecycle, ordered, ranges, reconcile, reports, scores, scoring
from ..sources import loads
from .registry import query

PROVEN = "verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED')"


@query("j1_message_detail", """SELECT coalesce(m.block_id, s.block_id) AS block_id, m.block_id IS NOT NULL AS indexed, coalesce(m.tag, s.tag) AS tag, m.verdict,
    s.sub_id, s.source, v.is_solid AND v.inclusion_state <> 'conflicting' AS solid, c.result AS content
    FROM (SELECT block_id, tag, verdict FROM messages WHERE n % 43 <> 0) m FULL JOIN submissions s ON m.block_id = s.block_id
    LEFT JOIN validations v ON v.block_id = coalesce(m.block_id, s.block_id) LEFT JOIN content_checks c ON c.block_id = coalesce(m.block_id, s.block_id)""")
def j1(t):
    return reconcile.message_detail(t.messages.filter("n % 43 <> 0"), t.submissions, t.validations, t.content_checks)


@query("j2_shadow", """SELECT block_id, tag, iss, ie_id, verdict, ms_index, confirmed_at_ms AS confirmed_ms FROM messages m
    WHERE confirmed_at_ms <= 1706500000000 AND confirmed_at_ms >= (SELECT min(received_at_ms) FROM submissions) AND tag <> 'LLO-Docker'
    AND block_id NOT IN (SELECT block_id FROM submissions) AND block_id NOT IN (SELECT block_id FROM alerts WHERE rule = 'SHADOW' AND id % 4 = 2)""")
def j2(t):
    known = t.alerts.filter("rule = 'SHADOW' AND id % 4 = 2")
    rows = reconcile.shadow_candidates(t.messages, t.submissions, known, None, 1706500000000, ["LLO-Docker"])
    return rows.select("block_id", "tag", "iss", "ie_id", "verdict", "ms_index", "confirmed_ms")


@query("j3_missing", "SELECT block_id FROM blocks WHERE block_id NOT IN (SELECT block_id FROM stored_messages)")
def j3(t):
    return reconcile.missing_messages(t.blocks, t.stored_messages)


@query("j4_blind_lookup", """SELECT DISTINCT token, e.block_id, tag, ms_index FROM (SELECT block_id, unnest(['t' || user_id, 't' || n % 5]) AS token FROM envelopes
    WHERE n % 11 = 0 AND n % 13 <> 0) b JOIN envelopes e USING (block_id) WHERE token IN ('t3', 't4', 't17')""")
def j4(t):
    tok = t.envelopes.select("block_id", C.blind_tokens(C.parsed(F.col("envelope"))).alias("tokens"))
    index = loads.blind_rows(tok, "tokens").filter(F.col("token").isin("t3", "t4", "t17"))
    return index.join(t.messages.select("block_id", "tag", "ms_index"), "block_id").distinct()


LATEST_CLEAN = f"""SELECT ie_id, block_id, score, ts, ms_index FROM (SELECT *, row_number() OVER (PARTITION BY ie_id ORDER BY ms_index DESC, wf_index DESC, block_id DESC) AS rn
    FROM messages WHERE score IS NOT NULL AND {PROVEN} AND block_id NOT IN (SELECT block_id FROM alerts WHERE rule IN ('SHADOW', 'UNSIGNED'))) WHERE rn = 1"""


@query("j5_latest_trusted", LATEST_CLEAN)
def j5(t):
    return scores.latest_scores(t.messages, alerts=t.alerts)


J6_SQL = """WITH ev AS (SELECT m.*, m.block_id IN (SELECT block_id FROM submissions) AS submitted, m.block_id IN (SELECT block_id FROM alerts WHERE rule = 'SHADOW') AS shadowed
    FROM messages m WHERE tag = 'self-orchestrator' AND verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED', 'UNSIGNED_LEGACY'))
    SELECT p.block_id, count(e.block_id) AS events, count(CASE WHEN e.error_code <> 0 AND (e.verdict <> 'UNSIGNED_LEGACY' OR (e.submitted AND NOT e.shadowed)) THEN 1 END) AS corroborating
    FROM (SELECT * FROM messages WHERE score IS NOT NULL) p LEFT JOIN ev e ON e.ie_id = p.ie_id AND e.ts BETWEEN p.ts - 86400 AND p.ts
      AND (e.ms_index, e.wf_index) < (p.ms_index, p.wf_index) GROUP BY p.block_id"""


@query("j6_corroboration", J6_SQL)
def j6(t):
    events = scores.security_events(t.messages, t.alerts, t.submissions, t.policy)
    probes = t.messages.filter("score IS NOT NULL").select("ie_id", "block_id", "ms_index", "wf_index", "ts")
    return scores.events_in_window(probes, events, 86400).select("block_id", "events", "corroborating")


@query("j7_previous_score", f"""SELECT block_id, last_value(CASE WHEN score IS NOT NULL AND {PROVEN} THEN score END IGNORE NULLS) OVER w AS previous_score,
    last_value(CASE WHEN score IS NOT NULL AND {PROVEN} THEN block_id END IGNORE NULLS) OVER w AS previous_block_id FROM messages WHERE ie_id IS NOT NULL
    WINDOW w AS (PARTITION BY ie_id ORDER BY ms_index, wf_index, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def j7(t):
    df = scores.with_previous_score(t.messages.filter("ie_id IS NOT NULL"), scores.score_eligible())
    return df.select("block_id", "previous_score", "previous_block_id")


@query("j7_asof_context", f"""SELECT p.block_id, (SELECT score FROM messages q WHERE q.ie_id = p.ie_id AND q.score IS NOT NULL AND q.{PROVEN}
    AND (q.ms_index, q.wf_index) < (p.ms_index, p.wf_index) ORDER BY q.ms_index DESC, q.wf_index DESC LIMIT 1) AS score_before
    FROM messages p WHERE p.tag = 'self-orchestrator'""")
def j7b(t):
    errors = t.messages.filter("tag = 'self-orchestrator'").select("ie_id", "block_id", "ms_index", "wf_index")
    found = ordered.asof(errors, scores.valid_scores(t.messages), ["ie_id"], ordered.BY_POSITION, {"score_before": "score"})
    return found.select("block_id", "score_before")


J8_FLAGS = """SELECT m.*, coalesce(list_contains(allowed, '*') OR list_contains(allowed, iss), FALSE) AS may_write,
    coalesce(require_signature AND NOT legacy_grace, FALSE) AS needs, m.block_id IN (SELECT block_id FROM submissions) AS submitted,
    m.block_id IN (SELECT block_id FROM alerts WHERE rule IN ('SHADOW', 'UNSIGNED')) AS bad FROM messages m LEFT JOIN policy USING (tag)"""


@query("j8_trusted_previous", f"""WITH f AS ({J8_FLAGS}), g AS (SELECT *, score IS NOT NULL AND NOT bad AND may_write AND verdict = 'PRODUCER_SIGNED' AS p,
    score IS NOT NULL AND NOT bad AND ((may_write AND {PROVEN}) OR (verdict = 'UNSIGNED_LEGACY' AND NOT needs AND submitted)) AS r FROM f WHERE ie_id IS NOT NULL)
    SELECT block_id, last_value(CASE WHEN p THEN score END IGNORE NULLS) OVER w AS proven_score, last_value(CASE WHEN p THEN block_id END IGNORE NULLS) OVER w AS proven_block_id,
    last_value(CASE WHEN r THEN score END IGNORE NULLS) OVER w AS relayed_score FROM g
    WINDOW w AS (PARTITION BY ie_id ORDER BY ms_index, wf_index, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def j8(t):
    f = scores.trusted_flags(t.messages.filter("ie_id IS NOT NULL"), t.policy, t.alerts, t.submissions)
    f = f.withColumn("trust", F.lit("relayed"))
    return scores.with_trusted_previous(f, sizes=t.messages).select("block_id", "proven_score", "proven_block_id", F.col("previous_score").alias("relayed_score"))


@query("j9_chain_head", f"""WITH p AS (SELECT * FROM messages WHERE {PROVEN}), h AS (SELECT a.block_id, b.block_id AS head_block, b.seq AS head_seq,
    row_number() OVER (PARTITION BY a.block_id ORDER BY b.seq DESC, b.ts DESC, b.block_id) AS rn FROM p a JOIN p b
    ON a.iss = b.iss AND b.seq < a.seq AND (b.ms_index, b.wf_index) < (a.ms_index, a.wf_index))
    SELECT p.block_id, head_block, head_seq FROM p LEFT JOIN h ON h.block_id = p.block_id AND rn = 1""")
def j9(t):
    return chain.heads_on_arrival(t.messages.select(*chain.PLACED)).select("block_id", "head_block", "head_seq")


@query("j9_settled_head", f"""SELECT block_id, lag(block_id) OVER (PARTITION BY iss ORDER BY seq, block_id) AS head_block FROM messages WHERE {PROVEN}""")
def j9b(t):
    return chain.settled_heads(t.messages).select("block_id", F.col("head.block_id").alias("head_block"))


@query("j10_siblings", f"""SELECT block_id, count(*) OVER (PARTITION BY iss, prev) - 1 AS siblings FROM messages WHERE {PROVEN} AND prev IS NOT NULL
    QUALIFY siblings > 0""")
def j10(t):
    return chain.siblings(t.messages).select("block_id", "siblings")


@query("j11_anchor_cover", """SELECT block_id, max(anchors.seq) AS seq FROM messages LEFT JOIN anchors ON ms_index BETWEEN from_ms - 100 AND to_ms + 50 GROUP BY block_id""")
def j11(t):
    wide = t.anchors.selectExpr("seq", "from_ms - 100 AS from_ms", "to_ms + 50 AS to_ms")
    return ranges.covering(t.messages.select("block_id", "ms_index"), "ms_index", wide, "from_ms", "to_ms", "seq").select("block_id", "seq")


@query("j12_overlapping", "SELECT seq, from_ms, to_ms FROM anchors WHERE to_ms >= 1000 AND from_ms <= 5000")
def j12(t):
    return ranges.overlapping(t.anchors, "from_ms", "to_ms", 1000, 5000).select("seq", "from_ms", "to_ms")


@query("j13_drift", f"""SELECT ie_id, l.block_id, trust_score AS context_score, score AS ledger_score FROM context_ie JOIN ({LATEST_CLEAN}) l USING (ie_id)
    WHERE trust_score IS NULL OR abs(trust_score - score) > 0.1""")
def j13(t):
    return scores.drift(t.context_ie, scores.latest_scores(t.messages, alerts=t.alerts), 0.1).drop("delta")


@query("j14_unknown_ie", """SELECT ie_id, block_id FROM (SELECT *, row_number() OVER (PARTITION BY ie_id ORDER BY ms_index, wf_index, block_id) AS rn FROM messages
    WHERE ie_id IS NOT NULL AND ie_id NOT IN (SELECT ie_id FROM context_ie)) WHERE rn = 1""")
def j14(t):
    rows = t.messages.filter("ie_id IS NOT NULL").join(t.context_ie.select("ie_id"), "ie_id", "left_anti")
    return ordered.latest(rows, ["ie_id"], *[F.col(c) for c in ordered.BY_POSITION.cols]).select("ie_id", "block_id")


@query("j15_component_host", "SELECT block_id, host_ie FROM messages JOIN component_host USING (service)")
def j15(t):
    hosts = t.component_host.select(C.component_key(F.col("service")).alias("k"), "host_ie")
    return t.messages.filter("service IS NOT NULL").withColumn("k", C.component_key(F.col("service"))).join(hosts, "k").select("block_id", "host_ie")


@query("j16_report_alerts", """SELECT a.id, a.rule FROM alerts a LEFT JOIN messages m ON m.block_id = a.block_id LEFT JOIN blocks b ON b.block_id = a.block_id
    WHERE (a.block_id IS NOT NULL AND coalesce(m.ms_index, b.ms_index) BETWEEN 1000 AND 4000)
    OR (a.block_id IS NULL AND a.at_ms >= (SELECT min(ts) * 1000 FROM milestones WHERE idx >= 1000) AND a.at_ms < (SELECT min(ts) * 1000 FROM milestones WHERE idx > 4000))""")
def j16(t):
    return reports.report_alerts(t.alerts, t.messages, t.blocks, t.milestones, ms_from=1000, ms_to=4000).select("id", "rule")


@query("j17_reverify_candidates", """WITH ids AS (SELECT block_id FROM content_checks WHERE result = 'MATCH' UNION SELECT block_id FROM stored_submissions UNION SELECT block_id FROM stored_messages
      UNION SELECT block_id FROM lifecycle WHERE status = 'CONTENT_VERIFIED')
    SELECT i.block_id, s.sub_id, s.block_id IS NOT NULL AS has_submission, m.block_id IS NOT NULL AS has_message,
    i.block_id IN (SELECT block_id FROM content_checks WHERE result = 'MATCH') OR i.block_id IN (SELECT block_id FROM lifecycle WHERE status = 'CONTENT_VERIFIED') AS verified_once,
    CASE WHEN i.block_id IN (SELECT block_id FROM lifecycle WHERE status = 'CONTENT_VERIFIED') THEN 'CONTENT_VERIFIED' END AS outcome
    FROM ids i LEFT JOIN stored_submissions s USING (block_id) LEFT JOIN stored_messages m USING (block_id)""")
def j17(t):
    df = reconcile.reverify_candidates(t.content_checks, t.stored_submissions, t.stored_messages, t.lifecycle, t.alerts)
    return df.select("block_id", "sub_id", "has_submission", "has_message", "verified_once", "outcome")


TAMPER_SQL = """WITH c AS (SELECT l.block_id, l.tag AS lt, l.data AS ld, s.block_id IS NOT NULL AS hs, s.tag AS st, s.data AS sd, m.block_id IS NOT NULL AS hm, m.tag AS mt, m.data AS md
      FROM ledger_content l LEFT JOIN stored_submissions s USING (block_id) LEFT JOIN stored_messages m USING (block_id)
      WHERE s.block_id IS NOT NULL OR m.block_id IS NOT NULL)
    SELECT block_id, 'submissions.tag' AS field, lt AS expected, st AS actual FROM c WHERE hs AND st IS DISTINCT FROM lt
    UNION ALL SELECT block_id, 'submissions.data', ld, sd FROM c WHERE hs AND sd IS DISTINCT FROM ld
    UNION ALL SELECT block_id, 'messages.tag', lt, mt FROM c WHERE hm AND mt IS DISTINCT FROM lt
    UNION ALL SELECT block_id, 'messages.data', ld, md FROM c WHERE hm AND md IS DISTINCT FROM ld"""


@query("j18_tamper", TAMPER_SQL)
def j18(t):
    df = reconcile.reverify_candidates(t.content_checks, t.stored_submissions, t.stored_messages, t.lifecycle, t.alerts)
    return reconcile.tampered(df, t.ledger_content).drop("reason")


@query("j19_content_check", """SELECT m.block_id, CASE WHEN b.block_id IS NULL THEN 'NOT_FOUND' WHEN n1 % 101 = 0 OR s.data <> l.data THEN 'MISMATCH' ELSE 'MATCH' END AS result,
    CASE WHEN b.block_id IS NOT NULL THEN concat_ws(',', CASE WHEN n1 % 101 = 0 THEN 'blockId' END, CASE WHEN s.data <> l.data THEN 'data' END) END AS fields
    FROM (SELECT *, n AS n1 FROM stored_submissions) s JOIN messages m USING (block_id) JOIN ledger_content l USING (block_id)
    LEFT JOIN (SELECT * FROM blocks WHERE n % 89 <> 0) b USING (block_id)""")
def j19(t):
    served = t.blocks.filter("n % 89 <> 0").join(t.ledger_content.select("block_id", "tag", "data"), "block_id")
    return reconcile.content_check(t.stored_submissions.select("block_id", "tag", "data"), served).drop("first_diff")


@query("j22_blocks_with_alert", """SELECT block_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM alerts WHERE rule IN ('SHADOW', 'UNSIGNED', 'FORGED')
    AND block_id IN (SELECT block_id FROM messages WHERE ms_index > 3000) GROUP BY block_id""")
def j22(t):
    found = reports.blocks_with_alerts(t.alerts, ("SHADOW", "UNSIGNED", "FORGED"), t.messages.filter("ms_index > 3000"))
    return found.select("block_id", F.array_join("rules", ",").alias("rules"))


@query("j23_ie_list", f"""WITH h AS ({LATEST_CLEAN}) SELECT a.ie_id, a.count, a.first_ts, a.last_ts, a.last_ms_index, h.score, h.block_id AS score_block_id, h.ts AS score_ts
    FROM (SELECT ie_id, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts, max(ms_index) AS last_ms_index FROM messages WHERE ie_id IS NOT NULL GROUP BY ie_id) a
    LEFT JOIN h USING (ie_id)""")
def j23(t):
    return reports.ie_list(t.messages, scores.latest_scores(t.messages, alerts=t.alerts))


RECORDS = "SELECT seq, from_ms, to_ms, ms_root, CASE WHEN seq % 11 = 3 THEN concat(checkpoint_hash, '0') ELSE checkpoint_hash END AS checkpoint_hash FROM anchors WHERE seq % 13 <> 12"
AUDIT_SQL = f"""SELECT a.seq, CASE WHEN r.seq IS NULL THEN 'unverifiable' WHEN w.root <> r.ms_root OR a.checkpoint_hash <> r.checkpoint_hash THEN 'mismatch'
    WHEN w.root IS NULL THEN 'unverifiable' ELSE 'verified' END AS state,
    CASE WHEN r.seq IS NULL THEN 'no record' WHEN w.root <> r.ms_root THEN 'root' WHEN a.checkpoint_hash <> r.checkpoint_hash THEN 'mirror'
    WHEN w.root IS NULL THEN 'incomplete' END AS detail
    FROM anchors a LEFT JOIN ({RECORDS}) r USING (seq) LEFT JOIN (SELECT w AS seq, root FROM wtree_root) w USING (seq)"""


def records(t):
    return t.anchors.filter("seq % 13 <> 12").withColumn("checkpoint_hash", F.when(
        F.col("seq") % 11 == 3, F.concat("checkpoint_hash", F.lit("0"))).otherwise(F.col("checkpoint_hash")))


@query("j24_anchor_audit", AUDIT_SQL)
def j24(t):
    return anchors.audit(t.anchors, records(t), t.milestones).select("seq", "state", "detail")


DOC_KIND = "ledger.checkpoint"
#: What `hashed_anchors` plants: altered roots, mirrors and message counts, and one record that claims every index there can be.
HASHED_AUDIT_SQL = """SELECT w AS seq, CASE WHEN w % 5 = 0 OR w % 3 = 0 OR w % 4 = 0 THEN 'mismatch' ELSE 'verified' END AS state,
    CASE WHEN w % 5 = 0 THEN 'root' WHEN w % 3 = 0 THEN 'mirror' WHEN w % 4 = 0 THEN 'hash' END AS detail FROM wtree_root
    UNION ALL SELECT 0, 'unverifiable', 'incomplete' FROM (SELECT 1 FROM wtree_root LIMIT 1)"""


def hashed_anchors(t):
    """Anchors and records with every hashed field, some of them altered."""
    made = anchors.chained(anchors.checkpoints(t.milestones, t.messages, network="n", domain="d", policy_hash="0x0"), DOC_KIND).withColumn("seq", F.col("window") + 1)
    seq = F.col("seq")
    shown = made.select("seq", F.when(seq % 3 == 0, F.concat("checkpoint_hash", F.lit("0"))).otherwise(F.col("checkpoint_hash")).alias("checkpoint_hash"))
    records_ = made.withColumns({"ms_root": F.when(seq % 5 == 0, F.reverse("ms_root")).otherwise(F.col("ms_root")), "msg_count": F.col("msg_count") + (seq % 4 == 0).cast("int")})
    forged = made.limit(1).withColumns({"seq": F.lit(0).cast("bigint"), "from_ms": F.lit(0).cast("bigint"), "to_ms": F.lit(V.MAX_MILESTONE).cast("bigint")})
    forged = forged.withColumn("checkpoint_hash", anchors.checkpoint_hash(DOC_KIND))
    return shown.unionByName(forged.select("seq", "checkpoint_hash")), records_.unionByName(forged)


@query("j24_anchor_audit_hashed", HASHED_AUDIT_SQL)
def j24b(t):
    shown, records_ = hashed_anchors(t)
    return anchors.audit(shown, records_, t.milestones, doc_kind=DOC_KIND).select("seq", "state", "detail")


@query("j25_recheck", f"""WITH r AS ({RECORDS}), x AS (SELECT a.seq, 'ms_root' AS what, a.ms_root AS explorer, r.ms_root AS chain FROM anchors a LEFT JOIN r USING (seq)
    UNION ALL SELECT a.seq, 'checkpoint_hash', a.checkpoint_hash, r.checkpoint_hash FROM anchors a LEFT JOIN r USING (seq)),
    c AS (SELECT *, CASE WHEN explorer IS NULL OR chain IS NULL THEN 'unknown' WHEN explorer = chain THEN 'same' ELSE 'differs' END AS c FROM x)
    SELECT seq, what, c, CASE WHEN bool_or(c = 'differs') OVER (PARTITION BY seq) THEN FALSE WHEN bool_and(c = 'same') OVER (PARTITION BY seq) THEN TRUE END AS verdict FROM c""")
def j25(t):
    fields = ["ms_root", "checkpoint_hash"]
    return anchors.recheck(t.anchors.select("seq", *fields), records(t).select("seq", *fields), fields, fields).select("seq", "what", "c", "verdict")


@query("j26_key_in_force", """SELECT block_id, public_key, revoked_at_ms FROM (SELECT m.block_id, k.public_key, k.revoked_at_ms, row_number() OVER (PARTITION BY m.block_id ORDER BY
    CASE WHEN k.revoked_at_ms IS NULL OR k.revoked_at_ms >= (m.ts + 1) * 1000 THEN 0 ELSE 1 END,
    CASE WHEN k.revoked_at_ms IS NULL OR k.revoked_at_ms >= (m.ts + 1) * 1000 THEN coalesce(k.revoked_at_ms, 4611686018427387904) ELSE -k.revoked_at_ms END, k.pos DESC) AS rn
    FROM messages m JOIN key_history k USING (kid)) WHERE rn = 1""")
def j26(t):
    return keys.in_force(t.messages.select("block_id", "kid", "ts"), t.key_history, (F.col("ts") + 1) * 1000).select("block_id", "public_key", "revoked_at_ms")


@query("j27_trap_alerts", """SELECT DISTINCT id, rule FROM alerts WHERE at_ms <= 1706000000000 AND (block_id IN (SELECT block_id FROM messages WHERE n % 4 = 0)
    OR (at_ms >= 1704500000000 AND ie_id IN (SELECT ie_id FROM context_ie WHERE user_id % 9 = 0)))""")
def j27(t):
    sent, ies = t.messages.filter("n % 4 = 0"), t.context_ie.filter("user_id % 9 = 0")
    return scoring.trap_alerts(sent, ies, t.alerts, 1704500000000, 1706000000000).select("id", "rule")


TRIALS_SQL = """SELECT concat('A', lpad(CAST(n % 20 + 1 AS VARCHAR), 2, '0')) AS class, n AS trial, block_id, CASE WHEN n % 20 < 5 THEN ie_id END AS ie_id, ts * 1000 AS start_ms FROM messages WHERE n % 7 = 1"""


def injected(t):
    return t.messages.filter("n % 7 = 1").selectExpr(
        "concat('A', lpad(CAST(n % 20 + 1 AS STRING), 2, '0')) AS class", "n AS trial", "block_id",
        "CASE WHEN n % 20 < 5 THEN ie_id END AS ie_id", "ts * 1000 AS start_ms")


@query("j28_late_alerts", f"""WITH tr AS ({TRIALS_SQL}) SELECT class, rule, count(*) AS n FROM (SELECT DISTINCT tr.class, tr.trial, a.id, a.rule FROM tr JOIN alerts a
    ON a.block_id = tr.block_id OR (a.ie_id = tr.ie_id AND a.at_ms >= tr.start_ms)) WHERE (trial, id) NOT IN (SELECT (tr.trial, a.id) FROM tr JOIN alerts a USING (block_id) WHERE a.rule = 'FORGED')
    GROUP BY class, rule""")
def j28(t):
    tr = injected(t)
    seen = tr.select("trial", "block_id").join(t.alerts.filter("rule = 'FORGED'").select("block_id", "id"), "block_id").select("trial", "id")
    return scoring.late_alerts(tr, t.alerts, seen)


@query("j29_identity_tags", """SELECT DISTINCT iss, tag FROM (SELECT DISTINCT iss FROM messages) i, policy p WHERE list_contains(allowed, iss) OR list_contains(allowed, '*')""")
def j29(t):
    return keys.writable_tags(t.messages.select("iss").distinct(), t.policy)


@query("j30_message_status", """SELECT m.block_id, coalesce(CASE WHEN m.n % 29 = 0 THEN 'SHADOW' END, l.status) AS status FROM messages m
    LEFT JOIN (SELECT block_id, arg_max(status, at_ms) AS status FROM lifecycle GROUP BY block_id) l USING (block_id)""")
def j30(t):
    own = t.messages.select("block_id", F.when(F.col("n") % 29 == 0, "SHADOW").alias("status"))
    # half of the log names only the submission, not the block
    log = t.lifecycle.withColumn("block_id", F.when(F.col("id") % 2 == 0, F.col("block_id")))
    return lifecycle.message_status(own, log, t.submissions)


