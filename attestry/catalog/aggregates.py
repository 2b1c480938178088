"""Aggregates, reports, Merkle trees and detection scoring."""

from pyspark.sql import functions as F


from ..operators import chain, keys, lifecycle, merkle, reports, scoring
from .registry import query

PROVEN = "verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED')"


@query("a1_ie_activity", "SELECT ie_id, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts, max(ms_index) AS last_ms_index FROM messages WHERE ie_id IS NOT NULL GROUP BY ie_id")
def a1(t):
    return reports.ie_activity(t.messages)


@query("a2_flows", " UNION ALL ".join(
    f"SELECT '{d}' AS by, {c} AS key, count(*) AS count, min(ts) AS first_ts, max(ts) AS last_ts FROM messages WHERE {c} IS NOT NULL GROUP BY {c}"
    for d, c in (("issuer", "iss"), ("ie", "ie_id"), ("service", "service"), ("corr", "corr"))))
def a2(t):
    return reports.flows(t.messages)


@query("a3_table_stats", " UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n FROM {x}" for x in (
    "messages", "blocks", "submissions", "milestones", "alerts", "anchors", "lifecycle", "validations", "content_checks", "context_ie", "component_host", "policy", "key_history")))
def a3(t):
    names = ("messages", "blocks", "submissions", "milestones", "alerts", "anchors", "lifecycle", "validations", "content_checks", "context_ie", "component_host", "policy", "key_history")
    return reports.table_counts({n: getattr(t, n) for n in names})


@query("a4_payload_ratio", """SELECT count(*) AS total, count(*) FILTER (WHERE NOT encrypted) AS plaintext, count(*) FILTER (WHERE encrypted) AS encrypted,
    count(*) FILTER (WHERE NOT encrypted) / count(*)::DOUBLE AS ratio FROM messages""")
def a4(t):
    return reports.payload_ratio(t.messages)


@query("a5_verdict_counts", "SELECT verdict, encrypted, count(*) AS n, count(ms_index) AS confirmed FROM messages GROUP BY verdict, encrypted")
def a5(t):
    return reports.verdict_counts(t.messages)


@query("a6_alert_grouping_sets", "SELECT severity, rule, count(*) AS n FROM alerts GROUP BY GROUPING SETS ((severity), (rule), ())")
def a6(t):
    return reports.alert_groups(t.alerts)


@query("a7_anchor_counts", """SELECT status, count(*) AS n, max(seq) AS newest_seq, arg_max(ms_root, seq) AS newest_root FROM anchors WHERE to_ms >= 500 AND from_ms <= 8000 GROUP BY status""")
def a7(t):
    return reports.anchor_counts(t.anchors, 500, 8000)


REPORT_SQL = """WITH m AS (SELECT * FROM messages WHERE ms_index BETWEEN 1000 AND 4000), r AS (SELECT a.* FROM alerts a LEFT JOIN messages m ON m.block_id = a.block_id
    WHERE (a.block_id IS NOT NULL AND m.ms_index BETWEEN 1000 AND 4000)
    OR (a.block_id IS NULL AND a.at_ms >= (SELECT min(ts) * 1000 FROM milestones WHERE idx >= 1000) AND a.at_ms < (SELECT min(ts) * 1000 FROM milestones WHERE idx > 4000)))
    SELECT (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m WHERE encrypted) AS encrypted, (SELECT count(*) FROM m WHERE verdict = 'FORGED') AS forged,
    (SELECT count(*) FROM r) AS alerts, (SELECT count(*) FROM r WHERE rule = 'SHADOW') AS shadow, (SELECT count(*) FROM anchors WHERE to_ms >= 1000 AND from_ms <= 4000 AND status = 'anchored') AS anchored,
    (SELECT count(*) FROM m) > 50 AS truncated, (SELECT block_id FROM m ORDER BY ms_index, wf_index LIMIT 1) AS first_proof"""


@query("a8_audit_report", REPORT_SQL)
def a8(t):
    r = reports.audit_report(t.messages, t.alerts, t.blocks, t.milestones, t.anchors, network="net", at_ms=1706700000000,
                             ms_from=1000, ms_to=4000, proof_limit=50)
    g = lambda p, kind: F.try_variant_get(F.parse_json("report"), p, kind)
    return r.select(g("$.messages.total", "bigint").alias("total"), g("$.messages.encrypted", "bigint").alias("encrypted"),
                    g("$.messages.byVerdict.FORGED", "bigint").alias("forged"), g("$.alerts.total", "bigint").alias("alerts"),
                    g("$.alerts.byRule.SHADOW", "bigint").alias("shadow"), g("$.anchors.byStatus.anchored", "bigint").alias("anchored"),
                    g("$.proofsTruncated", "boolean").alias("truncated"), g("$.proofs[0].block_id", "string").alias("first_proof"))


@query("a9_message_count", "SELECT count(*) AS n FROM messages WHERE ms_index BETWEEN 2000 AND 3000")
def a9(t):
    return reports.message_count(t.messages, 2000, 3000)


@query("a10_issuer_state", f"""SELECT iss, max(seq) AS top_seq, CAST(least(count(*), 500) AS BIGINT) AS nonces, arg_max(nonce, (ts, -n)) AS newest FROM messages WHERE {PROVEN} GROUP BY iss""")
def a10(t):
    state = chain.issuer_state(t.messages, nonces=500)
    newest = chain.proven_messages(t.messages).groupBy("iss").agg(F.max_by("nonce", F.struct("ts", -F.col("n"))).alias("newest"))
    return state.join(newest, "iss").select("iss", "top_seq", F.size("nonces").cast("bigint").alias("nonces"), "newest")


@query("a11_milestone_counts", """SELECT b.ms_index, blocks, tagged, coalesce(messages, 0) AS messages FROM (SELECT ms_index, count(*) AS blocks, count(*) FILTER (WHERE payload_type = 5) AS tagged FROM blocks GROUP BY ms_index) b
    LEFT JOIN (SELECT ms_index, count(*) AS messages FROM messages WHERE n % 211 <> 0 GROUP BY ms_index) m USING (ms_index)""")
def a11(t):
    return reports.milestone_counts(t.blocks, t.messages.filter("n % 211 <> 0"))


@query("a12_first_submission", "SELECT min(received_at_ms) AS baseline_ms FROM submissions")
def a12(t):
    return lifecycle.first_submission(t.submissions)


@query("a13_ledger_clock", """SELECT max(ts) AS latest_ts, CASE WHEN 1706800000 - max(ts) > 120 THEN 'stalled' ELSE 'ok' END AS status FROM milestones""")
def a13(t):
    return reports.ledger_clock(t.milestones, 1706800000)


LINKS_SQL = f"""SELECT *, last_value(CASE WHEN proven THEN block_id END IGNORE NULLS) OVER (PARTITION BY iss ORDER BY seq, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    proven AND prev IS NOT NULL AND count(CASE WHEN proven AND prev IS NOT NULL THEN 1 END) OVER (PARTITION BY iss, prev) > 1 AS forked FROM (SELECT *, {PROVEN} AS proven FROM messages)"""


@query("a14_chain_view", f"""SELECT iss, count(*) FILTER (WHERE prev = before) AS links, count(*) FILTER (WHERE prev IS NOT NULL AND prev IS DISTINCT FROM before) AS gaps,
    count(DISTINCT CASE WHEN forked THEN prev END) AS forks FROM ({LINKS_SQL}) WHERE proven GROUP BY iss""")
def a14(t):
    return chain.chain_view(t.messages)


@query("a15_link_states", f"""SELECT block_id, CASE WHEN NOT proven THEN 'claims' WHEN forked THEN 'fork' WHEN prev = before THEN 'linked' WHEN prev IS NOT NULL THEN 'gap'
    WHEN before IS NULL THEN 'start' ELSE 'none' END AS state FROM ({LINKS_SQL})""")
def a15(t):
    return chain.links(t.messages).select("block_id", "state")


@query("a16_merkle_root", "SELECT w AS ms_index, root, leaves FROM ctree_root JOIN (SELECT ms_index AS w, count(*) AS leaves FROM messages GROUP BY ms_index) USING (w)")
def a16(t):
    return merkle.roots(t.messages, ["ms_index"], "wf_index", "block_id")


@query("a16_window_root", "SELECT w AS seq, root FROM wtree_root")
def a16w(t):
    return t.window_roots.select("seq", "root")


@query("a16_merkle_root_blake2b")
def a16b(t):
    return merkle.roots(t.messages, ["ms_index"], "wf_index", "block_id", algorithm="blake2b")


PATH_SQL = "WITH lv AS (" + " UNION ALL ".join(f"SELECT {i} AS k, w, pos, h FROM wtree_{i}" for i in range(10)) + """)
    SELECT seq, idx, string_agg(CASE WHEN (place >> k) % 2 = 0 THEN 'R:' ELSE 'L:' END || h, ',' ORDER BY k) AS path FROM windows JOIN lv ON w = seq AND lv.pos = xor(place >> k, 1)
    GROUP BY seq, idx"""


@query("a17_audit_path", PATH_SQL, *[f"wtree_{i}" for i in range(10)])
def a17(t):
    full = t.windows.join(t.window_roots.select("seq"), "seq", "left_semi")
    df = merkle.paths(full, ["seq"], "place", "id")
    return df.select("seq", "idx", F.array_join(F.transform("path", lambda s: F.concat(s["side"], F.lit(":"), s["hash"])), ",").alias("path"))


@query("a18_path_verification", """SELECT block_id, n % 10 <> 0 AS holds FROM messages""")
def a18(t):
    df = merkle.paths(t.messages, ["ms_index"], "wf_index", "block_id")
    claimed = F.when(F.col("n") % 10 == 0, F.concat(F.lit("0x"), F.sha2("block_id", 256))).otherwise(F.col("block_id"))
    return df.select("block_id", merkle.verify(claimed, F.col("path"), F.col("root")).alias("holds"))


@query("a19_signature_threshold", """SELECT idx, count(DISTINCT CASE WHEN pk IN ('k0', 'k1', 'k2') AND ok THEN pk END) AS valid,
    count(DISTINCT CASE WHEN pk IN ('k0', 'k1', 'k2') AND ok THEN pk END) >= 2 AS enough
    FROM (SELECT idx, concat('k', CAST((idx + j) % 5 AS VARCHAR)) AS pk, (idx * 7 + j) % 4 <> 0 AS ok FROM milestones, (VALUES (0), (1), (2), (2)) v(j)) GROUP BY idx""")
def a19(t):
    from ..plans import proofs
    sigs = t.milestones.select("idx", F.explode(F.array(*[F.lit(j) for j in (0, 1, 2, 2)])).alias("j")).selectExpr(
        "idx", "concat('k', (idx + j) % 5) AS pk", "(idx * 7 + j) % 4 <> 0 AS ok")
    pinned = t.spark.createDataFrame([("k0",), ("k1",), ("k2",)], "pk string")
    return proofs.signature_counts(sigs, pinned, ["idx"], 2)


@query("a20_ladder", """SELECT block_id, CASE WHEN bool_or(NOT ok) THEN 'INVALID' WHEN bool_and(ok IS NOT NULL) THEN 'VALID' ELSE 'PARTIAL' END AS overall
    FROM (SELECT block_id, CASE WHEN (n * 3 + j) % 17 = 0 THEN FALSE WHEN (n + j) % 9 = 0 THEN NULL ELSE TRUE END AS ok FROM messages, (VALUES (0), (1), (2), (3), (4)) v(j)) GROUP BY block_id""")
def a20(t):
    from ..plans import proofs
    steps = t.messages.select("block_id", "n", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j")).selectExpr(
        "block_id", "CASE WHEN (n * 3 + j) % 17 = 0 THEN FALSE WHEN (n + j) % 9 = 0 THEN NULL ELSE TRUE END AS ok")
    return proofs.overall(steps, ["block_id"])


OBS = """SELECT class, trial, CASE WHEN trial % 3 <> 0 THEN 'FORGED' END AS verdict, trial % 4 = 0 AS sealed, CASE WHEN trial % 5 < 3 THEN 'SHADOW' END AS alert, trial % 7 <> 0 AS inclusion,
    CASE WHEN trial % 6 = 0 THEN 'INVALID' ELSE 'VALID' END AS overall FROM trials"""
CLS = """SELECT class, CASE WHEN k % 4 = 0 THEN 'FORGED' END AS exp_verdict, CASE WHEN k % 4 = 1 OR k % 8 = 0 THEN 'SHADOW' END AS exp_alert,
    CASE WHEN k % 4 = 2 THEN 'inclusion' END AS exp_step, CASE WHEN k % 4 = 3 THEN 'INVALID' END AS exp_overall FROM (SELECT DISTINCT class, CAST(substr(class, 2) AS INT) AS k FROM trials)"""


def answer_key(t):
    k = t.trials.select("class").distinct().withColumn("k", F.expr("CAST(substr(class, 2) AS INT)"))
    return k.selectExpr("class", "CASE WHEN k % 4 = 0 THEN 'FORGED' END AS exp_verdict", "CASE WHEN k % 4 = 1 OR k % 8 = 0 THEN 'SHADOW' END AS exp_alert",
                        "CASE WHEN k % 4 = 2 THEN 'inclusion' END AS exp_step", "CASE WHEN k % 4 = 2 THEN true END AS exp_ok",
                        "CASE WHEN k % 4 = 3 THEN 'INVALID' END AS exp_overall", "CAST(NULL AS BOOLEAN) AS exp_sealed",
                        "array('CLOCK_SKEW') AS allowed", "CAST(20 AS BIGINT) AS planned")


@query("a21_trial_scoring", f"""SELECT class, trial, d AS detected, CASE WHEN d THEN coalesce(exp_verdict, exp_alert, 'ladder:' || exp_step, 'ladder_overall:' || exp_overall)
    ELSE coalesce(verdict, alert) END AS observed FROM (SELECT *, coalesce((exp_verdict IS NULL OR coalesce(verdict = exp_verdict, FALSE)) AND (exp_alert IS NULL OR coalesce(alert = exp_alert, FALSE))
    AND (exp_step IS NULL OR inclusion) AND (exp_overall IS NULL OR overall = exp_overall), FALSE) AS d FROM ({OBS}) JOIN ({CLS}) USING (class))""")
def a21(t):
    obs = t.trials.selectExpr("class", "trial", "CASE WHEN trial % 3 <> 0 THEN 'FORGED' END AS verdict", "trial % 4 = 0 AS sealed",
                              "CASE WHEN trial % 5 < 3 THEN array('SHADOW') ELSE cast(array() AS array<string>) END AS alerts",
                              "map('inclusion', trial % 7 <> 0) AS ladder", "CASE WHEN trial % 6 = 0 THEN 'INVALID' ELSE 'VALID' END AS overall")
    return scoring.evaluate(obs, answer_key(t)).select("class", "trial", "detected", "observed")


@query("p29_expected_label", f"SELECT class, coalesce(exp_verdict, exp_alert, 'ladder:' || exp_step, 'ladder_overall:' || exp_overall) AS expected FROM ({CLS})")
def p29(t):
    return answer_key(t).select("class", scoring.expected_label(*[F.col(c) for c in ("exp_verdict", "exp_alert", "exp_step", "exp_overall")]).alias("expected"))


@query("a22_confusion", "SELECT class, coalesce(observed, 'NONE') AS observed, count(*) AS n FROM trials WHERE NOT failed GROUP BY 1, 2")
def a22(t):
    return scoring.confusion(scoring.scored(t.trials)[0])


PER_CLASS = """SELECT class, count(*) AS trials, count(*) FILTER (WHERE detected) AS detected, quantile_disc(CASE WHEN detected THEN latency_ms END, 0.5) AS p50_ms,
    quantile_disc(CASE WHEN detected THEN latency_ms END, 0.95) AS p95_ms, count(*) FILTER (WHERE detected) / count(*)::DOUBLE AS rate FROM trials WHERE NOT failed GROUP BY class"""


@query("a23_per_class", PER_CLASS)
def a23(t):
    return scoring.per_class(scoring.scored(t.trials)[0])


@query("a24_percentile", "SELECT observed, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95, quantile_disc(latency_ms, 0.99) AS p99 FROM trials GROUP BY observed")
def a24(t):
    return t.trials.groupBy("observed").agg(*[scoring.percentile("latency_ms", p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])


@query("a25_alert_buckets", f"""SELECT class, extra_alert AS rule, CASE WHEN extra_alert = exp_alert THEN 'expected' WHEN extra_alert = 'CLOCK_SKEW' THEN 'side' ELSE 'unexpected' END AS bucket, count(*) AS n
    FROM trials JOIN ({CLS}) USING (class) WHERE extra_alert IS NOT NULL GROUP BY 1, 2, 3""")
def a25(t):
    seen = t.trials.filter("extra_alert IS NOT NULL").select("class", "trial", F.col("extra_alert").alias("rule"))
    return scoring.alert_buckets(seen, answer_key(t))


CONTROL_COLS = ["n AS trial", "CASE WHEN n % 31 = 0 THEN 'error' ELSE 'ok' END AS status", "CASE WHEN n % 62 = 0 THEN 'timeout' END AS error",
                "CASE WHEN n % 37 <> 0 THEN block_id END AS block_id", "n % 41 <> 0 AS indexed", "verdict"]


@query("a26_controls", f"""SELECT trial, why IS NULL AS passed, why FROM (SELECT *, CASE WHEN status <> 'ok' THEN concat('not run: ', coalesce(error, status)) WHEN block_id IS NULL THEN 'no block id'
    WHEN NOT indexed THEN 'block never indexed' WHEN verdict <> 'PRODUCER_SIGNED' THEN concat('verdict ', verdict, ', not PRODUCER_SIGNED') WHEN trial % 23 = 0 THEN 'alerts: SHADOW' END AS why
    FROM (SELECT {', '.join(CONTROL_COLS)} FROM messages))""")
def a26(t):
    rows = t.messages.selectExpr(*CONTROL_COLS, "CASE WHEN n % 23 = 0 THEN array('SHADOW') ELSE cast(array() AS array<string>) END AS alerts")
    return scoring.controls(rows).select("trial", "passed", "why")


TRAP_SQL = """SELECT (SELECT count(*) FROM messages WHERE n % 4 = 0) AS messages, (SELECT count(*) FROM messages WHERE n % 4 = 0 AND n % 44 = 0) AS not_indexed,
    (SELECT count(DISTINCT id) FROM alerts WHERE block_id IN (SELECT block_id FROM messages WHERE n % 4 = 0)) AS alerts,
    (SELECT count(DISTINCT id) FROM alerts WHERE block_id IN (SELECT block_id FROM messages WHERE n % 4 = 0))
      + (SELECT count(*) FROM messages WHERE n % 4 = 0 AND n % 44 <> 0 AND verdict NOT IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED', 'UNSIGNED_LEGACY')) AS false_positives, FALSE AS meets_profile"""


def trap_row(t):
    sent = t.messages.filter("n % 4 = 0").withColumn("verdict", F.when(F.col("n") % 44 != 0, F.col("verdict"))).withColumn("at_ms", F.col("ts") * 1000)
    hits = t.alerts.join(sent.select("block_id"), "block_id", "left_semi")
    return scoring.trap(sent, hits, ["PRODUCER_SIGNED", "RELAY_ATTESTED", "UNSIGNED_LEGACY"], 500, 1800)


@query("a27_trap", TRAP_SQL)
def a27(t):
    return trap_row(t).drop("duration_s")


@query("a28_scorecard", f"""WITH r AS (SELECT * FROM trials WHERE NOT failed), s AS (SELECT class, count(*) AS n FROM trials WHERE failed GROUP BY class), u AS (SELECT count(*) AS n FROM trials JOIN ({CLS}) USING (class)
      WHERE extra_alert IS NOT NULL AND extra_alert <> 'CLOCK_SKEW'), tr AS ({TRAP_SQL})
    SELECT count(*) FILTER (WHERE detected) AS detected, count(*) AS attacks, count(*) FILTER (WHERE detected) / count(*)::DOUBLE AS rate, FALSE AS valid,
    concat('INVALID RUN (control C01 failed): detected ', count(*) FILTER (WHERE detected), '/', count(*), ' attacks (', count(*) FILTER (WHERE detected), '/', (SELECT 20 * count(DISTINCT class) FROM trials),
      ' planned), ', (SELECT n FROM u), ' unexpected alerts, ', (SELECT false_positives FROM tr), '/', (SELECT messages FROM tr), ' false positives, ', (SELECT not_indexed FROM tr), ' trap messages not indexed',
      CASE WHEN (SELECT count(*) FROM s) > 0 THEN concat(' (', (SELECT sum(n) FROM s), ' planned trials not run: ', (SELECT string_agg(class, ', ' ORDER BY class) FROM s), ')') ELSE '' END) AS headline FROM r""")
def a28(t):
    from ..plans import scorecard
    return scorecard.summary_from_ledger(t).select("detected", "attacks", "rate", "valid", "headline")


@query("a29_parity", """SELECT n AS trial, n % 3 <> 0 OR n % 5 <> 0 AS agree FROM messages""")
def a29(t):
    steps = t.messages.select(F.col("n").alias("trial"), F.explode(F.array(*[F.lit(s) for s in ("hash", "inclusion", "overall")])).alias("step"))
    a = steps.withColumn("ok", F.when(F.col("step") == "hash", F.lit(None).cast("boolean")).otherwise(F.col("trial") % 2 == 0))
    b = a.withColumn("ok", F.when((F.col("step") == "inclusion") & (F.col("trial") % 15 == 0), ~F.col("ok")).otherwise(F.col("ok")))
    return scoring.parity(a, b)


@query("a30_key_status", """SELECT kid, kid <> 'did:x:3#k1' AS published, CASE WHEN bool_or(revoked_at_ms IS NULL) THEN 'active' ELSE 'revoked' END AS state,
    CASE WHEN NOT bool_or(revoked_at_ms IS NULL) THEN max(revoked_at_ms) END AS revoked_at_ms FROM key_history GROUP BY kid""")
def a30(t):
    return keys.key_status(t.key_history, t.key_history.filter("kid <> 'did:x:3#k1'").select("kid"))


@query("a32_replay_evidence", f"""SELECT block_id, earlier FROM (SELECT a.block_id, (SELECT b.block_id FROM messages b WHERE b.iss = a.iss AND b.seq = a.seq AND b.{PROVEN}
    AND (b.ms_index, b.wf_index) < (a.ms_index, a.wf_index) ORDER BY b.ms_index, b.wf_index LIMIT 1) AS earlier FROM messages a) WHERE earlier IS NOT NULL""")
def a32(t):
    from ..plans import verdicts
    return verdicts.earlier_uses(t.messages).select("block_id", "earlier")


@query("a34_highest_ids", "SELECT coalesce(max(id), 0) AS last_alert, (SELECT max(seq) FROM messages WHERE iss = 'did:x:4') AS last_seq FROM alerts")
def a34(t):
    return reports.highest_ids(t.alerts, t.messages, "did:x:4")


@query("w18_detection_latency", """SELECT n AS trial, greatest(0, coalesce(a.at_ms, ts * 1000 + 5000) - (ts * 1000 + 1500)) AS latency_ms, CASE WHEN a.at_ms IS NULL THEN 'poll' ELSE 'alert' END AS source
    FROM messages m LEFT JOIN (SELECT block_id, rule, min(at_ms) AS at_ms FROM alerts GROUP BY ALL) a ON a.block_id = m.block_id AND a.rule = CASE WHEN n % 2 = 0 THEN 'SHADOW' ELSE 'FORGED' END""")
def w18(t):
    tr = t.messages.selectExpr("n AS trial", "CASE WHEN n % 2 = 0 THEN 'SHADOW' ELSE 'FORGED' END AS exp_alert", "block_id",
                               "ts * 1000 + 1500 AS injected_ms", "ts * 1000 + 5000 AS polled_ms")
    return scoring.detections(tr, t.alerts)


