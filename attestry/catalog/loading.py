"""Readers and idempotent loads."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import anchors, reports
from ..sources import loads, records
from .registry import query

RECORD = ("CASE WHEN n % 29 = 0 THEN 'not json' WHEN n % 31 = 0 THEN '{\"subId\":\"x\"}' ELSE concat('{\"subId\":\"', sub_id, '\",\"receivedAtMs\":', CAST(received_at_ms AS STRING),"
          " ',\"tag\":\"', tag, '\",\"message\":', message_json, ',\"dataHex\":', CASE WHEN n % 37 = 0 THEN 'null' WHEN n % 41 = 0 THEN '\"0xabc\"' ELSE concat('\"', data_hex, '\"') END,"
          " ',\"blockId\":\"', block_id, '\",\"status\":201,\"relay\":{\"verdict\":\"', relay_verdict, '\",\"iss\":\"', iss, '\",\"seq\":', CASE WHEN n % 43 = 0 THEN '\"7\"' ELSE CAST(seq AS STRING) END, '}}') END AS value")
GOOD = "n % 29 <> 0 AND n % 31 <> 0 AND n % 37 <> 0 AND n % 41 <> 0 AND n % 43 <> 0"


def record_lines(t, *more):
    return t.submissions.selectExpr("source", RECORD, *more)


@query("s1_submission_records", f"SELECT sub_id, block_id, received_at_ms, source, tag, message_json, data_hex, CAST(201 AS BIGINT) AS node_status, relay_verdict, iss, seq FROM submissions WHERE {GOOD}")
def s1(t):
    good, _ = records.parse_submissions(record_lines(t, "message_json AS _sent"), F.col("source"), keep=["_sent"])
    # compared with the text sent: key order inside the message is not part of the record
    return good.withColumn("message_json", F.when(F.to_json(C.parsed(F.col("_sent"))) == F.col("message_json"), F.col("_sent"))).drop("_sent")


@query("s1_quarantine", f"""SELECT CASE WHEN n % 29 = 0 THEN 'submission record must be a JSON object' WHEN n % 31 = 0 THEN 'submission record misses a field'
    WHEN n % 37 = 0 THEN 'a record with a blockId must carry the dataHex that was sent' WHEN n % 41 = 0 THEN 'dataHex must be 0x-prefixed hex of whole bytes' ELSE 'relay.seq must be an integer' END AS problem, count(*) AS n
    FROM submissions WHERE NOT ({GOOD}) GROUP BY 1""")
def s1b(t):
    _, bad = records.parse_submissions(record_lines(t), F.col("source"))
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("s2_insert_once", "SELECT sub_id, block_id FROM submissions WHERE n % 3 <> 0")
def s2(t):
    cols = ["sub_id", "block_id", "received_at_ms", "source"]
    new = t.submissions.select(*cols)
    # the same block again over the other transport, and the same submission again later
    again = new.withColumn("sub_id", F.concat(F.lit("z"), "sub_id")).withColumn("received_at_ms", F.col("received_at_ms") + 5)
    later = new.withColumn("received_at_ms", F.col("received_at_ms") + 9)
    stored = t.submissions.filter("n % 3 = 0").select(*cols)
    return loads.insert_submissions(stored, new.union(again).union(later)).select("sub_id", "block_id")


@query("s3_milestone_load", "SELECT idx, id FROM milestones WHERE idx % 10 < 4")
def s3(t):
    new = t.milestones.select("idx", "id")
    return loads.append_new(t.milestones.filter("idx % 10 >= 4"), new.union(new), ["idx"])


UPSERT_COLS = ["block_id", "tag", "verdict", "iat", "nonce", "ms_index", "wf_index", "ts", "confirmed_at_ms"]


@query("s4_message_upsert", """SELECT block_id, CASE WHEN n % 4 = 0 THEN 'inserted' WHEN n % 4 = 1 THEN 'confirmed' END AS outcome, ms_index, ts, CASE WHEN n % 4 = 2 THEN 'OLD' ELSE verdict END AS verdict FROM messages WHERE n % 4 < 3""")
def s4(t):
    m = t.messages.filter("n % 4 < 3")
    unconfirmed = F.col("n") % 4 == 1
    stored = m.filter("n % 4 > 0").withColumn("verdict", F.when(~unconfirmed, "OLD"))
    for c in ("ms_index", "wf_index", "confirmed_at_ms"):
        stored = stored.withColumn(c, F.when(~unconfirmed, F.col(c)))
    stored = stored.withColumn("ts", F.when(unconfirmed, 0).otherwise(F.col("ts")))
    return loads.upsert_messages(stored.select(*UPSERT_COLS), m.select(*UPSERT_COLS)).select("block_id", "outcome", "ms_index", "ts", "verdict")


@query("s4_message_upsert_all", """SELECT block_id, CASE n % 4 WHEN 0 THEN 'inserted' WHEN 1 THEN 'confirmed' END AS outcome, CASE WHEN n % 4 <> 3 THEN ms_index END AS ms_index,
    CASE WHEN n % 4 = 3 THEN 0 ELSE ts END AS ts, CASE WHEN n % 4 >= 2 THEN 'OLD' ELSE verdict END AS verdict FROM messages""")
def s4b(t):
    # all messages: new, confirmed by the second copy, confirmed before, and unconfirmed in both copies
    k = F.col("n") % 4
    stored = t.messages.filter("n % 4 > 0").withColumn("verdict", F.when(k > 1, "OLD"))
    for c in ("ms_index", "wf_index", "confirmed_at_ms"):
        stored = stored.withColumn(c, F.when(k == 2, F.col(c)))
    stored = stored.withColumn("ts", F.when(k == 2, F.col("ts")).otherwise(0))
    new = t.messages
    for c in ("ms_index", "wf_index", "confirmed_at_ms"):
        new = new.withColumn(c, F.when(k < 3, F.col(c)))
    return loads.upsert_messages(stored.select(*UPSERT_COLS), new.select(*UPSERT_COLS)).select("block_id", "outcome", "ms_index", "ts", "verdict")


@query("s5_blind_rows", """SELECT DISTINCT block_id, token FROM (SELECT block_id, unnest(['t' || user_id, 't' || n % 5]) AS token FROM envelopes WHERE n % 11 = 0 AND n % 13 <> 0)""")
def s5(t):
    tok = t.envelopes.select("block_id", C.blind_tokens(C.parsed(F.col("envelope"))).alias("tokens"))
    return loads.blind_rows(tok, "tokens")


@query("s5_score_rows", "SELECT ie_id, block_id, ms_index, ts, score, verdict FROM messages WHERE score IS NOT NULL")
def s5b(t):
    df = t.messages.filter("kind = 'trust.score'").select("block_id", "ms_index", "ts", "verdict", "kind", "json")
    df = C.with_fields(df, "json", "m").filter(C.body_fits(F.col("kind"), F.col("m")))
    return df.select(C.at(F.col("m")["id"], "$", "string").alias("ie_id"), "block_id", "ms_index", "ts", C.score_of(F.col("m")["score"]).alias("score"), "verdict")


@query("s6_alert_insert", "SELECT id, rule FROM alerts WHERE id % 3 <> 0")
def s6(t):
    a = t.alerts
    # stored ones come again, and every new one twice
    return loads.insert_alerts(a.filter("id % 3 = 0"), a.union(a)).select("id", "rule")


@query("s7_event_tail", "SELECT id, rule AS type, at_ms FROM alerts WHERE id > 40000 AND rule = 'SHADOW' ORDER BY id LIMIT 120")
def s7(t):
    log = t.alerts.select("id", F.col("rule").alias("type"), "at_ms")
    return loads.tail(log, 40000, "SHADOW", 120)


@query("s9_context_entities", """SELECT entity_id, ie_id, 'Dom' AS domain, CASE WHEN user_id % 7 = 0 THEN NULL ELSE trust_score END AS trust_score FROM context_ie""")
def s9(t):
    score = F.coalesce(F.col("trust_score").cast("string"), F.lit("null"))
    value = (F.when(F.col("user_id") % 7 == 0, F.lit('"high"')).when(F.col("user_id") % 2 == 0, score)
             .otherwise(F.concat(F.lit('{"type":"Property","value":'), score, F.lit("}"))))
    lines = t.context_ie.select(F.concat(F.lit('{"id":"'), "entity_id", F.lit('","trustScore":'), value, F.lit("}")).alias("value"))
    return records.context_entities(lines).drop("raw_score")


@query("s10_component_hosts", "SELECT service AS component, host_ie FROM component_host")
def s10(t):
    urn = F.concat(F.lit('"urn:ngsi-ld:InfrastructureElement:'), "host_ie", F.lit('"'))
    k = F.substring("service", 4, 3).cast("int") % 4
    attr = (F.when(k == 0, urn).when(k == 1, F.concat(F.lit('{"type":"Relationship","object":'), urn, F.lit("}")))
            .when(k == 2, F.concat(F.lit('{"value":'), urn, F.lit("}"))).otherwise(F.concat(F.lit('{"object":{"id":'), urn, F.lit("}}"))))
    lines = t.component_host.select(F.concat(F.lit('{"id":"'), "service", F.lit('","infrastructureElement":'), attr, F.lit("}")).alias("value"))
    return records.component_hosts(lines).select("component", "host_ie")


MIRROR = ("concat('{\"seq\":', CAST(ms_index % 40 + 1 AS STRING), ',\"checkpoint\":{\"v\":1,\"kind\":\"k\",\"network\":\"net\",\"domain\":\"d\",\"from\":{\"index\":', CAST(ms_index AS STRING), ',\"id\":\"', block_id,"
          " '\"},\"to\":{\"index\":', CAST(ms_index + 9 AS STRING), ',\"id\":\"', block_id, '\"},\"msRoot\":\"', block_id, '\",\"msgCount\":5,\"policyHash\":\"', block_id, '\",\"prev\":', CASE WHEN n % 3 = 0 THEN '\"zz\"' ELSE 'null' END,"
          " '},\"checkpointHash\":\"', block_id, '\",\"rebased\":{\"network\":\"net\",\"trail\":\"', block_id, '\",\"record\":', CAST(n AS STRING), ',\"tx\":\"', repeat('A', 40), '\"}}') AS json")
MIRROR_SQL = "SELECT *, ms_index % 40 + 1 AS aseq FROM messages WHERE iss = 'did:x:2' AND verdict = 'PRODUCER_SIGNED' AND n % 3 <> 0"


@query("s11_mirrored_anchors", f"""SELECT aseq AS seq, ms_index AS from_ms, ms_index + 9 AS to_ms, block_id AS ms_root, n AS record, block_id FROM (SELECT *, row_number() OVER (PARTITION BY aseq ORDER BY ms_index, wf_index, block_id) AS rn FROM ({MIRROR_SQL})) WHERE rn = 1""")
def s11(t):
    m = t.messages.selectExpr("block_id", "ms_index", "wf_index", "ts", "verdict", "iss", "'ledger.anchor' AS tag", MIRROR)
    anchors, _ = records.mirrored_anchors(m, "ledger.anchor", "did:x:2")
    return anchors.select("seq", "from_ms", "to_ms", "ms_root", "record", "block_id")


@query("s11_anchor_clashes", f"""SELECT a.aseq AS seq, a.block_id FROM ({MIRROR_SQL}) a JOIN (SELECT aseq, arg_min(block_id, (ms_index, wf_index, block_id)) AS first FROM ({MIRROR_SQL}) GROUP BY aseq) f USING (aseq) WHERE a.block_id <> first""")
def s11b(t):
    m = t.messages.selectExpr("block_id", "ms_index", "wf_index", "ts", "verdict", "iss", "'ledger.anchor' AS tag", MIRROR)
    return records.mirrored_anchors(m, "ledger.anchor", "did:x:2")[1].select("seq", "block_id")


@query("s12_anchor_upsert", """SELECT seq, from_ms, CASE WHEN seq % 3 = 0 THEN 'mismatch' ELSE status END AS status, CASE WHEN seq % 3 = 0 AND seq % 2 = 0 THEN 'tx2' WHEN seq % 4 <> 3 OR seq % 3 = 0 THEN 'tx1' END AS tx, record
    FROM anchors""")
def s12(t):
    a = t.anchors.select("seq", "from_ms", "to_ms", "ms_root", "checkpoint_hash", "status", "record")
    stored = a.filter("seq % 4 <> 3 OR seq % 3 = 0").withColumn("tx", F.lit("tx1"))
    new = a.filter("seq % 4 = 3 AND seq % 3 <> 0").withColumn("tx", F.lit(None).cast("string"))
    change = a.filter("seq % 3 = 0").withColumn("status", F.lit("mismatch")).withColumn("tx", F.when(F.col("seq") % 2 == 0, "tx2"))
    change = change.withColumn("from_ms", F.lit(0).cast("bigint")).withColumn("record", F.lit(None).cast("bigint"))
    return loads.upsert_anchors(stored, new.unionByName(change)).select("seq", "from_ms", "status", "tx", "record")


@query("s13_trial_log", """SELECT class, trials, concat('setup ', first) AS error FROM (SELECT class, count(*) AS trials, CAST(min(trial) AS VARCHAR) AS first FROM trials WHERE failed GROUP BY class)""")
def s13(t):
    line = F.to_json(F.struct("class", "trial", F.when(F.col("failed"), "error").otherwise("ok").alias("status"), "error", "detected", "observed", "latency_ms"))
    return records.trial_log(t.trials.select(line.alias("value")))[2]


@query("s14_report_store", """SELECT block_id AS report_hash, n % 2 = 0 AS anchored FROM messages WHERE n % 5 = 0 AND n % 3 <> 0""")
def s14(t):
    r = t.messages.filter("n % 5 = 0").select(F.col("block_id").alias("report_hash"), "n")
    new = reports.put_reports(r.filter("n % 3 = 0"), r.union(r))
    accepted = new.filter("n % 2 = 0").select("report_hash", F.col("report_hash").alias("block_id"), F.lit(1).cast("bigint").alias("anchored_at_ms"))
    return reports.mark_anchored(new, accepted).select("report_hash", "anchored")


@query("s14_report_store_all", """SELECT block_id AS report_hash, n % 2 = 0 AS anchored FROM messages WHERE n % 3 <> 0""")
def s14b(t):
    # a report per message; those with n % 3 = 0 are stored already
    r = t.messages.select(F.col("block_id").alias("report_hash"), "n")
    new = reports.put_reports(r.filter("n % 3 = 0"), r.union(r))
    accepted = r.filter("n % 2 = 0").select("report_hash", F.col("report_hash").alias("block_id"), F.lit(1).cast("bigint").alias("anchored_at_ms"))
    return reports.mark_anchored(new, accepted).select("report_hash", "anchored")


@query("l7_anchor_rotation", """SELECT seq, CAST(CASE WHEN seq % 7 = 0 THEN 0 ELSE 1 END AS BIGINT) AS priority FROM anchors""")
def l7(t):
    # every anchor is audited in each run; the unverified ones only come first
    return anchors.rotation(t.anchors).select("seq", "priority")


@query("l7_anchor_rotation_page", """SELECT seq, 0::BIGINT AS priority FROM anchors WHERE status = 'pending'
    UNION ALL SELECT * FROM (SELECT seq, 1::BIGINT FROM anchors WHERE status <> 'pending' AND seq > 3 ORDER BY seq LIMIT 4)""")
def l7b(t):
    return anchors.rotation(t.anchors, page=4, after=3).select("seq", "priority")
