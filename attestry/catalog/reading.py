"""Search, filters, lookups, pages and set operations."""

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import ordered, reconcile, textindex
from ..operators import search as S
from ..session import scratch_path
from .columns import INCIDENT_ROWS, incident_rows
from .registry import query

COLS = "block_id, tag, verdict, ms_index, wf_index"
PROJ = ["block_id", "tag", "verdict", "ms_index", "wf_index"]


@query("f1_search_tag_verdict", f"""SELECT {COLS} FROM messages WHERE tag = 'trust.score' AND verdict = 'PRODUCER_SIGNED'
    AND ms_index BETWEEN 1000 AND 6000 AND ts >= 1704400000 AND coalesce(received_at_ms, confirmed_at_ms, ts * 1000) <= 1705700000000""")
def f1(t):
    return S.search(t.messages, tag="trust.score", verdict="PRODUCER_SIGNED", ms_from=1000, ms_to=6000,
                    ts_from=1704400000, date_to_ms=1705700000000).select(*PROJ)


TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"


@query("f2_fulltext", f"""SELECT doc_id, lang FROM documents WHERE list_has_all({TOKENS}, ['les', 'de'])""")
def f2(t):
    return t.raw("documents").filter(S.has_words(F.col("text"), "les DE")).select("doc_id", "lang")


@query("f2_inverted_index", f"""SELECT token, count(*) AS docs FROM (SELECT doc_id, unnest(list_distinct({TOKENS})) AS token FROM documents)
    GROUP BY token""")
def f2_index(t):
    index = S.inverted_index(t.raw("documents"), "doc_id", "text")
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


@query("f2_index_search", f"""SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['les', 'de', 'la'])""")
def f2_search(t):
    return S.search_index(S.inverted_index(t.raw("documents"), "doc_id", "text"), "doc_id", "les de la")


_INDEXES: dict[tuple, str] = {}


def stored_index(t) -> str:
    """The index of the documents, built once per session and folder from two loads."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _INDEXES:
        path, docs = scratch_path(t.spark, "text-index"), t.raw("documents").select("doc_id", "text")
        half = docs.agg((F.max("doc_id") / 2).alias("h")).first()["h"] or 0
        textindex.append(docs.filter(F.col("doc_id") <= half), "doc_id", "text", path, 0)
        textindex.append(docs.filter((F.col("doc_id") > half) | F.col("doc_id").isNull()), "doc_id", "text", path, 1)
        _INDEXES[key] = path
    return _INDEXES[key]


@query("f2_stored_index_search", f"""SELECT doc_id FROM documents WHERE list_has_all({TOKENS}, ['les', 'de', 'la'])""")
def f2_stored(t):
    return textindex.search(t.spark, stored_index(t), "les de la", "doc_id").select("doc_id")


@query("f2b_substring", "SELECT doc_id FROM documents WHERE contains(lower(text), 'oi le')")
def f2b(t):
    return t.raw("documents").filter(S.contains_text(F.col("text"), "OI le")).select("doc_id")


@query("f3_json_path", "SELECT event_id, user_id FROM events WHERE (props->>'$.k') = '7'")
def f3(t):
    return t.events.filter(S.json_text_at(F.col("props"), "k") == "7").select("event_id", "user_id")


@query("f4_skew", """SELECT block_id, iat - ts * 1000 AS skew_ms FROM messages WHERE iat IS NOT NULL AND ts > 0 AND abs(iat - ts * 1000) > 300000""")
def f4(t):
    from ..functions import columns as C
    return t.messages.filter(C.clock_skewed(F.col("iat"), F.col("ts"))).select("block_id", (F.col("iat") - F.col("ts") * 1000).alias("skew_ms"))


@query("f5_alert_filter", "SELECT * FROM alerts WHERE rule = 'SHADOW' AND severity = 'high' AND at_ms >= 1705000000000")
def f5(t):
    return S.matching(t.alerts, rule="SHADOW", severity="high", ie_id=None, block_id=None, since_at_ms=1705000000000)


RECEIPTS = "submissions"


@query("f7_receipt_filter", "SELECT sub_id, block_id, tag, iss, seq FROM submissions WHERE tag = 'LLO-K8s' AND iss = 'did:x:3'")
def f7(t):
    return S.matching(t.submissions, tag="LLO-K8s", iss="did:x:3").select("sub_id", "block_id", "tag", "iss", "seq")


@query("f8_report_range", f"""SELECT {COLS} FROM messages WHERE ie_id = 'Dom:000000000007' AND ms_index >= 500 AND ms_index <= 8000""")
def f8(t):
    return S.search(t.messages, ie="Dom:000000000007", ms_from=500, ms_to=8000).select(*PROJ)


@query("f9_exact_document", """SELECT block_id, json FROM messages WHERE json IN (SELECT json FROM messages WHERE n % 100 = 0)""")
def f9(t):
    hashed = t.messages.withColumn("canon_hash", H.sha256_hex(F.col("json")))
    asked = hashed.filter("n % 100 = 0").select("canon_hash").distinct()
    return hashed.join(asked, "canon_hash", "left_semi").dropDuplicates(["block_id"]).select("block_id", "json")


@query("f9_exact_document_canonical", """SELECT block_id, json FROM messages WHERE json IN (SELECT json FROM messages WHERE n % 100 = 0)""")
def f9b(t):
    # asked for with other white space: documents are equal if their canonical forms are
    hashed = t.messages.withColumn("canon_hash", H.canonical_hash(F.col("json")))
    spaced = F.concat(F.lit(" "), F.replace("json", F.lit(',"'), F.lit(' ,\n "')))
    asked = t.messages.filter("n % 100 = 0").select(H.canonical_hash(spaced).alias("canon_hash")).distinct()
    return hashed.join(asked, "canon_hash", "left_semi").select("block_id", "json")


@query("f10_alert_by_key", """SELECT id FROM alerts a WHERE EXISTS (SELECT 1 FROM alerts k WHERE k.id % 3 = 1 AND k.rule = a.rule
    AND k.block_id IS NOT DISTINCT FROM a.block_id AND k.ie_id IS NOT DISTINCT FROM a.ie_id AND k.dedupe_key IS NOT DISTINCT FROM a.dedupe_key)""")
def f10(t):
    on = ["rule", "block_id", "ie_id", "dedupe_key"]
    return S.lookup(t.alerts, t.alerts.filter("id % 3 = 1").select(*on), on).select("id")


@query("f10_exists", """SELECT block_id, block_id IN (SELECT block_id FROM alerts WHERE rule = 'SHADOW') AS has_alert,
    block_id IN (SELECT block_id FROM submissions) AS submitted FROM messages""")
def f10b(t):
    from ..operators import documents
    df = documents.flag(t.messages.select("block_id"), "block_id", t.alerts.filter("rule = 'SHADOW'").select("block_id"), "has_alert")
    return documents.flag(df, "block_id", t.submissions.select("block_id"), "submitted")


MIXED = "SELECT n, block_id, CASE WHEN n % 97 <> 0 THEN ms_index END AS ms_index, CASE WHEN n % 97 <> 0 THEN wf_index END AS wf_index, received_at_ms, ts FROM messages"


def _mixed(t):
    seen = F.col("n") % 97 != 0
    return t.messages.withColumn("ms_index", F.when(seen, F.col("ms_index"))).withColumn("wf_index", F.when(seen, F.col("wf_index")))


@query("l1_page", f"""SELECT block_id, ms_index, wf_index FROM ({MIXED}) ORDER BY CASE WHEN ms_index IS NULL THEN 0 ELSE 1 END,
    coalesce(ms_index, received_at_ms, ts) DESC, coalesce(wf_index, 0) DESC, block_id DESC LIMIT 300""")
def l1(t):
    return S.page(_mixed(t), 300).select("block_id", "ms_index", "wf_index")


@query("l1_page_after", f"""SELECT block_id, ms_index, wf_index FROM ({MIXED}) WHERE ms_index IS NOT NULL AND (ms_index < 4000
    OR (ms_index = 4000 AND (wf_index < 2 OR (wf_index = 2 AND block_id < '0x8'))))
    ORDER BY ms_index DESC, wf_index DESC, block_id DESC LIMIT 100""")
def l1b(t):
    return S.page(_mixed(t), 100, (1, 4000, 2, "0x8")).select("block_id", "ms_index", "wf_index")


@query("l2_timeline_page", """SELECT block_id, at_ms FROM (SELECT block_id, coalesce(received_at_ms, confirmed_at_ms) AS at_ms FROM messages WHERE ie_id = 'Dom:000000000005')
    WHERE at_ms > 1704700000000 OR (at_ms = 1704700000000 AND block_id > '0x4') ORDER BY at_ms, block_id LIMIT 40""")
def l2(t):
    rows = t.messages.filter("ie_id = 'Dom:000000000005'").select("block_id", F.coalesce("received_at_ms", "confirmed_at_ms").alias("at_ms"))
    return S.after_key(rows, ["at_ms", "block_id"], [1704700000000, "0x4"]).orderBy("at_ms", "block_id").limit(40)


@query("l3_newest_oldest_first", "SELECT * FROM (SELECT id, block_id FROM validations WHERE id < 12000 ORDER BY id DESC LIMIT 150)")
def l3(t):
    return S.newest(S.before_key(t.validations, ["id"], [12000]), 150, "id", oldest_first=True).select("id", "block_id")


@query("l4_report_page", """SELECT report_hash, generated_at_ms FROM (SELECT block_id AS report_hash, received_at_ms AS generated_at_ms FROM submissions)
    WHERE generated_at_ms < 1705500000000 OR (generated_at_ms = 1705500000000 AND report_hash < '0x9') ORDER BY generated_at_ms DESC, report_hash DESC LIMIT 60""")
def l4(t):
    r = t.submissions.select(F.col("block_id").alias("report_hash"), F.col("received_at_ms").alias("generated_at_ms"))
    return S.newest(S.before_key(r, ["generated_at_ms", "report_hash"], [1705500000000, "0x9"]), 60, "generated_at_ms", "report_hash")


@query("l5_newest_alerts", "SELECT id, rule, at_ms FROM alerts ORDER BY at_ms DESC, id DESC LIMIT 200")
def l5(t):
    return S.newest(t.alerts, 200, "at_ms", "id").select("id", "rule", "at_ms")


STATUS_SQL = "SELECT block_id, arg_max(status, at_ms) AS status FROM lifecycle GROUP BY block_id"


@query("l6_unfinished", f"""SELECT s.sub_id, s.block_id, l.status FROM submissions s JOIN ({STATUS_SQL}) l USING (block_id)
    WHERE l.status IN ('SUBMITTED', 'SOLID', 'CONFIRMED') ORDER BY s.received_at_ms, s.sub_id LIMIT 250""")
def l6(t):
    from ..operators import lifecycle
    now = lifecycle.current_status(t.lifecycle).filter(F.col("status").isin("SUBMITTED", "SOLID", "CONFIRMED"))
    return (t.submissions.join(now.select("block_id", "status"), "block_id").orderBy("received_at_ms", "sub_id").limit(250)
            .select("sub_id", "block_id", "status"))


@query("l8_proofs", """SELECT block_id, ms_index, (SELECT count(*) FROM messages WHERE ms_index BETWEEN 2000 AND 2500) > 100 AS truncated
    FROM messages WHERE ms_index BETWEEN 2000 AND 2500 ORDER BY ms_index, wf_index, block_id LIMIT 100""")
def l8(t):
    from ..operators import reports
    return reports.proof_index(t.messages, ms_from=2000, ms_to=2500, limit=100).select("block_id", "ms_index", "truncated")


@query("u1_candidate_blocks", """SELECT block_id FROM content_checks WHERE result = 'MATCH' UNION SELECT block_id FROM submissions
    UNION SELECT block_id FROM stored_messages UNION SELECT block_id FROM lifecycle WHERE status = 'CONTENT_VERIFIED'""")
def u1(t):
    from ..operators import reconcile
    return reconcile.candidate_blocks(t.content_checks, t.submissions, t.stored_messages, t.lifecycle)


@query("u2_table_counts", """SELECT 'messages' AS name, count(*) AS n FROM messages UNION ALL SELECT 'alerts', count(*) FROM alerts
    UNION ALL SELECT 'milestones', count(*) FROM milestones""")
def u2(t):
    from ..operators import reports
    return reports.table_counts({"messages": t.messages, "alerts": t.alerts, "milestones": t.milestones})


@query("u3_difference", "SELECT block_id FROM blocks EXCEPT SELECT block_id FROM stored_messages")
def u3(t):
    return reconcile.not_stored(t.blocks, t.stored_messages)


@query("u4_key_overlap", """SELECT DISTINCT a.id, m.corr FROM alerts a JOIN messages m ON m.block_id = a.block_id WHERE m.corr IN ('c3', 'c7')
    OR concat('ie:', m.ie_id) IN ('ie:Dom:000000000009')""")
def u4(t):
    return S.alerts_by_keys(t.alerts, t.messages, ("c3", "c7", "ie:Dom:000000000009"))


@query("u5_field_sets", """SELECT block_id, CAST(len(list_filter(json_keys(envelope), lambda k: k NOT IN ('w','tag','iss','kid','seq','iat','nonce','att','body','enc','bix','cmt','prev','corr','sig'))) AS BIGINT) AS unknown,
    CAST(len(list_filter(['w','tag','iss','sig'], lambda k: NOT list_contains(json_keys(envelope), k))) AS BIGINT) AS missing FROM envelopes""")
def u5(t):
    from ..functions import columns as C, vocabulary as V
    keys = C.fields_of(C.parsed(F.col("envelope")))
    lit = lambda names: F.array(*[F.lit(x) for x in names])
    df = t.envelopes.select("block_id", keys.alias("keys"))
    return df.select("block_id", F.size(F.array_except("keys", lit(V.ENVELOPE_FIELDS))).cast("bigint").alias("unknown"),
                     F.size(F.array_except(lit(("w", "tag", "iss", "sig")), F.col("keys"))).cast("bigint").alias("missing"))


@query("w1_latest_score", """SELECT ie_id, block_id, score, ts, ms_index FROM (SELECT *, row_number() OVER (PARTITION BY ie_id
    ORDER BY ms_index DESC, wf_index DESC, block_id DESC) AS rn FROM messages WHERE score IS NOT NULL AND verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED')) WHERE rn = 1""")
def w1(t):
    from ..operators import scores
    return scores.latest_scores(t.messages)


@query("w1_score_heads", """SELECT ie_id, block_id, score, ts, ms_index, verdict FROM (SELECT *, row_number() OVER (PARTITION BY ie_id
    ORDER BY ms_index DESC, ts DESC, block_id DESC) AS rn FROM messages WHERE score IS NOT NULL) WHERE rn = 1""")
def w1b(t):
    rows = t.messages.filter("score IS NOT NULL")
    order = [F.col(c).desc() for c in ("ms_index", "ts", "block_id")]
    return ordered.latest(rows, ["ie_id"], *order).select("ie_id", "block_id", "score", "ts", "ms_index", "verdict")


@query("w15_flow_listing", """SELECT iss, block_id, seq, prev, verdict, row_number() OVER (PARTITION BY iss ORDER BY seq, block_id) - 1 AS position FROM messages""")
def w15(t):
    return ordered.rank_by(t.messages, ["iss"], ordered.BY_SEQ).select("iss", "block_id", "seq", "prev", "verdict", "position")


@query("w16_overlays", """SELECT ie_id, 'alert' AS kind, id, at_ms AS start_ms, rule AS label, severity FROM alerts WHERE ie_id IS NOT NULL""")
def w16(t):
    from ..operators import scores
    return scores.overlays(t.alerts).drop("end_ms", "block_id")


@query("w16_overlays_all", f"""SELECT ie_id, 'alert' AS kind, CAST(id AS VARCHAR) AS id, at_ms AS start_ms, CAST(NULL AS BIGINT) AS end_ms, rule AS label, severity, block_id FROM alerts WHERE ie_id IS NOT NULL
    UNION ALL SELECT ie_id, 'incident', incident, opened_ms, closed_ms, title, severity, closed_by FROM ({INCIDENT_ROWS.format(alerts="alerts")})""")
def w16b(t):
    from ..operators import scores
    return scores.overlays(t.alerts, incident_rows(t))


@query("w17_cone_ids", """SELECT ms_index, string_agg(block_id, ',' ORDER BY wf_index) AS ids FROM messages GROUP BY ms_index""")
def w17(t):
    from ..operators import merkle
    return merkle.cone_ids(t.messages).select("ms_index", F.array_join("ids", ",").alias("ids"))
