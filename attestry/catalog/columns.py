"""Row enrichment: one column expression per query, over the whole table."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import hashing as H
from ..functions import vocabulary as V
from ..operators import documents
from .registry import query

KEY = b"search key"
_PAD = KEY.ljust(64, b"\0")
IPAD, OPAD = (bytes(b ^ x for b in _PAD).hex() for x in (0x36, 0x5C))


@query("p1_decode_tag", """SELECT block_id, CASE WHEN d IS NOT NULL AND NOT contains(d, chr(0)) THEN d
    ELSE concat('0x', lower(hex(b))) END AS tag_text FROM (SELECT block_id, b, TRY(decode(b)) AS d FROM (
    SELECT block_id, CASE WHEN n % 13 = 0 THEN unhex(substr(block_id, 3, 8)) ELSE CAST(tag AS BLOB) END AS b FROM messages))""")
def p1(t):
    raw = F.when(F.col("n") % 13 == 0, F.unhex(F.substring("block_id", 3, 8))).otherwise(F.col("tag").cast("binary"))
    return t.messages.select("block_id", C.decode_tag(raw).alias("tag_text"))


@query("p2_kind", """SELECT block_id, CASE WHEN json_valid(body) AND json_type(TRY(CAST(body AS JSON))) = 'OBJECT' THEN kind ELSE 'unknown' END AS kind
    FROM bodies""")
def p2(t):
    v = C.parsed(F.col("body"))
    return t.bodies.select("block_id", C.kind_of(F.col("tag"), C.is_object(v)).alias("kind"))


SCHEMA_SQL = """SELECT block_id, CASE WHEN NOT json_valid(body) THEN FALSE ELSE coalesce(CASE
    WHEN json_type(body) <> 'OBJECT' THEN FALSE
    WHEN kind = 'trust.score' THEN json_type(body, '$.score') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
      AND TRY_CAST(body->>'$.score' AS DOUBLE) BETWEEN 0 AND 1 AND json_type(body, '$.id') = 'VARCHAR'
      AND regexp_full_match(body->>'$.id', '[^:\\s]+:[0-9a-fA-F]{12}')
    WHEN kind LIKE 'llo%' THEN body->>'$.event' <> '' AND body->>'$.lloId' <> '' AND body->>'$.serviceComponentId' <> ''
    ELSE body->>'$.infrastructureElementId' <> '' AND (json_type(body, '$.errorCode') IN ('BIGINT', 'UBIGINT')
      OR (json_type(body, '$.errorCode') = 'VARCHAR' AND body->>'$.errorCode' <> '')) END, FALSE) END AS schema_ok FROM bodies"""


@query("p3_schema_ok", SCHEMA_SQL)
def p3(t):
    m = C.with_fields(t.bodies.select("block_id", "kind", "body"), "body", "m")
    return m.select("block_id", C.body_fits(F.col("kind"), F.col("m")).alias("schema_ok"))


@query("p4_ie_ref", """SELECT block_id, CASE WHEN NOT json_valid(body) OR json_type(body) <> 'OBJECT' THEN NULL
    WHEN kind = 'trust.score' AND regexp_full_match(body->>'$.id', '[^:\\s]+:[0-9a-fA-F]{12}') THEN body->>'$.id'
    WHEN kind = 'self-orchestrator' AND body->>'$.infrastructureElementId' <> '' THEN
      regexp_replace(body->>'$.infrastructureElementId', '^urn:ngsi-ld:InfrastructureElement:(.+)$', '\\1') END AS ie FROM bodies""")
def p4(t):
    return t.bodies.select("block_id", C.ie_of(F.col("kind"), C.parsed(F.col("body"))).alias("ie"))


@query("p5_unwrap", """SELECT block_id, is_env AS is_envelope,
    is_env AND json_exists(envelope, '$.enc') AND NOT json_exists(envelope, '$.body') AS sealed,
    CASE WHEN is_env THEN envelope->>'$.nonce' END AS nonce, CASE WHEN is_env THEN envelope->>'$.prev' END AS prev,
    CASE WHEN is_env THEN envelope->>'$.corr' END AS corr
    FROM (SELECT *, coalesce(json_type(envelope, '$.w') IN ('UBIGINT', 'BIGINT') AND (envelope->>'$.w') = '1'
      AND json_type(envelope, '$.sig') = 'VARCHAR', FALSE) AS is_env FROM envelopes)""")
def p5(t):
    m = F.col("m")
    is_env = C.is_envelope(m)
    part = lambda p: F.when(is_env & C.is_text(m[p]), C.at(m[p], "$", "string"))
    return C.with_fields(t.envelopes.select("block_id", "envelope"), "envelope", "m").select(
        "block_id", is_env.alias("is_envelope"), F.coalesce(C.is_sealed(m), F.lit(False)).alias("sealed"),
        part("nonce").alias("nonce"), part("prev").alias("prev"), part("corr").alias("corr"))


@query("p6_envelope_shape", """SELECT block_id, CASE WHEN n % 13 = 0 THEN 'not a version 1 envelope'
    WHEN list_has_any(json_keys(envelope), ['extra']) THEN 'unknown top-level field'
    WHEN NOT regexp_full_match(envelope->>'$.nonce', '[A-Za-z0-9_-]{21}[AQgw]') THEN 'invalid nonce encoding'
    WHEN (envelope->>'$.att.mode') = 'relay' AND (envelope->>'$.att.sub') IS NULL THEN 'relay attestation requires att.sub'
    WHEN json_exists(envelope, '$.body') AND json_type(envelope, '$.body') <> 'OBJECT' THEN 'invalid field: body'
    END AS problem FROM envelopes""")
def p6(t):
    m = C.with_fields(t.envelopes.select("block_id", "envelope"), "envelope", "m")
    return m.select("block_id", C.envelope_problem(F.col("m")).alias("problem"))


@query("p7_message_date", "SELECT block_id, coalesce(received_at_ms, confirmed_at_ms, ts * 1000) AS date_ms FROM messages")
def p7(t):
    return t.messages.select("block_id", C.message_date(F.col("received_at_ms"), F.col("confirmed_at_ms"), F.col("ts")).alias("date_ms"))


@query("p8_event_time", """SELECT block_id, CASE WHEN received_at_ms BETWEEN ts * 1000 - 120000 AND ts * 1000
    THEN received_at_ms ELSE ts * 1000 END AS at_ms FROM messages""")
def p8(t):
    return t.messages.select("block_id", C.event_time(F.col("ts"), F.col("confirmed_at_ms"), F.col("received_at_ms"), 120000).alias("at_ms"))


@query("p9_iso", """SELECT block_id, CASE WHEN n % 301 = 0 THEN NULL ELSE concat(strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S'), '.',
    lpad(CAST(ms % 1000 AS VARCHAR), 3, '0'), 'Z') END AS iso FROM (SELECT block_id, n, iat AS ms FROM messages)""")
def p9(t):
    ms = F.when(F.col("n") % 301 == 0, F.lit(V.MAX_SAFE_INT)).otherwise(F.col("iat"))
    return t.messages.select("block_id", C.iso(ms).alias("iso"))


@query("p10_score", """SELECT block_id, CASE WHEN json_valid(body) AND json_type(body, '$.score') IN ('DOUBLE', 'BIGINT', 'UBIGINT')
    AND CAST(body->>'$.score' AS DOUBLE) BETWEEN 0 AND 1 THEN CAST(body->>'$.score' AS DOUBLE) END AS score FROM bodies""")
def p10(t):
    return t.bodies.select("block_id", C.score_of(C.at(C.parsed(F.col("body")), "$.score")).alias("score"))


@query("p11_error_code", """SELECT block_id, coalesce(CASE WHEN NOT json_valid(body) THEN FALSE
    WHEN json_type(body, '$.errorCode') = 'BOOLEAN' THEN (body->>'$.errorCode') = 'true'
    WHEN json_type(body, '$.errorCode') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(body->>'$.errorCode' AS DOUBLE) <> 0
    WHEN json_type(body, '$.errorCode') = 'VARCHAR' THEN trim(body->>'$.errorCode') NOT IN ('', '0') END, FALSE) AS is_error FROM bodies""")
def p11(t):
    return t.bodies.select("block_id", C.is_error_code(C.at(C.parsed(F.col("body")), "$.errorCode")).alias("is_error"))


@query("p12_component_key", """SELECT block_id, lower(CASE WHEN user_id % 2 = 0 THEN concat('urn:ngsi-ld:Service:', CAST(user_id AS VARCHAR), ':Component:', service)
    ELSE concat('urn:ngsi-ld:Service:', CAST(user_id AS VARCHAR), ':Component:', upper(service)) END) AS component FROM messages WHERE service IS NOT NULL""")
def p12(t):
    k8s = F.concat(F.lit(" URN-ngsi-ld-service-"), F.col("user_id"), F.lit("-component-"), F.col("service"))
    entity = F.concat(F.lit("urn:ngsi-ld:Service:"), F.col("user_id"), F.lit(":Component:"), F.upper("service"))
    raw = F.when(F.col("user_id") % 2 == 0, k8s).otherwise(entity)
    return t.messages.filter("service IS NOT NULL").select("block_id", C.component_key(raw).alias("component"))


@query("p13_label", r"""SELECT doc_id, CASE WHEN length(s) <= 160 THEN s ELSE concat(left(s, 159), '…') END AS label FROM (
    SELECT doc_id, regexp_replace(regexp_replace(left(text, 640), '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS s FROM documents)""")
def p13(t):
    return t.raw("documents").select("doc_id", C.label(F.col("text")).alias("label"))


@query("p14_evidence", """SELECT doc_id, length(text) AS chars, CASE WHEN length(text) <= 512 THEN text ELSE concat(left(text, 509), '...') END AS shown,
    CAST(least(len(words), 65) AS BIGINT) AS items, CASE WHEN len(words) > 64 THEN concat('... ', CAST(len(words) - 64 AS VARCHAR), ' more items') END AS more
    FROM (SELECT doc_id, text, string_split(text, ' ') AS words FROM documents)""")
def p14(t):
    words = C.cut_items(F.split("text", " "))
    return t.raw("documents").select(
        "doc_id", F.char_length("text").cast("bigint").alias("chars"), C.cut_text(F.col("text")).alias("shown"),
        F.size(words).cast("bigint").alias("items"),
        F.when(F.size(words) > V.ITEMS_MAX, F.element_at(words, -1)).alias("more"))


@query("p15_canonical_hash", """SELECT event_id, concat('0x', sha256(concat('{"b":', replace(props, ' ', ''), ',"n":', CAST(event_id AS VARCHAR), '}'))) AS canon_hash FROM events""")
def p15(t):
    doc = F.concat(F.lit('{ "n" : '), F.col("event_id"), F.lit(', "b": '), F.col("props"), F.lit("}"))
    return t.events.select("event_id", H.canonical_hash(doc).alias("canon_hash"))


@query("p15_canonical_hash_blake2b")
def p15b(t):
    return t.messages.select("block_id", H.canonical_hash(F.col("json"), "blake2b").alias("canon_hash"))


@query("p16_commitment", """SELECT block_id, commitment, stored = commitment AS holds FROM (SELECT block_id, commitment,
    CASE WHEN n % 9 = 0 THEN 'x' ELSE commitment END AS stored FROM (SELECT block_id, n, rtrim(replace(replace(to_base64(unhex(sha256(
    unhex(substr(block_id, 3, 32)) || encode(CAST(seq AS VARCHAR))))), '+', '-'), '/', '_'), '=') AS commitment FROM messages))""")
def p16(t):
    salt = F.unhex(F.substring("block_id", 3, 32))
    disclosed = t.messages.select("block_id", "n", H.commitment(salt, F.col("seq").cast("string")).alias("commitment"))
    stored = disclosed.select("block_id", F.when(F.col("n") % 9 == 0, "x").otherwise(F.col("commitment")).alias("stored"))
    return disclosed.join(stored, "block_id").select("block_id", "commitment", (F.col("stored") == F.col("commitment")).alias("holds"))


@query("p17_blind_token", f"""SELECT block_id, rtrim(replace(replace(to_base64(unhex(sha256(unhex('{OPAD}') || unhex(sha256(unhex('{IPAD}')
    || encode(concat('ie:', ie_id))))))), '+', '-'), '/', '_'), '=') AS token FROM messages WHERE ie_id IS NOT NULL""")
def p17(t):
    return t.messages.filter("ie_id IS NOT NULL").select("block_id", H.blind_token(KEY, F.lit("ie"), F.col("ie_id")).alias("token"))


@query("p18_prev_link", "SELECT block_id, CASE WHEN n % 3 = 0 THEN NULL ELSE prev END AS prev FROM messages")
def p18(t):
    raw = F.when(F.col("n") % 3 == 0, F.substring("prev", 1, 40)).otherwise(F.upper(F.col("prev")))
    fixed = F.when(F.col("n") % 3 == 0, raw).otherwise(F.concat(F.lit("0x"), F.substring(raw, 3, 64)))
    return t.messages.select("block_id", C.hex_prefix(fixed).alias("prev"))


@query("p19_key_valid", """SELECT m.block_id, k.pos, k.revoked_at_ms IS NULL OR k.revoked_at_ms >= (m.ts + 1) * 1000 AS valid
    FROM messages m JOIN key_history k USING (kid)""")
def p19(t):
    return t.messages.join(t.key_history.drop("iss"), "kid").select(
        "block_id", "pos", C.valid_through_second(F.col("revoked_at_ms"), F.col("ts")).alias("valid"))


@query("p20_severity", """SELECT block_id, arg_max(severity, CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) AS worst
    FROM alerts WHERE block_id IS NOT NULL GROUP BY block_id""")
def p20(t):
    return (t.alerts.filter("block_id IS NOT NULL").groupBy("block_id")
            .agg(F.max_by("severity", C.severity_rank(F.col("severity"))).alias("worst")))


@query("p21_redaction", """SELECT block_id, CASE WHEN n % 13 <> 0 AND json_exists(envelope, '$.enc') AND NOT json_exists(envelope, '$.body')
    AND n % 2 = 0 THEN NULL ELSE CASE WHEN n % 2 = 0 THEN json ELSE envelope END END AS shown FROM envelopes""")
def p21(t):
    sent = F.when(F.col("n") % 2 == 0, F.col("json")).otherwise(F.col("envelope"))
    hidden = C.relay_sealed(C.parsed(F.col("envelope")), C.parsed(sent))
    return t.envelopes.select("block_id", F.when(~hidden, sent).alias("shown"))


@query("p22_json_diff", """SELECT block_id, path, kind FROM (
    SELECT block_id, '$.score' AS path, 'changed' AS kind FROM bodies JOIN messages USING (block_id) WHERE body <> json AND json_valid(body)
      AND bodies.kind = 'trust.score' AND json_type(body) = 'OBJECT' AND (body->'$.score')::VARCHAR <> (json->'$.score')::VARCHAR
    UNION ALL SELECT block_id, '$.id', 'changed' FROM bodies JOIN messages USING (block_id) WHERE body <> json AND json_valid(body)
      AND bodies.kind = 'trust.score' AND json_type(body) = 'OBJECT' AND (body->>'$.id') <> (json->>'$.id')
    UNION ALL SELECT block_id, '$', 'changed' FROM bodies JOIN messages USING (block_id)
      WHERE bodies.kind = 'trust.score' AND json_valid(body) AND json_type(body) <> 'OBJECT')""")
def p22(t):
    pairs = (t.bodies.filter("kind = 'trust.score'").select("block_id", F.col("body").alias("actual"))
             .join(t.messages.select("block_id", F.col("json").alias("expected")), "block_id"))
    return documents.json_diff(pairs, ["block_id"], "expected", "actual").select("block_id", "path", "kind")


@query("p22_json_diff_all", """WITH p AS (SELECT block_id, n, json AS e, body AS a FROM bodies JOIN (SELECT block_id, json FROM messages) USING (block_id) WHERE json_valid(body)),
    k AS (SELECT DISTINCT block_id, e, a, unnest(list_concat(json_keys(e), json_keys(a))) AS k FROM p WHERE json_type(a) = 'OBJECT')
    SELECT block_id, concat('$.m[0].', k) AS path, CASE WHEN NOT json_exists(a, concat('$.', k)) THEN 'removed' WHEN NOT json_exists(e, concat('$.', k)) THEN 'added' ELSE 'changed' END AS kind
      FROM k WHERE json_extract(e, concat('$.', k))::VARCHAR IS DISTINCT FROM json_extract(a, concat('$.', k))::VARCHAR
    UNION ALL SELECT block_id, '$.m[0]', 'changed' FROM p WHERE json_type(a) <> 'OBJECT'
    UNION ALL SELECT block_id, '$.m[1].k[1]', 'changed' FROM p WHERE n % 3 = 0
    UNION ALL SELECT block_id, '$.m[2]', 'added' FROM p WHERE n % 5 = 0
    UNION ALL SELECT block_id, '$.m[1].x', 'removed' FROM p WHERE n % 7 = 0""")
def p22b(t):
    # bodies of every kind, inside arrays and objects that differ too
    n = F.col("n")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    expected = text('{"m":[', F.col("json"), ',{"k":[0,', n.cast("string"), ']', F.when(n % 7 == 0, ',"x":null').otherwise(""), '}]}')
    actual = text('{"m":[', F.col("body"), ',{"k":[0,', F.when(n % 3 == 0, n + 1).otherwise(n).cast("string"), ']}', F.when(n % 5 == 0, ',[1]').otherwise(""), ']}')
    pairs = t.bodies.select("block_id", "n", "body").join(t.messages.select("block_id", "json"), "block_id").select(
        "block_id", expected.alias("expected"), actual.alias("actual"))
    return documents.json_diff(pairs, ["block_id"], "expected", "actual").select("block_id", "path", "kind")


@query("p23_first_difference", """SELECT block_id, CAST(coalesce(list_position(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: a[i] <> b[i]), TRUE) - 1,
    least(length(a), length(b))) AS BIGINT) AS first_diff FROM (SELECT m.block_id, m.json AS a, b.body AS b FROM messages m JOIN bodies b USING (block_id))""")
def p23(t):
    return (t.messages.select("block_id", "json").join(t.bodies.select("block_id", "body"), "block_id")
            .select("block_id", C.first_difference(F.col("json"), F.col("body")).alias("first_diff")))


@query("p24_claims_issuer", "SELECT block_id, verdict NOT IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED') AS claims FROM messages")
def p24(t):
    return t.messages.select("block_id", C.claims_issuer(F.col("iss"), F.col("verdict")).alias("claims"))


@query("p25_writer_rule", """SELECT block_id, coalesce(list_contains(allowed, '*') OR list_contains(allowed, iss), FALSE) AS may_write,
    coalesce(require_signature AND NOT legacy_grace, FALSE) AS signature_required FROM messages LEFT JOIN policy USING (tag)""")
def p25(t):
    return documents.with_writer_rule(t.messages, t.policy).select("block_id", "may_write", "signature_required")


@query("p26_solid", "SELECT id, is_solid AND inclusion_state <> 'conflicting' AS solid FROM validations")
def p26(t):
    return t.validations.select("id", C.solid_ok(F.col("is_solid"), F.col("inclusion_state")).alias("solid"))


TRUST_SQL = """SELECT m.block_id, CASE WHEN m.verdict NOT IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED', 'UNSIGNED_LEGACY') THEN 'untrusted'
    WHEN m.verdict = 'UNSIGNED_LEGACY' AND coalesce(p.require_signature AND NOT p.legacy_grace, FALSE) THEN 'untrusted'
    WHEN m.verdict <> 'UNSIGNED_LEGACY' AND NOT coalesce(list_contains(p.allowed, '*') OR list_contains(p.allowed, m.iss), FALSE) THEN 'untrusted'
    WHEN m.block_id IN (SELECT block_id FROM alerts WHERE rule IN ('SHADOW', 'UNSIGNED')) THEN 'untrusted'
    WHEN m.verdict = 'PRODUCER_SIGNED' THEN 'proven'
    WHEN m.verdict = 'RELAY_ATTESTED' OR m.block_id IN (SELECT block_id FROM submissions) THEN 'relayed' ELSE 'untrusted' END AS trust
    FROM messages m LEFT JOIN policy p USING (tag)"""


@query("p27_trust_level", TRUST_SQL)
def p27(t):
    return documents.with_trust(t.messages, t.policy, t.alerts, t.submissions).select("block_id", "trust")


@query("p28_score_series", """SELECT ie_id, block_id, ts * 1000 AS at_ms, score, CASE WHEN verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED') THEN 'signed'
    WHEN verdict = 'UNSIGNED_LEGACY' THEN 'unsigned' ELSE 'rejected' END AS family,
    verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED', 'UNSIGNED_LEGACY') AS on_line FROM messages WHERE score IS NOT NULL""")
def p28(t):
    family = C.verdict_family(F.col("verdict"))
    return (t.messages.filter("score IS NOT NULL")
            .select("ie_id", "block_id", (F.col("ts") * 1000).alias("at_ms"), "score", family.alias("family"),
                    family.isin("signed", "unsigned").alias("on_line")))


@query("p30_event_trust", """SELECT block_id, CASE WHEN revoked IS NOT NULL THEN 'revoked' WHEN trust = 'odd' THEN 'unknown' ELSE trust END AS level FROM (
    SELECT block_id, CASE WHEN n % 23 = 0 THEN 'shadow' END AS revoked, CASE WHEN n % 3 = 0 THEN 'proven' WHEN n % 3 = 1 THEN 'relayed' ELSE 'odd' END AS trust FROM messages)""")
def p30(t):
    n = F.col("n")
    trust = F.when(n % 3 == 0, "proven").when(n % 3 == 1, "relayed").otherwise("odd")
    return t.messages.select("block_id", C.trust_of_event(trust, F.when(n % 23 == 0, "shadow")).alias("level"))


@query("p31_feed_rows", """SELECT 'message' AS kind, concat('m:', block_id) AS key, ts * 1000 AS at_ms, tag AS title, verdict AS state, block_id FROM messages
    UNION ALL SELECT 'milestone', concat('ms:', CAST(idx AS VARCHAR)), ts * 1000, NULL, NULL, NULL FROM milestones
    UNION ALL SELECT 'alert', concat('a:', CAST(id AS VARCHAR)), at_ms, rule, severity, block_id FROM alerts""")
def p31(t):
    return documents.feed_rows(messages=t.messages, milestones=t.milestones, alerts=t.alerts)


#: Incidents as plain rows, in both dialects: one per element with alerts.
INCIDENT_ROWS = """SELECT concat('ie:', ie_id) AS incident, ie_id, min(at_ms) AS opened_ms, max(at_ms) AS closed_ms, 'alerts' AS title, 'closed:quiet' AS status,
    'high' AS severity, min(block_id) AS closed_by FROM {alerts} WHERE ie_id IS NOT NULL GROUP BY ie_id"""


def incident_rows(t):
    return t.spark.sql(INCIDENT_ROWS, alerts=t.alerts)


@query("p31_feed_rows_all", f"""SELECT 'message' AS kind, concat('m:', block_id) AS key, ts * 1000 AS at_ms, tag AS title, verdict AS state, block_id FROM messages
    UNION ALL SELECT 'milestone', concat('ms:', CAST(idx AS VARCHAR)), ts * 1000, NULL, NULL, NULL FROM milestones
    UNION ALL SELECT 'alert', concat('a:', CAST(id AS VARCHAR)), at_ms, rule, severity, block_id FROM alerts
    UNION ALL SELECT 'anchor', concat('c:', CAST(seq AS VARCHAR)), at_ms, NULL, status, NULL FROM anchors
    UNION ALL SELECT 'incident', concat('i:', incident), opened_ms, title, status, NULL FROM ({INCIDENT_ROWS.format(alerts="alerts")})""")
def p31b(t):
    return documents.feed_rows(messages=t.messages, milestones=t.milestones, alerts=t.alerts, anchors=t.anchors, incidents=incident_rows(t))
