"""Incident correlation over the whole ledger."""

from pyspark.sql import functions as F

from ..fixtures import Ledger
from ..operators import search as S
from ..plans import incidents as I
from .registry import query

AS_OF = 1706700000000
_RUNS: dict[tuple, tuple] = {}


def run(t: Ledger):
    """One correlation run per ledger; its tables live in the shared folder."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _RUNS:
        _RUNS[key] = I.correlate(t.messages, t.alerts, t.submissions, t.policy, t.context_ie, t.component_host, AS_OF)
    return _RUNS[key]


@query("i1_observations")
def i1(t):
    return run(t)[0].select("primary", "block_id", "role", "level", "opens", "severity", "at_ms")


@query("i2_subjects")
def i2(t):
    return run(t)[0].select("block_id", "ie_id", F.array_join("keys", ",").alias("keys")).distinct()


SESSION_SQL = """WITH e AS (SELECT ie_id, ts, block_id FROM messages WHERE tag = 'self-orchestrator' AND error_code <> 0 AND verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED')),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY ie_id ORDER BY ts, block_id) <= 36000 THEN 0 ELSE 1 END AS s FROM e),
    h AS (SELECT *, sum(s) OVER (PARTITION BY ie_id ORDER BY ts, block_id) AS run FROM g)
    SELECT ie_id, min(ts) AS opened, max(ts) AS last, count(*) AS events FROM h GROUP BY ie_id, run"""


@query("i3_sessions", SESSION_SQL)
def i3(t):
    rows = t.messages.filter("tag = 'self-orchestrator' AND error_code <> 0 AND verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED')")
    return I.sessions(rows, 36000)


SHARED_SQL = """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY ts, ms_index, wf_index, block_id) AS i, block_id, ts * 1000 AS t, verdict = 'PRODUCER_SIGNED' AS proven,
      ['ie:' || ie_id, 'iss:' || iss] AS keys FROM messages WHERE tag = 'self-orchestrator' AND error_code <> 0 AND verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED')),
    s AS (SELECT 0::BIGINT AS i, []::STRUCT(name VARCHAR, keys VARCHAR[], opened BIGINT, pinned BIGINT, fin BIGINT, n BIGINT)[] AS st
      UNION ALL SELECT i, CASE WHEN b IS NULL THEN list_append(st, {'name': keys[1] || '@' || block_id, 'keys': keys, 'opened': t, 'pinned': t, 'fin': t, 'n': 1::BIGINT})
        ELSE list_transform(st, lambda x, k: CASE WHEN k <> b THEN x ELSE {'name': x.name, 'keys': if(proven, list_distinct(list_concat(x.keys, keys)), x.keys), 'opened': x.opened,
          'pinned': if(proven, greatest(x.pinned, t), x.pinned), 'fin': greatest(x.fin, if(proven, t, least(t, x.pinned + 600000))), 'n': x.n + 1} END) END
      FROM (SELECT o.*, st, list_max(list_transform(list_filter(range(1, len(st) + 1), lambda k: list_has_any(st[k].keys, keys) AND t BETWEEN st[k].opened - 600000 AND st[k].fin + 600000),
        lambda k: {'e': st[k].fin, 'k': k})).k AS b FROM s JOIN o ON o.i = s.i + 1))
    SELECT x.name AS incident, x.opened AS opened_ms, x.fin AS last_ms, x.n AS events, array_to_string(list_sort(x.keys), ',') AS keys
    FROM (SELECT unnest(st) AS x FROM s WHERE i = (SELECT count(*) FROM o))"""


@query("i3_shared_keys", SHARED_SQL)
def i3b(t):
    """Errors gathered by element and issuer, whichever an incident already has."""
    rows = t.messages.filter("tag = 'self-orchestrator' AND error_code <> 0 AND verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED')")
    found = I.incidents(I.fold_all(I.numbered(I.plain_observations(rows), "errors"), I.Settings(), AS_OF))
    keys = F.array_join(F.array_sort(F.from_json("keys", "array<string>")), ",")
    return found.select("incident", "opened_ms", "last_ms", "events", keys.alias("keys"))


@query("i5_incidents")
def i5(t):
    return I.incidents(run(t)[1])


@query("i6_recovered")
def i6(t):
    return I.incidents(run(t)[1]).filter("status = 'closed:recovered'").select("incident", "closed_by", "closed_ms", "baseline", "low")


@query("i7_quiet")
def i7(t):
    return I.incidents(run(t)[1]).filter("status = 'closed:quiet'").select("incident", "last_ms", "closed_ms")


@query("i9_linked_alerts")
def i9(t):
    return I.linked_alerts(run(t)[1])


@query("i10_timeline")
def i10(t):
    return I.timeline(I.events(run(t)[1]), t.messages, t.lifecycle)


@query("i11_changes")
def i11(t):
    return run(t)[1].select("incident", "n", "action", "block_id", "role", "status", "severity")


@query("f6_incident_filter")
def f6(t):
    return S.matching(I.incidents(run(t)[1]), severity="high", since_opened_ms=1704500000000).select("incident", "status", "opened_ms")


@query("j20_incident_timeline")
def j20(t):
    return I.timeline(I.events(run(t)[1]), t.messages, t.lifecycle)


@query("j21_incident_alerts")
def j21(t):
    links = I.linked_alerts(run(t)[1]).select("incident", "alert_id").distinct()
    return links.join(t.alerts.withColumnRenamed("id", "alert_id"), "alert_id").select("incident", "alert_id", "rule", "severity", "at_ms")


@query("a31_incident_counts")
def a31(t):
    return I.incidents(run(t)[1]).select("incident", "events", "alerts")


@query("a33_recovery_target")
def a33(t):
    obs, changes = run(t)
    return I.recovery_targets(I.events(changes), obs)


@query("s8_alert_routing")
def s8(t):
    from ..sources import loads
    changes = run(t)[1].filter("incident IS NOT NULL").select("action", "incident", "status", "severity", "title", "ie_id", "block_id", "role", "at_ms", "rule")
    return loads.route(changes, "ledger/alerts")


@query("i4_extension")
def i4(t):
    # how far the events of an incident moved its end past its opening
    return I.incidents(run(t)[1]).select("incident", (F.col("last_ms") - F.col("opened_ms")).alias("extended_ms"), "events")


@query("i8_revoked_evidence", """SELECT block_id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM messages JOIN alerts USING (block_id)
    WHERE kind = 'self-orchestrator' AND error_code <> 0 AND verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED') AND rule IN ('SHADOW', 'UNSIGNED') GROUP BY block_id""")
def i8(t):
    # in hindsight: events that would count but for an alert raised on their block
    bad = t.alerts.filter(F.col("rule").isin("SHADOW", "UNSIGNED"))
    s = I.Settings(hindsight=True)

    def counted(alerts):
        rows = I.message_observations(I._subjects(t.messages, t.policy, alerts, t.submissions, t.component_host, s), s)
        return rows.filter("role = 'security'").select("block_id")

    lost = counted(t.alerts.join(bad.select("id"), "id", "left_anti")).join(counted(t.alerts), "block_id", "left_anti").join(bad.select("block_id", "rule"), "block_id")
    return lost.groupBy("block_id").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))


@query("i8_revocations", """SELECT DISTINCT block_id, rule FROM messages JOIN alerts USING (block_id)
    WHERE kind = 'self-orchestrator' AND error_code <> 0 AND verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED') AND rule = 'SHADOW' AND at_ms > ts * 1000""")
def i8b(t):
    # as it happened: errors counted when they came and were taken back when the alert did
    obs, changes = run(t)
    errors = obs.filter("role = 'security' AND is_drop = false AND severity = 'medium'").select("block_id")
    return changes.filter("action = 'revoked'").join(errors, "block_id", "left_semi").select("block_id", "rule").distinct()


@query("i11_memberships")
def i11b(t):
    return I.memberships(run(t)[1]).select("incident", "block_id", "role", "sign")
