"""The incident fold on written scenarios; components and streams against one sequential fold of everything."""

import random
from collections import Counter
from types import SimpleNamespace

import pytest

from attestry.catalog import streams
from attestry.catalog.incident_queries import AS_OF
from attestry.fixtures import Ledger
from attestry.operators import ordered
from attestry.plans import incidents as I
from attestry.session import scratch_path
from attestry.streaming import jobs as J

MIN = 60_000


def obs(spark, rows):
    return spark.createDataFrame([tuple(full(i, r)[c] for c in I.COLUMNS) for i, r in enumerate(rows)], I.OBSERVATION)


def full(i, r):
    d = dict(primary="ie:A", ord_ms=r["at"], ms_index=r["at"], wf_index=0, rank=0, alert_id=-1, block_id=f"b{i}", at_ms=r["at"], role="security", level="proven",
             opens=True, finding=False, severity="medium", title="t", ie_id="A", keys=["ie:A"], score=None, base=None, base_block=None, is_drop=False, rule=None,
             link_only=False, pending=False)
    d.update({k: v for k, v in r.items() if k != "at"})
    return d


def whole(spark, rows, as_of=10**9):
    """The changes as the library finds them: components in Spark, a fold of each."""
    return I.fold_all(I.numbered(obs(spark, rows), "test-observations"), I.Settings(), as_of)


def sequential(rows, as_of):
    """One fold over all observations in order, nothing grouped."""
    made = I.Fold(I.Settings())
    for d in sorted((full(i, r) for i, r in enumerate(rows)), key=lambda d: tuple(d[c] for c in I.ORDER)):
        made.feed(SimpleNamespace(**d))
    made.put_down(as_of)
    return [(0, *r) for r in made.out]


def fold(spark, rows, as_of=10**9):
    return spark.createDataFrame(sequential(rows, as_of), I.CHANGE)


def found(changes):
    return sorted((r["opened_ms"], r["last_ms"], r["status"], r["severity"], r["events"]) for r in I.incidents(changes).collect())


def test_session_bound_is_inclusive(spark):
    t = 10 * MIN
    assert found(fold(spark, [dict(at=t), dict(at=t + 600_000)])) == [(t, t + 600_000, "closed:quiet", "medium", 2)]
    assert len(found(fold(spark, [dict(at=t), dict(at=t + 600_001)]))) == 2


def test_relayed_events_move_the_end_at_most_one_window_past_the_anchor(spark):
    t = 10 * MIN
    relayed = [dict(at=t)] + [dict(at=t + k * 5 * MIN, level="relayed") for k in range(1, 5)]
    assert found(fold(spark, relayed)) == [(t, t + 10 * MIN, "closed:quiet", "medium", 5)]


def drop(at, score=0.5, base=0.9, **more):
    return dict(at=at, role="trust-drop", is_drop=True, score=score, base=base, severity="high", **more)


def routine(at, score, **more):
    return dict(at=at, role="score", opens=False, score=score, severity=None, **more)


def distrust(at, block, n, **more):
    return dict(at=at, role="distrust", level="untrusted", opens=False, block_id=block, alert_id=n, rank=2, rule="SHADOW", severity="high", ms_index=2**62, **more)


def test_recovery_closes_after_a_drop_only(spark):
    t = 10 * MIN
    rows = I.incidents(fold(spark, [drop(t), routine(t + MIN, 0.4), routine(t + 2 * MIN, 0.8), routine(t + 3 * MIN, 0.9)])).collect()
    assert [(r["status"], r["closed_ms"], r["low"], r["baseline"]) for r in rows] == [("closed:recovered", t + 3 * MIN, 0.4, 0.9)]
    rows = I.incidents(fold(spark, [dict(at=t), routine(t + MIN, 0.9)])).collect()
    assert [r["status"] for r in rows] == ["closed:quiet"]


def test_context_alone_opens_nothing_and_alerts_of_a_held_block_link(spark):
    t = 10 * MIN
    assert fold(spark, [dict(at=t, opens=False, role="deployment")]).count() == 0
    rows = [dict(at=t, block_id="x"), dict(at=t, block_id="x", rank=1, alert_id=7, role="alert", level="untrusted", rule="FORGED", severity="critical")]
    assert found(fold(spark, rows)) == [(t, t, "closed:quiet", "critical", 1)]


def test_any_shared_key_joins(spark):
    """An element's key that an incident gained from a proven event draws in what has only that key, whatever came first by name."""
    t = 10 * MIN
    both, other = dict(at=t, keys=["ie:A", "ie:B"]), dict(at=t + MIN, keys=["ie:B"], primary="ie:B", ie_id="B")
    assert found(fold(spark, [both, other])) == [(t, t + MIN, "closed:quiet", "medium", 2)]
    far = dict(at=t + MIN, keys=["ie:C"], primary="ie:C", ie_id="C")
    assert len(found(fold(spark, [both, far]))) == 2
    # only a proven event widens the keys
    relayed = dict(at=t + MIN, keys=["ie:A", "ie:C"], level="relayed")
    assert len(found(fold(spark, [both, relayed, dict(at=t + 2 * MIN, keys=["ie:C"], primary="ie:C")]))) == 2
    # A is held open through B for longer than A's own pause
    rows = [both, *[dict(at=t + k * 9 * MIN, keys=["ie:B"], primary="ie:B", ie_id="B") for k in range(1, 10)], dict(at=t + 85 * MIN, keys=["ie:A"])]
    assert [r[-1] for r in found(fold(spark, rows))] == [11]


def test_late_distrust_takes_back_what_a_block_did(spark):
    t = 10 * MIN
    rows = [drop(t, pending=True, block_id="d", score=0.4), routine(t + 5 * MIN, 0.95, block_id="r", pending=True), distrust(t + 6 * MIN, "r", 1), distrust(t + 7 * MIN, "d", 2),
            routine(t + 8 * MIN, 0.96)]
    changes = fold(spark, rows[:3], as_of=t + 6 * MIN)
    seen = [(r.action, r.block_id, r.role) for r in changes.orderBy("n").collect()]
    assert seen == [("opened", "d", "trigger"), ("attached", "r", "remediation"), ("closed", "r", None), ("revoked", "r", "remediation"), ("reopened", "r", None), ("standing", None, None)]
    (i,) = I.incidents(changes).collect()
    assert (i.status, i.closed_by, i.closed_ms, i.baseline, i.low, i.alerts) == ("open", None, None, 0.9, 0.4, 1)
    assert sorted((r.block_id, r.role) for r in I.events(changes).collect()) == [("d", "trigger"), ("r", "alert")]
    changes = fold(spark, rows)  # the drop itself was none: no recovery target is left, only time closes
    (i,) = I.incidents(changes).collect()
    assert (i.status, i.low, i.closed_by) == ("closed:quiet", None, None)
    assert {r.role for r in I.events(changes).collect()} == {"alert"} and I.recovery_targets(I.events(changes), obs(spark, rows)).count() == 0
    signs = {}
    for r in I.memberships(changes).collect():
        signs[r.block_id, r.role] = signs.get((r.block_id, r.role), 0) + r.sign
    assert signs == {("d", "trigger"): 0, ("d", "alert"): 1, ("r", "remediation"): 0, ("r", "alert"): 1}


def test_remaining_drops_give_the_recovery_target(spark):
    t = 10 * MIN
    rows = [drop(t, 0.5, 0.9, block_id="a", pending=True), drop(t + MIN, 0.3, 0.8, block_id="b"), distrust(t + 2 * MIN, "a", 1), routine(t + 3 * MIN, 0.8)]
    (i,) = I.incidents(fold(spark, rows)).collect()
    assert (i.status, i.baseline, i.low, i.closed_ms) == ("closed:recovered", 0.8, 0.3, t + 3 * MIN)


def scenario(seed, n=350, keys=14, span=40 * 3_600_000):
    """Random observations with overlapping key sets, pauses, drops, scores, alerts and late distrust."""
    rng = random.Random(seed)
    rows, blocks = [], []
    for i in range(n):
        at = rng.randrange(span) // 1000 * 1000
        own = sorted({f"ie:{rng.randrange(keys)}" for _ in range(rng.choice((1, 1, 1, 2, 3)))})
        ie, kind, block = own[0][3:], rng.random(), f"b{i}"
        common = dict(at=at, keys=own, primary=own[0], ie_id=ie, block_id=block, at_ms=at - rng.choice((0, 0, 60_000, 500_000)), ms_index=at // 1000)
        level = rng.choice(("proven", "proven", "relayed"))
        if kind < 0.3:
            rows.append(dict(common, level=level))
        elif kind < 0.45:
            rows.append(dict(common, role="deployment", opens=False, level=level, severity=None))
        elif kind < 0.6:
            rows.append({**drop(at, rng.choice((0.2, 0.4)), rng.choice((0.7, 0.9))), **common, "level": level})
        else:
            rows.append({**routine(at, rng.choice((0.1, 0.3, 0.6, 0.8, 0.95))), **common, "keys": own[:1]})
            if kind < 0.9:
                continue
        if rng.random() < 0.3:
            rows.append(dict(common, rank=1, alert_id=10 * i, role="alert", level="untrusted", opens=False, rule=rng.choice(("FORGED", "DRIFT")), severity=rng.choice(("critical", "high"))))
        elif rng.random() < 0.3:
            rows[-1]["pending"] = True
            late = at + rng.randrange(3_600_000) // 1000 * 1000 + 1000
            rows.append(dict(distrust(late, block, 10 * i + 1), keys=own, primary=own[0], ie_id=ie, at_ms=late))
    return rows


CHECKED = ("incident", "action", "block_id", "alert_id", "role", "status", "severity", "opened_ms", "last_ms", "closed_ms", "closed_by", "baseline", "low", "keys")


def counted(rows, as_of):
    return Counter(tuple(dict(zip(I.CHANGE_COLUMNS, r))[c] for c in CHECKED) for r in sequential(rows, as_of))


def rows_of(changes):
    return Counter(tuple(r) for r in changes.select(*CHECKED).collect())


@pytest.mark.parametrize("seed,keys,n,hours", [(1, 14, 200, 23), (2, 40, 400, 200)])
def test_components_equal_one_sequential_fold(spark, seed, keys, n, hours):
    rows = scenario(seed, n, keys, hours * 3_600_000)
    want = counted(rows, 10**9)
    assert {a for _, a, *_ in want} >= {"opened", "attached", "closed", "revoked", "updated"}
    got = whole(spark, rows)
    assert rows_of(got) == want
    assert seed == 1 or got.select("component").distinct().count() > 20  # not one group


def test_hot_keys_are_cut_and_give_the_same(spark):
    rows = scenario(3, 250, 5)
    want = counted(rows, 10**9)
    spark.conf.set(ordered.HOT_ROWS_CONF, "40")
    try:
        assert rows_of(whole(spark, rows)) == want
    finally:
        spark.conf.unset(ordered.HOT_ROWS_CONF)


def test_stream_of_overlapping_keys_equals_one_fold(spark):
    """Incidents of different keys that an observation of a later batch joins, and corrections of earlier batches."""
    rows = sorted(scenario(4, 300, 12), key=lambda r: (r["at"], r.get("rank", 0)))
    folder, changes = scratch_path(spark, "obs"), scratch_path(spark, "changes")
    cuts = [rows[len(rows) // 2]["at"]]
    for k, part in enumerate(([r for r in rows if r["at"] < cuts[0]], [r for r in rows if r["at"] >= cuts[0]])):
        obs(spark, part).coalesce(1).write.parquet(f"{folder}/part={k}")
    source = spark.readStream.schema(I.OBSERVATION + ", part int").option("maxFilesPerTrigger", 1).parquet(folder).drop("part")
    J.incident_stream(source, scratch_path(spark, "books"), changes)
    key = [CHECKED.index(c) for c in ("action", "block_id", "alert_id", "role")]
    at_end = max(r["at"] for r in rows)
    # rows are named by position within a part, so blocks are compared under the names the scenario gives
    want = counted(rows, at_end)
    want = Counter({k: v for k, v in want.items() if k[1] != "standing"})
    got = rows_of(spark.read.schema(I.CHANGE).parquet(changes))
    assert got == want, [(tuple(k[i] for i in key), k[0]) for k in (got - want)][:5]


@pytest.fixture(scope="module")
def batch(spark, folder):
    t = Ledger.at(spark, folder)
    return t, I.correlate(t.messages, t.alerts, t.submissions, t.policy, t.context_ie, t.component_host, AS_OF)


def test_whole_stream_equals_batch(batch):
    """Every observation and action; only what closes after the stream's clock may still be open."""
    t, (_, changes) = batch
    key = ["incident", "action", "block_id", "role", "status"]
    got, want = (Counter(map(tuple, df.select(*key).collect())) for df in (streams.t7(t), changes))
    assert not got - want and all(action == "closed" for _, action, *_ in want - got)


def test_ledger_wide_incidents_in_batch_and_stream(spark):
    """Alerts without element go to the incident that holds their block, else to one of the ledger itself."""
    t = 10 * MIN
    alert = dict(role="alert", level="untrusted", rank=1, opens=True, finding=True, rule="DB_TAMPER", severity="critical")
    rows = [dict(at=t, block_id="x"), dict(alert, at=t, block_id="x", alert_id=1, link_only=True), dict(at=t + MIN, role="deployment", opens=False, block_id="y", keys=["ie:Z"], primary="ie:Z"),
            dict(alert, at=t + MIN, block_id="y", alert_id=2, link_only=True, keys=["ie:Z"], primary="ie:Z"),
            dict(alert, at=t + 2 * MIN, block_id="", alert_id=3, keys=["ledger"], primary="ledger", ie_id=None)]
    changes = whole(spark, rows)
    assert sorted((r.incident, r.alert_id) for r in I.linked_alerts(changes).collect()) == [("ie:A@x", 1), ("ledger@y", 2), ("ledger@y", 3)]
    folder, out = scratch_path(spark, "obs"), scratch_path(spark, "changes")
    obs(spark, rows).coalesce(1).write.parquet(folder)
    J.incident_stream(spark.readStream.schema(I.OBSERVATION).parquet(folder), scratch_path(spark, "books"), out)
    got = spark.read.schema(I.CHANGE).parquet(out)
    assert sorted((r.incident, r.alert_id) for r in I.linked_alerts(got).collect()) == [("ie:A@x", 1), ("ledger@y", 2), ("ledger@y", 3)]


def test_running_twice_gives_the_same_incidents(batch):
    t, (_, changes) = batch
    again = I.correlate(t.messages, t.alerts, t.submissions, t.policy, t.context_ie, t.component_host, AS_OF)[1]
    assert found(again) == found(changes)
