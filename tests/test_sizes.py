"""What only larger ledgers show: keys of long incidents, slices of several files, the last second of a key, id ranges."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from attestry.catalog import QUERIES, loading, streams
from attestry.catalog import jobs as CJ
from attestry.fixtures import Ledger
from attestry.functions import hashing as H
from attestry.operators import merkle, reconcile
from attestry.plans import incidents as I
from attestry.plans import proofs, verdicts
from attestry.session import scratch_path
from attestry.sources import records
from attestry.streaming import jobs as J
from tests.test_incidents import full

MID_S = 1704067200 + 15 * 86400  # the first key of each issuer is revoked at this second's beginning


def at_the_change_of_keys(t):
    sound = t.envelopes.filter("n % 13 <> 0 AND n % 53 <> 0 AND n % 59 <> 0 AND n % 61 <> 0 AND n % 71 <> 0 AND n % 50 <> 0 AND n % 83 <> 0 AND n % 97 <> 5 AND iss <> 'did:x:7'").select("block_id")
    return CJ.signed_envelopes(t).join(sound, "block_id", "left_semi").withColumn("ts", F.lit(MID_S).cast("bigint"))


def test_verdict_in_the_second_in_which_keys_change(spark, folder):
    t = Ledger.at(spark, folder)
    judged = verdicts.judge(at_the_change_of_keys(t), t.policy, t.key_history)
    assert judged.count() and not judged.filter("verdict = 'REVOKED_KEY'").count()


def test_envelope_step_in_the_second_in_which_keys_change(spark, folder):
    t = Ledger.at(spark, folder)
    steps = proofs.envelope_step(at_the_change_of_keys(t), t.key_history)
    assert [r[0] for r in steps.select("envelope_ok").distinct().collect()] == [True]


def test_changes_of_a_long_incident_do_not_repeat_its_keys():
    made = I.Fold(I.Settings())
    for i in range(400):
        made.feed(SimpleNamespace(**full(i, dict(at=i * 1000, keys=[f"ie:{i}", "iss:x"]))))
    made.put_down(10**9)
    told = [json.loads(k) for k in (r[I.CHANGE_COLUMNS.index("keys") - 1] for r in made.out) if k]
    assert sum(map(len, told)) == 401
    assert len({k for ks in told for k in ks}) == 401


def test_an_incident_has_all_keys_it_gained(spark):
    made = I.Fold(I.Settings())
    for i in range(3):
        made.feed(SimpleNamespace(**full(i, dict(at=i * 1000, keys=[f"ie:{2 - i}", 'iss:"x'], level="relayed" if i == 1 else "proven"))))
    made.put_down(10**9)
    changes = spark.createDataFrame([(0, *r) for r in made.out], I.CHANGE)
    assert [r[0] for r in I.incidents(changes).select("keys").collect()] == [json.dumps(["ie:0", "ie:2", 'iss:"x'])]


def test_a_trigger_takes_a_slice_whole(spark, folder):
    """Slices of several files and different sizes: every trigger gets the rows of one slice."""
    t = Ledger.at(spark, folder)
    rows = spark.range(0, 12_000, 1, 7).select(F.when(F.col("id") < 9000, F.col("id") % 1000).otherwise(F.col("id") - 9000).alias("at"))
    stream = streams.feed(t, "uneven", rows, "at", rows_per_file=500)
    got = []
    J.each_batch(stream, lambda batch, n: got.append(tuple(batch.agg(F.min("at"), F.max("at")).head())))
    assert got == [(0, 999), (1000, 1999), (2000, 2999)]


@pytest.mark.parametrize("cuts", [(), (50_000,), (1_000, 60_000, 70_000, 80_000)])
def test_definitive_orphans_however_sliced(spark, cuts):
    log = [("a", "s1", 0, J.SUBMITTED, False), ("a", "s1", 1_000, J.ANSWER, False), ("a", "s1", 70_000, J.ANSWER, False),  # an orphan
           ("b", "s2", 0, J.SUBMITTED, False), ("b", "s2", 1_000, J.ANSWER, False), ("b", "s2", 60_000, J.CONFIRMED, True), ("b", "s2", 70_000, J.ANSWER, False),
           ("c", "s3", 0, J.SUBMITTED, False), ("c", "s3", 70_000, J.ANSWER, False),  # no answer inside the timeout
           ("d", "s4", 0, J.SUBMITTED, False), ("d", "s4", 1_000, J.ANSWER, False), ("d", "s4", 70_000, J.ANSWER, False), ("d", "s4", 71_000, J.CONFIRMED, True),
           ("e", "s5", 30_000, J.SUBMITTED, False), ("e", "s5", 31_000, J.ANSWER, False), ("e", "s5", 100_000, J.ANSWER, False),  # answered at the clock
           ("f", "s6", 1, J.SUBMITTED, False), ("f", "s0", 0, J.SUBMITTED, False), ("f", "s0", 2, J.ANSWER, False), ("f", "s0", 70_000, J.ANSWER, False)]
    source, out, edges = scratch_path(spark, "log"), scratch_path(spark, "out"), [-1, *cuts, 10**9]
    for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
        spark.createDataFrame([r for r in log if lo < r[2] <= hi], J.ANSWERS).coalesce(1).write.parquet(f"{source}/part={k}")
    stream = spark.readStream.schema(J.ANSWERS + ", part int").option("maxFilesPerTrigger", 1).parquet(source).drop("part")
    J.definitive_orphans(stream, scratch_path(spark, "waiting"), out)
    assert sorted((r.sub_id, r.block_id, r.received_at_ms, r.orphaned_at_ms) for r in spark.read.schema(J.ORPHAN).parquet(out).collect()) == [("s0", "f", 0, 70_000), ("s1", "a", 0, 70_000), ("s4", "d", 0, 70_000)]


def test_ids_in_several_ranges(spark, folder):
    """Earlier messages are found in the id ranges before, single messages of a range included."""
    e = spark.createDataFrame([(n, "did:x:1", n % 3 != 0, n // 4) for n in (0, 1, 2, 3, 4, 6, 8, 11, 12, 13, 14, 15, 21, 22, 300, 301)], "n bigint, iss string, proven boolean, _chunk bigint")
    e = e.selectExpr("*", "n AS user_id", "'view' AS event_type", "n AS received_ms", "n AS ms_index")
    got = {r.n: (r.seq, r._n1, r._n2) for r in Ledger._with_earlier(e).collect()}
    rows = sorted(e.select("n", "proven").collect())
    for k, r in enumerate(rows):
        own = [x.n for x in rows[:k] if x.proven == r.proven]
        assert got[r.n] == (k + 1 - (r.n % 97 == 0), *([None, None, *own][::-1][:2])), r


def test_runs_of_blocks_go_without_their_key(spark):
    """A block's key is as long as its id; behind the scan the run's number says all."""
    held = spark.createDataFrame([(1, 0, "ie:A"), (1, 0, "block:0xa"), (2, 10**9, "ie:A"), (2, 10**9, "block:0xa")], "oid bigint, ord_ms bigint, key string")
    runs = I._runs(held, 60_000).collect()
    assert sorted((r.oid, r.key or "") for r in runs) == [(1, ""), (1, "ie:A"), (2, ""), (2, "ie:A")]
    assert len({r.run for r in runs if r.key is None}) == 1 and len({r.run for r in runs if r.key}) == 2


def test_subjects_are_those_that_something_asks_for(spark, folder):
    t = Ledger.at(spark, folder)
    rows = I._subjects(t.messages, t.policy, t.alerts, t.submissions, t.component_host, I.Settings())
    assert not rows.filter("trust = 'untrusted' AND NOT alerted").count() and rows.filter("trust = 'untrusted'").count() and rows.filter("pending").count()
    assert "received_at_ms" not in rows.columns


@pytest.mark.parametrize("hindsight", [False, True])
def test_doubts_count_from_the_start_or_come_late(spark, folder, hindsight):
    t = Ledger.at(spark, folder)
    some = t.messages.filter("verdict = 'PRODUCER_SIGNED' AND kind = 'self-orchestrator'").select("block_id", "ts").orderBy("block_id").limit(5).collect()
    kinds = [("SHADOW", "high", 0), ("SHADOW", "high", 1), ("SHADOW", "low", 1), ("CLOCK_SKEW", "high", 1), ("SHADOW", "high", None)]
    alerts = [(i, r, s, m.block_id, None, None if at is None else m.ts * 1000 + at, None) for i, (m, (r, s, at)) in enumerate(zip(some, kinds))]
    df = spark.createDataFrame(alerts, t.alerts.schema)
    rows = I._subjects(t.messages, t.policy, df, t.submissions, t.component_host, I.Settings(hindsight=hindsight)).collect()
    got = {r.block_id: (r.trust, r.pending) for r in rows}
    lost, kept = ("untrusted", False), ("proven", False)
    want = [lost, lost if hindsight else ("proven", True), None, kept, lost]  # the third has no grave alert and no trust: it is left out
    assert [got.get(m.block_id) for m in some] == want


def test_feeds_leave_texts_in_the_tables(spark, folder):
    t = Ledger.at(spark, folder)
    assert not {"json", "prev", "kid", "nonce"} & set(streams.messages(t).columns)
    assert not {"message_json", "data_hex"} & set(streams.submissions(t).columns)


def test_message_table_shuffles_no_hashes_or_texts(spark, folder):
    """Hashes and texts are written out behind the last window, so no shuffle carries them."""
    plan = Ledger(spark, folder).derive_messages()._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Window [", 1)
    assert "sha2(" in above and "json" in above
    assert "sha2(" not in below and "json" not in below


def test_submission_records_are_joined_with_nothing(spark, folder):
    """Spark takes parsed records for a twentieth of their size, so a join broadcasts millions of them."""
    plan = QUERIES["s1_submission_records"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_kept_columns_stay_with_their_records(spark, folder):
    t = Ledger.at(spark, folder)
    good, bad = records.parse_submissions(loading.record_lines(t, "sub_id AS _own", "n"), F.col("source"), keep=["_own", "n"])
    rows = good.select("sub_id", "_own", "n").collect()
    assert rows and all(r.sub_id == r._own == f"sn{r.n}" for r in rows) and bad.columns == ["value", "source", "problem"]


def joined(node):
    """Names of the columns that any join of a plan takes in."""
    below = [node.children().apply(i) for i in range(node.children().length())]
    own = {c.output().apply(i).name() for c in below for i in range(c.output().length())} if node.nodeName() == "Join" else set()
    return own.union(*map(joined, below))


def test_paths_of_blocks_are_not_joined(spark, folder):
    """A path is as long as ten blocks. It is made in the row that uses it, so no join shuffles it."""
    for name in ("r25_proof_audit_envelope", "r24_proofs"):
        names = joined(QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan())
        assert "_rows" in names and not {"path", "_path", "inclusion_path"} & names, name


def test_rows_and_windows_travel_with_their_paths(spark):
    """Two windows of two tiers and one of none; rows with a map, which has no order; a window that is not asked for."""
    df = spark.range(0, 2500).selectExpr("id % 2 AS w", "id div 2 AS p", "concat('0x', sha2(CAST(id AS STRING), 256)) AS id", "map('k', id) AS more").unionByName(
        spark.range(2500, 2501).selectExpr("CAST(7 AS BIGINT) AS w", "CAST(0 AS BIGINT) AS p", "concat('0x', sha2(CAST(id AS STRING), 256)) AS id", "map('k', id) AS more"))
    windows = spark.createDataFrame([(0, "a"), (1, None)], "w bigint, what string")
    got = merkle.paths(df, ["w"], "p", "id", windows=windows, sizes=df)
    assert got.columns == ["w", "p", "id", "more", "path", "root", "what"]
    own = F.concat(F.lit("0x"), F.sha2(F.col("more")["k"].cast("string"), 256)) == F.col("id")
    r = got.agg(F.count(F.lit(1)), F.bool_and(merkle.verify(F.col("id"), F.col("path"), F.col("root"))), F.bool_and(own & (F.col("more")["k"] == F.col("p") * 2 + F.col("w"))),
                F.bool_and(F.col("what").eqNullSafe(F.when(F.col("w") == 0, "a")))).head()
    assert tuple(r) == (2500, True, True, True)
    roots = {r.w: r.root for r in merkle.roots(df, ["w"], "p", "id").collect()}
    assert {(r.w, r.root) for r in got.select("w", "root").distinct().collect()} == {(w, roots[w]) for w in (0, 1)}


def nodes(plan, name):
    below = [plan.children().apply(i) for i in range(plan.children().length())]
    return (plan.nodeName() == name) + sum(nodes(b, name) for b in below)


def test_packed_ids_come_back(spark):
    ids = ["0x" + "ab" * 32, "0x" + "AB" * 32, "0x" + "ab" * 31, "0x" + "ab" * 32 + "m", "ab" * 32, "", "é", "0x", "a" * 32, "0x" + "61" * 32]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id string").select("id", H.packed(F.col("id")).alias("p"))
    rows = df.select("id", "p", H.unpacked(F.col("p")).alias("back")).collect()
    assert all(r.back == r.id for r in rows) and len({bytes(r.p) for r in rows if r.id is not None}) == len(ids)
    assert {len(r.p) for r in rows if r.id == ids[0]} == {33}


def test_rules_deal_no_messages_by_tag(spark, folder):
    plan = QUERIES["r21_rules_run_all"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(" in plan and "hashpartitioning(tag" not in plan


def test_candidates_deal_each_table_once(spark, folder):
    t = Ledger.at(spark, folder)
    df = reconcile.reverify_candidates(t.content_checks, t.stored_submissions, t.stored_messages, t.lifecycle, t.alerts)
    assert nodes(df._jdf.queryExecution().optimizedPlan(), "Join") <= 1  # with the alerts


def test_candidates_are_what_is_held_or_was_verified(spark):
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    checks = table([("a", "MATCH"), ("b", "MISMATCH"), (None, "MATCH")], "block_id string, result string")
    subs = table([("s1", "c", "t", "x"), ("s2", "c", "t", "y"), ("s3", None, "t", "z")], "sub_id string, block_id string, tag string, data string")
    messages = table([("c", None, None), ("0x" + "ab" * 32, "t", "x")], "block_id string, tag string, data string")
    steps = [("d", "ORPHANED", 1, 1, None), ("e", "CONTENT_VERIFIED", 1, 2, None), ("c", "NOT_FOUND", 1, 3, None), ("c", "CONTENT_MISMATCH", 2, 4, "DB_TAMPER"), ("f", "CONFIRMED", 1, 5, None)]
    lifecycle = table(steps, "block_id string, status string, at_ms bigint, id bigint, cause string")
    alerts = table([("c", "NOT_FOUND", "critical"), ("c", "CONTENT_MISMATCH", "critical"), ("e", "NOT_FOUND", "low")], "block_id string, rule string, severity string")
    got = reconcile.reverify_candidates(checks, subs, messages, lifecycle, alerts)
    cols = ("block_id", "sub_id", "has_submission", "has_message", "verified_once", "outcome", "outcome_alerted")
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == [
        ("0x" + "ab" * 32, None, False, True, False, None, False), ("a", None, False, False, True, None, False), ("c", "s1", True, True, False, "NOT_FOUND", True),
        ("c", "s2", True, True, False, "NOT_FOUND", True), ("e", None, False, False, True, "CONTENT_VERIFIED", False)]
