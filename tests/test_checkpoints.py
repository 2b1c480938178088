"""Checkpoint hashes against plain JSON and hashlib, the chain over them, audits that recompute them, and the intervals they claim."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from attestry.fixtures import Ledger
from attestry.operators import anchors, ranges

KIND = "ledger.checkpoint"
FIRST, LAST, ROOT = ("0x" + hashlib.sha256(x).hexdigest() for x in (b"first", b"last", b"root"))


def plain(row, prev, algorithm):
    network, domain, from_ms, from_id, to_ms, to_id, root, count, policy = row
    doc = {"v": 1, "kind": KIND, "network": network, "domain": domain, "from": {"index": from_ms, "id": from_id}, "to": {"index": to_ms, "id": to_id},
           "msRoot": root, "msgCount": count, "policyHash": policy, "prev": prev}
    text = json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    return "0x" + (hashlib.sha256(text) if algorithm == "sha256" else hashlib.blake2b(text, digest_size=32)).hexdigest()


def test_hashes_equal_plain_json(spark):
    schema = "network string, domain string, from_ms bigint, from_id string, to_ms bigint, to_id string, ms_root string, msg_count bigint, policy_hash string, prev string"
    rows = [("net", 'd "é"', 370, FIRST, 373, LAST, ROOT, 11, "0x" + "00" * 32, None), ("net", "d", 374, LAST, 380, FIRST, ROOT, 0, "0x" + "01" * 32, "0x" + "02" * 32)]
    df = spark.createDataFrame(rows, schema)
    for algorithm in ("sha256", "blake2b"):
        got = [r[0] for r in df.select(anchors.checkpoint_hash(KIND, algorithm)).collect()]
        assert got == [plain(r[:9], r[9], algorithm) for r in rows]


def test_audit_recomputes_the_hash_of_a_record(spark, folder):
    t = Ledger.at(spark, folder)
    made = anchors.chained(anchors.checkpoints(t.milestones, t.messages, network="n", domain='d "x" é', policy_hash="0x0"), KIND, algorithm="blake2b")
    records = made.withColumn("seq", F.col("window") + 1)
    assert records.filter(anchors.checkpoint_hash(KIND, "blake2b") != F.col("checkpoint_hash")).count() == 0
    shown = records.select("seq", "checkpoint_hash")
    altered = records.withColumn("msg_count", F.col("msg_count") + (F.col("seq") == 2).cast("int"))  # root and mirrored hash still agree
    got = {r.seq: (r.state, r.detail) for r in anchors.audit(shown, altered, t.milestones, algorithm="blake2b", doc_kind=KIND).collect()}
    assert len(got) > 2 and got.pop(2) == ("mismatch", "hash") and set(got.values()) == {("verified", None)}


def test_a_claimed_range_costs_a_few_rows(spark):
    """Whatever a record claims, its nodes are few, and only what is stored is listed."""
    wide = spark.createDataFrame([(1, 0, 2**32 - 1), (2, 1, 2**32 - 2), (3, 5, 4), (4, 7, 7), (5, 6, 6), (6, None, 3), (7, 0, 2**62)], "seq bigint, from_ms bigint, to_ms bigint")
    nodes = {}
    for r in ranges.spread(wide, "from_ms", "to_ms").collect():
        nodes.setdefault(r.seq, []).append((r.level, r.node))
    assert nodes[1] == [(32, 0)] and len(nodes[2]) == 62 and 3 not in nodes and nodes[4] == [(0, 7)] and nodes[5] == [(0, 6)] and 6 not in nodes and len(nodes[7]) <= 64
    stored = spark.range(100).selectExpr("id AS idx", "concat('m', id) AS id").filter("idx <> 50")
    twice = stored.union(stored.filter("idx = 70"))
    claims = spark.createDataFrame([(1, 0, 2**32 - 1), (2, 0, 49), (3, 51, 69), (4, 49, 51), (5, 60, 80), (6, 99, 99), (7, 100, 100)], "seq bigint, from_ms bigint, to_ms bigint")
    whole = ranges.complete(claims, twice)
    assert sorted(r.seq for r in whole.collect()) == [2, 3, 6]
    assert ranges.members(whole, twice).count() == 50 + 19 + 1


def test_covering_equals_brute_force(spark):
    rng = random.Random(4)
    spans = []
    for i in range(200):
        low = rng.randrange(-300, 3000)
        spans.append((i, low, low + rng.choice((-1, 0, 1, 7, 64, 1000))))
    spans += [(300, -50, 2**32), (301, None, 5)]
    points = [*range(-310, 3100, 3), 2**31, None]
    got = {r.p: r.seq for r in ranges.covering(spark.createDataFrame([(p,) for p in points], "p bigint"), "p", spark.createDataFrame(
        spans, "seq bigint, low bigint, high bigint"), "low", "high", "seq").collect()}
    assert got == {p: max((s for s, a, b in spans if p is not None and a is not None and a <= p <= b), default=None) for p in points}
