"""Operators against plain sequential Python on small random tables, whole and cut into small chunks."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.operators import chain, graph, merkle, ordered
from attestry.plans import verdicts


@pytest.fixture(params=[None, 7], ids=["whole", "cut"])
def hot(request, spark):
    if request.param:
        spark.conf.set(ordered.HOT_ROWS_CONF, str(request.param))
    yield request.param
    spark.conf.unset(ordered.HOT_ROWS_CONF)


def block(i):
    return "0x" + hashlib.sha256(str(i).encode()).hexdigest()


def ledger(seed, n=120, issuers=2, seqs=40, nonces=40, swap=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append(dict(block_id=block(i), iss=f"i{min(rnd.randrange(issuers * 2), issuers - 1)}", seq=rnd.randrange(seqs),
                         nonce=None if rnd.random() < .1 else f"n{rnd.randrange(nonces)}", ms_index=i // 5 if not swap else rnd.randrange(30),
                         wf_index=i % 5 if not swap else i, spends=rnd.random() < .8, prev=block(rnd.randrange(n)) if rnd.random() < .8 else None,
                         ts=1000 + i, verdict="PRODUCER_SIGNED" if rnd.random() < .8 else "FORGED"))
    return rows


SCHEMA = ("block_id string, iss string, seq bigint, nonce string, ms_index bigint, wf_index bigint, spends boolean, prev string, ts bigint, verdict string")


def frame(spark, rows):
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], SCHEMA)


def place(r):
    return (r["ms_index"], r["wf_index"], r["block_id"])


@pytest.mark.parametrize("seed", range(2))
def test_replays_equal_the_sequential_rule(spark, seed):
    rows = ledger(seed, swap=True)
    spent_seq, spent_nonce, want = {}, {}, {}
    for r in sorted(rows, key=place):
        a, b = spent_seq.get((r["iss"], r["seq"])), spent_nonce.get((r["iss"], r["nonce"])) if r["nonce"] else None
        if a or b:
            want[r["block_id"]] = (a, b)
        elif r["spends"]:
            spent_seq[r["iss"], r["seq"]] = r["block_id"]
            if r["nonce"]:
                spent_nonce[r["iss"], r["nonce"]] = r["block_id"]
    got = {r["block_id"]: (r["seq_used_by"], r["nonce_used_by"]) for r in verdicts.resolve_replays(frame(spark, rows)).collect()}
    assert got == want


def test_a_long_chain_of_conflicts_is_decided_in_order(spark, monkeypatch):
    """Each of 10,000 messages shares its seq with the one before and its nonce with the one after, or the other way round."""
    written, settle = [], verdicts.settle
    for module in (verdicts, graph):
        monkeypatch.setattr(module, "settle", lambda df, name: written.append(name) or settle(df, name))
    n = 10_000
    rows = [dict(block_id=f"c{i:05d}", iss="i", seq=i // 2, nonce=f"n{(i + 1) // 2}", ms_index=i, wf_index=0, spends=i % 1001 != 0, prev=None, ts=i, verdict="PRODUCER_SIGNED") for i in range(n)]
    rows += [dict(rows[0], block_id=f"d{i:05d}", iss="j", seq=1, nonce=f"m{i % 700}", ms_index=i) for i in range(2_000)]  # a large group of one seq
    spent, want = {}, {}
    for r in sorted(rows, key=place):
        a, b = spent.get((r["iss"], r["seq"])), spent.get((r["iss"], r["nonce"]))
        if a or b:
            want[r["block_id"]] = (a, b)
        elif r["spends"]:
            spent |= {(r["iss"], r["seq"]): r["block_id"], (r["iss"], r["nonce"]): r["block_id"]}
    got = {r["block_id"]: (r["seq_used_by"], r["nonce_used_by"]) for r in verdicts.resolve_replays(frame(spark, rows)).collect()}
    assert got == want
    assert written.count("graph-edges") <= 20 and len(written) < 120  # logarithmic, where there were 5,000 rounds


def test_nonce_freed_by_a_replayed_message(spark):
    base = dict(iss="i", ms_index=1, spends=True, prev=None, ts=1, verdict="PRODUCER_SIGNED")
    rows = [dict(base, block_id="a", seq=1, nonce="x", wf_index=0), dict(base, block_id="b", seq=1, nonce="y", wf_index=1),
            dict(base, block_id="c", seq=2, nonce="y", wf_index=2)]
    assert [r["block_id"] for r in verdicts.resolve_replays(frame(spark, rows)).collect()] == ["b"]


def test_replays_without_seq_are_judged_by_nonce(spark):
    base = dict(iss="i", seq=None, ms_index=1, spends=True, prev=None, ts=1, verdict="PRODUCER_SIGNED")
    rows = [dict(base, block_id="a", nonce="x", wf_index=0), dict(base, block_id="b", nonce="x", wf_index=1), dict(base, block_id="c", nonce="y", wf_index=2),
            dict(base, block_id="d", nonce="z", wf_index=3, iss=None), dict(base, block_id="e", nonce="z", wf_index=4, iss=None)]
    assert [(r["block_id"], r["nonce_used_by"]) for r in verdicts.resolve_replays(frame(spark, rows)).collect()] == [("b", "a")]


@pytest.mark.parametrize("seed", range(2))
def test_heads_on_arrival(spark, hot, seed):
    rows = [r for r in ledger(seed, swap=True)]
    proven = [r for r in rows if r["verdict"] == "PRODUCER_SIGNED"]
    want = {}
    for r in proven:
        c = [q for q in proven if q["iss"] == r["iss"] and q["seq"] < r["seq"] and place(q)[:2] < place(r)[:2]]
        best = sorted(c, key=lambda q: (-q["seq"], -q["ts"], q["block_id"]))
        want[r["block_id"]] = best[0]["block_id"] if best else None
    got = {r["block_id"]: r["head_block"] for r in chain.heads_on_arrival(frame(spark, rows)).collect()}
    assert got == want


def test_head_search_holds_what_it_keeps_of_one_chunk():
    """The search takes batches as they come: rows of one chunk in several, columns of others passed on untouched."""
    rows = [("i", 0, 1, 5, "a", 2**60 + 1), ("i", 0, 2, 9, "b", None), ("i", 0, 2, 7, "c", 3), ("i", 0, 3, 8, "d", 4), ("i", 1, 4, 9, "e", 5), ("j", 1, 5, 10, "f", 6)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("iss", "_chunk", "seq", "_place", "block_id", "other"), r)) for r in part]) for part in (rows[:2], rows[2:])]
    got = [r for b in chain._search(iter(batches)) for r in b.to_pylist()]
    assert [(r["head_block"], r["head_seq"], r["other"]) for r in got] == [
        (None, None, 2**60 + 1), ("a", 1, None), ("a", 1, 3), ("c", 2, 4), (None, None, 5), (None, None, 6)]


@pytest.mark.parametrize("backwards", [False, True])
def test_scan_folds_rows_before(spark, hot, backwards):
    rows = ledger(3)
    df = frame(spark, rows).withColumn("iss", F.when(F.col("iss") != "i0", F.col("iss")))  # a null key is a group too
    got = ordered.scan(df, ["iss"], ordered.BY_POSITION, {
        "n": ordered.count(), "top": ordered.running_max(F.col("seq")), "prior": ordered.last(F.col("nonce"), F.col("spends"))}, backwards=backwards)
    have = {r["block_id"]: (r["n"], r["top"], r["prior"]) for r in got.collect()}
    for r in rows:
        key = None if r["iss"] == "i0" else r["iss"]
        other = [q for q in rows if (None if q["iss"] == "i0" else q["iss"]) == key and
                 (place(q) > place(r) if backwards else place(q) < place(r))]
        other.sort(key=place, reverse=backwards)
        good = [q["nonce"] for q in other if q["spends"]]
        assert have[r["block_id"]] == (len(other), max((q["seq"] for q in other), default=None), good[-1] if good else None)


def test_asof(spark, hot):
    rows = ledger(5)
    left, right = frame(spark, rows).filter("verdict = 'FORGED'"), frame(spark, rows).filter("verdict <> 'FORGED'")
    got = {r["block_id"]: r["found"] for r in ordered.asof(left, right, ["iss"], ordered.BY_POSITION, {"found": "block_id"}).collect()}
    for r in rows:
        if r["verdict"] == "FORGED":
            c = [q for q in rows if q["iss"] == r["iss"] and q["verdict"] != "FORGED" and place(q) < place(r)]
            assert got[r["block_id"]] == (max(c, key=place)["block_id"] if c else None)


def tree(ids, h):
    if len(ids) == 1:
        return h(b"\0" + ids[0])
    k = 1
    while k * 2 < len(ids):
        k *= 2
    return h(b"\1" + tree(ids[:k], h) + tree(ids[k:], h))


@pytest.mark.parametrize("algorithm", ["sha256", "blake2b"])
def test_merkle_root_equals_the_recursive_split(spark, algorithm):
    h = (lambda b: hashlib.sha256(b).digest()) if algorithm == "sha256" else (lambda b: hashlib.blake2b(b, digest_size=32).digest())
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 31, 1023, 1024, 1025, 2300]
    rows = [(n, p, block(f"{n}/{p}")) for n in sizes for p in range(n)]
    df = spark.createDataFrame(rows, "w bigint, p bigint, id string")
    got = {r["w"]: r["root"] for r in merkle.roots(df, ["w"], "p", "id", algorithm=algorithm).collect()}
    for n in sizes:
        assert got[n] == "0x" + tree([bytes.fromhex(block(f"{n}/{p}")[2:]) for p in range(n)], h).hex()


def test_every_audit_path_verifies_and_no_other_does(spark):
    rows = [(n, p, block(f"{n}/{p}")) for n in (1, 5, 1030) for p in range(n)]
    df = merkle.paths(spark.createDataFrame(rows, "w bigint, p bigint, id string"), ["w"], "p", "id")
    other = F.concat(F.lit("0x"), F.sha2("id", 256))
    r = df.agg(F.bool_and(merkle.verify(F.col("id"), F.col("path"), F.col("root"))).alias("good"),
               F.bool_or(merkle.verify(other, F.col("path"), F.col("root"))).alias("bad"), F.count(F.lit(1)).alias("n")).head()
    assert (r["good"], r["bad"], r["n"]) == (True, False, len(rows))


@pytest.mark.parametrize("seed", range(2))
def test_screening_equals_the_sequential_rule(spark, hot, seed):
    rnd = random.Random(seed)
    rows = [(f"s{i:03d}", i, "t", f"i{rnd.randrange(2)}", i + rnd.randrange(-6, 6) + 10, f"n{rnd.randrange(25)}", None, None, rnd.random() < .9) for i in range(60)]
    df = spark.createDataFrame(rows, "sub_id string, received_at_ms bigint, tag string, iss string, seq bigint, nonce string, early string, revoked_at_ms bigint, schema_ok boolean")
    policy = spark.createDataFrame([("t", ["*"], False, False)], "tag string, allowed array<string>, require_signature boolean, legacy_grace boolean")
    top, used, want = {}, set(), {}
    for sub, _, _, iss, seq, nonce, _, _, ok in rows:
        if seq <= top.get(iss, -1) or (iss, nonce) in used:
            want[sub] = "REPLAY"
        elif not ok:
            want[sub] = "MALFORMED"
        else:
            want[sub], top[iss] = None, seq
            used.add((iss, nonce))
    got = {r["sub_id"]: r["refused_as"] for r in verdicts.screen(df, policy, as_of_ms=0).collect()}
    assert got == want


@pytest.mark.parametrize("shape", ["burst", "one time", "even"])
def test_hot_groups_are_cut_evenly(spark, shape):
    """A group of 90 % of all rows, whether they come at distinct times in a burst, at one time, or evenly."""
    time = {"burst": "IF(id % 10 = 0, id * 1000000, 5000000000 + id)", "one time": "IF(id % 10 = 0, id, 77)", "even": "id * 1000"}[shape]
    df = spark.range(20_000).selectExpr("IF(id % 10 = 9, 'rare', 'hot') AS iss", f"{time} AS ms_index", "id AS wf_index", "CAST(id AS STRING) AS block_id")
    cuts = ordered.measure(df, ["iss"], ordered.BY_POSITION, 2_000)
    sizes = [r["count"] for r in ordered.with_chunk(df.filter("iss = 'hot'"), cuts).groupBy("_chunk").count().collect()]
    assert 30 <= len(sizes) <= 40 and max(sizes) <= 1_000
    got = ordered.scan(df, ["iss"], ordered.BY_POSITION, {"n": ordered.count()}, cuts=cuts).filter("iss = 'hot'")
    assert [r["n"] for r in got.orderBy("ms_index", "wf_index", "block_id").select("n").collect()] == list(range(18_000))
