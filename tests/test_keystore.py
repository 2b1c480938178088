"""The keyed store against a plain list of all rows, over many batches."""

import random

from attestry.session import scratch_path
from attestry.streaming import keystore
from attestry.streaming.keystore import KeyStore

SCHEMA = "iss string, seq bigint, nonce string, block_id string"


def test_live_runs_cover_every_batch_once():
    for n in (0, 1, 7, 8, 9, 63, 64, 65, 600):
        covered = []
        for run in KeyStore.live(n):
            level, i = map(int, run.split("-"))
            covered += range(i * 8**level, (i + 1) * 8**level)
        assert sorted(covered) == list(range(n)) and len(KeyStore.live(n)) <= 7 * 4


def test_lookups_equal_all_rows_and_read_few_folders(spark, monkeypatch):
    monkeypatch.setattr(keystore, "FAN", 3)
    rng, store, rows, read = random.Random(3), KeyStore(scratch_path(spark, "spent"), SCHEMA, {"seq": ("iss", "seq"), "nonce": ("iss", "nonce")}), [], []
    for n in range(11):
        new = [(f"i{rng.randrange(3)}", 1000 * n + rng.randrange(900), None if rng.random() < 0.1 else f"n{n}-{rng.randrange(900)}", f"b{n}-{k}") for k in range(40)]
        batch = spark.createDataFrame(new, SCHEMA)
        asked = spark.createDataFrame([*[(r[0], r[1], r[2], f"q{k}") for k, r in enumerate(rng.sample(rows, min(3, len(rows))))], ("i0", -5, "never", "q9"), (None, 1, None, "q8")], SCHEMA)
        if n in (1, 4, 9, 10):
            for family, at in (("seq", 1), ("nonce", 2)):
                got = sorted((r.block_id, r.stored.block_id) for r in store.find(asked, family, n).collect())
                assert got == sorted((q.block_id, r[3]) for q in asked.collect() for r in rows if q[at] is not None and (q[0], q[at]) == (r[0], r[at]))
            read.append(len(store.parts(asked, "seq", n)))
        store.append(batch, n)
        if n == 5:
            store.append(batch, n)  # run again: the same folders
        rows += new
    assert len(store.live(11)) <= 6 and max(read) <= 6  # 3 keys that are there, whatever the number of batches
    assert sorted(map(repr, map(tuple, store.rows(spark, 11).collect()))) == sorted(map(repr, rows))


def test_few_keys_that_may_be_there_meet_the_entries(spark, monkeypatch):
    """New keys hardly pass the filters, and of runs that may hold few of them only those few rows are joined."""
    settled = {}
    monkeypatch.setattr(keystore, "settle", lambda df, name, real=keystore.settle: settled.setdefault(name, real(df, name)))
    store = KeyStore(scratch_path(spark, "spent"), SCHEMA, {"seq": ("iss", "seq"), "nonce": ("iss", "nonce")})
    rows = [[("i", 1000 * n + k, f"n{n}-{k}", f"b{n}-{k}") for k in range(500)] for n in range(2)]
    for n in range(2):
        store.append(spark.createDataFrame(rows[n], SCHEMA), n)
    new = spark.createDataFrame([("i", 9000 + k, f"x{k}", f"q{k}") for k in range(300)], SCHEMA)
    assert len(store.parts(new, "seq", 2)) <= 10 and not store.find(new, "seq", 2).count()
    settled.clear()
    asked = new.union(spark.createDataFrame([rows[0][7], *rows[1][:200]], SCHEMA))
    got = sorted((r.block_id, r.stored.block_id) for r in store.find(asked, "seq", 2).collect())
    assert got == sorted((r[3], r[3]) for r in (rows[0][7], *rows[1][:200]))
    assert settled["asked"].count() <= 10
