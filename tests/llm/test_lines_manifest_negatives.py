"""Line dedup, the Merkle manifest and hard negatives against brute force, and over odd and empty tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import hard_negatives, line_dedup, merkle_manifest, queries
from attestry.llm.cuckoo import Cuckoo

SPACE = " \t\n\x0b\x0c\r"


# -- line dedup ------------------------------------------------------------------------


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def kept(texts, least):
    """(n_lines, n_dropped, text) of each text, one after the other."""
    lines = [(t or "").split("\n") for t in texts]
    held = Counter(k for own in lines for k in {key(x) for x in own} - {""})
    out = []
    for own in lines:
        left = [x for x in own if held[key(x)] < least]
        out.append((len(own), len(own) - len(left), "\n".join(left)))
    return out


def results(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect())


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def expected(rows, least):
    return sorted((-1 if i is None else i, *k) for (i, _), k in zip(rows, kept([t for _, t in rows], least)))


def test_cuckoo_filter_holds_what_was_put_in():
    rng = random.Random(1)
    names = [hashlib.sha256(str(i).encode()).digest() for i in range(20_000)]
    made = Cuckoo.of(names)
    assert made.contains(names).all() and Cuckoo(made.buckets, made.bytes()).contains(names).all()
    others = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(50_000)]
    assert made.contains(others).mean() < 3e-4
    rng.shuffle(names)
    made.delete(names[:15_000])
    assert made.contains(names[15_000:]).all() and made.contains(names[:15_000]).mean() < 3e-4
    assert made.insert(names[:15_000]) and made.contains(names).all()
    made.delete(names)
    assert not made.table.any()
    with pytest.raises(ValueError):
        made.delete(names[:1])
    assert not Cuckoo(4).insert(names[:16])  # too full: the caller builds a larger one
    assert not Cuckoo.of([]).contains(names[:5]).any()


def test_lines_equal_brute_force_and_sql_is_whole(documents):
    rows = rows_of(documents)
    assert results(line_dedup.dedup_lines(documents, 10)) == expected(rows, 10)
    assert results(line_dedup.dedup_lines(documents, 2)) == expected(rows, 2)


def test_lines_of_odd_tables(spark, odd, none):
    got = line_dedup.dedup_lines(odd, 2)
    assert results(got) == expected(rows_of(odd), 2)
    assert set(got.columns) == {*odd.columns, "n_lines", "n_dropped"} and {r.carried for r in got.collect()} == {"c"}
    assert line_dedup.dedup_lines(none, 2).collect() == []
    ties = spark.createDataFrame([(i, " AÄb \nown %d\n\n x" % i) for i in range(10)] + [(10, "aÄB"), (11, "aäb")], "doc_id bigint, text string")
    assert results(line_dedup.dedup_lines(ties, 11)) == expected(rows_of(ties), 11)  # exactly at the threshold


def test_line_index_is_reversible(spark, monkeypatch):
    """Putting documents in and taking them out leads back to the same counts and filters' answers, across shards and full filters."""
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 40)
    rng = random.Random(5)
    def batch(a, b, words):
        return spark.createDataFrame([(i, "\n".join(f"line {rng.randrange(words)}" for _ in range(30))) for i in range(a, b)], "doc_id bigint, text string")
    first, second = batch(0, 40, 120).cache(), batch(40, 100, 600).cache()
    def counts(index):
        return {bytes(r.digest): r.n for r in index.counts.collect()}
    one = line_dedup.build(first, 5)
    both = line_dedup.insert(one, second)
    assert counts(both) == counts(line_dedup.build(first.union(second), 5))
    assert results(line_dedup.clean(first, both)) == results(line_dedup.dedup_lines(first.union(second), 5).filter("doc_id < 40"))
    back = line_dedup.delete(both, second)
    assert counts(back) == counts(one) and results(line_dedup.clean(first, back)) == results(line_dedup.clean(first, one)) == expected(rows_of(first), 5)
    held = {r.shard: Cuckoo(r.buckets, r.slots) for r in back.filters.collect()}
    frequent = sum(n >= 5 for n in counts(one).values())
    assert sum((f.table > 0).sum() for f in held.values()) == frequent  # nothing is left of the second batch
    assert line_dedup.delete(back, first).counts.count() == 0
    with pytest.raises(ValueError):
        line_dedup.delete(one, second)


def test_a_full_filter_is_built_anew_from_the_counts(spark):
    a = spark.createDataFrame([(i, "one\ntwo") for i in range(3)], "doc_id bigint, text string")
    b = spark.createDataFrame([(i, "\n".join(f"l{k}" for k in range(400))) for i in range(3)], "doc_id bigint, text string")
    small = line_dedup.build(a, 3)
    grown = line_dedup.insert(small, b)
    assert max(r.buckets for r in grown.filters.collect()) > max(r.buckets for r in small.filters.collect())
    assert all(r.text == "" and r.n_dropped == 400 for r in line_dedup.clean(b, grown).collect())


# -- Merkle manifest -------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def grow(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def manifest(rows, altered):
    """Sorted (doc_id, leaf, subroot, root, proof, folded root, verified), node by node."""
    trees = {}
    for r in rows:
        trees.setdefault((r.source is not None, (r.source or "").encode()), []).append((r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text), leaf_of(r, altered(r))))
    trees = {k: sorted(v) for k, v in sorted(trees.items())}
    grown = [grow([x[2] for x in v]) for v in trees.values()]
    top = grow([g[-1][0] for g in grown])
    def path(levels, i):
        for level in levels[:-1]:
            start, place = i // 16 * 16, i % 16
            run = level[start:start + 16]
            yield "".join(run[:place]), "".join(run[place + 1:])
            i //= 16
    out = []
    for t, (leaves, levels) in enumerate(zip(trees.values(), grown)):
        for i, (known, doc_id, leaf, bad) in enumerate(leaves):
            whole = [*path(levels, i), *path(top, t)]
            for a, b in whole:
                bad = h(a + bad + b)
            out.append((doc_id if known else None, leaf, levels[-1][0], top[-1][0], h("".join(a + b for a, b in whole)), bad, bad == top[-1][0]))
    return out


def same(got, want):
    return sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


@pytest.mark.parametrize("span", [1, 3])
def test_manifest_equals_brute_force(spark, span):
    """Sources of 1, 16, 17 and 5,000 rows, and a null one: trees of several kept levels, short last runs, lone nodes."""
    sizes = [(None, 3), ("a", 1), ("b", 16), ("c", 17), ("d", 257), ("é", 5_000), ("Z", 2)]
    rows = [(i * 7 % 6000 + k * 10_000, f"T {i}", "x" if i % 3 else None, s, i) for k, (s, n) in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(7)
    altered = F.when(F.col("doc_id") % 5 == 0, F.lower("text")).otherwise(F.col("text"))
    got = merkle_manifest.audit(merkle_manifest.build(docs, altered, span)).collect()
    assert same(got, manifest(docs.collect(), lambda r: r.text.lower() if r.doc_id % 5 == 0 else r.text))


def test_manifest_of_odd_tables(odd, none):
    got = merkle_manifest.audit(merkle_manifest.build(odd.withColumn("source", F.col("marks").cast("string")))).collect()
    assert same(got, manifest(odd.withColumn("source", F.col("marks").cast("string")).collect(), lambda r: r.text)) and all(r.verified for r in got)
    assert same(merkle_manifest.audit(merkle_manifest.build(odd)).collect(), manifest(odd.collect(), lambda r: r.text))  # null sources
    assert merkle_manifest.audit(merkle_manifest.build(none)).collect() == []


def test_proofs_lead_to_the_root_and_altered_leaves_do_not(documents):
    made = merkle_manifest.build(documents)
    for r in merkle_manifest.proofs(made).collect():
        path = [(p.ahead.encode(), p.behind.encode()) for p in r.path]
        assert merkle_manifest.fold(r.leaf.encode(), path).decode() == r.root
        assert merkle_manifest.fold(h(r.leaf).encode(), path).decode() != r.root


# -- hard negatives --------------------------------------------------------------------


def mined(rows, anchor, positives=5, negatives=10):
    out = []
    ints = [(i, label, [int(np.floor(256 * float(x))) for x in v]) for i, label, v in rows]
    for i, label, v in ints:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), k, other) for k, other, w in ints if k != i)
        for p, k, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, k, n + 1, s[1], -p, -s[0]) for n, s in enumerate(fit)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    for size, spread, n in ((64, 0.1, 700), (5, 0.02, 400), (70, 1.0, 300)):  # small spreads give many equal scores
        base = rng.normal(0, spread, (4, size))
        rows = [(i, int(i % 3 == 0) + int(i % 7 == 0), (base[i % 4] * (i % 2) + rng.normal(0, spread, size)).astype("f4").tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
        got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 20 == 0).collect())
        assert got == mined(rows, lambda i: i % 20 == 0) and got


def test_intervals_are_certain_and_leave_most_rows_out(monkeypatch):
    rng = np.random.default_rng(8)
    vectors = np.floor(256 * rng.normal(0, 1 / 8, (3000, 64)))
    codes, facts = hard_negatives.encode(vectors)
    shard = hard_negatives.Shard(np.arange(3000), np.zeros(3000, np.int64), vectors.astype(np.int64), codes, facts)
    left = 0
    for a in range(0, 3000, 100):
        low, high = shard.intervals(vectors[a], hard_negatives.rotation(64) @ vectors[a], 0, 3000)
        score = vectors @ vectors[a]
        assert (low <= score).all() and (score <= high).all()
        best = hard_negatives.Best(10)
        wanted = best.wanted(low, high)
        assert wanted[np.argsort(-score)[:10]].all()
        left += wanted.sum()
        tiled = hard_negatives.Best(10, 2000, 9000)
        monkeypatch.setattr(hard_negatives, "TILE", 137)
        hard_negatives._meet(shard, [(0, 1000), (1200, 3000)], a, vectors[a].astype(np.int64), [tiled])
        fit = sorted((-int(s), i) for i, s in enumerate(score) if 2000 <= s <= 9000 and not 1000 <= i < 1200 and i != a)[:10]
        assert list(zip(-tiled.score, tiled.id)) == fit
    assert left < 0.25 * 30 * 3000


def test_hard_negatives_of_odd_tables(spark):
    schema = "vec_id bigint, label int, embedding array<float>, rank string, positive_id string"
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (2, 1, [0.5]), (3, 2, [0.4, 0.4]), (3, 3, [9.0, 9.0]), (4, None, [0.4, 0.4]), (5, 2, None),
            (6, 2, [None, 0.4]), (7, 2, [nan, 0.4]), (8, 2, [inf, 0.1]), (None, 2, [0.4, 0.4]), (9, 2, []), (100, 5, [-0.5, 0.1]), (200, 2, [0.4, 0.4, 0.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], schema)
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0).collect())
    sound = [(0, 1, [0.5, 0.5, 0]), (1, 1, [0.5, 0.5, 0]), (2, 1, [0.5, 0, 0]), (3, 2, [0.4, 0.4, 0]), (9, 2, [0, 0, 0]), (100, 5, [-0.5, 0.1, 0]), (200, 2, [0.4, 0.4, 0])]
    assert got == mined([(i, k, [float(np.float32(x)) for x in v]) for i, k, v in sound], lambda i: i % 100 == 0) and got
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(spark.createDataFrame([(0, 1, [1e30], "", "")], schema), F.col("vec_id") % 100 == 0).collect()


def test_new_queries_return_their_columns(spark, folder):
    kinds = {"op11_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
             "op12_merkle_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
             "op13_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}}
    for name, want in kinds.items():
        assert dict(queries.QUERIES[name](spark, folder).dtypes) == want
