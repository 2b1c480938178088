"""The document operators against brute force, and over odd and empty tables."""

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestry.llm import decontaminate, fingerprint, language, near_dedup, packing, quality, queries, substring_dedup
from attestry.llm.words import words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def groups(texts, n, percent):
    """Smallest reachable id per id, by all pairs that share a shingle."""
    sets, posting, shared, parent = {i: shingles(t, n) for i, t in texts.items()}, defaultdict(list), Counter(), {i: i for i in texts}
    for i, s in sets.items():
        for x in s:
            posting[x].append(i)
    for ids in posting.values():
        shared.update(itertools.combinations(sorted(ids), 2))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sets, {i: root(i) for i in texts}


def test_words_equal_the_pattern(texts):
    some = [*texts.values(), "", None, " a\x0b\x0cb ", "é\u0085ü x"]
    w = words_of(pa.array(some), lower=True)
    for i, t in enumerate(some):
        at = range(w.first[i], w.first[i + 1])
        assert [w.data[w.start[k]:w.end[k]].tobytes().decode() for k in at] == WORD.findall(lower(t))
    names = {}
    for k in range(len(w.name)):
        assert names.setdefault(w.name[k], w.data[w.start[k]:w.end[k]].tobytes()) == w.data[w.start[k]:w.end[k]].tobytes()


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(documents, texts, n):
    sets, root = groups(texts, n, 80)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(documents, shingle=n, percent=80).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i in texts}


def test_large_group_of_near_copies(spark):
    """Edited copies of one text: links that do not touch a bucket's smallest document are found too."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(120)]
    texts = {}
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    _, root = groups(texts, 4, 80)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=4, percent=80).collect()}
    assert got == root and len(set(root.values())) > 1


def test_sketches_let_similar_sets_pass():
    rng = np.random.default_rng(1)
    for size in (5, 50, 400, 6000):
        for _ in range(20):
            both = rng.integers(0, 2**63, size).astype(np.uint64)
            differing = max(0, int(size * 0.2))
            a, b = both, np.concatenate([both[:size - differing // 2], rng.integers(0, 2**63, differing // 2).astype(np.uint64)])
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            if j < 0.8:
                continue
            for shape in (near_dedup.SMALL, near_dedup.LARGE):
                x, y = (np.frombuffer(near_dedup.odd_sketch(near_dedup.samples(s, shape[0]), shape[1]), np.uint64) for s in (a, b))
                assert np.bitwise_count(x ^ y).sum() <= near_dedup.most_flips(0.8, shape)
    assert near_dedup.miss_chance(0.8) < 1e-7


def expected_repeats(texts, window):
    seen, out = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        gone, own = [False] * len(w), [tuple(w[k:k + window]) for k in range(len(w) - window + 1)]
        for k, x in enumerate(own):
            if x in seen:
                gone[k:k + window] = [True] * window
        for x in own:
            seen.setdefault(x, i)
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


@pytest.mark.parametrize("window", [8, 50])
def test_repeats(documents, texts, window):
    want = expected_repeats(texts, window)
    got = {r.doc_id: (r.n_words, r.n_removed, WORD.findall(r.text or "")) for r in substring_dedup.remove_repeats(documents, window).collect()}
    assert got == want and any(v[1] for v in want.values())


def test_repeats_of_runs_and_periods(spark):
    """Windows inside long runs of a word and inside periodic text, at every alignment."""
    rng = random.Random(5)
    texts = {}
    for i in range(40):
        filler = [f"f{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))]
        core = rng.choice([["a"] * rng.randint(40, 90), ["a", "b"] * rng.randint(20, 45), ["x", "y", "y"] * rng.randint(16, 30), [f"c{k}" for k in range(55)]])
        texts[i] = " ".join(filler + core + filler[::-1])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, WORD.findall(r.text)) for r in substring_dedup.remove_repeats(docs, 50).collect()}
    assert got == expected_repeats(texts, 50)


def test_equal_windows_share_an_anchor():
    rng = random.Random(9)
    rounds = substring_dedup.Rounds.of(50)
    assert rounds.caps and 2 * rounds.margin < 50
    for _ in range(60):
        common = [rng.choice("abcdefgh") if rng.random() < 0.5 else f"u{rng.randrange(99)}" for _ in range(50)]
        keys = []
        for _ in range(2):
            around = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))] for _ in range(2)]
            w = words_of(pa.array([" ".join(around[0] + common + around[1])]))
            _, key, at = substring_dedup.anchors(w, rounds)
            inside = (at >= len(around[0]) + rounds.margin) & (at + rounds.longest + rounds.margin <= len(around[0]) + 50)
            keys.append(set(key[inside].tolist()))
        assert keys[0] & keys[1]


def test_packing(documents, texts):
    from tokenizers import Tokenizer
    names = queries.vocabulary()
    plain = Tokenizer.from_file(names["vocabulary"])
    got = [r.asDict() for r in packing.pack_documents(documents, **names).collect()]
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    total = 0
    for i, t in texts.items():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and own[0]["start"] == 0 and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 2048 for r in own[1:]) and len(own) == -(-len(ids) // 2048)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
        total += len(ids)
    rows = defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in rows.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(rows) <= -(-total // 2048) + 1
    made = packing.sequences(documents, **names).collect()
    assert len(made) == len(rows) and sum(len(r.ids) for r in made) == total and max(len(r.ids) for r in made) <= 2048


def test_libraries_agree():
    names = queries.vocabulary()
    fast, plain = packing.encoder(**names), packing.encoder(names["vocabulary"], None)
    for c in [*range(0, 0x250), *range(0x2000, 0x2070), 0x4E2D, 0x1F600, 0x85]:
        for text in (f"a{chr(c)}b", f"  {chr(c)} {chr(c)}{chr(c)}\n{chr(c)}", f"1{chr(c)}'s <|endoftext|>"):
            assert fast(text).tolist() == plain(text).tolist()


def test_packing_in_many_parts(spark):
    """Parts with gaps exchange documents: hardly more sequences than one part needs, and every row exactly once."""
    rng = random.Random(2)
    lengths = [rng.randint(1, 1024) if rng.random() < 0.7 else rng.randint(600, 2048) for _ in range(6000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "row bigint, length bigint")
    placed = packing.pack(items, 2048, part=300).join(items, "row").collect()
    assert sorted(r.row for r in placed) == list(range(len(lengths)))
    used = defaultdict(int)
    for r in placed:
        used[r.sequence_id] += r.length
    bound = packing.lower_bound(np.bincount(lengths, minlength=2049), 2048)
    assert max(used.values()) <= 2048 and bound <= len(used) <= 1.005 * bound + 1


def test_lower_bound_never_exceeds_the_best():
    rng = random.Random(4)
    for _ in range(200):
        capacity = rng.choice([10, 12, 30])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 8))), reverse=True)
        best = len(items)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(items):
                best = len(rooms)
                return
            for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
                place(i + 1, [r - items[i] if j == k else r for j, r in enumerate(rooms)])
            place(i + 1, [*rooms, capacity - items[i]])

        place(0, [])
        assert packing.lower_bound(np.bincount(items, minlength=capacity + 1), capacity) <= best


def test_fingerprints(documents, texts):
    ids = sorted(texts)

    def units(t):
        return set(t.split("\n")) if t else set()

    got = {r.doc_id: r for r in fingerprint.fingerprints(documents).collect()}
    prints = {}
    for k, i in enumerate(ids):
        t, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        n = len(t)
        edited = t[:n - n // 4] + after[:n // 4]
        r = got[i]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((r.near_edited, edited), (r.near_next, after)):
            every = units(t) | units(other)
            assert value == pytest.approx(len(units(t) & units(other)) / len(every) if every else 1.0)
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)


def test_sketches_retry_until_everything_is_recovered(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i, n in enumerate([0, 1, 5, 12, 40, 300, 5000]):
        shared, a, b = ([rng.randrange(-2**62, 2**62) for _ in range(m)] for m in (n, n, n // 2))
        rows.append((i, shared + a, b + shared))
        want[i] = n / (n + n + n // 2) if n else 1.0
    got = {r.row: r.likeness for r in fingerprint.likeness(spark.createDataFrame(rows, "row bigint, a array<bigint>, b array<bigint>")).collect()}
    assert got == pytest.approx(want)


def test_leaks(spark, folder, documents, texts):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    runs = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    split = lambda t: [x for x in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if x]
    want = {(i, r.item_id) for i, t in texts.items() for r in items.collect() if (x := runs(split(r.text))) and len(x & runs(split(t))) >= len(x)}
    got = decontaminate.contaminated(documents, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    parts = decontaminate.contaminated(documents, items, part_bytes=300).collect()
    assert {(r.doc_id, r.item_id) for r in parts} == want
    kept = {r.doc_id for r in decontaminate.without_contaminated(documents, items).select("doc_id").collect()}
    assert kept == set(texts) - {i for i, _ in want}


def test_wand_equals_scoring_everything():
    rng = random.Random(8)
    rows, texts, df = [], {}, Counter()
    for item in range(90):
        words = rng.choices(range(60), [1 / (k + 1) for k in range(60)], k=rng.randint(3, 20))
        texts[item] = (item, "x")
        for t, tf in Counter(words).items():
            rows.append({"item": item, "term": t, "tf": tf, "words": len(words)})
            df[t] += 1
    index = decontaminate.build([{**r, "df": df[r["term"]]} for r in rows], texts, 90, 10.0, 20)
    for _ in range(300):
        query = rng.sample(range(len(index.terms)), rng.randint(1, 25))
        scores = Counter()
        for t in query:
            for item, w in zip(*index.lists[t]):
                scores[item] += w
        for least in (0.2, 0.5, 0.9):
            want = {i for i, s in scores.items() if s >= least}
            assert {i for i, _ in decontaminate.wand(index, query, least, range(index.maxima.shape[1]))} == want


def test_languages(documents, texts):
    known = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    model = language.learn(documents.filter(~language.held_out()))
    rows = language.predict(documents, model).withColumn("held", language.held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held and known[r.doc_id]]
    assert sum(r.lang_pred == known[r.doc_id] for r in held) >= 0.95 * len(held)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    change = rng.normal(size=(2, 2))
    for n in (1, 2, 7, 70):
        score = rng.normal(size=(n, 2))
        got = language.expected_words(score, np.array([0, n]), change)[0]
        ahead, m = [], np.full(2, 0.5)
        for s in score:
            m = (m @ np.exp(change)) * np.exp(s)
            m /= m.sum()
            ahead.append(m)
        back, total = np.ones(2), np.zeros(2)
        for k in range(n - 1, -1, -1):
            g = ahead[k] * back
            total += g / g.sum()
            back = np.exp(change) @ (np.exp(score[k]) * back)
            back /= back.sum()
        assert got == pytest.approx(total)


def test_quality(spark, folder):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.QUERIES["op9_quality_network"](spark, folder).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert held and sum(r.predicted == labels[r.doc_id] for r in held) >= 0.9 * len(held)


def test_odd_documents(spark, folder, odd, none):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    near = near_dedup.near_duplicates(odd).collect()
    assert len(near) == 16
    by_id = defaultdict(list)
    for r in near:
        by_id[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == [(4, 1, True)] * 2 and by_id[12] == [(4, 1, False)] and by_id[2] == [(0, 2, True)] and by_id[4] == [(0, 4, True)]
    assert sorted(by_id[None]) == [(0, None, True), (4, None, True)] and by_id[6][0][1:] == (5, False) and by_id[9] == [(1, 8, False)]
    cleaned = substring_dedup.remove_repeats(odd)
    assert cleaned.columns == [*[c for c in odd.columns if c != "n_words"], "n_words", "n_removed"]
    gone = {(r.doc_id, r.n_removed) for r in cleaned.collect()}
    assert (6, 60_001) in gone and (5, 0) in gone and (2, 0) in gone and (None, 0) in gone
    prints = fingerprint.fingerprints(odd).collect()
    assert len(prints) == 16 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in prints)
    assert len({r.fingerprint for r in prints if r.n_chars == 0}) == 1
    found = language.predict(odd, language.learn(odd)).collect()
    assert {r.lang_pred for r in found if r.doc_id in (2, 3, 4, 7)} == {"und"} and all(r.marks == 1 for r in found) and len(found) == 16
    assert decontaminate.contaminated(odd, items).count() == 0 and decontaminate.without_contaminated(odd, items).count() == 16
    leaky = items.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), "text")
    assert decontaminate.contaminated(leaky, items.union(items).union(items.select(F.lit(None).cast("bigint").alias("item_id"), F.lit("")))).count() >= 2
    scores = quality.score_documents(odd, spark.createDataFrame([(1, 1), (1, 0), (5, None), (None, 1), (8, 1), (7, 0)], "doc_id bigint, quality int")).collect()
    assert len(scores) == 16 and all(0 <= r.score <= 1 for r in scores)
    names = queries.vocabulary()
    packed = packing.pack_documents(odd, **names).collect()
    assert len({r.row for r in packed}) == len(packed) and sum(r.doc_id == 2 for r in packed) == 1
    # tables without rows
    assert near_dedup.near_duplicates(none).count() == substring_dedup.remove_repeats(none).count() == fingerprint.fingerprints(none).count() == 0
    assert language.predict(none, language.learn(none)).count() == packing.pack_documents(none, **names).count() == 0
    assert decontaminate.contaminated(none, items).count() == decontaminate.contaminated(odd, items.limit(0)).count() == 0
    assert quality.score_documents(none, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 0


def test_bounds_of_long_texts_take_bounded_memory(monkeypatch):
    """A text of two megabytes against 2,048 items: the sums of block maxima are made piece by piece, and pieces change nothing."""
    rng = random.Random(9)
    names = [f"v{i}" for i in range(20_000)]
    texts = {i: (i, " ".join(rng.choices(names, k=30))) for i in range(2_048)}
    rows, df = [], Counter()
    for i, (_, t) in texts.items():
        w = words_of(pa.array([t]), lower=True, apart=decontaminate.PUNCTUATION)
        for term, tf in zip(*np.unique(w.name, return_counts=True)):
            df[int(term)] += 1
            rows.append({"item": i, "term": int(term), "tf": int(tf), "words": len(w.name)})
    index = decontaminate.build([{**r, "df": df[r["term"]]} for r in rows], texts, len(texts), 30.0, 30)
    long = " ".join(rng.choices(names, k=60_000)) + " " + texts[5][1] + " " + " ".join(rng.choices(names, k=190_000))
    part = pa.record_batch({"text": pa.array([long, texts[7][1], "", None])})
    tracemalloc.start()
    whole = decontaminate._hits(index, part, 0.6, 0.8, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(0, 5), (1, 7)} <= set(whole) and peak < 200 << 20
    monkeypatch.setattr(decontaminate, "SUMMED", 5_000)
    short = pa.record_batch({"text": pa.array([texts[7][1], long[:20_000], texts[5][1] + " " + long[:9_000]])})
    pieces = decontaminate._hits(index, short, 0.3, 0.5, 0.2)
    monkeypatch.setattr(decontaminate, "SUMMED", 1 << 30)
    assert pieces == decontaminate._hits(index, short, 0.3, 0.5, 0.2) and len(pieces) > 1
