"""Long repeated substrings across documents, found by recompression.

A text is a row of words, each with a 64-bit name. A round of recompression first names runs of one
symbol, then names pairs of neighbours (left, right), where a coin drawn from each symbol's name says
which side it takes. A name is a function of what it stands for, so every task gives equal substrings
equal symbols without a shared dictionary; the coin makes pairs disjoint, so a symbol depends on nothing
outside itself. Only the symbol at either end of a repeated substring can differ between its occurrences,
once per step and by at most the step's longest symbol: after the rounds, all symbols that lie `margin`
words inside two equal windows are equal. With windows of 50 words there are two rounds, symbols of up
to 8 words, and a margin of 12.

Every window therefore picks one of its inner symbols (the least by hash, the leftmost of equals), and
both occurrences of an equal window pick the same. The picked symbol together with the margin around it
is an anchor: anchors that two documents share reveal a repeat of at least 32 words, and no repeat of a
whole window is without one. Around shared anchors, and only there, every window gets a 128-bit name;
a window whose name occurs in a document with a smaller doc_id is a repeat and its words go.

Documents with the same words are one class: only the smallest doc_id of a class is searched, the other
copies go whole (if they have a window at all). Shuffles carry names and positions; groups are reduced to their
smallest doc_id before they are joined, so a passage that a third of all documents hold costs its occurrences.

Defined results: null, empty and blank texts have no words and lose none. Texts shorter than a window lose
none. Repeats inside one document stay. Rows with equal doc_id are judged each by its own text, and never
against one another. Rows without doc_id lose nothing and count for nobody. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .carry import CARRIED, carry, restore
from .words import Words, mix, powers, slices, words_of

_ONE, _TWO, _RUN = (np.uint64(int(mix(np.array([i], np.uint64))[0]) | 1) for i in (11, 12, 13))


@dataclass(frozen=True)
class Rounds:
    """Longest run and longest pair per round, and what they imply."""

    window: int
    caps: tuple[tuple[int, int], ...]
    longest: int  # words of a symbol after the last round
    margin: int  # words at either end of a window whose symbols may differ

    @classmethod
    def of(cls, window: int) -> Rounds:
        """As many rounds as leave half of the window inside the margins."""
        caps, longest, margin = [], 1, 0
        while window - 2 * (margin + (4 << len(caps))) >= window / 2:
            run = 2 << len(caps)
            margin += 2 * run  # a run at the edge, then a symbol that may pair outwards: neither is longer than `run`
            longest = 2 * run
            caps.append((run, longest))
        return cls(window, tuple(caps), longest, margin)

    @property
    def picks(self) -> int:
        """How many consecutive word positions a window picks its symbol's start from."""
        return self.window - 2 * self.margin - self.longest + 1


def recompress(words: Words, rounds: Rounds) -> tuple[np.ndarray, np.ndarray]:
    """(first word, name) of every symbol after the rounds."""
    name, length, text = words.name, np.ones(len(words.name), np.int64), words.text_of()
    start = np.arange(len(name))
    for r, (run_cap, pair_cap) in enumerate(rounds.caps):
        if len(name) < 2:
            break
        # runs: equal neighbours within one text
        fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
        at = np.flatnonzero(fresh)
        count = np.diff(np.concatenate([at, [len(name)]]))
        whole = np.repeat((count > 1) & (count * length[at] <= run_cap), count)
        keep = fresh | ~whole
        times = np.repeat(count, count)
        name = np.where(whole, mix(name * _RUN + times.astype(np.uint64)), name)[keep]
        length = np.where(whole, times * length, length)[keep]
        start, text = start[keep], text[keep]
        # pairs: a left symbol with the right symbol after it
        right = ((mix(name + np.uint64(r + 1)) >> np.uint64(7)) & np.uint64(1)).astype(bool)
        pair = ~right[:-1] & right[1:] & (text[1:] == text[:-1]) & (length[1:] + length[:-1] <= pair_cap)
        first = np.flatnonzero(pair)
        name, length = name.copy(), length.copy()
        name[first] = mix(name[first] * _ONE + name[first + 1] * _TWO)
        length[first] += length[first + 1]
        keep = np.ones(len(name), bool)
        keep[first + 1] = False
        name, length, start, text = name[keep], length[keep], start[keep], text[keep]
    return start, name


def _least_start(order: np.ndarray, n: int) -> np.ndarray:
    """For each position the leftmost position of the least value among it and the n - 1 after it."""
    best = np.arange(len(order))
    span = 1

    def better(a, b):
        return np.where(order[b] < order[a], b, a)

    while 2 * span <= n:
        best = better(best[:-span], best[span:]) if len(best) > span else best[:0]
        span *= 2
    rest = n - span
    return best if not rest else (better(best[:-rest], best[rest:]) if len(best) > rest else best[:0])


def _sums(words: Words, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the words' names times powers, and the inverse powers, for hashing any run of words."""
    base = int(mix(np.array([salt], np.uint64))[0]) | 1
    n = len(words.name)
    up = powers(base, n)
    values = mix(words.name + np.uint64(salt)) * up
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)]), powers(pow(base, -1, 1 << 64), n)


def _hash(sums, first: np.ndarray, n: int) -> np.ndarray:
    total, down = sums
    return mix((total[first + n] - total[first]) * down[first])


def anchors(words: Words, rounds: Rounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, first word of the anchor's symbol) of every anchor."""
    n, w = len(words.name), rounds.window
    start, name = recompress(words, rounds)
    order = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    order[start] = mix(name + np.uint64(77)) >> np.uint64(1)
    best = _least_start(order, rounds.picks)
    count = np.diff(words.first)
    has = np.maximum(count - w + 1, 0)
    text = np.repeat(np.arange(len(count)), has)
    at = np.arange(int(has.sum())) - np.repeat(np.cumsum(has) - has, has) + np.repeat(words.first[:-1], has)
    picked = best[at + rounds.margin] if len(at) else at
    new = np.ones(len(picked), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (text[1:] != text[:-1])
    text, picked = text[new], picked[new]
    key = _hash(_sums(words, 5), picked - rounds.margin, rounds.longest + 2 * rounds.margin) if len(picked) else np.zeros(0, np.uint64)
    return text, key, picked


def _digests(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each text's row of words."""
    first, out = words.first, []
    for salt in (21, 22):
        total, down = _sums(words, salt)
        down = np.concatenate([down, [np.uint64(1)]])
        out.append(mix((total[first[1:]] - total[first[:-1]]) * down[np.minimum(first[:-1], len(words.name))] + np.diff(first).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """Values, sorted by owner, as one list for each of n owners."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _scan(docs: DataFrame, rounds: Rounds) -> DataFrame:
    """Per row: doc_id, d0, d1 (digest of its words), n_words, and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                d0, d1 = _digests(words)
                text, key, at = anchors(words, rounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(d0), pa.array(d1), pa.array(np.diff(words.first), pa.int64()),
                     _lists(key.view(np.int64), text, part.num_rows, pa.int64()),
                     _lists((at - words.first[text]).astype(np.int32), text, part.num_rows, pa.int32())],
                    ["doc_id", "d0", "d1", "n_words", "keys", "places"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL").mapInArrow(
        run, "doc_id bigint, d0 bigint, d1 bigint, n_words bigint, keys array<bigint>, places array<int>")


def _windows(docs: DataFrame, shared: DataFrame, rounds: Rounds) -> DataFrame:
    """(h0, h1, doc_id, d0, at): the name of every window around the shared anchors of each document."""
    w, b = rounds.window, rounds.margin

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                d0, _ = _digests(words)
                lists, own = part.column("places"), part.column("own").to_numpy()
                out_doc, out_at = [], []
                for i in range(part.num_rows):
                    n = int(words.first[i + 1] - words.first[i])
                    if own[i] != d0[i] or n < w:
                        continue
                    places = lists[i].values.to_numpy()
                    marks = np.zeros(n - w + 2, np.int32)
                    np.add.at(marks, np.maximum(places + rounds.longest + b - w, 0), 1)
                    np.add.at(marks, np.minimum(places - b, n - w) + 1, -1)
                    found = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
                    out_doc.append(np.full(len(found), i))
                    out_at.append(found)
                row = np.concatenate([np.zeros(0, np.int64), *out_doc])
                at = np.concatenate([np.zeros(0, np.int64), *out_at])
                first = words.first[row] + at
                names = [_hash(_sums(words, salt), first, w).view(np.int64) if len(first) else np.zeros(0, np.int64) for salt in (31, 32)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[0]), pa.array(names[1]), part.column("doc_id").take(pa.array(row)), pa.array(d0[row]), pa.array(at.astype(np.int32))],
                    ["h0", "h1", "doc_id", "d0", "at"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(shared, "doc_id")
    return rows.mapInArrow(run, "h0 bigint, h1 bigint, doc_id bigint, d0 bigint, at int")


def repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, marks): per document the starts of the windows to remove, each with the digest of the text it
    belongs to; a start of -1 stands for the whole text (a later copy)."""
    rounds = Rounds.of(window)
    scanned = settle(_scan(docs, rounds), "anchors").filter(F.col("n_words") >= window)
    classes = settle(scanned.groupBy("d0", "d1").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "classes")
    copies = (scanned.select("doc_id", "d0", "d1").join(classes.filter("least < most"), ["d0", "d1"]).filter("doc_id > least")
              .select("doc_id", "d0", F.lit(-1).alias("at")))
    leaders = scanned.join(classes.select("d0", "d1", F.col("least").alias("doc_id")), ["doc_id", "d0", "d1"], "left_semi")
    each = leaders.select("doc_id", "d0", F.explode(F.arrays_zip("keys", "places")).alias("a")).select(
        "doc_id", "d0", F.col("a.keys").alias("key"), F.col("a.places").alias("place"))
    # written first, so that the join reads plain exchanges, which Spark splits where one key has many rows
    common = settle(each.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("key"), "common")
    shared = (each.join(common, "key").groupBy("doc_id", F.col("d0").alias("own"))
              .agg(F.collect_list("place").alias("places")))
    windows = settle(_windows(docs, shared, rounds), "windows")
    first = settle(windows.groupBy("h0", "h1").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi"), "first")
    later = windows.join(first, ["h0", "h1"]).filter("doc_id > lo").select("doc_id", "d0", "at")
    return later.union(copies).groupBy("doc_id").agg(F.collect_list(F.struct("d0", "at")).alias("marks"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """`docs` with `text` free of repeated windows, and n_words (before) and n_removed.

    White space around what stays is left as it is; a null text stays null."""
    found = settle(repeats(docs, window), "marks").withColumnRenamed("doc_id", "of")
    rows = carry(docs, "doc_id", "text")
    joined = rows.join(found, F.col("doc_id").cast("bigint") == F.col("of"), "left").drop("of")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = words_of(part.column("text"))
                d0, _ = _digests(words)
                count = np.diff(words.first)
                removed = np.zeros(part.num_rows, np.int64)
                lists, text = part.column("marks"), part.column("text")
                hit = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
                fresh = {}
                for i in hit:
                    marks = lists[int(i)].values
                    at = marks.field("at").to_numpy()[marks.field("d0").to_numpy() == d0[i]]
                    if not len(at):
                        continue
                    cover = np.zeros(count[i] + 1, np.int32)
                    if at.min() < 0:
                        cover[0] = 1
                    else:
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    removed[i] = gone.sum()
                    f, t = words.first[i], words.first[i + 1]
                    # a removed word goes with the white space after it
                    edge = np.append(words.start[f:t], words.end[t - 1])
                    lo, hi = edge[:-1][~gone], edge[1:][~gone]
                    fresh[int(i)] = b"".join(words.data[a:z].tobytes() for a, z in _joined(lo, hi)).decode()
                if fresh:
                    text = pa.array([fresh.get(i, x) for i, x in enumerate(text.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), text.cast(pa.string()), part.column(CARRIED), pa.array(count, pa.int64()), pa.array(removed)],
                    ["doc_id", "text", CARRIED, "n_words", "n_removed"])

    schema = T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return restore(joined.mapInArrow(run, schema), docs, "doc_id", "text", added=("n_words", "n_removed"))


def _joined(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Adjacent byte ranges joined into longer ones."""
    if not len(lo):
        return []
    cut = np.flatnonzero(lo[1:] != hi[:-1])
    return list(zip(lo[np.concatenate([[0], cut + 1])].tolist(), hi[np.concatenate([cut, [len(hi) - 1]])].tolist()))
