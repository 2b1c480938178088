"""Benchmark passages in training documents: a BM25 index of the items, searched with block-max WAND.

The benchmark is the index and the training text asks the queries. Every document is cut into passages of
twice the longest item, starting every longest item, so that any item lies whole inside some passage. A
passage's score for an item is its BM25 sum over the item's words, divided by the item's own sum: 1 if the
passage has all the words of the item. All items at or above `least_score` are retrieved, none beyond a rank:

* items stand in blocks, and each posting list knows its greatest impact in each block; one vector step sums these block
  maxima for all passages at once and drops the passages that no block can lift to the threshold;
* the others walk their posting lists with block-max WAND: lists ordered by item, a pivot where the sum of list maxima
  reaches the threshold, and whole blocks skipped where the sum of block maxima does not.

A retrieved item is verified by runs of five words: at least `overlap` of the item's runs stand in the passage,
and of its question and of its answer at least `part_overlap` each. The answer is the item's last line, or its last
sentence if it has one line; an item of one sentence is all question. Words are runs of letters and digits, in lower case.

The index is built by Spark from all items (document frequencies and lengths are those of the whole benchmark). It is
cut into parts of about `part_bytes` of item text; a part is collected and broadcast, and searched with all documents,
one part after the other, so what a task holds does not grow with the benchmark. Documents are never shuffled.

Defined results: null and empty texts match nothing; empty or null items are never matched; rows without doc_id or
item_id count like others (their id is null in the result); repeated rows are searched each. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .words import PUNCTUATION, mix, slices, words_of

K1, B = 1.2, 0.75
BLOCK, MOST_BLOCKS = 8, 256  # items in a block at least; blocks of an index part at most
RUN = 5


def _names(column: pa.Array):
    return words_of(pc.utf8_lower(pc.fill_null(column, "")), apart=PUNCTUATION)


def _parts(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    text = text.strip()
    head, cut, tail = text.rpartition("\n")
    if not cut:
        at = max(text.rfind(mark, 0, len(text) - 1) for mark in (". ", "? ", "! "))
        head, tail = (text[:at + 1], text[at + 2:]) if at >= 0 else (text, "")
    return (head, tail) if head.strip() else (tail, "")


SUMMED = 1 << 20  # block maxima added up at once


def _runs(text: str) -> tuple[int, np.ndarray]:
    """The length of a text's runs (five words, or all it has) and their names."""
    words = _names(pa.array([text]))
    n = min(RUN, len(words.name))
    return n, _run_names(words.name, n)


def _run_names(names: np.ndarray, n: int) -> np.ndarray:
    if n == 0 or len(names) < n:
        return np.zeros(0, np.uint64)
    factor = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    total = len(names) - n + 1
    return np.unique(mix(sum(names[i:i + total] * factor[i] for i in range(n))))


def postings(items: DataFrame) -> DataFrame:
    """The inverted index: (item, term, tf, words of the item), one row per distinct word of each item.

    `item` is a number given to each row of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = _names(part.column("text"))
                out = [np.unique(words.name[words.first[i]:words.first[i + 1]], return_counts=True) for i in range(part.num_rows)]
                n = np.array([len(t) for t, _ in out], np.int64)
                row = np.repeat(np.arange(part.num_rows), n)
                terms = np.concatenate([np.zeros(0, np.uint64), *[t for t, _ in out]]).view(np.int64)
                tf = np.concatenate([np.zeros(0, np.int64), *[c for _, c in out]])
                yield pa.RecordBatch.from_arrays(
                    [part.column("item").take(pa.array(row)), pa.array(terms), pa.array(tf), pa.array(np.diff(words.first)[row])],
                    ["item", "term", "tf", "words"])

    return items.select("item", "text").mapInArrow(run, "item bigint, term bigint, tf bigint, words bigint")


@dataclass
class Index:
    """One part of the index: posting lists of normalised impacts with their block maxima, and the items' runs."""

    terms: np.ndarray  # sorted 64-bit names
    lists: list[tuple[list[int], list[float]]]  # items, impacts
    block: int  # items in a block
    maxima: np.ndarray  # (terms, blocks): greatest impact of each list in each block
    item_ids: list
    runs: list[tuple[tuple[int, np.ndarray], ...]]  # of the whole item, its question, its answer
    span: int
    best: np.ndarray = field(init=False)  # greatest impact of each list
    gate: np.ndarray = field(init=False)

    def __post_init__(self):
        self.best = self.maxima.max(axis=1)
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, names: np.ndarray) -> np.ndarray:
        """The number of each word in the index, -1 for the others."""
        out = np.full(len(names), -1)
        maybe = np.flatnonzero(self.gate[(names & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, names[maybe]), len(self.terms) - 1)
        same = self.terms[at] == names[maybe]
        out[maybe[same]] = at[same]
        return out


def build(rows: list, texts: dict[int, tuple], n_items: int, mean_words: float, span: int) -> Index:
    """An index part from its postings (item, term, tf, words, df) and its items' (id, text)."""
    number = {item: i for i, item in enumerate(sorted(texts))}
    by_term: dict[int, list[tuple[int, float]]] = {}
    own = np.zeros(len(number))
    for r in rows:
        idf = log(1 + (n_items - r["df"] + 0.5) / (r["df"] + 0.5))
        impact = idf * r["tf"] * (K1 + 1) / (r["tf"] + K1 * (1 - B + B * r["words"] / mean_words))
        by_term.setdefault(r["term"] & 0xFFFFFFFFFFFFFFFF, []).append((number[r["item"]], impact))
        own[number[r["item"]]] += impact
    terms = sorted(by_term)
    block = max(BLOCK, ceil(len(number) / MOST_BLOCKS))
    lists, maxima = [], np.zeros((len(terms), ceil(len(number) / block)), np.float32)
    for k, t in enumerate(terms):
        pairs = sorted(by_term[t])
        items, impacts = [i for i, _ in pairs], [w / own[i] for i, w in pairs]
        lists.append((items, impacts))
        np.maximum.at(maxima[k], np.array(items) // block, impacts)
    runs = []
    for item in sorted(texts):
        question, answer = _parts(texts[item][1] or "")
        runs.append((_runs(texts[item][1] or ""), _runs(question), _runs(answer)))
    return Index(np.array(terms, np.uint64), lists, block, maxima, [texts[k][0] for k in sorted(texts)], runs, span)


def wand(index: Index, terms: list[int], least: float, blocks: range) -> list[tuple[int, float]]:
    """All (item, score) with score >= least among the items of `blocks`, for a query of distinct terms, by block-max WAND."""
    least -= 1e-6
    low, high = blocks.start * index.block, blocks.stop * index.block
    cursors = []  # place, items, impacts, list maximum, block maxima, end
    for t in terms:
        items, impacts = index.lists[t]
        at, end = bisect_left(items, low), bisect_left(items, high)
        if at < end:
            maxima = index.maxima[t]
            cursors.append([at, items, impacts, float(maxima[blocks.start:blocks.stop].max()), maxima, end])
    out = []
    while cursors:
        cursors.sort(key=lambda c: c[1][c[0]])
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += c[3]
            if total >= least:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][1][cursors[pivot][0]]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][1][cursors[pivot + 1][0]] == item:
            pivot += 1
        block = item // index.block
        if sum(c[4][block] for c in cursors[:pivot + 1]) < least:
            # no item before the block's end or the next list's item can reach the threshold
            goal = (block + 1) * index.block
            if pivot + 1 < len(cursors):
                goal = min(goal, cursors[pivot + 1][1][cursors[pivot + 1][0]])
        elif cursors[0][1][cursors[0][0]] == item:
            score = sum(c[2][c[0]] for c in cursors[:pivot + 1])
            if score >= least:
                out.append((item, score))
            goal = item + 1
        else:
            goal = item
        for c in cursors[:pivot + 1]:
            c[0] = bisect_left(c[1], goal, c[0], c[5])
        cursors = [c for c in cursors if c[0] < c[5]]
    return out


def _share(wanted: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(wanted, there).mean()) if len(wanted) else 1.0


def _reached(maxima: np.ndarray, term: np.ndarray, first: np.ndarray, some: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """The passages that may reach `least` in a block, with which blocks: sums of block maxima, for a bounded number of terms at once."""
    at_once, ends = max(1, SUMMED // maxima.shape[1]), first[some + 1]
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, first[some[at]] + at_once, side="right")))
        low, high = first[some[at]], first[some[to - 1] + 1]
        reach = np.add.reduceat(maxima[term[low:high]], first[some[at:to]] - low, axis=0) >= least
        for row in np.flatnonzero(reach.any(axis=1)):
            yield some[at + row], reach[row]
        at = to


def _hits(index: Index, part: pa.RecordBatch, least_score: float, overlap: float, part_overlap: float) -> dict[tuple[int, int], tuple]:
    """Verified pairs (row, item number) with the start of the best passage, its score and the three overlaps."""
    span, step = 2 * index.span, index.span
    words = _names(part.column("text"))
    found = index.find(words.name)
    count = np.diff(words.first)
    passages = np.where(count > 0, np.maximum(np.ceil((count - span) / step).astype(np.int64), 0) + 1, 0)
    text = np.repeat(np.arange(part.num_rows), passages)
    begin = words.first[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(passages) - passages, passages))
    end = np.minimum(begin + span, words.first[text + 1])
    # the distinct index terms of every passage, and its sums of block maxima
    size = end - begin
    word = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    asked = np.repeat(np.arange(len(begin)), size)[found[word] >= 0] * len(index.terms) + found[word][found[word] >= 0]
    owner, term = np.divmod(np.unique(asked), len(index.terms))
    first = np.searchsorted(owner, np.arange(len(begin) + 1))
    some = np.flatnonzero(np.diff(first))
    hits: dict[tuple[int, int], tuple] = {}
    for p, reach in _reached(index.maxima, term, first, some, least_score - 1e-5):
        terms = term[first[p]:first[p + 1]].tolist()
        edge = np.flatnonzero(np.diff(np.concatenate([[0], reach.astype(np.int8), [0]])))
        ranked = [hit for a, z in edge.reshape(-1, 2).tolist() for hit in wand(index, terms, least_score, range(a, z))]
        if not ranked:
            continue
        names = words.name[begin[p]:end[p]]
        there = {n: _run_names(names, n) for n in range(1, RUN + 1)}
        for item, score in ranked:
            whole, question, answer = (_share(wanted, there[n]) if n else 1.0 for n, wanted in index.runs[item])
            key = (int(text[p]), item)
            if whole >= overlap and min(question, answer) >= part_overlap and (key not in hits or hits[key][1] < score):
                hits[key] = (int(begin[p] - words.first[text[p]]), score, whole, question, answer)
    return hits


def index_parts(items: DataFrame, part_bytes: int) -> Iterator:
    """The index of the benchmark `items` (item_id, text), one broadcast part after the other."""
    spark = items.sparkSession
    numbered = settle(items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text IS NOT NULL")
                      .withColumn("item", F.monotonically_increasing_id()), "items")
    index = settle(postings(numbered), "postings")
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = index.groupBy("item").agg(F.first("words").alias("words")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("words").alias("mean"), F.max("words").alias("most")).first()
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, ceil(size / part_bytes))
    index = settle(index.join(df, "term"), "index")
    for k in range(parts):
        mine = F.expr(f"pmod(xxhash64(item), {parts}) = {k}")
        rows = index.filter(mine).collect()
        if rows:
            known = {r["item"] for r in rows}
            texts = {r["item"]: (r["item_id"], r["text"]) for r in numbered.filter(mine).collect() if r["item"] in known}
            yield spark.sparkContext.broadcast(build(rows, texts, stats["n"], stats["mean"], stats["most"]))


PAIRS = "doc_id bigint, item_id bigint, passage_start bigint, score double, overlap double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, *, least_score: float = 0.6, overlap: float = 0.8, part_overlap: float = 0.5,
                 part_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, passage_start, score, overlap, question_overlap, answer_overlap): every verified pair of a
    document and a benchmark item, with the best passage of the document."""
    found = docs.sparkSession.createDataFrame([], PAIRS)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    for shared in index_parts(items, part_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    index: Index = shared.value
                    hits = _hits(index, part, least_score, overlap, part_overlap)
                    keys = sorted(hits)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array([k[0] for k in keys], pa.int64())),
                         pa.array([index.item_ids[k[1]] for k in keys], pa.int64()),
                         *[pa.array([hits[k][i] for k in keys], pa.int64() if i == 0 else pa.float64()) for i in range(5)]],
                        ["doc_id", "item_id", "passage_start", "score", "overlap", "question_overlap", "answer_overlap"])

        found = found.union(texts.mapInArrow(run, PAIRS))
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, *, least_score: float = 0.6, overlap: float = 0.8, part_overlap: float = 0.5,
                         part_bytes: int = 8 << 20) -> DataFrame:
    """The rows of `docs` that no benchmark item is verified in; a filter inside the scan, without a shuffle."""
    kept = docs
    for shared in index_parts(items, part_bytes):

        def run(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, "text"):
                    bad = {row for row, _ in _hits(shared.value, part, least_score, overlap, part_overlap)}
                    yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
