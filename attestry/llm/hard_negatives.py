"""Hard negatives by rotated one-bit codes with stored alignment, deterministic residual intervals and integer scores.

Vectors become whole numbers, floor(scale * x), and a score is their inner product. A vector is rotated (one fixed orthogonal
matrix) and coded as signs, with the alignment of the vector to its signs; the signs of what is left are coded in the same way,
STAGES times, and the length of the last residual is kept. For an anchor the inner product with the codes follows from popcounts
with the bit planes of its own rotated components; what the codes leave out is at most (Cauchy-Schwarz) the length of the
residual times the length of the anchor's part across the last code. That interval is certain, rounding of the planes included,
so a row whose interval cannot reach an anchor's best ones is left out without loss; all others are scored in integers.

For each anchor: the first `positives` other rows of its label; for each of those the first `negatives` rows of another label
with low * positive_score <= 100 * negative_score <= high * positive_score. Higher scores first, ties by smaller id.

Rows without id, label or vector, or with a null or non-finite component, take no part. Of rows with one id the least (label,
vector) takes part. Vectors may differ in length; missing components count as 0. Components beyond LARGEST after scaling are an
error, as scores would not fit 64 bits. No rows, no anchors or no pairs give an empty table. Other columns play no part.

At scale: rows are dealt to shards by a hash of the id, whatever their label, and every anchor visits every shard once for its
positives and once for its negatives; a shard holds about SHARD_ROWS rows and gives at most `negatives` rows per anchor and
positive. Anchors are streamed past a shard, and only they are replicated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

STAGES = 6
PLANES = 8  # bits of an anchor's components
SHARD_ROWS = 1 << 16
LEAST_SHARDS = 32
TILE = 8192  # rows of a shard that meet an anchor at once
LARGEST = 1 << 25
ROUNDING = 1e-9  # of the product of two lengths: far above what double arithmetic can lose

CODED = "vec_id bigint, label bigint, vector binary, code binary, facts binary"


@lru_cache(maxsize=4)
def rotation(width: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(width).standard_normal((width, width)))[0]


def width_of(size: int) -> int:
    return max(64, -(-size // 64) * 64)


def bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as 64-bit words."""
    return np.packbits(flags, axis=1, bitorder="little").view("<u8")


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, STAGES, words) and facts (n, STAGES + 3): the alignment of each stage, and the lengths of residual, of code, of vector."""
    rest = vectors @ rotation(vectors.shape[1]).T
    codes, facts = [], []
    whole = np.zeros_like(rest)
    for _ in range(STAGES):
        sign = rest >= 0
        along = np.abs(rest).mean(1)
        part = np.where(sign, along[:, None], -along[:, None])
        codes.append(bits(sign))
        facts.append(along)
        whole += part
        rest = rest - part
    facts += [np.linalg.norm(rest, axis=1), np.linalg.norm(whole, axis=1), np.linalg.norm(vectors, axis=1)]
    return np.stack(codes, 1), np.stack(facts, 1)


def planes_of(rotated: np.ndarray) -> tuple[np.ndarray, float, float, np.ndarray]:
    """An anchor's rotated components in PLANES bits: bit planes, least value, step, and the components they stand for."""
    low = float(rotated.min())
    step = float(rotated.max() - low) / ((1 << PLANES) - 1) or 1.0
    level = np.rint((rotated - low) / step).astype(np.int64)
    return bits(level[None, :] >> np.arange(PLANES)[:, None] & 1 > 0), low, step, low + step * level


class Shard:
    """Rows that meet anchors, sorted by label so that rows of one label are one range."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, facts: np.ndarray) -> None:
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.vectors, self.facts = ids[order], labels[order], vectors[order], facts[order]
        self.codes = np.ascontiguousarray(codes[order].transpose(1, 2, 0))
        self.ones = np.bitwise_count(self.codes).sum(1, dtype=np.int64)

    def intervals(self, anchor: np.ndarray, rotated: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """Certain bounds of the anchor's scores with rows at .. to."""
        planes, low, step, stood = planes_of(rotated)
        width, facts = len(rotated), self.facts[at:to]
        estimate = np.zeros(to - at)
        for t in range(STAGES):
            met = np.zeros(to - at, np.int32)
            for k in range(PLANES):
                for w in range(self.codes.shape[1]):
                    met += np.bitwise_count(self.codes[t, w, at:to] & planes[k, w]).astype(np.int32) << k
            with_signs = low * (2 * self.ones[t, at:to] - width) + 2 * step * met - (stood - low).sum()
            estimate += facts[:, t] * with_signs
        off, length = float(np.linalg.norm(rotated - stood)), float(np.linalg.norm(anchor))
        along = np.maximum(np.abs(with_signs) / np.sqrt(width) - off, 0)
        across = np.sqrt(np.maximum(length * length - along * along, 0))
        half = across * facts[:, STAGES] + off * facts[:, STAGES + 1] + ROUNDING * (length * facts[:, STAGES + 2] + 1)
        return estimate - half, estimate + half

    def scores(self, anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.vectors[rows] @ anchor


class Best:
    """The first `most` of (score, id) seen, higher scores first, then smaller ids, within [least, cap]."""

    def __init__(self, most: int, least: int | None = None, cap: int | None = None) -> None:
        self.most, self.least, self.cap = most, least, cap
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def wanted(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which rows may belong to the first ones, by certain bounds."""
        sure = low if self.cap is None else low[(low >= self.least) & (high <= self.cap)]
        floor = -np.inf if self.least is None else self.least
        if len(sure) >= self.most:
            floor = max(floor, np.partition(sure, len(sure) - self.most)[len(sure) - self.most])
        if len(self.score) == self.most:
            floor = max(floor, self.score[-1])
        return (high >= floor) if self.cap is None else (high >= floor) & (low <= self.cap)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if self.cap is not None:
            fits = (score >= self.least) & (score <= self.cap)
            score, ids = score[fits], ids[fits]
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[:self.most]
        self.score, self.id = score[order], ids[order]


def _meet(shard: Shard, ranges: list[tuple[int, int]], anchor_id: int, anchor: np.ndarray, lists: list[Best]) -> None:
    """Let an anchor meet the rows of some ranges; each list takes its first ones."""
    rotated = rotation(len(anchor)) @ anchor
    for start, stop in ranges:
        for at in range(start, stop, TILE):
            to = min(at + TILE, stop)
            low, high = shard.intervals(anchor, rotated, at, to)
            wanted = np.zeros(to - at, bool)
            for best in lists:
                wanted |= best.wanted(low, high)
            rows = at + np.flatnonzero(wanted & (shard.ids[at:to] != anchor_id))
            score = shard.scores(anchor, rows)
            for best in lists:
                best.add(score, shard.ids[rows])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(b, kind) for b in column.to_pylist()])


def _past_shards(batches: Iterator[pa.RecordBatch], answer: Callable[[Shard, pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, its own rows before the anchors: let the anchors pass the shard, batch by batch."""
    here, parts, shard = None, [], None
    for batch in batches:
        key = batch.column("shard").to_numpy().astype(np.int64) * 2 + batch.column("visits").cast(pa.int64()).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else []
        for at, to in zip(cuts, cuts[1:]):
            part = batch.slice(at, to - at)
            if key[at] // 2 != here:
                here, parts, shard = key[at] // 2, [], None
            if key[at] % 2 == 0:
                parts.append(part)
                continue
            if shard is None and parts:
                own = pa.Table.from_batches(parts).combine_chunks()
                vectors, facts = _matrix(own["vector"], "<i4").astype(np.int64), _matrix(own["facts"], "<f8")
                codes = _matrix(own["code"], "<u8").reshape(len(vectors), STAGES, -1)
                shard, parts = Shard(own["vec_id"].to_numpy(), own["label"].to_numpy(), vectors, codes, facts), []
            if shard is not None:
                yield from answer(shard, part)


def _find_positives(most: int):
    def answer(shard: Shard, anchors: pa.RecordBatch):
        out = [[], [], []]
        for i, label, vector in zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "label", "vector"))):
            anchor, best = np.frombuffer(vector, "<i4").astype(np.int64), Best(most)
            _meet(shard, [(np.searchsorted(shard.labels, label), np.searchsorted(shard.labels, label, "right"))], i, anchor, [best])
            for column, values in zip(out, ([i] * len(best.id), best.id.tolist(), best.score.tolist())):
                column += values
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor_id", "positive_id", "positive_score"])

    return lambda batches: _past_shards(batches, answer)


def _find_negatives(most: int, low: int, high: int):
    def answer(shard: Shard, anchors: pa.RecordBatch):
        out = [[] for _ in range(5)]
        for i, label, vector, positives in zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "label", "vector", "positives"))):
            anchor = np.frombuffer(vector, "<i4").astype(np.int64)
            lists = [(p, Best(most, -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100)) for p in positives or ()]
            lists = [(p, best) for p, best in lists if best.least <= best.cap]
            if lists:
                ranges = [(0, np.searchsorted(shard.labels, label)), (np.searchsorted(shard.labels, label, "right"), len(shard.labels))]
                _meet(shard, ranges, i, anchor, [best for _, best in lists])
            for p, best in lists:
                n = len(best.id)
                for column, values in zip(out, ([i] * n, [p["positive_id"]] * n, [p["positive_score"]] * n, best.id.tolist(), best.score.tolist())):
                    column += values
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return lambda batches: _past_shards(batches, answer)


def _coder(size: int, scale: float):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = width_of(size)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = np.zeros((batch.num_rows, width))
            for row, components in zip(vectors, batch.column("vector").to_pylist()):
                row[:len(components)] = components
            vectors = np.floor(scale * vectors)
            if np.abs(vectors).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST}: scores would not fit 64 bits")
            codes, facts = encode(vectors)
            columns = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (vectors.astype("<i4"), codes.astype("<u8"), facts.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *columns], ["vec_id", "label", "vector", "code", "facts"])

    return code


def _first(rows: DataFrame, most: int, score: str, ident: str, *keys: str) -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(ident))
    return rows.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= most)


def _visit(coded: DataFrame, anchors: DataFrame, shards: int, fn: Callable, schema: str) -> DataFrame:
    rows = coded.withColumn("visits", F.lit(False))
    visitors = anchors.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "visits": F.lit(True)})
    met = rows.unionByName(visitors, allowMissingColumns=True)
    return met.repartition("shard").sortWithinPartitions("shard", "visits").mapInArrow(fn, schema)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256) -> DataFrame:
    """Hard negatives of the rows (vec_id, label, embedding) that `is_anchor` marks, against all rows: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    given = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = given.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    one = sound.groupBy("vec_id").agg(F.min(F.struct("label", F.col("embedding").alias("vector"))).alias("own")).select("vec_id", "own.*")
    seen = sound.agg(F.max(F.size("embedding")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    shards = max(LEAST_SHARDS, -(-seen["n"] // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    coded = settle(one.mapInArrow(_coder(seen["size"] or 0, scale), CODED).withColumn("shard", shard), "codes")
    anchors = coded.filter(is_anchor).select("vec_id", "label", "vector")
    near = _visit(coded, anchors, shards, _find_positives(positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    chosen = _first(near, positives, "positive_score", "positive_id", "anchor_id")
    of = chosen.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asking = settle(anchors.join(of, "vec_id"), "anchors")
    hard = _visit(coded.withColumn("positives", F.lit(None).cast("array<struct<positive_id: bigint, positive_score: bigint>>")), asking, shards,
                  _find_negatives(negatives, low, high), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    return _first(hard, negatives, "negative_score", "negative_id", "anchor_id", "positive_id").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
