"""Packing token pieces into as few sequences as possible: best-fit decreasing with certified bounds.

A document's tokens, closed by an end id, are one piece; only documents longer than a sequence are cut, into whole
sequences with the shorter piece first. Whole pieces are sequences of their own. The others are dealt into parts by a
hash of the row, each part is packed by best-fit decreasing in a task of its own, and dual feasible functions give a lower
bound of the sequences that the part needs. A part that meets its bound is certified: no packing of it is better. Parts
with a gap, and the emptier sequences of the others (rounding up costs each part one), put their documents into a pool,
which is dealt and packed anew while that saves sequences. The pool shrinks to the open sequences of each
part, so the rounds grow with the logarithm of the number of parts, and no task ever holds more than a part.

Defined results: null and empty texts are a piece of the end id alone; rows with equal doc_id are separate
documents with the same name (their pieces are told apart by `row`); other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .words import slices

PART = 50_000  # pieces packed by one task
OPEN = 0.05  # a sequence with more than this share unused is worth dealing again


# Where the two libraries were compared character by character; any other text goes to `tokenizers` itself.
_COMPARED = re.compile("[^\x00-\u024f\u2000-\u206f]")


@cache
def _library(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@cache
def _special(path: str) -> re.Pattern | None:
    names = [t.content for t in _library(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, names))) if names else None


@cache
def _ranks(path: str):
    """The same vocabulary in a library that encodes five times as fast, if its file lies beside."""
    import tiktoken
    from public_tokenizers import PATTERN
    with open(path) as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(vocabulary: str, ranks: str | None):
    """text -> uint32 ids. `ranks` names the vocabulary's rank file, for texts where both libraries agree for certain."""

    def encode(text: str) -> np.ndarray:
        if ranks and not _COMPARED.search(text) and not ((s := _special(vocabulary)) and s.search(text)):
            return _ranks(ranks).encode_to_numpy(text, disallowed_special=())
        return np.array(_library(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def token_pieces(docs: DataFrame, vocabulary: str, *, ranks: str | None = None, capacity: int = 2048, end_id: int = 0,
                 with_ids: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and `ids` (array<int>) if asked for."""
    encode = encoder(vocabulary, ranks)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[tuple] = []
                for i, text in enumerate(part.column("text")):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                    first = len(ids) % capacity or min(capacity, len(ids))
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                        out.append((i, k, a, z - a, zlib.crc32(ids[a:z].tobytes()), ids[a:z].astype(np.int32) if with_ids else None))
                columns = list(zip(*out)) or [[]] * 6
                arrays = [part.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()),
                          *[pa.array(columns[c], pa.int64()) for c in (2, 3, 4)]]
                if with_ids:
                    arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length, and what is left in each bin. Open bins are kept by room; a bit
    set of the rooms in use finds the tightest that fits."""
    place, offset, room = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = used >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                used &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        place[i], offset[i] = b, capacity - r
        room[b] = left = r - n
        if left:
            by_room[left].append(b)
            used |= 1 << left
    return place, offset, np.array(room, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that `counts[n]` pieces of each length n (0 … capacity) need at least, by two families of dual feasible functions."""
    n = np.arange(capacity + 1)
    weight = counts * n
    best = ceil(weight.sum() / capacity)
    # pieces beyond capacity - a count as a whole bin, pieces below a as nothing
    pieces, mass = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]]), np.concatenate([np.cumsum(weight[::-1])[::-1], [0]])
    a = np.arange(1, capacity // 2 + 1)
    bounds = pieces[capacity - a + 1] + np.ceil((mass[a] - mass[capacity - a + 1]) / capacity).astype(np.int64)
    best = max(best, int(bounds.max()))
    # lengths rounded down to a k-th, but for those that are a multiple of a (k + 1)-th
    for k in range(1, 65):
        times = (k + 1) * n
        share = (times // capacity) * np.where(times % capacity == 0, k, k + 1)  # in 1 / (k (k + 1))
        best = max(best, -(-int((counts * share).sum()) // (k * (k + 1))))
    return best


def _pack_round(items: DataFrame, capacity: int, number: int, parts: int) -> DataFrame:
    """(row, length, sequence_id, offset, room, gap) of one dealing into parts."""

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy()
        place, offset, room = best_fit_decreasing(lengths, capacity)
        gap = len(room) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        name = (number << 56) + (key[0].as_py() << 24)
        return pa.table({"row": table["row"], "length": table["length"], "sequence_id": pa.array(place + name, pa.int64()),
                         "offset": pa.array(offset), "room": pa.array(room[place]), "gap": pa.array(np.full(len(place), gap), pa.int64())})

    dealt = items.select("row", "length", F.expr(f"pmod(xxhash64(row, {number}), {parts})").alias("part"))
    return dealt.groupBy("part").applyInArrow(pack, "row bigint, length bigint, sequence_id bigint, offset bigint, room bigint, gap bigint")


def pack(items: DataFrame, capacity: int = 2048, *, part: int = PART) -> DataFrame:
    """(row, sequence_id, offset) for items (row, length), lengths 1 … capacity, rows distinct."""
    whole = items.filter(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    pool = items.filter(F.col("length") < capacity).select("row", "length")
    n = pool.count()
    done, number, before = [whole], 1, None
    while n:
        parts = max(1, ceil(n / part))
        packed = settle(_pack_round(pool, capacity, number, parts), "packed")
        bins = packed.filter("offset = 0").count()
        if before is not None and bins >= before["bins"]:
            done.append(before["pool"].select("row", "sequence_id", "offset"))  # dealing again saved nothing
            break
        again = (F.col("room") > 0) & ((F.col("gap") > 0) | (F.col("room") > OPEN * capacity))
        if parts == 1:
            done.append(packed.select("row", "sequence_id", "offset"))
            break
        done.append(packed.filter(~again).select("row", "sequence_id", "offset"))
        pool = packed.filter(again)
        stats = pool.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("offset") == 0, 1).otherwise(0)).alias("bins")).first()
        n, before, number = stats["n"], {"pool": pool, "bins": stats["bins"] or 0}, number + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, *, ranks: str | None = None, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Per piece of every document: row, doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, vocabulary, ranks=ranks, capacity=capacity, end_id=end_id, with_ids=False)
    pieces = settle(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces.select("row", "length"), capacity), "row")


def sequences(docs: DataFrame, vocabulary: str, **how) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, at most `capacity` ids in each."""
    capacity, end_id = how.get("capacity", 2048), how.get("end_id", 0)
    pieces = settle(token_pieces(docs, vocabulary, ranks=how.get("ranks"), capacity=capacity, end_id=end_id)
                    .withColumn("row", F.monotonically_increasing_id()), "pieces")
    placed = pieces.join(pack(pieces.select("row", "length"), capacity), "row")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
