"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased. An index holds

- `counts`: for each key (its SHA-256) the number of documents that hold it, exact;
- `filters`: per shard of the keys a cuckoo filter of those in at least `least` documents.

`insert` and `delete` add and take away whole documents: counts are merged by key, and only keys that cross the threshold touch
their shard's filter, so taking documents out again leads back to the counts before. A filter that is full is built anew from the
exact counts. `clean` asks the filters first; only lines that may be repeated are looked up in the exact counts.

Every row of the input is one document, repeated rows and rows of one doc_id included. A null or empty text is one empty line.
Empty keys are never counted nor dropped. Long texts are whole. Columns beside doc_id and text are carried along unchanged; those
named like a result column are replaced.

At scale: a shard holds at most 2 * KEYS_PER_SHARD keys in its filter, the number of shards follows from an exact count. Lines meet
the filters in (shard, lane) order: each filter is sent to LANES tasks, a line goes to the lane of its document, so a line that
every document has is spread over all lanes. Tasks stream their lines past one filter at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .carry import CARRIED, carry, restore
from .cuckoo import Cuckoo, buckets_for
from .words import slices

KEYS_PER_SHARD = 1 << 18
LEAST_SHARDS = 4
LANES = 64
SPACE = b" \t\n\x0b\x0c\r"

FILTERS = "shard int, buckets int, slots binary"
ADDED = ("n_lines", "n_dropped")


@dataclass(frozen=True)
class LineIndex:
    counts: DataFrame  # digest binary, n bigint
    filters: DataFrame  # shard int, buckets int, slots binary
    least: int
    shards: int


def key_of(line: bytes) -> bytes:
    return line.strip(SPACE).lower()  # bytes: only A-Z change


def lines_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the digests of its distinct keys that are not empty."""
    for batch in batches:
        for part in slices(batch, "text"):
            held = [list(dict.fromkeys(hashlib.sha256(k).digest() for k in map(key_of, lines_of(t)) if k)) for t in part.column("text").to_pylist()]
            others = [part.column(c) for c in part.schema.names if c != "text"]
            names = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(held, pa.list_(pa.binary()))], [*names, "digests"])


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _held(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, size, digests): what a document holds; equal rows have equal marks."""
    of = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.octet_length("text").alias("size"), F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return of.mapInArrow(_digests, f"doc_id {kind}, mark bigint, size int, digests array<binary>")


def _count(held: DataFrame, sign: int) -> DataFrame:
    return held.select(F.explode("digests").alias("digest")).groupBy("digest").agg((sign * F.count(F.lit(1))).alias("n"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    made = Cuckoo.of(pdf.digest.tolist())
    return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "buckets": [made.buckets], "slots": [made.bytes()]})


def _change(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after some digests came and others went; without slots if it has to be built anew."""
    old = pdf[pdf.slots.notna()]
    made = Cuckoo(int(old.buckets.iloc[0]), old.slots.iloc[0]) if len(old) else Cuckoo(buckets_for(len(pdf)))
    made.delete(pdf.digest[pdf.way == -1].tolist())
    fits = made.insert(pdf.digest[pdf.way == 1].tolist())
    return pd.DataFrame({"shard": [int(pdf.shard.iloc[0])], "buckets": [made.buckets if fits else 0], "slots": [made.bytes() if fits else None]})


def _filters(frequent: DataFrame, shards: int) -> DataFrame:
    return frequent.select(_shard(F.col("digest"), shards).alias("shard"), "digest").groupBy("shard").applyInPandas(_build, FILTERS)


def _sized(n: int) -> int:
    shards = LEAST_SHARDS
    while shards * KEYS_PER_SHARD < n:
        shards *= 2
    return shards


def _index(counts: DataFrame, least: int) -> LineIndex:
    frequent = counts.filter(F.col("n") >= least)
    shards = _sized(frequent.count())
    return LineIndex(counts, settle(_filters(frequent, shards), "line-filters"), least, shards)


def build(docs: DataFrame, least: int = 10) -> LineIndex:
    """The index of `docs`: every line of every document counts."""
    return _index(settle(_count(_held(docs), 1), "line-counts"), least)


def _merged(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    delta = _count(_held(docs), sign)
    both = index.counts.withColumn("d", F.lit(0).cast("bigint")).unionByName(delta.select("digest", F.lit(0).cast("bigint").alias("n"), F.col("n").alias("d")))
    sums = settle(both.groupBy("digest").agg(F.sum("n").alias("was"), (F.sum("n") + F.sum("d")).alias("n")), "line-sums")
    counts = sums.filter("n > 0").select("digest", "n")
    least = F.lit(index.least)
    seen = sums.agg(F.min("n").alias("lowest"), F.count_if(F.col("n") >= least).alias("frequent")).first()
    if (seen["lowest"] or 0) < 0:
        raise ValueError("documents are taken out that were never put in")
    if _sized(seen["frequent"]) > 2 * index.shards:  # grown: more shards
        return _index(counts, index.least)
    way = F.when((F.col("was") < least) & (F.col("n") >= least), 1).when((F.col("was") >= least) & (F.col("n") < least), -1)
    crossed = sums.select("digest", way.alias("way")).filter("way IS NOT NULL").withColumn("shard", _shard(F.col("digest"), index.shards))
    touched = index.filters.join(crossed.select("shard").distinct(), "shard", "left_semi")
    rows = touched.withColumns({"digest": F.lit(None).cast("binary"), "way": F.lit(None).cast("int")}).unionByName(
        crossed.withColumns({"buckets": F.lit(None).cast("int"), "slots": F.lit(None).cast("binary")}))
    changed = settle(rows.groupBy("shard").applyInPandas(_change, FILTERS), "line-changes")
    full = changed.filter("slots IS NULL").select("shard")
    frequent = counts.filter(F.col("n") >= least).withColumn("shard", _shard(F.col("digest"), index.shards)).join(full, "shard", "left_semi")
    anew = _filters(frequent.select("digest"), index.shards)
    left = index.filters.join(changed.select("shard"), "shard", "left_anti")
    filters = settle(left.unionByName(changed.filter("slots IS NOT NULL")).unionByName(anew), "line-filters")
    return LineIndex(counts, filters, index.least, index.shards)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the documents `docs` put in."""
    return _merged(index, docs, 1)


def delete(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the documents `docs` taken out again; taking out what was never put in is an error."""
    return _merged(index, docs, -1)


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by lane and shard, the shard's filter first: those whose digest the filter may hold."""
    here, seen = None, None
    for batch in batches:
        both = batch.column("lane").to_numpy().astype(np.int64) << 32 | batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(both)) + 1).tolist(), len(both)] if len(both) else []
        for at, to in zip(cuts, cuts[1:]):
            part = batch.slice(at, to - at)
            if both[at] != here:
                here, seen = both[at], None
            if part.column("slots")[0].is_valid:
                seen = Cuckoo(part.column("buckets")[0].as_py(), part.column("slots")[0].as_py())
                part = part.slice(1)
            if seen is None or not part.num_rows:
                continue
            own = part.select([c for c in part.schema.names if c not in ("shard", "lane", "buckets", "slots")])
            yield own.filter(pa.array(seen.contains(part.column("digest").to_pylist())))


def _repeated(held: DataFrame, index: LineIndex) -> DataFrame:
    """(doc_id, mark, size, digest): the keys of each document that are in `least` documents or more."""
    kind = held.schema["doc_id"].dataType.simpleString()
    spread = F.pmod(F.xxhash64("doc_id", "mark", "size"), F.lit(LANES)).cast("int")
    none = {"buckets": F.lit(None).cast("int"), "slots": F.lit(None).cast("binary")}
    lines = held.select("doc_id", "mark", "size", spread.alias("lane"), F.explode("digests").alias("digest")).withColumns(
        {"shard": _shard(F.col("digest"), index.shards), **none})
    filters = index.filters.withColumn("lane", F.explode(F.array(*map(F.lit, range(LANES))))).withColumns(
        {"doc_id": F.lit(None).cast(kind), "mark": F.lit(None).cast("bigint"), "size": F.lit(None).cast("int"), "digest": F.lit(None).cast("binary")})
    met = lines.unionByName(filters).repartition("shard", "lane").sortWithinPartitions("lane", "shard", F.col("buckets").asc_nulls_last())
    suspects = met.mapInArrow(_suspects, f"doc_id {kind}, mark bigint, size int, digest binary")
    frequent = index.counts.filter(F.col("n") >= index.least).select("digest")
    return suspects.join(frequent, "digest", "left_semi")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            kept, lines, dropped = [], [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist()):
                own, gone = lines_of(text), set(gone or ())
                left = [line for line in own if not ((k := key_of(line)) and hashlib.sha256(k).digest() in gone)] if gone else own
                kept.append(text if len(left) == len(own) else b"\n".join(left))
                lines.append(len(own))
                dropped.append(len(own) - len(left))
            others = [c for c in part.schema.names if c not in ("text", "gone")]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(kept, pa.binary()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                                             [*others, "text", *ADDED])


def clean(docs: DataFrame, index: LineIndex, held: DataFrame | None = None) -> DataFrame:
    """`docs` without the lines whose keys the index counts in `least` documents or more; adds n_lines and n_dropped.

    A null text stays null (one empty line). `held` may hand over what `_held` says of the same documents."""
    held = _held(docs) if held is None else held
    same = ("doc_id", "mark", "size")
    gone = _repeated(held, index).groupBy(*same).agg(F.collect_set("digest").alias("gone")).select(*[F.col(c).alias(f"_{c}") for c in same], "gone")
    rows = carry(docs, "doc_id", "text").withColumns({"mark": F.xxhash64("text"), "size": F.octet_length("text"), "text": F.col("text").cast("binary")})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    found = rows.join(gone, on, "left").select("doc_id", CARRIED, "text", "gone")
    kept = found.mapInArrow(_kept, T.StructType([*found.drop("gone").schema.fields, *[T.StructField(c, T.LongType()) for c in ADDED]]))
    return restore(kept.withColumn("text", F.col("text").cast("string")), docs, "doc_id", "text", added=ADDED)


def dedup_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """`docs` without the lines found in `least` or more of them: an index of them all, and each cleaned by it."""
    held = settle(_held(docs), "line-digests")
    index = _index(settle(_count(held, 1), "line-counts"), least)
    return clean(docs, index, held)
