"""Near-duplicate documents: banded MinHash candidates, verified by odd sketches and then exactly.

1. Each text becomes its set of word shingles (64-bit names). Texts with equal sets are one class.
2. A class has 32 bands of 4 MinHash samples. At Jaccard similarity 0.8 two sets miss each other in
   every band with probability 5e-8. A sketch folds the samples into parity bits ("odd sketch"): the
   bits of two sets differ by the samples that differ, so a population count estimates how similar they are.
3. Within a band bucket every class meets the bucket's smallest one: a bucket of n gives n - 1 pairs.
   Pairs whose sketches agree well enough are confirmed on the full sets; confirmed links form components.
4. Buckets that still hold several components may hide a link that does not touch the smallest class.
   Their members meet in blocks of 1,024, by larger sketches (1,024 samples in 4,096 bits, and the parity bits of the
   whole set, which tell the sizes of differences almost exactly) and only across components; what the sketches let
   pass is confirmed on the full sets again.

No pair inside a finished component is ever looked at, so a large group of near copies costs its size,
not its square. Nothing but checksums and one-row counts reaches the driver.

Defined results: null, empty and blank texts have an empty set and are linked with nothing. A text
shorter than a shingle is one shingle of all its words. Repeated rows each get their result, by their own
text. Rows without doc_id are kept, in no component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .graph import components
from .words import grams, mix, slices, words_of

BANDS, ROWS = 32, 4
SMALL, LARGE = (BANDS * ROWS, 1024), (1024, 4096)  # samples, bits
SET_BITS = 4096
BLOCK = 1024
SIGMAS = 5.5  # how far a sketch may fall short of the threshold by chance


def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * k + 1, dtype=np.uint64))
    return (seed[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[k:] >> np.uint64(32)).astype(np.uint32)


def samples(names: np.ndarray, k: int) -> np.ndarray:
    """k MinHash samples of a non-empty set of 64-bit names."""
    a, b = _family(k)
    short = (names >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 2048):
        out = np.minimum(out, (short[at:at + 2048, None] * a + b).min(axis=0))
    return out


def odd_sketch(sample: np.ndarray, bits: int) -> bytes:
    """Fold (position, sample) pairs into bits, flipping one for each."""
    k = len(sample)
    at = mix(sample.astype(np.uint64) + (np.arange(1, k + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def most_flips(similarity: float, shape: tuple[int, int]) -> int:
    """The greatest count of differing bits that a pair of this similarity shows, but for chance beyond SIGMAS."""
    k, bits = shape
    low = max(0.0, similarity - SIGMAS * (similarity * (1 - similarity) / k) ** 0.5)
    differing = 2 * k * (1 - low)
    expected = bits / 2 * (1 - np.exp(-2 * differing / bits))
    return int(expected + SIGMAS * (expected * (1 - expected / bits)) ** 0.5) + 1


def most_flips_of_sets(total: np.ndarray, similarity: float) -> np.ndarray:
    """The same for parity bits of whole sets, by the sum of the two sizes: at this similarity the sets differ
    in at most total * (1 - similarity) / (1 + similarity) names, each flipping one of SET_BITS bits."""
    differing, n = total * (1 - similarity) / (1 + similarity), float(SET_BITS)
    a, b = (1 - 2 / n) ** differing, (1 - 4 / n) ** differing
    spread = np.sqrt(np.maximum(n * (1 - a * a) + n * (n - 1) * (b - a * a), 0)) / 2
    return n * (1 - a) / 2 + SIGMAS * spread + 1


def miss_chance(similarity: float) -> float:
    """Chance that two sets of this similarity share no band."""
    return (1 - similarity ** ROWS) ** BANDS


def signatures(docs: DataFrame, shingle: int = 4, lower: bool = True) -> DataFrame:
    """Per row: doc_id, n_shingles, d0 and d1 (the set's digest), bands, sketch. Empty sets: null bands and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        row_factor = mix(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            for part in slices(batch, "text"):
                names, first = grams(words_of(part.column("text"), lower), shingle)
                size, d0, d1, bands, sketch = [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.unique(names[first[i]:first[i + 1]])
                    size.append(len(own))
                    d0.append(mix(own).sum(dtype=np.uint64))
                    d1.append(mix(own + np.uint64(0x51ED270B)).sum(dtype=np.uint64))
                    if not len(own):
                        bands.append(None)
                        sketch.append(None)
                        continue
                    s = samples(own, SMALL[0])
                    key = mix((s.astype(np.uint64).reshape(BANDS, ROWS) * row_factor).sum(axis=1, dtype=np.uint64) + band_salt)
                    bands.append(key.astype(np.int64))
                    sketch.append(odd_sketch(s, SMALL[1]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size, pa.int64()), pa.array(np.array(d0, np.uint64).view(np.int64)),
                     pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                    ["doc_id", "n_shingles", "d0", "d1", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_shingles bigint, d0 bigint, d1 bigint, bands array<bigint>, sketch binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, lower: bool) -> DataFrame:
    """(node, names, size, wide): the sorted 64-bit names of each wanted document's shingles, and its large sketches."""

    def wide(own: np.ndarray) -> bytes | None:
        if not len(own):
            return None
        flips = np.bincount((mix(own) % np.uint64(SET_BITS)).astype(np.int64), minlength=SET_BITS).astype(np.uint8) & 1
        return odd_sketch(samples(own, LARGE[0]), LARGE[1]) + np.packbits(flips).tobytes()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                names, first = grams(words_of(part.column("text"), lower), shingle)
                own = [np.unique(names[first[i]:first[i + 1]]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([s.tobytes() for s in own], pa.binary()), pa.array([len(s) for s in own], pa.int64()),
                     pa.array([wide(s) for s in own], pa.binary())],
                    ["node", "names", "size", "wide"])

    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return some.mapInArrow(run, "node bigint, names binary, size bigint, wide binary").filter("size > 0")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets."""

    def run(batches):
        for batch in batches:
            keep = []
            left, right = batch.column("left"), batch.column("right")
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("names").alias("left"), F.col("size").alias("n_left"))
    two = sets.select(F.col("node").alias("b"), F.col("names").alias("right"), F.col("size").alias("n_right"))
    # a set cannot reach the threshold with one that is too small or too large
    sized = (pairs.join(one, "a").join(two, "b")
             .filter(F.least("n_left", "n_right") * 100 >= F.greatest("n_left", "n_right") * percent))
    return sized.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint").distinct()


def _flips(x: str, y: str):
    """Population count of the difference of two sketches stored as arrays of 64-bit numbers."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components inside the buckets of `members` (key, node, bands, component)."""
    limit, words = most_flips(percent / 100, LARGE), LARGE[1] // 64

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        mine, one, two = (k.as_py() for k in key)
        block = table["block"].to_numpy()
        node, group = table["node"].to_numpy(), table["component"].to_numpy()
        bands = np.array(table["bands"].to_pylist(), np.int64).reshape(len(node), BANDS)
        wide = np.stack([np.frombuffer(x.as_buffer(), np.uint64) for x in table["wide"]])
        size = table["size"].to_numpy()
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        out_a, out_b = [], []
        for i in left:
            other = right[(group[right] != group[i]) & ((node[right] > node[i]) if one == two else True)]
            if not len(other):
                continue
            flips = np.bitwise_count(wide[other] ^ wide[i])
            other = other[(flips[:, :words].sum(axis=1) <= limit)
                          & (flips[:, words:].sum(axis=1) <= most_flips_of_sets(size[other] + size[i], percent / 100))]
            agree = bands[other] == bands[i]  # a pair is judged in the first bucket it shares
            other = other[bands[other, agree.argmax(axis=1)] == mine] if len(other) else other
            out_a.append(np.full(len(other), node[i]))
            out_b.append(node[other])
        a = np.concatenate([np.zeros(0, np.int64), *out_a])
        b = np.concatenate([np.zeros(0, np.int64), *out_b])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    mixed = (members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rows = (members.join(mixed, "key").join(sets.select("node", "wide", "size"), "node")
            .withColumn("block", F.expr("CAST(pmod(xxhash64(node), blocks) AS INT)"))
            .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
            .select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "component", "bands", "wide", "size"))
    return rows.groupBy("key", "one", "two").applyInArrow(meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links of at least `percent` Jaccard similarity."""
    sig = settle(signatures(docs, shingle, lower), "signatures")
    named = sig.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = settle(named.groupBy("d0", "d1").agg(F.min("doc_id").alias("node")), "classes")
    nodes = settle(named.join(classes.select("node", "d0", "d1"), ["d0", "d1"]).filter("doc_id = node").select("node", "bands", "sketch")
                   .dropDuplicates(["node", "bands"]), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = settle(keys.join(crowded, "key"), "members")

    packed = nodes.select("node", F.expr(f"transform(sequence(0, {SMALL[1] // 64 - 1}), "
                                         "i -> CAST(conv(hex(substring(sketch, i * 8 + 1, 8)), 16, -10) AS BIGINT))").alias("bits"))
    pairs = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    likely = (pairs.join(packed.select(F.col("node").alias("a"), F.col("bits").alias("x")), "a")
              .join(packed.select(F.col("node").alias("b"), F.col("bits").alias("y")), "b")
              .filter(_flips("x", "y") <= most_flips(percent / 100, SMALL)).select("a", "b").distinct())
    sets = settle(shingle_sets(docs, members.select("node").distinct(), shingle, lower), "sets")
    links = settle(confirm(likely, sets, percent), "links")
    first = components(links, "a", "b")

    placed = (members.select("key", "node").join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
              .join(nodes.select("node", "bands"), "node"))
    more = confirm(_across(settle(placed, "placed"), sets, percent), sets, percent)
    # the few links found late join whole components
    late = (more.join(first.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(first.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    joined = components(late, "a", "b", "least").withColumnRenamed("node", "component")
    of_class = (classes.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
                .join(joined, "component", "left").select("d0", "d1", F.coalesce("least", "component").alias("component_id")))
    return (sig.select("doc_id", "n_shingles", "d0", "d1").join(of_class, ["d0", "d1"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component_id"))
            .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
