"""Merkle trees over ordered ids: leaf prefix 00, node prefix 01, an odd last node moves up unchanged.

That level-wise form equals the recursive split at the largest power of two. A tree is built from
blocks of 2^10 neighbours: one shuffle per ten levels, at most 1024 hashes per group, and all
hashing inside array expressions, so a window of any size never meets in one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H

BITS = 10


def leaf(id_hex: Column, algorithm: str = "sha256") -> Column:
    """Hash of a leaf from its `0x` hex id; hex without prefix."""
    return H.hash_hex(F.unhex(F.concat(F.lit("00"), F.substr(id_hex, F.lit(3)))), algorithm)


def node(left: Column, right: Column) -> Column:
    return H.sha256_hex(F.unhex(F.concat(F.lit("01"), left, right)))


EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _next_level(level: str) -> str:
    """Pair neighbours; an odd last hash moves up. The level is bound once, so nested levels stay small."""
    return (f"get(transform(array({level}), row -> transform(sequence(0, CAST(floor((size(row) - 1) / 2) AS INT)),"
            " i -> IF(i * 2 + 1 < size(row), sha2(unhex(concat('01', get(row, i * 2), get(row, i * 2 + 1))), 256),"
            " get(row, i * 2)))), 0)")


def _blake_levels(leaves):
    import hashlib
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([hashlib.blake2b(b"\x01" + bytes.fromhex(row[i] + row[i + 1]), digest_size=32).hexdigest()
                       if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    return levels


def _levels(df: DataFrame, algorithm: str) -> DataFrame:
    """Add `l0` … `l10`: the levels of each block, as far as BITS."""
    if algorithm == "blake2b":
        from pyspark.sql import types as T

        @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
        def build(blocks):
            return blocks.map(lambda b: (lambda ls: ls + [ls[-1]] * (BITS + 1 - len(ls)))(_blake_levels(b)))

        df = df.withColumn("_all", build(F.col("l0")))
        return df.select(*[c for c in df.columns if c not in ("_all", "l0")],
                         *[F.get("_all", i).alias(f"l{i}") for i in range(BITS + 1)])
    return df.selectExpr("*", *[f"{_next_level(f'l{i}')} AS l{i + 1}" for i in range(BITS)])


def _tops(df: DataFrame, keys: Sequence[str], algorithm: str) -> DataFrame:
    """The top hash of each block, as the next round's leaf."""
    if algorithm == "sha256":
        top = "l0"
        for _ in range(BITS):
            top = _next_level(top)
        return df.select(*keys, F.col("_block").alias("_pos"), F.expr(f"get({top}, 0)").alias("_h"))
    return _levels(df, algorithm).select(*keys, F.col("_block").alias("_pos"), F.get(f"l{BITS}", F.lit(0)).alias("_h"))


def _blocks(leaves: DataFrame, keys: Sequence[str], position: str, hash_col: str) -> DataFrame:
    """Blocks of neighbours with their hashes as `l0`; hashes are shuffled as bytes, half as long as hex."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.unhex(hash_col).alias("h"))))
    return (leaves.withColumn("_block", F.shiftright(F.col(position), BITS)).groupBy(*keys, "_block")
            .agg(pairs.alias("_p")).select(*keys, "_block", F.transform("_p", lambda x: F.lower(F.hex(x["h"]))).alias("l0")))


def _row_blocks(leaves: DataFrame, keys: Sequence[str], position: str, id_col: str, algorithm: str) -> DataFrame:
    """Blocks of neighbours with their hashes as `l0` and, in the same order, their rows as `_rows`."""
    inside = algorithm == "sha256"  # made where the block is; a Python function cannot be called for the items of an array
    row = F.struct(*[c for c in leaves.columns if c not in keys])
    item = F.struct(F.col(position).cast("bigint").alias("p"), (F.lit(None).cast("string") if inside else leaf(F.col(id_col), algorithm)).alias("h"), row.alias("row"))
    found = leaves.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, position]))
    met = found.withColumn("_block", F.shiftright(F.col(position).cast("bigint"), BITS)).groupBy(*keys, "_block").agg(F.collect_list(item).alias("_met"))
    order = F.array_sort(F.transform("_met", lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"))))  # rows need not be orderable
    met = met.select(*keys, "_block", "_met", order.alias("_order")).select(*keys, "_block", F.transform("_order", lambda o: F.get("_met", o["i"])).alias("_met"))
    return met.select(*keys, "_block", F.transform("_met", lambda x: x["row"]).alias("_rows"),
                      F.transform("_met", lambda x: leaf(x["row"][id_col]) if inside else x["h"]).alias("l0"))


def _rounds(leaves: DataFrame, position: str) -> int:
    """Rounds of BITS levels that the largest window needs, from its last position."""
    last = leaves.agg(F.max(F.col(position).cast("bigint"))).first()[0] or 0
    n = 1
    while last >> (BITS * n):
        n += 1
    return n


def roots(leaves: DataFrame, keys: Sequence[str], position: str, id_col: str, *, algorithm: str = "sha256") -> DataFrame:
    """Root and leaf count per window of any size. Positions of a window are 0, 1, 2, … without holes."""
    keys = list(keys)
    level = leaves.select(*keys, F.col(position).cast("bigint").alias("_pos"), leaf(F.col(id_col), algorithm).alias("_h"))
    counts = leaves.groupBy(*keys).agg(F.count(F.lit(1)).alias("leaves"))
    for _ in range(_rounds(leaves, position)):
        level = _tops(_blocks(level, keys, "_pos", "_h"), keys, algorithm)
    return level.filter("_pos = 0").select(*keys, F.concat(F.lit("0x"), "_h").alias("root")).join(counts, keys)


def paths(leaves: DataFrame, keys: Sequence[str], position: str, id_col: str, *, algorithm: str = "sha256", windows: DataFrame | None = None,
          sizes: DataFrame | None = None) -> DataFrame:
    """Per leaf its audit path: array of (side, hash) from the leaf up, and the root.

    Rows go along with their block, whose levels hold the lower part of their paths. What is above a block (the path of the block
    among the blocks, the root, and the columns of `windows` for windows that it has) comes in one row a block, dealt as the blocks are:
    so each row is shuffled once, without a path. Positions of a window are 0, 1, 2, … without holes; the last is looked up in `sizes`, if given."""
    keys = list(keys)
    more = [] if windows is None else [c for c in windows.columns if c not in keys]
    tiers = [_row_blocks(leaves, keys, position, id_col, algorithm)]
    for _ in range(_rounds(leaves if sizes is None else sizes, position) - 1):
        tiers.append(_blocks(_tops(tiers[-1].drop("_rows"), keys, algorithm), keys, "_pos", "_h"))
    # of the last tier every window has one block, number 0; not a literal, which Spark would take out of the join's keys
    above = None if windows is None else windows.withColumn("_block", F.xxhash64(*keys).bitwiseAND(0))
    steps = ", ".join(
        f"IF((shiftright(i, {k}) ^ 1) < size(l{k}), named_struct('side', IF(shiftright(i, {k}) % 2 = 0, 'R', 'L'),"
        f" 'hash', get(l{k}, shiftright(i, {k}) ^ 1)), NULL)" for k in range(BITS))
    for tier in reversed(tiers):
        last, rows = tier is tiers[-1], tier is tiers[0]
        blocks = tier if above is None else tier.join(above.hint("shuffle_hash"), [*keys, "_block"])
        path = f"array_compact(array({steps}))" if last else f"concat(array_compact(array({steps})), _up)"
        row = ", 'row', get(_rows, i)" if rows else ""
        each = F.expr(f"explode(transform(sequence(0, size(l0) - 1), i -> named_struct('i', i, 'path', {path}{row})))")
        root = F.concat(F.lit("0x"), F.get(f"l{BITS}", F.lit(0))).alias("root") if last else F.col("root")
        out = _levels(blocks, algorithm).select(*keys, "_block", root, *more, each.alias("_e"))
        if not rows:
            above = out.select(*keys, (F.shiftleft(F.col("_block"), BITS) + F.col("_e.i")).alias("_block"), F.col("_e.path").alias("_up"), "root", *more)
    own = [F.col(c) if c in keys else F.col("_e.row")[c].alias(c) for c in leaves.columns]
    return out.select(*own, F.col("_e.path").alias("path"), "root", *more)


def verify(id_hex: Column, path: Column, root: Column) -> Column:
    """Whether a path leads from an id to the root."""
    sane = F.forall(path, lambda s: s["side"].isin("L", "R") & s["hash"].rlike("^[0-9a-f]{64}$"))
    end = F.aggregate(path, leaf(id_hex), lambda h, s: F.when(s["side"] == "L", node(s["hash"], h)).otherwise(node(h, s["hash"])))
    return F.coalesce(sane & id_hex.rlike("^0x[0-9a-f]{64}$") & (F.concat(F.lit("0x"), end) == root), F.lit(False))


def cone_ids(blocks: DataFrame, key: str = "ms_index", position: str = "wf_index", id_col: str = "block_id") -> DataFrame:
    """Ordered ids per milestone, in slices of 2^16 positions so a huge cone stays several rows."""
    part = F.shiftright(F.col(position), 16)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(id_col).alias("id"))))
    return (blocks.groupBy(key, part.alias("slice")).agg(pairs.alias("_p"))
            .select(key, "slice", F.transform("_p", lambda x: x["id"]).alias("ids")))
