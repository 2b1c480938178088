"""Merkle manifest of a dataset: checkpoints every few levels, everything between recomputed when a proof is asked for.

Each row is a leaf: H (lowercase hex SHA-256) over its fields, each `-` if null, else its UTF-8 byte count, `:` and the value.
The leaves of a source ascend by doc_id (null first, ties by leaf) and are joined 16 at a time, the last run being shorter, until
one node is left: the source's subroot (a lone leaf is its own). The subroots, by source (null first, bytewise), make the root.

Of a tree only every `span`-th level is kept as a table; the levels between are never written. A proof needs them for one aligned
subtree at a time (16 ** span nodes of a kept level): the task that holds those nodes joins them up again, emits each node's
siblings, and forgets them. The path above a subtree is handed down with its root, once per subtree, never once per leaf.

Rows that are alike are leaves of their own, in any number. An empty table gives no rows. Null and empty texts differ (`-`, `0:`).
Only the five fields are read; other columns, whatever their names, play no part.

At scale: positions come from a range-sorted table and one count per (source, file), so no source is ordered in one task. A task
holds at most 16 ** span nodes. The number of rounds is the depth of the deepest tree divided by span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

ARITY_BITS = 4
ARITY = 1 << ARITY_BITS
SPAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Manifest:
    """Kept levels of the trees of all sources, bottom first, and of the tree over their subroots.

    Tables of (tree, pos, total, digest): a node's place in its level and how many nodes the level has."""

    levels: list[DataFrame]
    upper: list[DataFrame]
    span: int


def leaf(*values: Column) -> Column:
    """H over the fields of a row."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def _tree(source: Column) -> Column:
    """A source's name that sorts null first and is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Add `pos`, a row's place in its tree, and `total`, how many rows that has: a written range sort, then counts per file."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows take part with their place in the scan, so that a large group of them is no single task's
    rows = rows.withColumn("_scan", F.monotonically_increasing_id())
    placed = rows.repartitionByRange(parts, F.col("tree"), *order, F.col("_scan")).sortWithinPartitions(F.col("tree"), *order, F.col("_scan"))
    placed = settle(placed.drop("_scan").withColumn("_at", F.monotonically_increasing_id()), "manifest-order")
    placed = placed.withColumn("_file", F.shiftright("_at", 33))
    counts = placed.groupBy("tree", "_file").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("tree")
    before = F.sum("_n").over(own.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "_file", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("total"))
    return placed.join(counts, ["tree", "_file"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_file", "_shift")


def _h(text: bytes) -> bytes:
    return hashlib.sha256(text).hexdigest().encode()


def _interior(digests: list[bytes], total: int, span: int) -> list[list[bytes]]:
    """The levels of an aligned subtree from its lowest nodes (hex) up: `span` of them, or to the root if it is the whole tree."""
    levels = [digests]
    whole = total <= ARITY**span
    while len(levels) <= span and not (whole and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([_h(b"".join(below[i:i + ARITY])) for i in range(0, len(below), ARITY)])
    return levels


def _hex(column: pd.Series) -> list[bytes]:
    return [bytes(d).hex().encode() for d in column]


def _climb(span: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def climb(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        total = int(pdf.total.iloc[0])
        top = _interior(_hex(pdf.digest), total, span)[-1][0]
        return pd.DataFrame({"tree": [pdf.tree.iloc[0]], "pos": [int(pdf.pos.iloc[0]) >> ARITY_BITS * span], "total": [-(-total // ARITY**span)],
                             "digest": [bytes.fromhex(top.decode())]})

    return climb


def _subtree(span: int) -> Column:
    return F.shiftright("pos", ARITY_BITS * span).alias("subtree")


def _grow(nodes: DataFrame, span: int) -> list[DataFrame]:
    """All kept levels above `nodes`, which is the first of them."""
    levels = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        below = levels[-1].select("tree", "pos", "total", "digest").groupBy("tree", _subtree(span))
        levels.append(settle(below.applyInPandas(_climb(span), "tree string, pos bigint, total bigint, digest binary"), "manifest-level"))
        most = -(-most // ARITY**span)
    return levels


def build(docs: DataFrame, altered: Column | None = None, span: int = SPAN) -> Manifest:
    """The manifest of `docs`. `altered` is a text that may have replaced a row's own since; `audit` holds its leaf against the tree."""
    altered = F.col("text") if altered is None else altered
    same = altered.eqNullSafe(F.col("text"))
    fields = [F.col(c) for c in FIELDS]
    rows = docs.select(*FIELDS, same.alias("_same"), altered.alias("_altered"))
    rows = rows.select("doc_id", _tree(F.col("source")).alias("tree"), F.unhex(leaf(*fields)).alias("digest"),
                       F.when(~F.col("_same"), F.unhex(leaf(*fields[:-1], F.col("_altered")))).alias("altered"))
    leaves = _numbered(settle(rows, "manifest-leaves"), F.col("doc_id").asc_nulls_first(), F.col("digest"))
    levels = _grow(settle(leaves, "manifest-level"), span)
    roots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    return Manifest(levels, _grow(settle(_numbered(roots, F.col("of")), "manifest-level"), span), span)


# -- proofs: down from the root, one aligned subtree at a time -----------------------------

#: What comes down to a subtree: the siblings above it as (hex before, hex after) per level, and the nodes it hangs under.
ABOVE = "tree string, pos bigint, ahead array<binary>, behind array<binary>, subroot string, root string"


def _runs(levels: list[list[bytes]]) -> list[list[tuple[bytes, bytes]]]:
    """Per level and node what stands before and after it in its run, as hex text."""
    out = []
    for level in levels[:-1]:
        sides = []
        for start in range(0, len(level), ARITY):
            run = level[start:start + ARITY]
            sides += [(b"".join(run[:i]), b"".join(run[i + 1:])) for i in range(len(run))]
        out.append(sides)
    return out


def _paths(nodes: pd.DataFrame, above: pd.DataFrame, span: int):
    """Per node of one subtree, in order: its row and the siblings of every level up to the root."""
    nodes = nodes.sort_values("pos")
    sides = _runs(_interior(_hex(nodes.digest), int(nodes.total.iloc[0]), span))
    up = above.iloc[0]
    higher = [(bytes(a), bytes(b)) for a, b in zip(up.ahead, up.behind)]
    for i, row in enumerate(nodes.itertuples(index=False)):
        yield row, [level[i >> ARITY_BITS * k] for k, level in enumerate(sides)] + higher, up


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a node (hex) and its siblings lead to."""
    for ahead, behind in path:
        digest = _h(ahead + digest + behind)
    return digest


def _hand_down(nodes: pd.DataFrame, above: pd.DataFrame, span: int) -> pd.DataFrame:
    made = [(row.tree, row.pos, [a for a, _ in path], [b for _, b in path], up.subroot, up.root) for row, path, up in _paths(nodes, above, span)]
    return pd.DataFrame(made, columns=["tree", "pos", "ahead", "behind", "subroot", "root"])


def _audited(nodes: pd.DataFrame, above: pd.DataFrame, span: int) -> pd.DataFrame:
    made = []
    for row, path, up in _paths(nodes, above, span):
        proof = hashlib.sha256(b"".join(side for sides in path for side in sides)).hexdigest()
        own = bytes(row.digest).hex()
        folded = fold((own if row.altered is None else bytes(row.altered).hex()).encode(), path).decode()
        made.append((row.doc_id, own, up.subroot, up.root, proof, folded, folded == up.root))
    return pd.DataFrame(made, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _proven(nodes: pd.DataFrame, above: pd.DataFrame, span: int) -> pd.DataFrame:
    made = [(row.doc_id, bytes(row.digest).hex(), [{"ahead": a.decode(), "behind": b.decode()} for a, b in path], up.root) for row, path, up in _paths(nodes, above, span)]
    return pd.DataFrame(made, columns=["doc_id", "leaf", "path", "root"])


def _below(nodes: DataFrame, above: DataFrame, span: int, emit: Callable, schema: str) -> DataFrame:
    """Meet each subtree of a kept level with what comes down to its root."""
    roots = above.groupBy("tree", F.col("pos").alias("subtree"))

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return emit(left, right, span)

    return nodes.groupBy("tree", _subtree(span)).cogroup(roots).applyInPandas(both, schema)


def _descend(manifest: Manifest) -> DataFrame:
    """What comes down to the subtrees of the leaves."""
    top = manifest.upper[-1].select("tree", "pos", F.lower(F.hex("digest")).alias("root"))
    none = F.array().cast("array<binary>")
    above = top.select("tree", "pos", none.alias("ahead"), none.alias("behind"), F.lit(None).cast("string").alias("subroot"), "root")
    for nodes in reversed(manifest.upper[:-1]):
        above = _below(nodes.select("tree", "pos", "total", "digest"), above, manifest.span, _hand_down, ABOVE)
    named = manifest.upper[0].select("tree", "pos", "of", F.lower(F.hex("digest")).alias("_own"))
    above = above.drop("subroot").join(named, ["tree", "pos"]).select(
        F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "ahead", "behind", F.col("_own").alias("subroot"), "root")
    for nodes in reversed(manifest.levels[1:-1]):
        above = _below(nodes, above, manifest.span, _hand_down, ABOVE)
    return settle(above, "manifest-paths") if len(manifest.levels) > 1 else above


def _all(manifest: Manifest, emit: Callable, schema: str) -> DataFrame:
    leaves = manifest.levels[0]
    kind = leaves.schema["doc_id"].dataType.simpleString()
    return _below(leaves.select("tree", "pos", "total", "doc_id", "digest", "altered"), _descend(manifest), manifest.span, emit, f"doc_id {kind}, {schema}")


def audit(manifest: Manifest) -> DataFrame:
    """Per leaf its proof's hash, and whether the row as it is now (altered or not) still leads to the root."""
    return _all(manifest, _audited, "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf its whole proof: the siblings of each level, as hex text before and after the node."""
    return _all(manifest, _proven, "leaf string, path array<struct<ahead: string, behind: string>>, root string")
