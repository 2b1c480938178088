"""Carrying a table's columns through an operator without clashing with the operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CARRIED = "carried"


def carry(docs: DataFrame, *own: str) -> DataFrame:
    """The columns `own` as they are, and all others of `docs` in one struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*(others or [F.lit(None).cast("string").alias("none")])).alias(CARRIED))


def restore(rows: DataFrame, docs: DataFrame, *own: str, added: tuple[str, ...] = (), changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `docs` in their order, `own` and `added` from `rows`; an added column replaces one of its name.

    `changed` gives columns of `docs` a new value."""
    changed = changed or {}
    kept = [c for c in docs.columns if c not in added]
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) if c in own else F.col(CARRIED).getField(c).alias(c) for c in kept], *added)
