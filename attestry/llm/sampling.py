"""Bounded samples for fitting models, drawn by a hash so that every run and every size draws them alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 1 << 40


def share_of(key: str, most: int, of: int) -> Column:
    """Whether a row belongs to a sample of about `most` of `of` rows; all of them if there are no more.

    A filter where the rows are: no task and no driver sees more of them than the sample."""
    if of <= most:
        return F.lit(True)
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(_RANGE)) < int(_RANGE * most / of), F.lit(False))
