"""Idempotent loads: insert once, upsert, null-safe dedupe, and the alert sink.

Each function returns what to append (or the new table); nothing is decided on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def first_by(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row per key, by aggregation (combined before the shuffle); rows without key stay."""
    whole = F.struct(*df.columns)
    picked = (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(whole, F.struct(*order)).alias("_f")).select("_f.*"))
    return picked.unionByName(df.filter(F.col(key).isNull()))


def insert_submissions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New submissions to append: the first record wins on `sub_id`, then on `block_id`, over both transports."""
    order = ("received_at_ms", "sub_id", "source")
    fresh = first_by(new, "sub_id", *order).join(stored.select("sub_id"), "sub_id", "left_anti")
    fresh = first_by(fresh.select(*new.columns), "block_id", *order)
    known = stored.filter("block_id IS NOT NULL").select("block_id")
    return fresh.join(known, "block_id", "left_anti").select(*new.columns)


def append_new(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet, once each."""
    return new.dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti")


def upsert_messages(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The message table after an upsert, with `outcome`: inserted, confirmed, or null for unchanged rows.

    An unconfirmed row is completed by its confirmed copy; anything else leaves the stored row alone."""
    cols = stored.columns
    a, b = stored.alias("a"), new.alias("b")
    df = a.join(b, F.col("a.block_id") == F.col("b.block_id"), "full_outer")
    fresh = F.col("a.block_id").isNull()
    completes = F.col("a.ms_index").isNull() & F.col("b.ms_index").isNotNull() & ~fresh
    taken = {"ms_index", "wf_index"}
    kept_unless_null = {"verdict", "iat", "nonce", "confirmed_at_ms"}
    out = []
    for c in cols:
        old, got = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in taken:
            merged = got
        elif c in kept_unless_null:
            merged = F.coalesce(got, old)
        elif c == "ts":
            merged = F.when(got > 0, got).otherwise(old)
        else:
            merged = old
        out.append(F.when(fresh, got).when(completes, merged).otherwise(old).alias(c))
    outcome = F.when(fresh, "inserted").when(completes, "confirmed")
    return df.select(*out, outcome.alias("outcome"))


def blind_rows(messages: DataFrame, tokens: str) -> DataFrame:
    return messages.select("block_id", F.explode(tokens).alias("token")).distinct()


ALERT_KEY = ("rule", "block_id", "ie_id", "dedupe_key")


def insert_alerts(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New alerts to append: one per (rule, block, element, dedupe key), nulls being equal."""
    once = new.dropDuplicates(list(ALERT_KEY))
    same = reduce(lambda x, y: x & y, [once[k].eqNullSafe(stored[k]) for k in ALERT_KEY])
    return once.join(stored, same, "left_anti")


def upsert_anchors(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert unknown seqs; for known ones set the status and keep tx and record unless given."""
    a, b = stored.alias("a"), updates.alias("b")
    df = a.join(b, F.col("a.seq") == F.col("b.seq"), "full_outer")
    keep_first = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    take_new = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    return df.select(*[take_new(c) if c in ("status", "tx", "record") else keep_first(c) for c in stored.columns])


def route(changes: DataFrame, prefix: str) -> DataFrame:
    """One compact JSON per incident change and its topic; an unknown severity goes to `unknown`."""
    severity = F.when(F.col("severity").isin(*V.SEVERITY_RANK), F.col("severity")).otherwise("unknown")
    return changes.select(F.concat(F.lit(prefix + "/"), severity).alias("topic"), F.to_json(F.struct(*changes.columns)).alias("payload"))


def write_routed(changes: DataFrame, prefix: str, path: str) -> None:
    route(changes, prefix).write.mode("append").partitionBy("topic").json(path)


def tail(events: DataFrame, after_id: int, event_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Events after an id, of one type if given; `limit` is the reader's page size."""
    df = events.filter(F.col("id") > after_id)
    df = df if event_type is None else df.filter(F.col("type") == event_type)
    return df if limit is None else df.orderBy("id").limit(limit)
