"""Row-level operators that need a second table or more than one output row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocabulary as V
from ..session import settle

PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_]*$"


def _same(e: Column, a: Column) -> Column:
    """Equal values, numbers by value: 1e2 is 100."""
    number = lambda v: F.when(C.json_type(v).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$", "double"))
    return F.coalesce(number(e) == number(a), F.to_json(e).eqNullSafe(F.to_json(a)))


def _children(e: Column, a: Column) -> Column:
    """The steps below two containers of one kind; null if they are none."""
    em, am = (C.at(x, "$", "map<string,variant>") for x in (e, a))
    ea, aa = (C.at(x, "$", "array<variant>") for x in (e, a))
    of_keys = F.transform(F.array_union(F.map_keys(em), F.map_keys(am)), lambda k: F.struct(
        F.when(k.rlike(PLAIN_KEY), F.concat(F.lit("."), k)).otherwise(F.concat(F.lit('["'), k, F.lit('"]'))).alias("step"),
        em[k].alias("e"), am[k].alias("a"), F.map_contains_key(em, k).alias("has_e"), F.map_contains_key(am, k).alias("has_a")))
    longest = F.greatest(F.size(ea), F.size(aa))
    of_items = F.transform(F.when(longest > 0, F.sequence(F.lit(0), longest - 1)), lambda i: F.struct(
        F.concat(F.lit("["), i.cast("string"), F.lit("]")).alias("step"), F.get(ea, i).alias("e"),
        F.get(aa, i).alias("a"), (i < F.size(ea)).alias("has_e"), (i < F.size(aa)).alias("has_a")))
    both = F.col("has_e") & F.col("has_a")
    return F.when(both & C.is_object(e) & C.is_object(a), of_keys).when(both & C.is_array(e) & C.is_array(a), of_items)


def json_diff(pairs: DataFrame, ids: Sequence[str], expected: str, actual: str) -> DataFrame:
    """Key-level differences of two JSON documents per row: path, kind, expected, actual.

    Each round replaces the pairs of differing containers by their children, until only single values are left, however deep
    they lie. Every change is a row of its own; a reader that shows a page of them limits its own page."""
    e, a = F.col("e"), F.col("a")
    rows = (pairs.select(*ids, F.lit("$").alias("path"), C.parsed(F.col(expected)).alias("e"), C.parsed(F.col(actual)).alias("a"),
                         F.lit(True).alias("has_e"), F.lit(True).alias("has_a"))
            .filter(F.col("e").isNotNull() & F.col("a").isNotNull()))
    kind = F.when(~F.col("has_a"), "removed").when(~F.col("has_e"), "added").otherwise("changed")
    differs = ~(F.col("has_e") & F.col("has_a")) | ~_same(e, a)
    found = []
    while True:
        rows = settle(rows.filter(differs).withColumn("below", _children(e, a)).select(
            *ids, "path", "has_e", "has_a", F.to_json("e").alias("expected"), F.to_json("a").alias("actual"),
            F.transform("below", lambda c: F.struct(c["step"].alias("step"), F.to_json(c["e"]).alias("e"), F.to_json(c["a"]).alias("a"),
                                                    c["has_e"].alias("has_e"), c["has_a"].alias("has_a"))).alias("below")), "json-diff")
        found.append(rows.filter("below IS NULL").select(*ids, "path", kind.alias("kind"), "expected", "actual"))
        inner = rows.filter("below IS NOT NULL")
        if inner.isEmpty():
            break
        rows = inner.select(*ids, "path", F.explode("below").alias("c")).select(
            *ids, F.concat("path", "c.step").alias("path"), C.parsed(F.col("c.e")).alias("e"), C.parsed(F.col("c.a")).alias("a"), "c.has_e", "c.has_a")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_writer_rule(messages: DataFrame, policy: DataFrame, default_allowed: Sequence[str] = ()) -> DataFrame:
    """Add `may_write` and `signature_required` from the policy's rule for the tag, else the default.

    A policy lists a few tags, of which one may be in a third of the messages: it is broadcast, as Spark cannot tell the size of a table that was
    made on the driver and would deal all messages by tag."""
    rules = policy.select(F.col("tag"), F.col("allowed").alias("_allowed"),
                          C.signature_required(F.col("require_signature"), F.col("legacy_grace")).alias("_required"))
    default = F.array(*[F.lit(x) for x in default_allowed]).cast("array<string>")
    return (messages.join(F.broadcast(rules), "tag", "left")
            .withColumn("may_write", C.may_write(F.coalesce("_allowed", default), F.col("iss")))
            .withColumn("signature_required", F.coalesce("_required", F.lit(False)))
            .drop("_allowed", "_required"))


def flag(df: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """Add whether `key` is among `ids` (a one-column table, duplicates allowed)."""
    present = ids.select(F.col(ids.columns[0]).alias(key)).filter(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    return df.join(present, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def with_trust(messages: DataFrame, policy: DataFrame, alerts: DataFrame | None, submissions: DataFrame) -> DataFrame:
    """Add `trust`: proven, relayed or untrusted. Without `alerts` the messages say themselves which are `distrusted`."""
    df = with_writer_rule(messages, policy)
    if alerts is not None:
        df = flag(df, "block_id", alerts.filter(F.col("rule").isin(*V.DISTRUST_RULES)).select("block_id"), "distrusted")
    df = flag(df, "block_id", submissions.select("block_id"), "submitted")
    verdict = F.col("verdict")
    trust = (F.when(~F.coalesce(verdict.isin(*V.PROVEN_VERDICTS, V.UNSIGNED), F.lit(False)), "untrusted")
             .when((verdict == V.UNSIGNED) & F.col("signature_required"), "untrusted")
             .when((verdict != V.UNSIGNED) & ~F.col("may_write"), "untrusted")
             .when(F.col("distrusted"), "untrusted")
             .when(verdict == "PRODUCER_SIGNED", "proven")
             .when((verdict == "RELAY_ATTESTED") | F.col("submitted"), "relayed").otherwise("untrusted"))
    return df.withColumn("trust", trust)


def feed_rows(*, messages: DataFrame | None = None, milestones: DataFrame | None = None, alerts: DataFrame | None = None,
              anchors: DataFrame | None = None, incidents: DataFrame | None = None) -> DataFrame:
    """One uniform row shape from up to five kinds of events."""
    def row(kind: str, key: Column, at_ms: Column, title: str | None, state: str | None, block: str | None, df: DataFrame):
        text = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
        return df.select(F.lit(kind).alias("kind"), key.alias("key"), at_ms.alias("at_ms"), text(title).alias("title"),
                         text(state).alias("state"), text(block).alias("block_id"))

    parts = []
    if messages is not None:
        parts.append(row("message", F.concat(F.lit("m:"), "block_id"), F.col("ts") * 1000, "tag", "verdict", "block_id", messages))
    if milestones is not None:
        parts.append(row("milestone", F.concat(F.lit("ms:"), "idx"), F.col("ts") * 1000, None, None, None, milestones))
    if alerts is not None:
        parts.append(row("alert", F.concat(F.lit("a:"), "id"), F.col("at_ms"), "rule", "severity", "block_id", alerts))
    if anchors is not None:
        parts.append(row("anchor", F.concat(F.lit("c:"), "seq"), F.col("at_ms"), None, "status", None, anchors))
    if incidents is not None:
        parts.append(row("incident", F.concat(F.lit("i:"), "incident"), F.col("opened_ms"), "title", "status", None, incidents))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distrusted(messages: DataFrame, alerts: DataFrame) -> DataFrame:
    """Add `distrusted`: whether an alert takes the block out of evidence."""
    return flag(messages, "block_id", alerts.filter(F.col("rule").isin(*V.DISTRUST_RULES)).select("block_id"), "distrusted")
