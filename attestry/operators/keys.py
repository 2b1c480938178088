"""Signing keys: which one was in force, key status, and which tags an identity may write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOREVER = 2**62


def in_force(asked: DataFrame, history: DataFrame, at_ms: Column) -> DataFrame:
    """Each row of `asked` (with `kid`) and the key in force at `at_ms`.

    Among the keys valid then, the one that expires first (the later entry on ties); with none valid
    the one revoked last. A kid's history is a short list, so it is folded to one array per kid and
    the choice is an expression: rows are never multiplied by keys.
    """
    entries = history.groupBy("kid").agg(F.collect_list(F.struct("pos", "revoked_at_ms", "public_key")).alias("_keys"))
    df = asked.withColumn("_at", at_ms).join(entries, "kid", "left")
    expiry = lambda k: F.coalesce(k["revoked_at_ms"], F.lit(FOREVER))
    ranked = lambda keys, sign: F.transform(keys, lambda k: F.struct(
        (expiry(k) * sign).alias("e"), (-k["pos"]).alias("p"), k["public_key"].alias("public_key"), k["revoked_at_ms"].alias("revoked_at_ms")))
    valid = F.filter("_keys", lambda k: k["revoked_at_ms"].isNull() | (k["revoked_at_ms"] >= F.col("_at")))
    chosen = F.when(F.size(valid) > 0, F.array_min(ranked(valid, 1))).otherwise(F.array_min(ranked(F.col("_keys"), -1)))
    df = df.withColumn("_k", chosen)
    return df.select(*asked.columns, F.col("_k.public_key").alias("public_key"), F.col("_k.revoked_at_ms").alias("revoked_at_ms"))


def key_status(history: DataFrame, published: DataFrame) -> DataFrame:
    """Per kid: active while any key is unrevoked, else revoked at the latest time; published or not."""
    known = history.groupBy("kid").agg(
        F.bool_or(F.col("revoked_at_ms").isNull()).alias("_active"), F.max("revoked_at_ms").alias("_last"))
    named = published.select("kid").distinct().withColumn("published", F.lit(True))
    df = known.join(named, "kid", "full_outer")
    return df.select("kid", F.coalesce("published", F.lit(False)).alias("published"),
                     F.when(F.col("_active").isNull(), "absent").when(F.col("_active"), "active").otherwise("revoked").alias("state"),
                     F.when(~F.col("_active"), F.col("_last")).alias("revoked_at_ms"))


def writable_tags(identities: DataFrame, policy: DataFrame) -> DataFrame:
    """Tags each identity (`iss`) may write under the policy."""
    rules = policy.select("tag", F.explode("allowed").alias("who"))
    named = identities.join(rules, F.col("iss") == F.col("who")).select("iss", "tag")
    # a tag open to everyone: the policy's few such tags as one array, not a cross product
    open_tags = rules.filter("who = '*'").agg(F.collect_set("tag").alias("_tags"))
    everyone = identities.join(F.broadcast(open_tags)).select("iss", F.explode("_tags").alias("tag"))
    return named.union(everyone).distinct()
