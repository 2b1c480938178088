"""Message search, lookups and pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

WORDS = r"[^\p{L}\p{N}_]+"


def search(messages: DataFrame, *, tag=None, ie=None, iss=None, verdict=None, kind=None, block_id=None,
           ms_from=None, ms_to=None, ts_from=None, ts_to=None, date_from_ms=None, date_to_ms=None,
           json_path: tuple[str, str] | None = None, words: str | None = None) -> DataFrame:
    """Any conjunction of filters; only the ones given reach the scan."""
    conds: list[Column] = []
    for column, value in (("tag", tag), ("ie_id", ie), ("iss", iss), ("verdict", verdict), ("kind", kind), ("block_id", block_id)):
        if value is not None:
            conds.append(F.col(column) == value)
    for column, low, high in (("ms_index", ms_from, ms_to), ("ts", ts_from, ts_to)):
        conds += [F.col(column) >= low] if low is not None else []
        conds += [F.col(column) <= high] if high is not None else []
    date = C.message_date(F.col("received_at_ms"), F.col("confirmed_at_ms"), F.col("ts"))
    conds += [date >= date_from_ms] if date_from_ms is not None else []
    conds += [date <= date_to_ms] if date_to_ms is not None else []
    if json_path is not None:
        conds.append(json_text_at(F.col("json"), json_path[0]) == json_path[1])
    if words:
        conds.append(has_words(F.col("json"), words))
    return messages.filter(reduce(lambda a, b: a & b, conds)) if conds else messages


def json_text_at(json: Column, path: str) -> Column:
    return F.get_json_object(json, "$." + path)


def tokens(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), WORDS)), "")


def query_words(words: str) -> list[str]:
    import re
    return sorted({w for w in re.split(r"[^\w]+", words.lower()) if w})


def has_words(text: Column, words: str) -> Column:
    """All words of the query occur in the text."""
    found = tokens(text)
    return reduce(lambda a, b: a & b, [F.array_contains(found, w) for w in query_words(words)])


def contains_text(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def inverted_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(token, key) rows; written partitioned by a token prefix it replaces the text scan."""
    return df.select(F.explode(tokens(F.col(text))).alias("token"), key)


def search_index(index: DataFrame, key: str, words: str) -> DataFrame:
    """Keys that carry every word, from the inverted index."""
    wanted = query_words(words)
    hits = index.filter(F.col("token").isin(*wanted))
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select(key)


def position_columns(messages: DataFrame) -> DataFrame:
    """Page order: unconfirmed messages first, then the newest."""
    return (messages.withColumn("_g", F.when(F.col("ms_index").isNull(), 0).otherwise(1))
            .withColumn("_a", F.coalesce("ms_index", "received_at_ms", "ts"))
            .withColumn("_b", F.coalesce("wf_index", F.lit(0).cast("bigint"))))


def page(messages: DataFrame, limit: int, cursor: tuple[int, int, int, str] | None = None) -> DataFrame:
    """One keyset page after `cursor` = (group, a, b, block id) of the last row seen.

    The extra row says whether another page follows (`last` is null on the last page)."""
    rows = position_columns(messages)
    if cursor is not None:
        g, a, b, bid = cursor
        after = F.struct("_a", "_b", "block_id") < F.struct(
            F.lit(a).cast("bigint").alias("_a"), F.lit(b).cast("bigint").alias("_b"), F.lit(bid).alias("block_id"))
        rows = rows.filter((F.col("_g") > g) | ((F.col("_g") == g) & after))
    order = [F.col("_g").asc(), F.col("_a").desc_nulls_last(), F.col("_b").desc(), F.col("block_id").desc()]
    return rows.orderBy(*order).limit(limit).drop("_g", "_a", "_b")


def newest(df: DataFrame, limit: int, *columns: str, oldest_first: bool = False) -> DataFrame:
    """The newest rows by `columns`, optionally shown oldest first."""
    top = df.orderBy(*[F.col(c).desc_nulls_last() for c in columns]).limit(limit)
    return top.orderBy(*[F.col(c).asc() for c in columns]) if oldest_first else top


def before_key(df: DataFrame, columns: Sequence[str], key: Sequence) -> DataFrame:
    """Rows strictly before `key` in the order of `columns` (keyset paging backwards)."""
    typed = [F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, key, strict=True)]
    return df.filter(F.struct(*columns) < F.struct(*typed))


def after_key(df: DataFrame, columns: Sequence[str], key: Sequence) -> DataFrame:
    typed = [F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(columns, key, strict=True)]
    return df.filter(F.struct(*columns) > F.struct(*typed))


def matching(df: DataFrame, **equal) -> DataFrame:
    """Rows equal to every given value; `since_<column>` is a lower bound, None means "any"."""
    for name, value in equal.items():
        if value is None:
            continue
        df = df.filter(F.col(name[6:]) >= value if name.startswith("since_") else F.col(name) == value)
    return df


def lookup(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `df` whose key is among `keys`, nulls being equal to nulls."""
    cond = reduce(lambda a, b: a & b, [df[c].eqNullSafe(keys[c]) for c in on])
    return df.join(keys, cond, "left_semi")


def alerts_by_keys(alerts: DataFrame, messages: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Alerts on messages that share a correlation key with `wanted`: their own correlation id, or `ie:` and their element."""
    keys = F.array_compact(F.array(F.col("corr"), F.concat(F.lit("ie:"), "ie_id")))
    found = messages.filter(F.arrays_overlap(keys, F.array(*map(F.lit, wanted)))).select("block_id", "corr")
    return alerts.join(found, "block_id").select("id", "corr").distinct()
