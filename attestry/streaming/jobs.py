"""Streams over messages, submissions, scores and events.

Every job takes streaming DataFrames and returns one, or starts a query that writes to a folder.
State is bounded by watermarks; whatever must be exact over the whole ledger (first submission wins,
spent sequence numbers) is decided per micro-batch against a stored table, keyed by batch id, so a
batch that runs twice writes the same thing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import vocabulary as V
from ..plans import incidents as I
from ..plans import verdicts
from ..session import scratch_path, settle
from ..sources import loads
from .keystore import KeyStore


def event_time(df: DataFrame, seconds: str = "ts", name: str = "event_time") -> DataFrame:
    return df.withColumn(name, F.timestamp_seconds(seconds))


def finish(df: DataFrame, *, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what its source holds now and return what it wrote."""
    spark = df.sparkSession
    out = scratch_path(spark, "stream-out")
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", out)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def each_batch(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    q = (df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or scratch_path(df.sparkSession, "stream-state"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def stored(spark: SparkSession, path: str, schema: str, before: int, latest: bool = False) -> DataFrame:
    """A table kept in folders `batch=N`: what the batches before this one wrote, or only the one just before it."""
    from pyspark.errors import AnalysisException
    try:
        own = F.col("batch") == before - 1 if latest else F.col("batch") < before
        return spark.read.schema(f"{schema}, batch bigint").parquet(path).filter(own).drop("batch")
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


# -- submissions and confirmations --------------------------------------------------------------


def dedupe_submissions(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a submission id, then of a block id, arriving within the watermark."""
    timed = stream.withColumn("event_time", F.timestamp_millis("received_at_ms")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["sub_id"])


SUBMISSION = "sub_id string, block_id string, received_at_ms bigint, source string"


def submission_store(path: str) -> KeyStore:
    return KeyStore(path, SUBMISSION, {"sub": ("sub_id",), "block": ("block_id",)})


def ingest_submissions(stream: DataFrame, path: str) -> None:
    """Insert each submission once, whichever transport delivers it first, exactly. A batch reads only the folders of the store in which
    its ids may lie."""
    store = submission_store(path)

    def write(batch: DataFrame, n: int) -> None:
        rows = batch.select("sub_id", "block_id", "received_at_ms", "source")
        known = store.find(rows, "sub", n).unionByName(store.find(rows, "block", n)).select("stored.*").distinct()
        store.append(loads.insert_submissions(settle(known, "known-submissions"), rows), n)

    each_batch(stream, write)


def _timed(stream: DataFrame, ms: str, name: str, delay: str) -> DataFrame:
    return stream.withColumn(name, F.timestamp_millis(ms)).withWatermark(name, delay)


WAITING = "block_id string, ie_id string, confirmed_at_ms bigint"


def shadow_stream(messages: DataFrame, submissions_path: str, waiting_path: str, out_path: str, grace_s: int = V.SHADOW_GRACE_S) -> None:
    """Confirmed messages without a submission, judged once the ledger's clock is a grace past their confirmation.

    A submission counts however long before the confirmation it came, so it is looked up in the stored table that
    `ingest_submissions` keeps; only the messages still within their grace are carried from batch to batch."""
    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        waiting = stored(spark, waiting_path, f"{WAITING}, top bigint", n, latest=True)
        rows = batch.select("block_id", "ie_id", "confirmed_at_ms")
        top = rows.select(F.col("confirmed_at_ms").alias("top")).union(waiting.select("top")).agg(F.max("top").alias("top"))
        every = rows.union(waiting.filter("block_id IS NOT NULL").drop("top")).join(F.broadcast(top))  # one row
        due = F.col("confirmed_at_ms") + grace_s * 1000 <= F.col("top")
        store, due_rows = submission_store(submissions_path), settle(every.filter(due).drop("top"), "due")
        sent = store.find(due_rows, "block", store.batches(spark)).filter(F.col("stored.received_at_ms") <= F.col("confirmed_at_ms") + grace_s * 1000)
        due_rows.join(sent.select("block_id").distinct(), "block_id", "left_anti").select(*due_rows.columns).write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        # the clock is kept even if nothing waits
        clock = top.select(F.lit(None).cast("string").alias("block_id"), F.lit(None).cast("string").alias("ie_id"), F.lit(None).cast("bigint").alias("confirmed_at_ms"), "top")
        every.filter(~due).union(clock).write.mode("overwrite").parquet(f"{waiting_path}/batch={n}")

    each_batch(messages, write)


def orphan_stream(submissions: DataFrame, messages: DataFrame, timeout_s: int = V.ORPHAN_S) -> DataFrame:
    """Submissions without confirmation within the timeout (null right side)."""
    s = _timed(submissions.select("block_id", "sub_id", "received_at_ms"), "received_at_ms", "s_time", f"{timeout_s} seconds")
    m = _timed(messages.select(F.col("block_id").alias("m_block"), "confirmed_at_ms"), "confirmed_at_ms", "m_time", f"{timeout_s} seconds")
    cond = (F.col("block_id") == F.col("m_block")) & F.expr(f"m_time BETWEEN s_time AND s_time + INTERVAL {timeout_s} SECONDS")
    return s.join(m, cond, "left_outer").select("sub_id", "block_id", "received_at_ms", F.col("m_block").isNull().alias("orphaned"))


ANSWERS = "block_id string, sub_id string, at_ms bigint, kind string, referenced boolean"
SUBMITTED, ANSWER, CONFIRMED = "submission", "answer", "confirmation"


UNANSWERED = "block_id string, submitted struct<at_ms: bigint, sub_id: string>, answers array<bigint>, yes_ms bigint, seen_ms bigint, clock_ms bigint"
ORPHAN = "sub_id string, block_id string, received_at_ms bigint, orphaned_at_ms bigint"
DAY_MS = 86_400_000


def definitive_orphans(log: DataFrame, waiting_path: str, out_path: str, timeout_s: int = V.ORPHAN_S, delay_s: int = 0) -> None:
    """Submissions that the node itself says were never referenced: an answer inside the timeout, another at its end or later, and
    up to that one neither an answer nor a confirmation that a milestone referenced the block. Polls without an answer say nothing.

    log: block_id, sub_id, at_ms, kind (submission, answer, confirmation), referenced. A micro-batch meets what the batch before left
    of the blocks without a verdict, one row a block. A verdict waits until the ledger's clock, less the delay, has passed its last
    answer, so the order of arrival within the delay does not matter; what never gets its answers is forgotten a day after its last
    event without a verdict."""
    def write(batch: DataFrame, n: int) -> None:
        waiting = stored(batch.sparkSession, waiting_path, UNANSWERED, n, latest=True)
        sent = F.col("kind") == SUBMITTED
        no = (F.col("kind") == ANSWER) & ~F.coalesce("referenced", F.lit(False))
        rows = batch.select("block_id", F.when(sent, F.struct("at_ms", "sub_id")).alias("submitted"),
                            F.when(no, F.array("at_ms")).otherwise(F.array().cast("array<bigint>")).alias("answers"),
                            F.when(~sent & ~no, F.col("at_ms")).alias("yes_ms"), F.col("at_ms").alias("seen_ms"))
        tops = rows.select(F.col("seen_ms").alias("clock_ms")).union(waiting.select("clock_ms"))
        clock = tops.agg(F.max("clock_ms").alias("clock_ms"))
        known = rows.unionByName(waiting.filter("block_id IS NOT NULL").drop("clock_ms")).groupBy("block_id").agg(
            F.min("submitted").alias("submitted"), F.flatten(F.collect_list("answers")).alias("answers"), F.min("yes_ms").alias("yes_ms"), F.max("seen_ms").alias("seen_ms"))
        received = F.col("submitted.at_ms")
        end = received + timeout_s * 1000
        known = known.join(F.broadcast(clock)).withColumns({  # one row
            "after": F.array_min(F.filter("answers", lambda a: a >= end)),
            "before": F.exists("answers", lambda a: (a >= received) & (a < end))})
        mark = F.col("clock_ms") - delay_s * 1000
        known = settle(known.withColumn("done", F.coalesce(F.col("after") < mark, F.lit(False))), "answered")
        orphaned = F.col("done") & F.col("before") & F.coalesce(F.col("yes_ms") > F.col("after"), F.lit(True))
        known.filter(orphaned).select("submitted.sub_id", "block_id", received.alias("received_at_ms"), F.col("after").alias("orphaned_at_ms")).write.mode(
            "overwrite").parquet(f"{out_path}/batch={n}")
        # the clock is kept even if nothing waits
        empty = clock.select(*[F.lit(None).alias(c) for c in ("block_id", "submitted", "answers", "yes_ms", "seen_ms")], "clock_ms")
        left = known.filter(~F.col("done") & (F.col("seen_ms") + DAY_MS >= mark)).select("block_id", "submitted", "answers", "yes_ms", "seen_ms", "clock_ms")
        left.unionByName(empty).write.mode("overwrite").parquet(f"{waiting_path}/batch={n}")

    each_batch(log, write)


# -- per-element state --------------------------------------------------------------------------


def silence_stream(scores: DataFrame, threshold_s: int = V.STALE_S, delay: str = "0 seconds") -> DataFrame:
    """One row per stretch without a score longer than the threshold: when the next score arrives, or before it,
    when the ledger's clock (the watermark) passes the deadline. The state is an element's last score, and only while
    its silence is unreported: a reported one needs no memory, as whatever comes next begins anew."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found: list[int] = []
        last = state.get[0] if state.exists else None
        for pdf in batches:  # none if the timer fired
            for ts in sorted(pdf["ts"].tolist()):
                if last is not None and ts - last > threshold_s:
                    found.append(last)
                last = int(ts) if last is None else max(last, int(ts))
        deadline = (last + threshold_s + 1) * 1000
        if state.hasTimedOut or deadline < state.getCurrentWatermarkMs():
            found.append(last)
            state.remove()
        else:
            state.update((last,))
            state.setTimeoutTimestamp(deadline)
        yield pd.DataFrame({"ie_id": [key[0]] * len(found), "last_ts": found, "threshold_s": [threshold_s] * len(found)})

    timed = event_time(scores.select("ie_id", "ts")).withWatermark("event_time", delay)
    return timed.groupBy("ie_id").applyInPandasWithState(
        step, "ie_id string, last_ts bigint, threshold_s bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def drift_stream(log: DataFrame, grace_s: int = V.DRIFT_GRACE_S) -> DataFrame:
    """DRIFT alerts: the first observation more than the grace after an episode began, once per episode. Only elements
    inside an episode have state."""
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, alerted = state.get if state.exists else (-1, False)
        found = []
        # one trigger's rows of one element; the trigger's rate limit bounds them
        rows = sorted((int(a), int(i), bool(d)) for pdf in batches for a, i, d in zip(pdf["at_ms"], pdf["id"], pdf["diverging"], strict=True))
        for at, _, diverging in rows:
            if not diverging:
                since, alerted = -1, False
                continue
            since = at if since < 0 else since
            if not alerted and at - since > grace_s * 1000:
                alerted = True
                found.append((since, at))
        if since >= 0:
            state.update((since, alerted))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"ie_id": [key[0]] * len(found), "since_ms": [s for s, _ in found], "alert_ms": [a for _, a in found]})

    return log.groupBy("ie_id").applyInPandasWithState(
        step, "ie_id string, since_ms bigint, alert_ms bigint", "since bigint, alerted boolean", "append", GroupStateTimeout.NoTimeout)


SPENT = "iss string, seq bigint, nonce string, block_id string"


def replay_stream(candidates: DataFrame, spent_path: str, out_path: str) -> None:
    """Replays per micro-batch against the spent seqs and nonces of all batches before, of which only the folders that may hold the
    batch's keys are read."""
    store = KeyStore(spent_path, SPENT, {"seq": ("iss", "seq"), "nonce": ("iss", "nonce")})

    def write(batch: DataFrame, n: int) -> None:
        hits = store.find(batch, "seq", n).withColumn("_rank", F.lit(0)).unionByName(store.find(batch, "nonce", n).withColumn("_rank", F.lit(1)))
        old = settle(hits.groupBy("block_id").agg(F.min(F.struct("_rank", F.col("stored.block_id").alias("b")))["b"].alias("earlier")), "replayed")
        fresh = settle(batch.join(old.select("block_id"), "block_id", "left_anti").select(*batch.columns), "fresh")
        again = settle(verdicts.resolve_replays(fresh), "again")
        found = old.unionByName(again.select("block_id", F.coalesce("seq_used_by", "nonce_used_by").alias("earlier")))
        found.write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        kept = fresh.filter("spends").join(again.select("block_id"), "block_id", "left_anti")
        store.append(kept.select("iss", "seq", "nonce", "block_id"), n)

    each_batch(candidates, write)


def incident_stream(observations: DataFrame, books_path: str, out_path: str, settings: I.Settings | None = None) -> None:
    """The incident fold, a micro-batch at a time: its observations meet the books that the batch before left (open incidents, and
    closed ones that may yet be corrected). Components are found anew in each batch, so incidents of different keys become one book
    as soon as an observation joins them. Alerts whose block no incident holds go on to the ledger's own incidents in the same batch.

    A book is closed by the ledger's clock, the latest observation of a batch, whether or not its keys are heard of again."""
    s = settings or I.Settings()

    def write(batch: DataFrame, n: int) -> None:
        obs = I.numbered(batch, "stream-observations")
        clock = obs.agg(F.max("ord_ms")).first()[0] or 0
        books = stored(batch.sparkSession, books_path, f"{I.BOOK}, ledger boolean", n, latest=True)
        books = settle(books.withColumn("oid", F.monotonically_increasing_id()), "stream-books")
        first = I.advance(obs.filter(F.col("primary") != I.LEDGER), s, clock, books.filter("NOT ledger").drop("ledger"), stream=True)
        second = I.advance(I.numbered(I.of_the_ledger(obs, first), "stream-ledger"), s, clock, books.filter("ledger").drop("ledger"), stream=True)
        left = I.books_of(first).withColumn("ledger", F.lit(False)).unionByName(I.books_of(second).withColumn("ledger", F.lit(True)))
        left.write.mode("overwrite").parquet(f"{books_path}/batch={n}")
        first.unionByName(second).filter("action NOT IN ('state', 'unheld')").write.mode("overwrite").parquet(f"{out_path}/batch={n}")

    each_batch(observations, write)


# -- late data, delivery, counters --------------------------------------------------------------


def split_late(stream: DataFrame, delay_s: int, clock_path: str, late_path: str, on_time_path: str) -> None:
    """Rows older than the newest milestone time seen in earlier batches less the delay go to a side table."""
    def write(batch: DataFrame, n: int) -> None:
        seen = stored(batch.sparkSession, clock_path, "top bigint", n).agg(F.max("top").alias("_top"))
        marked = batch.join(F.broadcast(seen))  # one row
        late = F.coalesce(F.col("ts") < F.col("_top") - delay_s, F.lit(False))
        marked.filter(late).drop("_top").write.mode("overwrite").parquet(f"{late_path}/batch={n}")
        marked.filter(~late).drop("_top").write.mode("overwrite").parquet(f"{on_time_path}/batch={n}")
        batch.agg(F.max("ts").alias("top")).write.mode("overwrite").parquet(f"{clock_path}/batch={n}")

    each_batch(stream, write)


def deliver(changes: DataFrame, prefix: str, path: str) -> None:
    """Route incident changes to topics; a batch delivered again overwrites itself."""
    def write(batch: DataFrame, n: int) -> None:
        loads.route(batch, prefix).write.mode("overwrite").partitionBy("topic").json(f"{path}/batch={n}")

    each_batch(changes, write)


def milestone_counters(messages: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Messages, milestones and forged messages per window of ledger time (append: closed windows only)."""
    timed = event_time(messages).withWatermark("event_time", delay)
    return (timed.groupBy(F.window("event_time", width)).agg(
        F.count(F.lit(1)).alias("messages"), F.size(F.collect_set("ms_index")).cast("bigint").alias("milestones"),
        F.count_if(F.col("verdict") == "FORGED").alias("forged"))
        .select(F.unix_timestamp(F.col("window.start")).alias("start_s"), "messages", "milestones", "forged"))
