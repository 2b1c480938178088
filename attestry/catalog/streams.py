"""The streaming jobs, run over the whole ledger as a sequence of arriving files."""

from pyspark.sql import functions as F

from ..plans import incidents as I
from ..session import scratch_path, settle
from ..streaming import jobs as J
from .incident_queries import run
from .jobs import EPISODES_SQL, drift_log
from .registry import query

PROVEN = "verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED')"
_FEEDS: dict[tuple, str] = {}


def feed(t, name, df, clock, slices=3, rows_per_file=250_000, stored=False):
    """A folder whose files arrive in time order, as a stream. Written once per ledger.

    A trigger takes so many files, so all slices have the same number of them: else a trigger would take the end of one slice with
    the beginning of the next, and a watermark would drop the rest of that as late. Columns of a `stored` table are not stored again."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if key not in _FEEDS:
        path = scratch_path(t.spark, f"feed-{name}")
        df = df if stored else settle(df, name)
        lo, hi = df.agg(F.min(clock), F.max(clock)).head()
        step = (hi - lo) // slices + 1
        of_slice = ((F.col(clock) - lo) / step).cast("int")
        sizes = {r[0]: r[1] for r in df.filter(F.col(clock).isNotNull()).groupBy(of_slice).count().collect()}
        files = max(1, min(max(sizes.values()) // rows_per_file, min(sizes.get(k, 0) for k in range(slices)) // 1000))  # none empty: rows are dealt round
        for k in range(slices):
            part = df.filter((F.col(clock) >= lo + k * step) & (F.col(clock) < lo + (k + 1) * step))
            part.repartition(files).write.option("compression", "zstd").parquet(f"{path}/slice={k}")
            found = len(t.spark.read.parquet(f"{path}/slice={k}").inputFiles())
            if found != files:
                raise RuntimeError(f"slice {k} of {name} has {found} files, not {files}")
        _FEEDS[key] = path
    arrived = t.spark.read.parquet(_FEEDS[key])
    return (t.spark.readStream.schema(arrived.schema).option("maxFilesPerTrigger", len(arrived.inputFiles()) // slices).parquet(_FEEDS[key])
            .drop("slice"))


def messages(t):
    """What the streams ask of a message: its texts stay in the message table."""
    return feed(t, "messages", t.messages.select("block_id", "ie_id", "verdict", "ms_index", "ts", "confirmed_at_ms"), "ms_index", stored=True)


def submissions(t):
    return feed(t, "submissions", t.submissions.select("sub_id", "block_id", "received_at_ms", "source"), "received_at_ms", stored=True)


@query("t1_ingest_once", "SELECT block_id, received_at_ms FROM submissions")
def t1(t):
    cols = ["sub_id", "block_id", "received_at_ms", "source"]
    s = t.submissions.select(*cols)
    again = s.withColumn("sub_id", F.concat(F.lit("z"), "sub_id")).withColumn("source", F.lit("http")).withColumn("received_at_ms", F.col("received_at_ms") + 3)
    path = scratch_path(t.spark, "ingested")
    J.ingest_submissions(feed(t, "records", s.union(s).union(again), "received_at_ms"), path)
    store = J.submission_store(path)
    return store.rows(t.spark, store.batches(t.spark)).select("block_id", "received_at_ms")


@query("t1_dedupe_watermark", "SELECT sub_id, block_id FROM submissions")
def t1b(t):
    s = t.submissions.select("sub_id", "block_id", "received_at_ms")
    return J.finish(J.dedupe_submissions(feed(t, "repeats", s.union(s), "received_at_ms")).select("sub_id", "block_id"))


@query("t2_shadow_stream", """SELECT block_id, ie_id FROM messages m WHERE confirmed_at_ms + 60000 <= (SELECT max(confirmed_at_ms) FROM messages)
    AND NOT EXISTS (SELECT 1 FROM submissions s WHERE s.block_id = m.block_id AND s.received_at_ms <= m.confirmed_at_ms + 60000)""")
def t2(t):
    sent, out = scratch_path(t.spark, "sent"), scratch_path(t.spark, "shadows")
    J.ingest_submissions(submissions(t), sent)
    J.shadow_stream(messages(t), sent, scratch_path(t.spark, "waiting"), out, grace_s=60)
    return t.spark.read.schema(J.WAITING).parquet(out).select("block_id", "ie_id")


@query("t3_orphan_stream")
def t3(t):
    return J.finish(J.orphan_stream(submissions(t), messages(t))).filter("orphaned").select("sub_id", "block_id")


@query("t3_definitive_orphans", """WITH e AS (SELECT *, received_at_ms + 70000 AS answered_ms, max(received_at_ms) OVER () + 70000 AS top FROM submissions)
    SELECT sub_id, block_id, answered_ms AS orphaned_at_ms FROM e WHERE n % 6 = 0 AND n % 5 <> 0 AND n % 7 <> 0 AND answered_ms < top""")
def t3b(t):
    # two polls per submission; every sixth block is never referenced; some first and some second polls go unanswered
    s = t.submissions.select("block_id", "sub_id", "n", "received_at_ms")
    row = lambda after, kind, referenced: F.struct((F.col("received_at_ms") + after).alias("at_ms"), F.lit(kind).alias("kind"), referenced.alias("referenced"))
    early = F.when(F.col("n") % 7 != 0, row(1000, J.ANSWER, F.lit(False)))
    late = F.when(F.col("n") % 5 != 0, row(70000, J.ANSWER, F.col("n") % 6 != 0))
    log = s.withColumn("_e", F.explode(F.array_compact(F.array(row(0, J.SUBMITTED, F.lit(False)), early, late)))).select("block_id", "sub_id", "_e.*")
    last = s.agg(F.max("received_at_ms")).first()[0] or 0
    clock = t.spark.createDataFrame([("clock", "clock", last + 70000, J.ANSWER, False)], J.ANSWERS)
    out = scratch_path(t.spark, "orphans")
    J.definitive_orphans(feed(t, "answers", log.unionByName(clock), "at_ms"), scratch_path(t.spark, "unanswered"), out)
    return t.spark.read.schema(J.ORPHAN).parquet(out).select("sub_id", "block_id", "orphaned_at_ms")


SILENCE_SQL = f"""WITH s AS (SELECT ie_id, ts, lead(ts) OVER (PARTITION BY ie_id ORDER BY ts) AS next_ts FROM messages WHERE score IS NOT NULL AND {PROVEN})
    SELECT ie_id, ts AS last_ts, CAST(120 AS BIGINT) AS threshold_s FROM s WHERE next_ts - ts > 120 OR next_ts IS NULL AND ts + 121 < (SELECT max(ts) FROM s)"""


@query("t4_silence_stream", SILENCE_SQL)
def t4(t, slices=3):
    s = feed(t, f"scores-{slices}", t.messages.filter(f"score IS NOT NULL AND {PROVEN}").select("ie_id", "ts"), "ts", slices)
    return J.finish(J.silence_stream(s))


@query("t5_drift_stream", f"SELECT ie_id, since_ms, alert_ms FROM ({EPISODES_SQL}) WHERE alert_ms IS NOT NULL")
def t5(t):
    return J.finish(J.drift_stream(feed(t, "observed", drift_log(t), "at_ms")))


@query("t6_replay_stream", """SELECT a.block_id FROM messages a WHERE EXISTS (SELECT 1 FROM messages b WHERE b.iss = a.iss AND b.seq = a.seq AND (b.ms_index, b.wf_index) < (a.ms_index, a.wf_index))""")
def t6(t):
    c = t.messages.select("block_id", "iss", "seq", "nonce", "ms_index", "wf_index").withColumn("spends", F.lit(True))
    out = scratch_path(t.spark, "replays")
    J.replay_stream(feed(t, "candidates", c, "ms_index"), scratch_path(t.spark, "spent"), out)
    return t.spark.read.parquet(out).select("block_id")


@query("t7_incident_stream")
def t7(t):
    changes = scratch_path(t.spark, "incident-changes")
    J.incident_stream(feed(t, "observations", run(t)[0].drop("oid"), "ord_ms"), scratch_path(t.spark, "books"), changes)
    return t.spark.read.schema(I.CHANGE).parquet(changes).select("incident", "action", "block_id", "role", "status")


@query("t8_late_rows", "SELECT block_id FROM messages WHERE n % 301 = 0 AND ms_index > 6200")
def t8(t):
    # a few messages arrive with a position far behind the ledger's clock
    m = t.messages.select("block_id", "ms_index", "ts", (F.when((F.col("n") % 301 == 0) & (F.col("ms_index") > 6200), F.col("ts") - 10_000_000).otherwise(F.col("ts"))).alias("claimed"))
    m = m.select("block_id", "ms_index", F.col("claimed").alias("ts"))
    late = scratch_path(t.spark, "late")
    J.split_late(feed(t, "arrivals", m, "ms_index"), 600, scratch_path(t.spark, "clock"), late, scratch_path(t.spark, "on-time"))
    return t.spark.read.parquet(late).select("block_id")


@query("t9_delivery", """SELECT concat('ledger/alerts/', severity) AS topic, count(*) AS n FROM alerts GROUP BY 1""")
def t9(t):
    path = scratch_path(t.spark, "delivered")
    J.deliver(feed(t, "alert-log", t.alerts, "at_ms"), "ledger/alerts", path)
    return t.spark.read.json(path).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("t10_milestone_counters", """WITH w AS (SELECT ts // 3600 * 3600 AS start_s, count(*) AS messages, count(DISTINCT ms_index) AS milestones, count(*) FILTER (WHERE verdict = 'FORGED') AS forged FROM messages GROUP BY 1)
    SELECT * FROM w WHERE start_s + 3600 <= (SELECT max(ts) FROM messages) - 600""")
def t10(t):
    return J.finish(J.milestone_counters(messages(t)))
