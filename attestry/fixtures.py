"""Ledger tables derived from the `events` table, in Spark and (for the oracle) in DuckDB.

Each table is a source, a filter and a list of expressions, written once for both dialects.
`Ledger` derives them in Spark; `messages` is written once per application to the shared folder,
as the message table of a ledger would be, and every query reads that table.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import merkle, ordered
from .session import prepare, settle

T0_MS = 1704067200000
T0_S = 1704067200
EVERY = 720
URN = "urn:ngsi-ld:InfrastructureElement:"

# -- the two dialects ---------------------------------------------------------------------------
# Expressions use TEXT, DIV and SHA(x) for what the engines spell differently.


def _sha(expr: str, spark: bool) -> str:
    while True:
        at = expr.find("SHA(")
        if at < 0:
            return expr
        depth, i = 0, at + 3
        while True:
            depth += {"(": 1, ")": -1}.get(expr[i], 0)
            if depth == 0:
                break
            i += 1
        inner = expr[at + 4:i]
        expr = expr[:at] + (f"sha2({inner}, 256)" if spark else f"sha256({inner})") + expr[i + 1:]


def dialect(expr: str, spark: bool) -> str:
    expr = re.sub(r"\bTEXT\b", "STRING" if spark else "VARCHAR", expr)
    expr = re.sub(r"\bDIV\b", "div" if spark else "//", expr)
    return _sha(expr, spark)


EVENT_COLUMNS = [
    "event_id AS n", "user_id", "event_type",
    "concat('0x', SHA(concat('b', CAST(event_id AS TEXT)))) AS block_id",
    "MICROS DIV 1000 AS received_ms",
    f"((MICROS DIV 1000) - {T0_MS}) DIV 300000 + 1 AS ms_index",
    "concat('did:x:', CAST(user_id % 12 AS TEXT)) AS iss",
    "CASE WHEN event_id % 50 = 0 THEN 'FORGED' WHEN event_id % 50 = 1 THEN 'UNAUTHORIZED_WRITER'"
    " WHEN event_id % 50 = 2 THEN 'REVOKED_KEY' WHEN event_id % 50 = 3 THEN 'MALFORMED'"
    " WHEN event_id % 50 < 10 THEN 'UNSIGNED_LEGACY' WHEN event_id % 50 < 20 THEN 'RELAY_ATTESTED'"
    " ELSE 'PRODUCER_SIGNED' END AS verdict",
]
IE = "concat('Dom:', lpad(CAST(user_id AS TEXT), 12, '0'))"
SERVICE = "concat('sc-', CAST(user_id % 40 AS TEXT))"
MILLI = "((n * 7919) % 1001)"
SCORE_TEXT = f"CASE WHEN {MILLI} = 1000 THEN '1.0' ELSE concat('0.', lpad(CAST({MILLI} AS TEXT), 3, '0')) END"
MESSAGE_COLUMNS = [
    "n", "user_id", "block_id",
    "CASE WHEN event_type IN ('view', 'click') THEN 'trust.score' WHEN event_type = 'purchase' THEN 'LLO-K8s'"
    " WHEN event_type = 'signup' THEN 'LLO-Docker' ELSE 'self-orchestrator' END AS tag",
    "CASE WHEN event_type IN ('view', 'click') THEN 'trust.score' WHEN event_type = 'purchase' THEN 'llo.k8s'"
    " WHEN event_type = 'signup' THEN 'llo.docker' ELSE 'self-orchestrator' END AS kind",
    f"CASE WHEN event_type IN ('view', 'click', 'error') THEN {IE} END AS ie_id",
    f"CASE WHEN event_type IN ('purchase', 'signup') THEN {SERVICE} END AS service",
    f"CASE WHEN event_type IN ('view', 'click') THEN {MILLI} / 1000e0 END AS score",
    "CASE WHEN event_type = 'error' THEN CAST(n % 3 AS INT) END AS error_code",
    "verdict", "iss", "concat(iss, '#k1') AS kid",
    "seq", "concat('n', CAST(n AS TEXT)) AS nonce",
    "CASE WHEN n % 67 = 0 THEN NULL WHEN n % 61 = 0 THEN p2 ELSE p1 END AS prev",
    "CASE WHEN n % 5 = 0 THEN concat('c', CAST(user_id % 30 AS TEXT)) END AS corr",
    "n % 11 = 0 AS encrypted", "ms_index", "wf_index", f"{T0_S} + ms_index * 300 AS ts",
    "CASE WHEN n % 23 <> 0 THEN received_ms END AS received_at_ms",
    f"({T0_S} + ms_index * 300) * 1000 AS confirmed_at_ms",
    "received_ms + CASE WHEN n % 41 = 0 THEN 900000 ELSE 0 END AS iat",
    "CASE WHEN event_type IN ('view', 'click') THEN concat('{\"id\":\"', " + IE + ", '\",\"score\":', "
    + SCORE_TEXT + ", '}')"
    " WHEN event_type = 'error' THEN concat('{\"infrastructureElementId\":\"" + URN + "', " + IE
    + ", '\",\"errorCode\":', CAST(n % 3 AS TEXT), '}')"
    " ELSE concat('{\"event\":\"', CASE WHEN n % 7 = 0 THEN 'Service component failed' ELSE"
    " 'Service component migrated' END, '\",\"lloId\":\"llo-', CAST(user_id % 5 AS TEXT),"
    " '\",\"serviceComponentId\":\"', " + SERVICE + ", '\"}') END AS json",
]
PROVEN = "verdict IN ('PRODUCER_SIGNED', 'RELAY_ATTESTED')"

# name -> (source, filter, expressions)
TABLES: dict[str, tuple[str, str | None, list[str]]] = {
    "submissions": ("messages", "received_at_ms IS NOT NULL", [
        "concat('s', nonce) AS sub_id", "block_id", "received_at_ms",
        "CASE WHEN ms_index % 2 = 0 THEN 'mqtt' ELSE 'http' END AS source", "tag", "json AS message_json",
        "concat('0x', lower(hex(json))) AS data_hex", "CAST(201 AS BIGINT) AS node_status",
        "verdict AS relay_verdict", "iss", "seq", "n"]),
    # what the ledger holds, and what the explorer's own copies hold (some altered or dropped)
    "blocks": ("messages", None, [
        "block_id", "ms_index", "wf_index", "CAST(5 AS BIGINT) AS payload_type", "n",
        "CASE WHEN n % 101 = 0 THEN concat('x', CAST(n AS TEXT)) ELSE concat('b', CAST(n AS TEXT)) END AS raw"]),
    "served_blocks": ("messages", None, [  # a block as a node serves it, with what it carries
        "block_id", "ms_index", "wf_index", "CAST(5 AS BIGINT) AS payload_type", "n", "tag", "json AS data",
        "CASE WHEN n % 101 = 0 THEN concat('x', CAST(n AS TEXT)) ELSE concat('b', CAST(n AS TEXT)) END AS raw"]),
    "ledger_content": ("messages", None, ["block_id", "tag", "json AS data", "ms_index", "n"]),
    "stored_messages": ("messages", "n % 211 <> 0", [
        "block_id", "CASE WHEN n % 103 = 0 THEN concat(tag, '!') ELSE tag END AS tag",
        "CASE WHEN n % 107 = 0 THEN NULL WHEN n % 109 = 0 THEN concat(json, ' ') ELSE json END AS data", "n"]),
    "stored_submissions": ("messages", "received_at_ms IS NOT NULL", [
        "concat('s', nonce) AS sub_id", "block_id", "tag",
        "CASE WHEN n % 113 = 0 THEN concat(json, '?') ELSE json END AS data", "n"]),
    "verdict_alerts": ("messages", "verdict IN ('FORGED', 'UNAUTHORIZED_WRITER', 'REVOKED_KEY', 'MALFORMED')", [
        "n * 10 + 1 AS id", "verdict AS rule",
        "CASE verdict WHEN 'FORGED' THEN 'critical' WHEN 'MALFORMED' THEN 'low' ELSE 'high' END AS severity",
        "block_id", "ie_id", "ts * 1000 + 1000 AS at_ms", "CAST(NULL AS TEXT) AS dedupe_key"]),
    "shadow_alerts": ("messages", "n % 23 = 0", [
        "n * 10 + 2 AS id", "'SHADOW' AS rule", "'high' AS severity", "block_id", "ie_id",
        "ts * 1000 + 30000 AS at_ms", "CAST(NULL AS TEXT) AS dedupe_key"]),
    "unsigned_alerts": ("messages", "verdict = 'UNSIGNED_LEGACY' AND tag = 'trust.score'", [
        "n * 10 + 3 AS id", "'UNSIGNED' AS rule", "'medium' AS severity", "block_id", "ie_id",
        "ts * 1000 + 1000 AS at_ms", "CAST(NULL AS TEXT) AS dedupe_key"]),
    "anchor_alerts": ("messages", "n % 500 = 7", [
        "n * 10 + 4 AS id", "'ANCHOR_UNVERIFIABLE' AS rule", "'low' AS severity",
        "CAST(NULL AS TEXT) AS block_id", "CAST(NULL AS TEXT) AS ie_id", "ts * 1000 + 500 AS at_ms",
        "concat('seq:', CAST(n DIV 500 AS TEXT)) AS dedupe_key"]),
    "validations": ("submissions", None, [
        "n * 2 AS id", "block_id", "received_at_ms + 1000 AS checked_at_ms", "n % 3 <> 0 AS is_solid",
        "CAST(NULL AS BIGINT) AS referenced_by_ms",
        "CASE WHEN n % 17 = 0 THEN 'conflicting' ELSE 'noTransaction' END AS inclusion_state", "n"]),
    "content_checks": ("submissions", "n % 7 <> 0", [
        "n AS id", "block_id", "received_at_ms + 900000 AS checked_at_ms",
        "CASE WHEN n % 19 = 0 THEN 'MISMATCH' ELSE 'MATCH' END AS result", "n"]),
    "context_ie": ("users", "user_id % 10 <> 3", [
        f"concat('{URN}', {IE}) AS entity_id", f"{IE} AS ie_id",
        "CASE WHEN user_id % 29 = 5 THEN NULL ELSE ((user_id * 37) % 1001) / 1000e0 END AS trust_score", "user_id"]),
    "component_host": ("users", "user_id < 40", [
        "concat('sc-', CAST(user_id AS TEXT)) AS service", f"{IE} AS host_ie"]),
    "bodies": ("messages", None, [
        "block_id", "n", "kind", "tag",
        "CASE WHEN n % 41 = 0 THEN 'not json' WHEN n % 37 = 0 THEN '[1,2]'"
        " WHEN kind = 'trust.score' AND n % 17 = 0 THEN concat('{\"id\":\"', ie_id, '\",\"score\":\"0.5\"}')"
        " WHEN kind = 'trust.score' AND n % 19 = 0 THEN '{\"id\":\"nope\",\"score\":0.5}'"
        " WHEN kind = 'trust.score' AND n % 29 = 0 THEN concat('{\"id\":\"', ie_id, '\",\"score\":1.5}')"
        " WHEN kind = 'trust.score' AND n % 31 = 0 THEN concat('{\"id\":\"', ie_id, '\",\"score\":true}')"
        " WHEN kind = 'self-orchestrator' AND n % 17 = 0 THEN '{\"infrastructureElementId\":\"\",\"errorCode\":1}'"
        " WHEN kind = 'self-orchestrator' AND n % 19 = 0 THEN '{\"infrastructureElementId\":\"e\",\"errorCode\":\"\"}'"
        " WHEN kind = 'self-orchestrator' AND n % 29 = 0 THEN '{\"infrastructureElementId\":\"e\",\"errorCode\":true}'"
        " WHEN kind = 'self-orchestrator' AND n % 31 = 0 THEN '{\"infrastructureElementId\":\"e\",\"errorCode\":\"0\"}'"
        " WHEN kind LIKE 'llo%' AND n % 17 = 0 THEN '{\"event\":\"x\",\"lloId\":\"\",\"serviceComponentId\":\"s\"}'"
        " ELSE json END AS body"]),
    "envelopes": ("messages", None, [
        "block_id", "n", "user_id", "tag", "kind", "json", "iss", "seq", "ms_index", "wf_index", "ts", "verdict",
        "CASE WHEN n % 13 = 0 THEN json ELSE concat('{\"w\":1,\"tag\":\"', tag, '\",\"iss\":\"', iss, '\",\"kid\":\"',"
        " CASE WHEN n % 71 = 0 THEN 'did:x:other' ELSE iss END, '#k1\",\"seq\":', CAST(seq AS TEXT), ',\"iat\":',"
        " CAST(iat AS TEXT), ',\"nonce\":\"', CASE WHEN n % 59 = 0 THEN 'short' ELSE"
        " concat(substr(SHA(concat('o', CAST(n DIV 2 AS TEXT))), 1, 21), 'A') END, '\",\"att\":',"
        " CASE WHEN n % 61 = 0 THEN '{\"mode\":\"relay\"}' WHEN verdict = 'RELAY_ATTESTED' THEN"
        " '{\"mode\":\"relay\",\"sub\":\"r1\"}' ELSE '{\"mode\":\"producer\"}' END,"
        " CASE WHEN n % 53 = 0 THEN ',\"extra\":1' ELSE '' END,"
        " CASE WHEN n % 11 = 0 THEN concat(',\"enc\":{\"c\":\"', CAST(n AS TEXT), '\"},\"bix\":[\"t', CAST(user_id AS TEXT),"
        " '\",\"t', CAST(n % 5 AS TEXT), '\",\"t', CAST(user_id AS TEXT), '\"]')"
        " WHEN n % 83 = 0 THEN ',\"body\":[1]' ELSE concat(',\"body\":', json) END,"
        " CASE WHEN prev IS NOT NULL THEN concat(',\"prev\":\"', prev, '\"') ELSE '' END,"
        " CASE WHEN corr IS NOT NULL THEN concat(',\"corr\":\"', corr, '\"') ELSE '' END,"
        " ',\"sig\":\"', SHA(concat('g', CAST(n AS TEXT))), substr(SHA(concat('h', CAST(n AS TEXT))), 1, 21), 'A\"}') END AS envelope"]),
    "trials": ("events", None, [
        "concat('A', lpad(CAST(event_id % 20 + 1 AS TEXT), 2, '0')) AS class", "event_id AS trial",
        "event_id % 13 <> 0 AS detected", "event_id % 5000 AS latency_ms",
        "CASE WHEN event_id % 13 <> 0 THEN concat('E', CAST(event_id % 20 + 1 AS TEXT))"
        " WHEN event_id % 26 = 0 THEN 'UNSIGNED_LEGACY' END AS observed",
        "CASE WHEN event_id % 37 = 0 THEN 'CLOCK_SKEW' WHEN event_id % 41 = 0 THEN 'STALE' END AS extra_alert",
        "event_id % 503 = 0 AS failed", "concat('setup ', CAST(event_id AS TEXT)) AS error"]),
}

# Writers the policy allows per tag. A short fixed list, so it is broadcast as literals.
POLICY = {
    "trust.score": ([f"did:x:{i}" for i in range(9)], True, False),
    "LLO-K8s": (["*"], False, False),
    "self-orchestrator": (["*"], False, False),
}


def policy_rows() -> list[tuple[str, list[str], bool, bool]]:
    return [(tag, allowed, sig, grace) for tag, (allowed, sig, grace) in POLICY.items()]


class Ledger:
    """The tables of one data folder, as DataFrames."""

    _cache: dict[tuple[str, str], Ledger] = {}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = prepare(spark), folder

    @classmethod
    def at(cls, spark: SparkSession, folder: str) -> Ledger:
        key = (spark.sparkContext.applicationId, folder)
        if key not in cls._cache:
            cls._cache[key] = cls(spark, folder)
        prepare(spark)
        return cls._cache[key]

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    def derive_messages(self) -> DataFrame:
        """The message table. What a message says of earlier ones is found on ids and times alone, two shuffles of a few numbers a
        row; hashes and texts are written out behind them. Ids are unique, so id ranges bound every chunk of an issuer's messages."""
        micros = "unix_micros(CAST(ts AS TIMESTAMP))"
        slim = [dialect(c, True).replace("MICROS", micros) for c in EVENT_COLUMNS if not c.endswith((" AS block_id", " AS verdict"))]
        verdict = dialect(next(c for c in EVENT_COLUMNS if c.endswith(" AS verdict")), True)
        e = self.events.selectExpr(*slim, verdict)
        e = e.withColumn("proven", F.expr(PROVEN)).drop("verdict").withColumn("_chunk", F.expr("n div 1048576"))
        s = self._with_earlier(e)
        s = ordered.rank_by(s, ["ms_index"], ordered.Order(("n",), "n"), "wf_index", sizes=e)
        block = "concat('0x', sha2(concat('b', CAST({} AS STRING)), 256))"
        s = s.withColumns({"block_id": F.expr(block.format("n")), "p1": F.expr(block.format("_n1")), "p2": F.expr(block.format("_n2")),
                           "verdict": F.expr(verdict.removesuffix(" AS verdict").replace("event_id", "n"))})
        return s.selectExpr(*[dialect(c, True) for c in MESSAGE_COLUMNS])

    @staticmethod
    def _with_earlier(e: DataFrame) -> DataFrame:
        """Add `seq`, a message's number among its issuer's, and `_n1`, `_n2`, the two ids before it among those as proven as it is.

        One shuffle by issuer and id range; what came before a range are the last two ids and the counts of the ranges before it."""
        by_n = lambda *keys: Window.partitionBy(*keys).orderBy("n")
        s = e.select("*", F.row_number().over(by_n("iss", "_chunk")).cast("bigint").alias("seq"))
        own = by_n("iss", "_chunk", "proven")
        s = s.select("*", F.lag("n", 1).over(own).alias("_l1"), F.lag("n", 2).over(own).alias("_l2"))
        kinds = ["iss", "proven", "_chunk"]
        ends = e.groupBy(*kinds).agg(F.count(F.lit(1)).alias("_count"), F.max("n").alias("_m1"))
        least = ends.select(*[F.col(k).alias(f"_r_{k}") for k in kinds], "_m1")
        second = (ordered._null_safe(e.select(*kinds, "n"), F.broadcast(least), [(k, f"_r_{k}") for k in kinds], "inner").filter("n < _m1")
                  .groupBy(*kinds).agg(F.max("n").alias("_m2")))
        ends = ordered._null_safe(ends, second.select(*[F.col(k).alias(f"_r_{k}") for k in kinds], "_m2"), [(k, f"_r_{k}") for k in kinds], "left")
        along = lambda *keys: Window.partitionBy(*keys).orderBy("_chunk")
        two = along("iss", "proven")
        carry = ends.select(*[F.col(k).alias(f"_r_{k}") for k in kinds], F.lag("_m1").over(two).alias("_c1"),
                            F.coalesce(F.lag("_m2").over(two), F.lag("_m1", 2).over(two)).alias("_c2"))
        counts = ends.groupBy("iss", "_chunk").agg(F.sum("_count").alias("_n"))
        before = counts.select(F.col("iss").alias("_r_iss"), F.col("_chunk").alias("_r__chunk"), (F.sum("_n").over(along("iss")) - F.col("_n")).alias("_before"))
        # both lists have a row or two per issuer and range of a million ids
        s = ordered._null_safe(s, F.broadcast(carry), [(k, f"_r_{k}") for k in kinds], "left")
        s = ordered._null_safe(s, F.broadcast(before), [("iss", "_r_iss"), ("_chunk", "_r__chunk")], "left")
        late = F.when(F.col("_l1").isNull(), F.col("_c2")).otherwise(F.col("_c1"))
        s = s.withColumns({"seq": F.expr("seq + _before - CASE WHEN n % 97 = 0 THEN 1 ELSE 0 END"),
                           "_n1": F.coalesce("_l1", "_c1"), "_n2": F.coalesce("_l2", late)})
        return s.select("n", "user_id", "event_type", "received_ms", "ms_index", "iss", "seq", "_n1", "_n2")

    @cached_property
    def messages(self) -> DataFrame:
        return settle(self.derive_messages(), "messages")

    @cached_property
    def users(self) -> DataFrame:
        return self.events.select("user_id").distinct()

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        source, where, exprs = TABLES[name]
        df = getattr(self, source)
        if where:
            df = df.filter(dialect(where, True))
        return df.selectExpr(*[dialect(x, True) for x in exprs])

    @property
    def alerts(self) -> DataFrame:
        return (self.verdict_alerts.unionByName(self.shadow_alerts).unionByName(self.unsigned_alerts)
                .unionByName(self.anchor_alerts))

    @property
    def milestones(self) -> DataFrame:
        """Every milestone up to the last one that confirmed a message, a few of them missing."""
        top = self.messages.agg(F.max("ms_index")).first()[0] or 0
        idx = self.spark.range(1, top + 1).toDF("idx")
        return idx.filter("idx % 1999 <> 0").selectExpr(
            "idx", f"{T0_S} + idx * 300 AS ts", "concat('0x', sha2(concat('m', idx), 256)) AS id",
            "concat('0x', sha2(concat('m', idx - 1 + CASE WHEN idx % 1511 = 0 THEN 1 ELSE 0 END), 256)) AS prev_id")

    @property
    def windows(self) -> DataFrame:
        """Milestones with their checkpoint window and place in it."""
        return self.milestones.selectExpr("*", f"(idx - 1) div {EVERY} + 1 AS seq", f"(idx - 1) % {EVERY} AS place")

    @property
    def window_roots(self) -> DataFrame:
        """Merkle root of every fully indexed window."""
        full = self.windows.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).filter(f"n = {EVERY}").select("seq")
        return merkle.roots(self.windows.join(full, "seq", "left_semi"), ["seq"], "place", "id")

    @property
    def anchors(self) -> DataFrame:
        """One anchor per window; every fifth root altered, and made up where milestones are missing."""
        spans = self.windows.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
        made_up = "concat('0x', sha2(concat('r', seq), 256))"
        return spans.join(self.window_roots.select("seq", "root"), "seq", "left").selectExpr(
            "seq", f"(seq - 1) * {EVERY} + 1 AS from_ms", f"seq * {EVERY} AS to_ms",
            f"CASE WHEN seq % 5 = 0 OR root IS NULL THEN {made_up} ELSE root END AS ms_root",
            "concat('0x', sha2(concat('h', seq), 256)) AS checkpoint_hash",
            "CASE WHEN seq % 7 = 0 THEN 'pending' ELSE 'anchored' END AS status", "seq * 10 AS record",
            f"({T0_S} + seq * {EVERY} * 300) * 1000 AS at_ms")

    @property
    def lifecycle(self) -> DataFrame:
        """Four transitions per submission; the third and fourth are missing for some."""
        steps = ("stack(4, 0, 'RECEIVED', 1, 'SUBMITTED', 2, 'CONFIRMED', 3, 'CONTENT_VERIFIED')"
                 " AS (step, status)")
        return (self.submissions.selectExpr("n", "sub_id", "block_id", "received_at_ms", steps)
                .filter("step < 2 OR n % 31 <> 0")
                .selectExpr("n * 4 + step AS id", "block_id", "sub_id", "status",
                            "received_at_ms + step * 250000 AS at_ms"))

    @property
    def policy(self) -> DataFrame:
        return self.spark.createDataFrame(
            policy_rows(), "tag string, allowed array<string>, require_signature boolean, legacy_grace boolean")

    @property
    def key_history(self) -> DataFrame:
        """Two keys per issuer's kid: the first one replaced mid-month; one issuer fully revoked."""
        issuers = self.messages.select("iss", "kid").distinct()
        mid = T0_MS + 15 * 86400000
        return issuers.selectExpr(
            "iss", "kid",
            f"stack(2, 0, {mid}, 1, CASE WHEN iss = 'did:x:7' THEN {mid + 86400000} END)"
            " AS (pos, revoked_at_ms)").selectExpr(
            "iss", "kid", "CAST(pos AS BIGINT) AS pos", "CAST(revoked_at_ms AS BIGINT) AS revoked_at_ms",
            "sha2(concat(kid, '/', pos), 256) AS public_key")


# -- the same tables for the oracle -------------------------------------------------------------

def _duck_select(source: str, where: str | None, exprs: list[str]) -> str:
    cols = ", ".join(dialect(x, False) for x in exprs)
    return f"SELECT {cols} FROM {source}" + (f" WHERE {dialect(where, False)}" if where else "")


def _hex_text(sql: str) -> str:
    return sql.replace("lower(hex(json))", "lower(hex(CAST(json AS BLOB)))")


DUCK: dict[str, tuple[tuple[str, ...], str]] = {
    "e0": ((), _duck_select("events", None, [c.replace("MICROS", "epoch_us(ts)") for c in EVENT_COLUMNS])),
    "messages": (("e0",), "SELECT " + ", ".join(dialect(c, False) for c in MESSAGE_COLUMNS) + f""" FROM (
        SELECT e0.*, CAST(row_number() OVER (PARTITION BY iss ORDER BY n)
            - CASE WHEN n % 97 = 0 THEN 1 ELSE 0 END AS BIGINT) AS seq,
          CAST(row_number() OVER (PARTITION BY ms_index ORDER BY n) - 1 AS BIGINT) AS wf_index,
          lag(block_id, 1) OVER (PARTITION BY iss, {PROVEN} ORDER BY n) AS p1,
          lag(block_id, 2) OVER (PARTITION BY iss, {PROVEN} ORDER BY n) AS p2 FROM e0)"""),
    "users": ((), "SELECT DISTINCT user_id FROM events"),
    "alerts": (("verdict_alerts", "shadow_alerts", "unsigned_alerts", "anchor_alerts"),
               "SELECT * FROM verdict_alerts UNION ALL SELECT * FROM shadow_alerts UNION ALL"
               " SELECT * FROM unsigned_alerts UNION ALL SELECT * FROM anchor_alerts"),
    "milestones": (("messages",), f"""SELECT idx, {T0_S} + idx * 300 AS ts,
        concat('0x', sha256(concat('m', CAST(idx AS VARCHAR)))) AS id,
        concat('0x', sha256(concat('m', CAST(idx - 1 + CASE WHEN idx % 1511 = 0 THEN 1 ELSE 0 END AS VARCHAR)))) AS prev_id
        FROM (SELECT unnest(generate_series(1, (SELECT max(ms_index) FROM messages))) AS idx) WHERE idx % 1999 <> 0"""),
    "lifecycle": (("submissions",), """SELECT n * 4 + step AS id, block_id, sub_id, status,
        received_at_ms + step * 250000 AS at_ms FROM submissions,
        (VALUES (0, 'RECEIVED'), (1, 'SUBMITTED'), (2, 'CONFIRMED'), (3, 'CONTENT_VERIFIED')) v(step, status)
        WHERE step < 2 OR n % 31 <> 0"""),
    "policy": ((), "SELECT * FROM (VALUES " + ", ".join(
        f"('{t}', [{', '.join(repr(x) for x in a)}], {s}, {g})" for t, a, s, g in policy_rows())
        + ") p(tag, allowed, require_signature, legacy_grace)"),
    "key_history": (("messages",), f"""SELECT iss, kid, CAST(pos AS BIGINT) AS pos,
        CASE WHEN pos = 0 THEN {T0_MS + 15 * 86400000}
             WHEN iss = 'did:x:7' THEN {T0_MS + 16 * 86400000} END AS revoked_at_ms,
        sha256(concat(kid, '/', CAST(pos AS VARCHAR))) AS public_key
        FROM (SELECT DISTINCT iss, kid FROM messages), (VALUES (0), (1)) v(pos)"""),
}
DUCK["windows"] = (("milestones",), f"SELECT *, (idx - 1) // {EVERY} + 1 AS seq, (idx - 1) % {EVERY} AS place FROM milestones")


def duck_levels(name: str, leaves: str, levels: int) -> None:
    """Tables `<name>_0` … holding each level of the trees over `leaves` (w, pos, id), and `<name>_root`."""
    DUCK[f"{name}_0"] = ((), f"SELECT w, pos, sha256(unhex(concat('00', substr(id, 3)))) AS h FROM ({leaves})")
    for i in range(levels):
        DUCK[f"{name}_{i + 1}"] = ((f"{name}_{i}",), f"""SELECT w, pos // 2 AS pos, CASE WHEN count(*) = 2
            THEN sha256(unhex(concat('01', arg_min(h, pos), arg_max(h, pos)))) ELSE min(h) END AS h
            FROM {name}_{i} GROUP BY w, pos // 2""")
    DUCK[f"{name}_root"] = ((f"{name}_{levels}",), f"SELECT w, concat('0x', h) AS root FROM {name}_{levels}")


duck_levels("wtree", f"SELECT seq AS w, place AS pos, id FROM windows WHERE seq IN (SELECT seq FROM windows GROUP BY seq HAVING count(*) = {EVERY})", 10)
DUCK["wtree_0"] = (("windows",), DUCK["wtree_0"][1])
duck_levels("ctree", "SELECT ms_index AS w, wf_index AS pos, block_id AS id FROM messages", 9)
DUCK["ctree_0"] = (("messages",), DUCK["ctree_0"][1])
DUCK["anchors"] = (("windows", "wtree_root"), f"""SELECT seq, (seq - 1) * {EVERY} + 1 AS from_ms, seq * {EVERY} AS to_ms,
    CASE WHEN seq % 5 = 0 OR root IS NULL THEN concat('0x', sha256(concat('r', CAST(seq AS VARCHAR)))) ELSE root END AS ms_root,
    concat('0x', sha256(concat('h', CAST(seq AS VARCHAR)))) AS checkpoint_hash,
    CASE WHEN seq % 7 = 0 THEN 'pending' ELSE 'anchored' END AS status, seq * 10 AS record, ({T0_S} + seq * {EVERY} * 300) * 1000 AS at_ms
    FROM (SELECT DISTINCT seq FROM windows) LEFT JOIN (SELECT w AS seq, root FROM wtree_root) USING (seq)""")
for _name, (_source, _where, _exprs) in TABLES.items():
    _needs = () if _source == "events" else (_source,)
    DUCK[_name] = (_needs, _hex_text(_duck_select(_source, _where, _exprs)))


def oracle(sql: str, *tables: str) -> str:
    """`sql` over the named ledger tables, as one DuckDB statement on the driver's views."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order or name not in DUCK:
            return
        for dep in DUCK[name][0]:
            need(dep)
        order.append(name)

    for t in tables:
        need(t)
    for t in DUCK:
        if re.search(rf"\b{t}\b", sql):
            need(t)
    head = ", ".join(f"{t} AS ({DUCK[t][1]})" for t in order)
    body = sql.strip()
    if re.match(r"WITH\s", body, re.I):
        recursive = bool(re.match(r"WITH\s+RECURSIVE", body, re.I))
        body = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}, {body}" if head else sql
    return f"WITH {head} {body}" if head else body
