"""Readers: submission records, context entities, component relationships, trial logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocabulary as V

RECORD_KEYS = ("subId", "receivedAtMs", "tag", "message", "dataHex", "blockId", "status", "relay")
BYTES_HEX = r"^0x(?:[0-9a-fA-F]{2})*$"
BLOCK_HEX = r"^0x[0-9a-fA-F]{64}$"


def parse_submissions(lines: DataFrame, source: str | Column, text: str = "value", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Submission records (JSON texts, batch or stream) as submission rows, and the rejected ones with a reason.

    Every key must be present with its type; hex fields are whole bytes; a block id implies the bytes sent.
    Columns of `lines` named in `keep` go along with the rows. Do not join the rows for them: Spark takes the maps they are read
    from for large and the rows for a twentieth of their size, and broadcasts millions of them.
    """
    df = (C.with_fields(lines, text, "_m").withColumn("_relay", C.fields(F.col("_m")["relay"]))
          .withColumn("source", F.lit(source) if isinstance(source, str) else source))
    m, relay = F.col("_m"), F.col("_relay")
    null = lambda x: x.isNull() | (C.json_type(x) == "VOID")
    number = lambda x: C.at(x, "$", "bigint")
    t = lambda x: C.at(x, "$", "string")
    tests = [
        (~F.col("source").isin("mqtt", "http"), "unknown source"),
        (m.isNull(), "submission record must be a JSON object"),
        (F.size(F.array_except(F.array(*[F.lit(k) for k in RECORD_KEYS]), F.map_keys(m))) > 0, "submission record misses a field"),
        (~C.is_text(m["subId"]), "subId must be a string"),
        (t(m["subId"]) == "", "subId must not be empty"),
        (~C.is_integer(m["receivedAtMs"]), "receivedAtMs must be an integer"),
        (number(m["receivedAtMs"]) < 0, "receivedAtMs must not be negative"),
        (~C.is_text(m["tag"]), "tag must be a string"),
        (~null(m["dataHex"]) & ~C.matches(m["dataHex"], BYTES_HEX), "dataHex must be 0x-prefixed hex of whole bytes"),
        (~null(m["blockId"]) & ~C.matches(m["blockId"], BLOCK_HEX), "blockId must be 0x followed by 64 hex digits"),
        (~null(m["blockId"]) & null(m["dataHex"]), "a record with a blockId must carry the dataHex that was sent"),
        (relay.isNull(), "relay must be an object"),
        (~null(m["status"]) & ~C.is_integer(m["status"]), "status must be an integer"),
        *[(~null(relay[n]) & ~C.is_text(relay[n]), f"relay.{n} must be a string") for n in ("verdict", "iss")],
        (~null(relay["seq"]) & ~C.is_integer(relay["seq"]), "relay.seq must be an integer"),
    ]
    df = df.withColumn("problem", C.first_problem(tests))
    bad = df.filter("problem IS NOT NULL").select(text, "source", "problem")
    posted = C.parsed(F.unhex(F.substr(t(m["dataHex"]), F.lit(3))).cast("string"))
    sealed = F.coalesce(C.at(m["messageSealed"], "$", "boolean"), F.lit(False)) | C.relay_sealed(posted, m["message"])
    good = df.filter("problem IS NULL").select(
        t(m["subId"]).alias("sub_id"), F.lower(t(m["blockId"])).alias("block_id"), number(m["receivedAtMs"]).alias("received_at_ms"),
        "source", t(m["tag"]).alias("tag"), F.when(~null(m["message"]) & ~sealed, F.to_json(m["message"])).alias("message_json"),
        F.lower(t(m["dataHex"])).alias("data_hex"), number(m["status"]).alias("node_status"),
        t(relay["verdict"]).alias("relay_verdict"), t(relay["iss"]).alias("iss"), number(relay["seq"]).alias("seq"), *keep)
    return good, bad


def context_entities(lines: DataFrame, text: str = "value") -> DataFrame:
    """Context entities: id, element id, domain and score, in normalized or key-value form."""
    df = lines.select(C.parsed(F.col(text)).alias("_v")).filter(C.filled_text(C.at(F.col("_v"), "$.id")))
    v = F.col("_v")
    raw = C.at(v, "$.trustScore")
    value = F.when(C.is_object(raw), C.at(v, "$.trustScore.value")).otherwise(raw)
    ie = C.strip_urn(C.at(v, "$.id", "string"))
    return df.select(C.at(v, "$.id", "string").alias("entity_id"), ie.alias("ie_id"),
                     F.when(F.contains(ie, F.lit(":")), F.split_part(ie, F.lit(":"), F.lit(1))).otherwise("").alias("domain"),
                     F.when(C.is_number(value), C.at(value, "$", "double")).alias("trust_score"),
                     F.to_json(raw).alias("raw_score"))


def component_hosts(lines: DataFrame, text: str = "value", attribute: str = "infrastructureElement") -> DataFrame:
    """Component id to the element it runs on: a text, an object, a value or an embedded entity."""
    v = F.col("_v")
    df = lines.select(C.parsed(F.col(text)).alias("_v")).filter(C.filled_text(C.at(v, "$.id")))
    a = C.at(v, f"$.{attribute}")
    keys = C.fields_of(a)
    inner = F.when(~C.is_object(a), a)
    for name in ("object", "value", "id"):
        inner = inner.when(F.array_contains(keys, name), C.at(v, f"$.{attribute}.{name}"))
    df = df.select("_v", inner.alias("_t"))
    target = F.when(C.is_object(F.col("_t")), C.at(F.col("_t"), "$.id")).otherwise(F.col("_t"))
    df = df.select(C.at(v, "$.id", "string").alias("component"), target.alias("_t"))
    host = C.strip_urn(C.at(F.col("_t"), "$", "string"))
    return df.filter(C.filled_text(F.col("_t"))).select("component", C.component_key(F.col("component")).alias("component_key"), host.alias("host_ie"))


def trial_log(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A log of trials (JSON lines) as attack rows, control rows, and not-run classes with their first error."""
    v = C.parsed(F.col(text))
    t = lambda p: C.at(F.col("_v"), f"$.{p}", "string")
    df = lines.select(v.alias("_v")).select(
        t("class").alias("class"), t("control").alias("control"), C.at(F.col("_v"), "$.trial", "bigint").alias("trial"),
        t("status").alias("status"), t("error").alias("error"), C.at(F.col("_v"), "$.detected", "boolean").alias("detected"),
        t("observed").alias("observed"), C.at(F.col("_v"), "$.latency_ms", "bigint").alias("latency_ms"))
    failed = F.coalesce(F.col("status") == "error", F.lit(False))
    attacks = df.filter(F.col("class").isNotNull() & ~failed)
    control = df.filter("control IS NOT NULL")
    skipped = (df.filter(F.col("class").isNotNull() & failed).groupBy("class")
               .agg(F.count(F.lit(1)).alias("trials"), F.min_by("error", "trial").alias("error")))
    return attacks, control, skipped


def mirrored_anchors(messages: DataFrame, anchor_tag: str, pinned_iss: str) -> tuple[DataFrame, DataFrame]:
    """Anchors announced by well-formed, producer-signed messages of the pinned issuer, first per seq;
    and the later ones that announce another hash under a known seq. Anchors carry the checkpoint's fields, so an audit can hash them."""
    v = F.col("_v")
    rows = (messages.filter((F.col("tag") == anchor_tag) & (F.col("verdict") == "PRODUCER_SIGNED") & (F.col("iss") == pinned_iss))
            .withColumn("_v", C.parsed(F.col("json"))))
    rows = C.with_fields(rows, "json", "_m").filter(C.body_fits(F.lit(V.ANCHOR_KIND), F.col("_m")))
    place = F.struct("ms_index", "wf_index", "block_id")
    seen = rows.select(
        C.at(v, "$.seq", "bigint").alias("seq"), C.at(v, "$.checkpoint.from.index", "bigint").alias("from_ms"),
        C.at(v, "$.checkpoint.to.index", "bigint").alias("to_ms"), C.at(v, "$.checkpoint.msRoot", "string").alias("ms_root"),
        C.at(v, "$.checkpointHash", "string").alias("checkpoint_hash"), C.at(v, "$.rebased.record", "bigint").alias("record"),
        C.at(v, "$.checkpoint.from.id", "string").alias("from_id"), C.at(v, "$.checkpoint.to.id", "string").alias("to_id"),
        *[C.at(v, f"$.checkpoint.{p}", "string").alias(c) for p, c in (("network", "network"), ("domain", "domain"), ("policyHash", "policy_hash"), ("prev", "prev"))],
        C.at(v, "$.checkpoint.msgCount", "bigint").alias("msg_count"),
        F.lit("anchored").alias("status"), (F.col("ts") * 1000).alias("created_at_ms"), "block_id", place.alias("_place"))
    first = seen.groupBy("seq").agg(F.min_by(F.struct(*[c for c in seen.columns if c != "seq"]), "_place").alias("f"))
    anchors = first.select("seq", "f.*").drop("_place")
    clash = (seen.join(first.select("seq", F.col("f.checkpoint_hash").alias("known")), "seq")
             .filter("checkpoint_hash <> known")
             .select("seq", "block_id", F.col("known").alias("stored_hash"), F.col("checkpoint_hash").alias("mirror_hash")))
    return anchors, clash
