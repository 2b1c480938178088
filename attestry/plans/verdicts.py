"""One verdict per message, and the admission screening of submissions.

The order of the tests is fixed: depth, envelope, shape, tag and key binding, signature, revocation,
writer policy, replay, body schema. `sig_ok` and `too_deep` are input columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocabulary as V
from ..operators import documents, graph, keys, ordered
from ..session import settle

def place() -> Column:
    return F.struct("ms_index", "wf_index", "block_id")


def earlier_uses(messages: DataFrame) -> DataFrame:
    """Messages whose seq or nonce a proven message of the issuer had used before: the first block that did (`earlier`;
    the seq's before the nonce's) and why, as an array of `seq` and `nonce`."""
    proven = messages.filter(C.proven(F.col("verdict")))
    first = {c: proven.filter(F.col(c).isNotNull()).groupBy("iss", c).agg(F.min(place()).alias(f"_{c}")) for c in ("seq", "nonce")}
    before = {c: F.when(F.col(f"_{c}") < place(), F.col(f"_{c}.block_id")) for c in first}
    seen = messages.join(first["seq"], ["iss", "seq"], "left").join(first["nonce"], ["iss", "nonce"], "left")
    why = F.array_compact(F.array(*[F.when(before[c].isNotNull(), F.lit(c)) for c in first]))
    return (seen.withColumn("earlier", F.coalesce(*before.values())).withColumn("reasons", why).filter("earlier IS NOT NULL")
            .drop("_seq", "_nonce"))


def _decided_in_order(undecided: DataFrame) -> DataFrame:
    """Those accepted when messages are taken in order: the messages of a component, which share seqs and nonces with each other
    only, are streamed through one pass that remembers what the accepted ones spent."""
    ends = {"_by_seq": F.xxhash64(F.lit("s"), "iss", "seq", "_own"), "_by_nonce": F.xxhash64(F.lit("n"), "iss", "nonce")}
    rows = undecided.withColumns(ends)  # two keys with one hash only make a component larger
    parts = graph.components(rows.filter("nonce IS NOT NULL"), "_by_seq", "_by_nonce").select(F.col("node").alias("_by_seq"), "component")
    rows = rows.join(parts, "_by_seq", "left").withColumn("component", F.coalesce("component", "_by_seq"))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, spent = None, set()
        for pdf in batches:
            keep = []
            for component, iss, seq, own, nonce in zip(*(pdf[c] for c in ("component", "iss", "seq", "_own", "nonce"))):
                if component != here:
                    here, spent = component, set()
                keys = {(iss, seq, own), *([(iss, nonce)] if isinstance(nonce, str) else [])}
                keep.append(not keys & spent)
                if keep[-1]:
                    spent |= keys
            yield pdf.loc[keep, ["block_id"]]

    order = ("component", "ms_index", "wf_index", "block_id")
    kept = rows.select(*order, "iss", "seq", "_own", "nonce").repartition("component").sortWithinPartitions(*order).mapInPandas(decide, "block_id string")
    return settle(undecided.join(kept, "block_id", "left_semi"), "accepted")


def resolve_replays(candidates: DataFrame) -> DataFrame:
    """Which candidates repeat a seq or nonce an accepted earlier one of the same issuer spent.

    candidates: block_id, iss, seq, nonce, ms_index, wf_index, spends. Returns the replays with
    `seq_used_by` and `nonce_used_by`.

    The rule is sequential: a message is accepted if no accepted one before it has its seq or its nonce. Two rounds of two aggregates
    each, combined before the shuffle, settle groups of copies of any size: the first undecided message of both its seq and its nonce is
    accepted, whatever shares either with it is not. What is left are chains in which each decision hangs on the one before; they fall
    into components of messages that share keys, and each component is decided in one ordered pass. However long a chain is, the number
    of rounds is that of finding components, which is logarithmic.
    """
    slim = candidates.select("block_id", "iss", "seq", "nonce", "ms_index", "wf_index", "spends")
    two = F.count(F.lit(1)) > 1
    dup_seq = slim.groupBy("iss", "seq").agg(two.alias("_d")).filter("_d").drop("_d")
    dup_nonce = slim.filter("nonce IS NOT NULL").groupBy("iss", "nonce").agg(two.alias("_d")).filter("_d").drop("_d")
    colliding = slim.join(dup_seq.withColumn("_s", F.lit(True)), ["iss", "seq"], "left").join(
        dup_nonce.withColumn("_n", F.lit(True)), ["iss", "nonce"], "left").filter("_s OR _n").drop("_s", "_n")
    # a message without issuer spends nothing; one without seq is judged by its nonce alone: a seq of its own stands in
    colliding = colliding.filter("iss IS NOT NULL").withColumn("_own", F.when(F.col("seq").isNull(), F.col("block_id")))
    colliding = settle(colliding.withColumn("seq", F.coalesce("seq", F.lit(-1).cast("bigint"))).withColumn("_own", F.coalesce("_own", F.lit("")))
                       .withColumn("place", place()), "colliding")
    undecided, parts = colliding.filter("spends"), []
    for _ in range(2):
        by_seq = undecided.groupBy("iss", "seq", "_own").agg(F.min("place").alias("_s"))
        by_nonce = undecided.filter("nonce IS NOT NULL").groupBy("iss", "nonce").agg(F.min("place").alias("_n"))
        ranked = undecided.join(by_seq, ["iss", "seq", "_own"]).join(by_nonce, ["iss", "nonce"], "left")
        first = (F.col("place") == F.col("_s")) & (F.col("nonce").isNull() | (F.col("place") == F.col("_n")))
        now = settle(ranked.filter(first).select("block_id", "iss", "seq", "_own", "nonce", "place"), "accepted")
        rest = (undecided.join(now.select("iss", "seq", "_own"), ["iss", "seq", "_own"], "left_anti")
                .join(now.filter("nonce IS NOT NULL").select("iss", "nonce"), ["iss", "nonce"], "left_anti"))
        undecided = settle(rest.select(*undecided.columns), "undecided")
        parts.append(now)
        if undecided.isEmpty():
            break
    else:
        parts.append(_decided_in_order(undecided).select(*parts[0].columns))
    accepted = reduce(DataFrame.unionByName, parts)
    s = accepted.select("iss", "seq", "_own", F.col("place").alias("_s"))
    n = accepted.filter("nonce IS NOT NULL").select("iss", "nonce", F.col("place").alias("_n"))
    df = colliding.join(s, ["iss", "seq", "_own"], "left").join(n, ["iss", "nonce"], "left")
    used = lambda c: F.when(F.col(c) < F.col("place"), F.col(f"{c}.block_id"))
    return (df.select("block_id", used("_s").alias("seq_used_by"), used("_n").alias("nonce_used_by"))
            .filter("seq_used_by IS NOT NULL OR nonce_used_by IS NOT NULL"))


def opened(messages: DataFrame, data: str = "data", kinds: dict[str, str] | None = None) -> DataFrame:
    """Parse each message once: its envelope's fields, its body and whether the body fits the schema."""
    m = F.col("_m")
    df = C.with_fields(messages, data, "_m")
    env = C.is_envelope(m)
    text = lambda n: F.when(C.is_text(m[n]), C.at(m[n], "$", "string"))
    df = df.select(
        *messages.columns, env.alias("is_env"), C.kind_of(F.col("tag"), m.isNotNull(), kinds).alias("kind_read"),
        F.when(env, C.envelope_problem(m)).alias("shape"), F.coalesce(C.is_sealed(m), F.lit(False)).alias("sealed"),
        text("tag").alias("env_tag"), text("iss").alias("env_iss"), text("kid").alias("env_kid"),
        C.at(m["seq"], "$", "bigint").alias("env_seq"), C.at(m["iat"], "$", "bigint").alias("env_iat"), text("nonce").alias("env_nonce"),
        C.at(m["att"], "$.mode", "string").alias("att_mode"), F.when(env, C.fields(m["body"])).otherwise(m).alias("_body"))
    fits = C.body_fits(F.col("kind_read"), F.col("_body"))
    body_ok = F.when(F.col("sealed"), True).when(F.col("is_env"), F.col("_body").isNotNull() & fits).otherwise(fits)
    return df.withColumn("schema_ok", body_ok).drop("_body")


def judge(messages: DataFrame, policy: DataFrame, key_history: DataFrame, *, data: str = "data",
          kinds: dict[str, str] | None = None) -> DataFrame:
    """Add `verdict` and `reason` to block_id, tag, data, ms_index, wf_index, ts, sig_ok, too_deep."""
    read = opened(messages, data, kinds).withColumnRenamed("env_kid", "kid").withColumnRenamed("env_iss", "iss")
    history = key_history.select("kid", "pos", "revoked_at_ms", "public_key")
    df = keys.in_force(read, history, (F.col("ts") + 1) * 1000)  # a second counts to its end, as in the revocation test below
    df = documents.with_writer_rule(df, policy)
    known_tag = F.col("tag").isin(*(kinds or V.KIND_OF_TAG))
    tests = [
        (F.col("too_deep"), "MALFORMED", F.lit("deeper than can be parsed")),
        (~F.col("is_env") & (F.col("kind_read") == V.UNKNOWN_KIND) & known_tag, "MALFORMED", F.lit("a JSON object was expected")),
        (~F.col("is_env"), V.UNSIGNED, F.lit(None).cast("string")),
        (F.col("shape").isNotNull(), "MALFORMED", F.col("shape")),
        (F.col("env_tag") != F.col("tag"), "FORGED", F.lit("the envelope names another tag")),
        (F.substring_index("kid", "#", 1) != F.col("iss"), "FORGED", F.lit("the key is of another issuer")),
        (F.col("public_key").isNull(), "FORGED", F.lit("no key is known under this id")),
        (~F.coalesce("sig_ok", F.lit(False)), "FORGED", F.lit("bad signature")),
        (~C.valid_through_second(F.col("revoked_at_ms"), F.col("ts")), "REVOKED_KEY", F.lit("the key was revoked by then")),
        (~F.col("may_write"), "UNAUTHORIZED_WRITER", F.lit("the policy does not let this issuer write the tag")),
    ]
    early = None
    for bad, verdict, reason in tests:
        value = F.struct(F.lit(verdict).alias("verdict"), reason.alias("reason"))
        early = F.when(bad, value) if early is None else early.when(bad, value)
    df = settle(df.withColumn("_early", early).select(
        *messages.columns, "iss", "kid", F.col("env_seq").alias("seq"), F.col("env_iat").alias("iat"), F.col("env_nonce").alias("nonce"),
        "att_mode", "schema_ok", "_early"), "judged")
    replays = resolve_replays(df.filter("_early IS NULL").withColumn("spends", F.col("schema_ok")))
    out = df.join(replays, "block_id", "left")
    spent = F.col("seq_used_by").isNotNull() | F.col("nonce_used_by").isNotNull()
    why = F.when(F.col("seq_used_by").isNotNull(), F.concat(F.lit("seq "), F.col("seq").cast("string"), F.lit(" already used by "), "seq_used_by")
                 ).otherwise(F.concat(F.lit("nonce already used by "), "nonce_used_by"))
    signed = F.when(F.col("att_mode") == "producer", "PRODUCER_SIGNED").otherwise("RELAY_ATTESTED")
    verdict = (F.when(F.col("_early").isNotNull(), F.col("_early.verdict")).when(spent, "REPLAY")
               .when(~F.col("schema_ok"), "MALFORMED").otherwise(signed))
    reason = (F.when(F.col("_early").isNotNull(), F.col("_early.reason")).when(spent, why)
              .when(~F.col("schema_ok"), F.lit("signed, but the body breaks the schema")))
    return out.withColumn("verdict", verdict).withColumn("reason", reason).drop("_early")


def _admitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by issuer and arrival, each above the mark of its time: those with a new nonce and a seq above all before."""
    here, top, spent = None, None, set()
    for pdf in batches:
        keep = []
        for iss, nonce, seq in zip(pdf["iss"], pdf["nonce"], pdf["seq"]):
            if iss != here:
                here, top, spent = iss, None, set()
            good = nonce not in spent and (top is None or seq > top)
            if good:
                top = top if pd.isna(seq) else seq
                spent.add(nonce)
            keep.append(good)
        yield pdf.loc[keep, ["iss", "nonce", "received_at_ms", "sub_id"]]


def screen(submissions: DataFrame, policy: DataFrame, *, as_of_ms: int, relay_iss: str | None = None) -> DataFrame:
    """Decision per submitted envelope, in arrival order: accepted, or the verdict it would get and why.

    submissions: sub_id, received_at_ms, tag, iss, seq, nonce, early (verdict of the envelope checks or
    null), revoked_at_ms, schema_ok. An issuer's seq must exceed every accepted one before it, and a nonce
    must be new among accepted ones.

    A message that takes no spent nonce raises the mark that later seqs must exceed, accepted or not; so the marks of all nonces
    that occur once come from one ordered scan. Of repeated nonces only messages above that mark can be accepted, and of those with
    one nonce and seq only the first: these few are decided in one ordered pass per issuer. Nothing is repeated.
    """
    df = documents.with_writer_rule(submissions, policy)
    early = (F.when(F.col("early").isNotNull(), F.col("early"))
             .when(F.col("revoked_at_ms") <= as_of_ms, "REVOKED_KEY")
             .when(F.col("iss") == F.lit(relay_iss), "REPLAY").when(~F.col("may_write"), "UNAUTHORIZED_WRITER"))
    rows = settle(df.withColumn("_early", early).withColumn("_place", F.struct("received_at_ms", "sub_id")), "screened")
    order = ordered.Order(("received_at_ms", "sub_id"), "received_at_ms")
    open_rows = rows.filter("_early IS NULL")
    repeated = (open_rows.filter("iss IS NOT NULL AND nonce IS NOT NULL").groupBy("iss", "nonce").agg(F.count(F.lit(1)).alias("_n"))
                .filter("_n > 1").select("iss", "nonce", F.lit(True).alias("_repeated")))
    live = open_rows.join(repeated, ["iss", "nonce"], "left").withColumn("_repeated", F.coalesce("_repeated", F.lit(False)))
    marked = ordered.scan(live, ["iss"], order, {"_mark": ordered.running_max(F.col("seq"), F.col("schema_ok") & ~F.col("_repeated"))})
    may = marked.filter(F.col("_repeated") & F.col("schema_ok") & (F.col("_mark").isNull() | (F.col("seq") > F.col("_mark"))))
    first = may.groupBy("iss", "nonce", "seq").agg(F.min("_place").alias("_f")).select("iss", "nonce", "seq", "_f.*")
    kept = (first.repartition("iss").sortWithinPartitions("iss", "received_at_ms", "sub_id").mapInPandas(_admitted, first.select("iss", "nonce", "received_at_ms", "sub_id").schema))
    spender = settle(kept, "spenders").select("iss", "nonce", F.struct("received_at_ms", "sub_id").alias("_first"))
    spent = open_rows.join(spender, ["iss", "nonce"]).filter("_first < _place").select("sub_id")
    live = documents.flag(open_rows, "sub_id", spent, "_spent")
    seen = ordered.scan(live, ["iss"], order, {"_top": ordered.running_max(F.col("seq"), F.col("schema_ok") & ~F.col("_spent"))})
    newer = F.col("_top").isNull() | (F.col("seq") > F.col("_top"))
    late = seen.withColumn("_late", ~newer).select("sub_id", "_late", "_spent")
    out = rows.join(late, "sub_id", "left")
    verdict = (F.when(F.col("_early").isNotNull(), F.col("_early")).when(F.col("_late") | F.col("_spent"), "REPLAY")
               .when(~F.col("schema_ok"), "MALFORMED"))
    return out.select(*submissions.columns, verdict.isNull().alias("accepted"), verdict.alias("refused_as"))
