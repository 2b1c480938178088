"""Checkpoint windows and anchors: building, chaining, auditing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import vocabulary as V
from ..session import settle
from . import merkle, ordered, ranges

CHECKPOINT_FIELDS = ("network", "domain", "from_ms", "from_id", "to_ms", "to_id", "ms_root", "msg_count", "policy_hash", "prev")


def windows(milestones: DataFrame, start: int = 1, every: int = V.CHECKPOINT_EVERY) -> DataFrame:
    """Windows of `every` milestones from `start`: only those with every index once and distinct ids."""
    w = F.floor((F.col("idx") - start) / every)
    df = milestones.filter(F.col("idx") >= start).withColumn("window", w)
    return (df.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("idx").alias("indexes"),
                                     F.count_distinct("id").alias("ids"))
            .filter(f"n = {every} AND indexes = {every} AND ids = {every}")
            .select("window", (F.col("window") * every + start).alias("from_ms"), ((F.col("window") + 1) * every + start - 1).alias("to_ms")))


def checkpoints(milestones: DataFrame, messages: DataFrame, *, network: str, domain: str, policy_hash: str,
                start: int = 1, every: int = V.CHECKPOINT_EVERY) -> DataFrame:
    """The checkpoint of each complete window: ends, root, message count. `chained` adds `prev` and `checkpoint_hash`."""
    full = windows(milestones, start, every)
    df = milestones.withColumn("window", F.floor((F.col("idx") - start) / every)).join(full, "window")
    tree = merkle.roots(df.withColumn("place", F.col("idx") - F.col("from_ms")), ["window"], "place", "id")
    ends = df.groupBy("window", "from_ms", "to_ms").agg(F.min_by("id", "idx").alias("from_id"), F.max_by("id", "idx").alias("to_id"))
    counted = (messages.filter(F.col("ms_index") >= start).groupBy(F.floor((F.col("ms_index") - start) / every).alias("window"))
               .agg(F.count(F.lit(1)).alias("msg_count")))
    return (ends.join(tree.select("window", F.col("root").alias("ms_root")), "window").join(counted, "window", "left")
            .withColumn("msg_count", F.coalesce("msg_count", F.lit(0).cast("bigint")))
            .withColumn("network", F.lit(network)).withColumn("domain", F.lit(domain)).withColumn("policy_hash", F.lit(policy_hash)))


def _parts(doc_kind: str) -> tuple[Column, Column]:
    """The canonical JSON of a checkpoint up to and after the value of `prev`: the keys are sorted, so only policyHash lies
    between `network` and it."""
    plain = lambda c: F.when(F.col(c).isNotNull(), F.regexp_replace(H.canonical_text(F.to_json(F.array(F.col(c)))), r"^\[|\]$", ""))
    number = lambda c: F.col(c).cast("bigint").cast("string")
    bound = lambda i, n: F.concat(F.lit('{"id":'), plain(i), F.lit(',"index":'), number(n), F.lit("}"))
    head = F.concat(F.lit('{"domain":'), plain("domain"), F.lit(',"from":'), bound("from_id", "from_ms"), F.lit(f',"kind":"{doc_kind}","msRoot":'),
                    plain("ms_root"), F.lit(',"msgCount":'), number("msg_count"), F.lit(',"network":'), plain("network"), F.lit(',"policyHash":'),
                    plain("policy_hash"), F.lit(',"prev":'))
    return head, F.concat(F.lit(',"to":'), bound("to_id", "to_ms"), F.lit(',"v":1}'))


def checkpoint_hash(doc_kind: str, algorithm: str = "sha256") -> Column:
    """The hash of a checkpoint's canonical fields (CHECKPOINT_FIELDS) under a document kind, plain letters and dots; null if a field but `prev` is missing."""
    head, tail = _parts(doc_kind)
    prev = F.coalesce(F.concat(F.lit('"'), "prev", F.lit('"')), F.lit("null"))
    return F.concat(F.lit("0x"), H.hash_hex(F.concat(head, prev, tail), algorithm))


def chained(checkpoints_: DataFrame, doc_kind: str, *, first_prev: str | None = None, algorithm: str = "sha256") -> DataFrame:
    """Add `prev`, the hash of the checkpoint before (of the first one `first_prev`), and `checkpoint_hash`, which commits to it.

    Every hash needs the one before, so one task folds over the sorted rows: a row per window, of a few hundred bytes, read
    batch by batch. The result is written once."""
    if algorithm not in ("sha256", "blake2b"):
        raise ValueError(f"unknown hash {algorithm!r}")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev = first_prev
        for rows in batches:
            links = []
            for head, tail in zip(rows["head"], rows["tail"]):
                if head is None or tail is None:
                    raise ValueError("a checkpoint lacks a field")
                data = f"{head}{'null' if prev is None else chr(34) + prev + chr(34)}{tail}".encode()
                digest = hashlib.sha256(data) if algorithm == "sha256" else hashlib.blake2b(data, digest_size=32)
                links.append((prev, "0x" + digest.hexdigest()))
                prev = links[-1][1]
            yield pd.DataFrame({"window": rows["window"], "prev": [a for a, _ in links], "checkpoint_hash": [b for _, b in links]})

    head, tail = _parts(doc_kind)
    checkpoints_ = settle(checkpoints_, "checkpoints")  # read twice, and its trees must not be built twice
    kind = checkpoints_.schema["window"].dataType.simpleString()
    links = checkpoints_.select("window", head.alias("head"), tail.alias("tail")).coalesce(1).sortWithinPartitions("window").mapInPandas(fold, f"window {kind}, prev string, checkpoint_hash string")
    return checkpoints_.join(settle(links, "checkpoint-chain"), "window")


def chain_breaks(anchors: DataFrame) -> DataFrame:
    """Whether each anchor's `prev_hash` is the hash of the anchor with the next lower seq, however far below; the first has none.

    An ordered scan over one constant key: anchors beyond the hot-group limit are cut like any other group."""
    one = anchors.withColumn("_all", F.lit(0)).withColumn("_seq", F.col("seq").cast("bigint"))
    seen = ordered.scan(one, ["_all"], ordered.Order(("_seq",), "_seq"), {"_before": ordered.last(F.struct("checkpoint_hash"))})
    return seen.withColumn("linked", F.when(F.col("_before").isNotNull(), F.col("prev_hash").eqNullSafe(F.col("_before.checkpoint_hash")))
                           .otherwise(F.col("prev_hash").isNull())).drop("_before", "_all", "_seq")


def audit(anchors: DataFrame, records: DataFrame, milestones: DataFrame, every: int = V.CHECKPOINT_EVERY, algorithm: str = "sha256",
          doc_kind: str | None = None) -> DataFrame:
    """Anchor states: the mirrored hash against the record's, and the recomputed root against the record's. With `doc_kind`, the records
    carry all of CHECKPOINT_FIELDS and their hash is recomputed too: a record that does not hash to what it states is a mismatch.

    records: seq, from_ms, to_ms, ms_root, checkpoint_hash. What a record claims is not believed: only a range of which every
    milestone is stored is ever listed, and its tree built."""
    tree = merkle.roots(ranges.members(ranges.complete(records, milestones), milestones), ["seq"], "place", "id")
    altered = F.lit(False) if doc_kind is None else ~checkpoint_hash(doc_kind, algorithm).eqNullSafe(F.col("checkpoint_hash"))
    df = (anchors.select("seq", F.col("checkpoint_hash").alias("mirror_hash"))
          .join(records.select("seq", "from_ms", "to_ms", F.col("ms_root").alias("record_root"), F.col("checkpoint_hash").alias("record_hash"),
                               altered.alias("altered")), "seq", "left")
          .join(tree.select("seq", F.col("root").alias("recomputed_root")), "seq", "left"))
    differs = F.col("mirror_hash").isNotNull() & (F.col("mirror_hash") != F.col("record_hash"))
    state = (F.when(F.col("record_root").isNull(), "unverifiable")
             .when(F.col("recomputed_root") != F.col("record_root"), "mismatch").when(differs | F.col("altered"), "mismatch")
             .when(F.col("recomputed_root").isNull(), "unverifiable").otherwise("verified"))
    detail = (F.when(F.col("record_root").isNull(), "no record")
              .when(F.col("recomputed_root") != F.col("record_root"), "root").when(differs, "mirror").when(F.col("altered"), "hash")
              .when(F.col("recomputed_root").isNull(), "incomplete"))
    return df.select("seq", "from_ms", "to_ms", state.alias("state"), detail.alias("detail"), "record_root", "recomputed_root")


def recheck(shown: DataFrame, chain: DataFrame, fields: list[str], required: list[str]) -> DataFrame:
    """Field by field comparison of two checkpoint tables, and a verdict per seq: true, false or null."""
    a = shown.unpivot("seq", fields, "what", "explorer") if fields else shown
    b = chain.unpivot("seq", fields, "what", "chain")
    df = a.join(b, ["seq", "what"], "left")
    c = F.when(F.col("explorer").isNull() | F.col("chain").isNull(), "unknown").when(F.col("explorer") == F.col("chain"), "same").otherwise("differs")
    rows = df.withColumn("c", c)
    sums = rows.groupBy("seq").agg(F.bool_or(F.col("c") == "differs").alias("_bad"), F.bool_and(F.col("c") == "same").alias("_same"),
                                   F.count_if(F.col("what").isin(*required)).alias("_required"))
    verdict = F.when(F.col("_bad"), False).when(F.col("_same") & (F.col("_required") == len(required)), True)
    return rows.join(sums.select("seq", verdict.alias("verdict")), "seq")


def continuity(milestones: DataFrame, incoming: DataFrame | None = None) -> DataFrame:
    """Breaks of the milestone chain: missing predecessors, wrong `prev_id`, another id for a known index.

    A self equi-join on the index, not one global window."""
    before = milestones.select((F.col("idx") + 1).alias("idx"), F.col("id").alias("_before"))
    first = milestones.agg(F.min("idx").alias("_first"))
    rows = milestones if incoming is None else incoming
    df = rows.join(before, "idx", "left").join(F.broadcast(first))  # one row
    problem = (F.when(F.col("_before").isNull() & (F.col("idx") > F.col("_first")), "gap")
               .when(F.col("_before") != F.col("prev_id"), "prev"))
    if incoming is not None:
        df = df.join(milestones.select("idx", F.col("id").alias("_stored")), "idx", "left")
        problem = F.when(F.col("_stored") != F.col("id"), "other id").otherwise(problem)
    return df.withColumn("problem", problem).filter("problem IS NOT NULL").select("idx", "id", "problem")


def cone_check(blocks: DataFrame, expected_id=None) -> DataFrame:
    """Per milestone whether positions are exactly 0 to n-1 and every block hashes to its id."""
    ok = F.lit(True) if expected_id is None else expected_id == F.col("block_id")
    df = blocks.groupBy("ms_index").agg(F.count(F.lit(1)).alias("n"), F.min("wf_index").alias("_lo"), F.max("wf_index").alias("_hi"),
                                        F.count_distinct("wf_index").alias("_d"), F.count_if(~ok).alias("bad_hashes"))
    order = (F.col("_lo") == 0) & (F.col("_hi") == F.col("n") - 1) & (F.col("_d") == F.col("n"))
    return df.select("ms_index", "n", order.alias("in_order"), "bad_hashes")


def rotation(anchors: DataFrame, page: int | None = None, after: int | None = None, pending: str = "pending") -> DataFrame:
    """Anchors to audit next: all that are unverified (priority 0), then the others (priority 1) in order of seq, beginning after the
    cursor `after` and, with `page`, that many."""
    waiting = anchors.filter(F.col("status") == pending)
    others = anchors.filter(~F.coalesce(F.col("status") == pending, F.lit(False)))
    others = others if after is None else others.filter(F.col("seq") > after)
    others = others if page is None else others.orderBy("seq").limit(page)
    first = waiting.withColumn("priority", F.lit(0).cast("bigint")).unionByName(others.withColumn("priority", F.lit(1).cast("bigint")))
    return first.orderBy("priority", "seq")
