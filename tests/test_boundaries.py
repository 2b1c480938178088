"""Thresholds at equality, and the small helpers."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from attestry.functions import columns as C
from attestry.functions import hashing as H
from attestry.operators import documents, scores


def scored(spark, values):
    rows = [(f"0x{i:064x}", "A", v, i, 0, i, "PRODUCER_SIGNED", "proven", True, True) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "block_id string, ie_id string, score double, ms_index bigint, wf_index bigint, ts bigint, verdict string,"
                                 " trust string, ref_proven boolean, ref_relayed boolean")


def test_jump_is_strict(spark):
    assert scores.jumps(scored(spark, [0.0, 0.3, 0.0, 0.31])).count() == 1


def test_drop_counts_at_its_threshold(spark):
    df = scores.with_trusted_previous(scored(spark, [0.5, 0.3, 0.1000001]))
    assert scores.drops(df).count() == 1


def test_skew_is_strict(spark):
    df = spark.createDataFrame([(1_300_000, 1000), (1_300_001, 1000), (0, 0)], "iat bigint, ts bigint")
    assert df.filter(C.clock_skewed(F.col("iat"), F.col("ts"))).count() == 1


def test_key_revoked_within_the_second(spark):
    df = spark.createDataFrame([(1999, 1), (2000, 1), (None, 1)], "revoked bigint, ts bigint")
    assert [r[0] for r in df.select(C.valid_through_second(F.col("revoked"), F.col("ts"))).collect()] == [False, True, True]


def test_hmac_equals_the_library(spark):
    df = spark.createDataFrame([("ie:Dom:1",)], "s string").select(F.lower(F.hex(H.hmac_sha256(b"k" * 70, F.col("s")))).alias("h"))
    assert df.head()["h"] == hmac.new(b"k" * 70, b"ie:Dom:1", hashlib.sha256).hexdigest()


@pytest.mark.parametrize("value,text", [(1.0, "1"), (0.1, "0.1"), (1e-7, "1e-7"), (1e21, "1e+21"), (0.000001, "0.000001"), (-0.0, "0"), (123456789.5, "123456789.5")])
def test_canonical_numbers(value, text):
    assert H.canonical({"b": value, "a": [True, None]}) == '{"a":[true,null],"b":' + text + "}"


def test_label_and_error_code(spark):
    df = spark.createDataFrame([("a\tb\x07  c" + "x" * 200,)], "s string").select(C.label(F.col("s"), 20).alias("l"))
    assert df.head()["l"] == "a b\\x07 cxxxxxxxxxx…"
    codes = spark.createDataFrame([("1",), ("0",), ('"0"',), ('" 0 "',), ('"E1"',), ("true",), ("false",), ("0.0",), ("null",)], "j string")
    got = [r[0] for r in codes.select(C.is_error_code(C.parsed(F.col("j")))).collect()]
    assert got == [True, False, False, False, True, True, False, False, False]


def test_json_diff_walks_objects_and_lists(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":[1,2]},"c":1,"x y":0}', '{"a":{"b":[1,3,4]},"d":2,"x y":1}')], "id int, e string, a string")
    got = {(r["path"], r["kind"]) for r in documents.json_diff(df, ["id"], "e", "a").collect()}
    assert got == {("$.a.b[1]", "changed"), ("$.a.b[2]", "added"), ("$.c", "removed"), ("$.d", "added"), ('$["x y"]', "changed")}


def test_json_diff_goes_as_deep_as_the_documents(spark):
    deep = lambda v: '{"a":' * 12 + v + "}" * 12
    many = lambda v: "[" + ",".join([v] * 500) + "]"
    df = spark.createDataFrame([(1, deep("1"), deep("2")), (2, many("1"), many("2")), (3, "[1e2,null,{}]", "[100,null,{}]"), (4, "5", "[5]"), (5, '{"a":null}', "{}")],
                               "id int, e string, a string")
    got = [(r["id"], r["path"], r["kind"]) for r in documents.json_diff(df, ["id"], "e", "a").collect()]
    assert sorted(x for x in got if x[0] != 2) == [(1, "$" + ".a" * 12, "changed"), (4, "$", "changed"), (5, "$.a", "removed")]
    assert len([x for x in got if x[0] == 2]) == 500


def test_checkpoint_shape(spark):
    h = "0x" + "a" * 64
    good = ('{"v":1,"kind":"k","network":"n","domain":"d","from":{"index":1,"id":"%s"},"to":{"index":2,"id":"%s"},"msRoot":"%s","msgCount":0,"policyHash":"%s","prev":null}' % (h, h, h, h))
    rows = [(good,), (good.replace('"index":1', '"index":3'),), (good.replace('"msgCount":0', '"msgCount":-1'),), ("[]",)]
    df = spark.createDataFrame(rows, "j string").select(C.checkpoint_problem(C.parsed(F.col("j"))).alias("p"))
    assert [r["p"] for r in df.collect()] == [None, "from.index is after to.index", "msgCount must be an unsigned integer", "checkpoint is not an object"]
