"""A stored full-text index: posting arrays in folders by token, appended load by load.

`docs` gives every text a number; numbers of one load follow each other within each written part, and those of later loads are
higher. `postings` holds, per token and run of 65,536 numbers (a chunk), the numbers that carry the token, as differences from
the start of the chunk. It lies in one folder per bucket of tokens, so that a search reads the folders of its words only. A token
that every text has is many chunks, never one row.

A search starts from its rarest word and keeps, word by word, the chunks and then the numbers that all have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import query_words, tokens

BUCKETS = 64
CHUNK_BITS = 16
PART_BITS = 33  # monotonically_increasing_id counts up from the part's number shifted by so many bits


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(f"{path}/{name}")
    except AnalysisException:  # nothing written yet
        return None


def append(df: DataFrame, key: str, text: str, path: str, load: int) -> None:
    """Add a load of texts. A load that is run again writes its own folders again; loads are numbered 0, 1, 2, …"""
    spark = df.sparkSession
    before = _read(spark, path, "docs")
    top = None if before is None else before.filter(F.col("load") < load).agg(F.max("doc")).first()[0]
    base = 0 if top is None else ((top >> PART_BITS) + 1) << PART_BITS
    df.select((F.monotonically_increasing_id() + base).alias("doc"), key, text).write.mode("overwrite").parquet(f"{path}/docs/load={load}")
    docs = spark.read.parquet(f"{path}/docs/load={load}")
    words = docs.select("doc", F.explode(tokens(F.col(text))).alias("token")).withColumn("chunk", F.shiftright("doc", CHUNK_BITS))
    lists = words.groupBy("token", "chunk").agg(F.array_sort(F.collect_list(F.col("doc").bitwiseAND((1 << CHUNK_BITS) - 1).cast("int"))).alias("docs"))
    rows = lists.withColumns({"bucket": _bucket(F.col("token")), "n": F.size("docs"), "docs": _gaps(F.col("docs"))})
    (rows.repartition("bucket").sortWithinPartitions("bucket", "token", "chunk").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/load={load}"))


def _gaps(numbers: Column) -> Column:
    """Each number as its difference from the one before."""
    return F.zip_with(numbers, F.concat(F.array(F.lit(0)), F.slice(numbers, 1, F.size(numbers) - 1)), lambda a, b: a - b)


def _numbers(postings: DataFrame) -> DataFrame:
    """A row per number: gaps added up along the exploded list, which a chunk bounds."""
    from pyspark.sql import Window
    along = Window.partitionBy("chunk").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    gaps = postings.select("chunk", F.posexplode("docs").alias("_i", "_gap"))
    return gaps.select((F.shiftleft("chunk", CHUNK_BITS) + F.sum("_gap").over(along)).alias("doc"))


def postings_of(spark: SparkSession, path: str, words: str) -> DataFrame:
    """The chunks of the query's words: reads only the folders of their buckets."""
    wanted = query_words(words)
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "token string").select(_bucket(F.col("token"))).collect()]
    return spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(*buckets) & F.col("token").isin(*wanted))


def search(spark: SparkSession, path: str, words: str, key: str) -> DataFrame:
    """Keys of the texts that carry every word of the query, with `doc`."""
    wanted, found = query_words(words), postings_of(spark, path, words)
    sizes = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.sum("n").alias("n")).collect()}  # one row per word
    docs = spark.read.parquet(f"{path}/docs").select("doc", key)
    if not wanted or len(sizes) < len(wanted):
        return docs.limit(0)
    rarest, *others = sorted(wanted, key=lambda w: (sizes[w], w))
    chunks = found.filter(F.col("token") == rarest)
    for w in others:
        chunks = chunks.join(found.filter(F.col("token") == w).select("chunk"), "chunk", "left_semi")
    hits = _numbers(chunks)
    for w in others:
        own = found.filter(F.col("token") == w).join(chunks.select("chunk"), "chunk", "left_semi")
        hits = hits.join(_numbers(own), "doc", "left_semi")
    return docs.join(hits, "doc", "left_semi")
