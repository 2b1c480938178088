"""A stored table that grows batch by batch and is asked by key, without being read as a whole.

A batch adds a run of entries: each row once per way of finding it (a family of key columns), in folders by bucket of the key's hash,
and with it a filter, three bitmaps of together some 16 bits per entry. A lookup tests its keys against the filters and reads only the
folders (run, bucket) in which a key may lie; what it reads is compared with the keys themselves. Of runs in which few keys of a batch
may lie, only those keys meet the entries, so that a batch of new keys does not move the table.

Eight runs are merged into one of the next level, eight of those again, so a table of n batches has at most 7 runs on each of
log8(n) levels. Which runs are live follows from the number of the batch alone: nothing has to be committed, and a batch that is run
again writes the same folders again. Runs that were merged are read no more and may be removed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

FAN = 8
BUCKETS = 32
PAGE_BITS = 15  # a bitmap has 32,768 bits
BITMAPS = 3  # an entry sets one bit in each: of 200 keys that a run does not hold, about one passes
BITS_PER_ENTRY = 16


@dataclass(frozen=True)
class KeyStore:
    path: str
    schema: str
    families: dict[str, tuple[str, ...]]

    @property
    def columns(self) -> list[str]:
        return [c.strip().split(" ")[0] for c in self.schema.split(",")]

    # -- runs --

    @staticmethod
    def live(n: int) -> list[str]:
        """The runs that hold the batches before n."""
        runs, level, end = [], 0, n
        while end:
            runs += [f"{level}-{i}" for i in range(end - end % FAN, end)]
            end, level = end // FAN, level + 1
        return runs

    def append(self, rows: DataFrame, n: int) -> None:
        """Add the rows of batch n. Keys with a null part cannot be found by that family."""
        parts = []
        for family, cols in self.families.items():
            known = rows.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
            parts.append(known.select(F.lit(family).alias("family"), self._hash(family, cols).alias("h"), *self.columns))
        self._write(rows.sparkSession, reduce(DataFrame.unionByName, parts), f"0-{n}")
        self._merge(rows.sparkSession, n + 1)

    def _merge(self, spark: SparkSession, n: int) -> None:
        level, end = 0, n
        while end and end % FAN == 0:  # the level below has just become full
            below = [f"{level}-{i}" for i in range(end - FAN, end)]
            level, end = level + 1, end // FAN
            self._write(spark, self._entries(spark, F.col("run").isin(below)), f"{level}-{end - 1}")

    def _write(self, spark: SparkSession, entries: DataFrame, run: str) -> None:
        placed = entries.withColumn("bucket", F.col("h").bitwiseAND(BUCKETS - 1).cast("int"))
        placed.repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/rows/run={run}")
        written = self._entries(spark, F.col("run") == run).select("h")
        pages = 1
        bits = written.count() * BITS_PER_ENTRY
        while BITMAPS * pages << PAGE_BITS < bits:
            pages *= 2
        paged = written.select(self._page(F.lit(pages)).alias("page"), *self._bits())
        filters = paged.groupBy("page").agg(*[F.bitmap_construct_agg(f"bit{i}").alias(f"bitmap{i}") for i in range(BITMAPS)]).withColumn("pages", F.lit(pages))
        filters.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/filters/run={run}")

    def _entries(self, spark: SparkSession, which) -> DataFrame:
        from pyspark.errors import AnalysisException
        schema = f"family string, h bigint, {self.schema}"
        try:
            return spark.read.schema(f"{schema}, run string, bucket int").parquet(f"{self.path}/rows").filter(which).drop("run", "bucket")
        except AnalysisException:  # nothing written yet
            return spark.createDataFrame([], schema)

    def batches(self, spark: SparkSession) -> int:
        """How many batches have been written, from the names of the runs."""
        from pyspark.errors import AnalysisException
        try:
            runs = spark.read.parquet(f"{self.path}/filters").select("run").distinct().filter("run LIKE '0-%'")
        except AnalysisException:
            return 0
        return (runs.agg(F.max(F.substring_index("run", "-", -1).cast("bigint"))).first()[0] or 0) + 1

    def rows(self, spark: SparkSession, n: int) -> DataFrame:
        """All rows of the batches before n that their first family can find."""
        first = next(iter(self.families))
        return self._entries(spark, F.col("run").isin(self.live(n))).filter(F.col("family") == first).select(*self.columns)

    # -- lookups --

    @staticmethod
    def _hash(family: str, cols: tuple[str, ...]):
        return F.xxhash64(F.lit(family), *cols)

    @staticmethod
    def _page(pages):
        return F.shiftright("h", 20).bitwiseAND(pages - 1)

    @staticmethod
    def _bits():
        """The bit of an entry in each bitmap of its page."""
        again = F.xxhash64("h")
        return [x.bitwiseAND((1 << PAGE_BITS) - 1).alias(f"bit{i}") for i, x in enumerate((F.shiftright("h", 44), again, F.shiftright(again, PAGE_BITS)))]

    def _hits(self, rows: DataFrame, family: str, n: int) -> DataFrame | None:
        """The hashes of the rows' keys with each live run whose filter has them."""
        from pyspark.errors import AnalysisException
        spark, live = rows.sparkSession, self.live(n)
        if not live:
            return None
        try:
            filters = spark.read.parquet(f"{self.path}/filters").filter(F.col("run").isin(live))
        except AnalysisException:
            return None
        runs = filters.groupBy("run").agg(F.first("pages").alias("pages"))  # one row per live run
        keys = rows.select(self._hash(family, self.families[family]).alias("h")).distinct()
        asked = keys.join(F.broadcast(runs)).withColumn("page", self._page(F.col("pages").cast("bigint")))
        met = asked.join(filters.drop("pages"), ["run", "page"]).select("*", *self._bits())
        byte = lambda i: F.conv(F.hex(F.expr(f"substring(bitmap{i}, CAST(bit{i} DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
        has = lambda i: byte(i).bitwiseAND(F.expr(f"shiftleft(1, CAST(bit{i} % 8 AS INT))")) != 0
        return met.filter(reduce(lambda a, b: a & b, [has(i) for i in range(BITMAPS)])).select("h", "run")

    @staticmethod
    def _folders(hits: DataFrame) -> list[str]:
        found = hits.select(F.concat("run", F.lit("/"), F.col("h").bitwiseAND(BUCKETS - 1).cast("string"))).distinct().collect()
        return sorted(r[0] for r in found)

    def parts(self, rows: DataFrame, family: str, n: int) -> list[str]:
        """The folders, as run/bucket, in which the batches before n may hold a key of the rows: at most BUCKETS for each live run."""
        hits = self._hits(rows, family, n)
        return [] if hits is None else self._folders(hits)

    def find(self, rows: DataFrame, family: str, n: int) -> DataFrame:
        """The rows with each stored row (its columns in the struct `stored`) of the batches before n that has their key.

        Runs that may hold at least an eighth as many keys as there are rows are joined with all rows; the others with the rows that they
        may hold, which are written first: Spark sees that they are few and leaves the entries where they are."""
        cols, hits = self.families[family], self._hits(rows, family, n)
        hits = None if hits is None else settle(hits, "hits")
        counts = {} if hits is None else {r[0]: r[1] for r in hits.groupBy("run").count().collect()}  # a row per live run
        most = rows.count() if counts else 0
        many = [run for run, c in counts.items() if 8 * c >= most]
        few = [run for run in counts if run not in many]
        found = [] if counts else [rows.filter(F.lit(False)).withColumn("stored", F.from_json(F.lit("{}"), self.schema))]
        if many:
            found.append(self._met(rows, family, self._folders(hits.filter(F.col("run").isin(many)))))
        if few:
            own = hits.filter(F.col("run").isin(few))
            asked = rows.withColumn("_h", self._hash(family, cols)).join(own.select(F.col("h").alias("_h")), "_h", "left_semi")
            found.append(self._met(settle(asked.select(*rows.columns), "asked"), family, self._folders(own)))
        return reduce(DataFrame.unionByName, found)

    def _met(self, rows: DataFrame, family: str, parts: list[str]) -> DataFrame:
        cols = self.families[family]
        part = F.concat("run", F.lit("/"), F.col("bucket").cast("string"))
        held = self._entries(rows.sparkSession, part.isin(parts)).filter(F.col("family") == family)
        held = held.select(F.struct(*self.columns).alias("stored"), *[F.col(c).alias(f"_k_{c}") for c in cols])
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in cols])
        return rows.join(held, same).select(*rows.columns, "stored")
