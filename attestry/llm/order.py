"""The next row in the order of a key, without ordering all rows in one place. DataFrame functions only."""

from __future__ import annotations

from math import log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_next(rows: DataFrame, key: str, columns: dict[str, str], *ties: str) -> DataFrame:
    """Add, for each (column, name) of `columns`, the column's value in the next row by `key`, which is a whole number.

    Keys are cut into ranges at approximate percentiles; a window orders each range, and the first row of a range stands as an
    extra, last row in the range before. Rows without key come first, equal keys follow `ties`, and the last row is followed by
    the smallest key. At most one key per range comes to the driver."""
    ranges = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.agg(F.min(key).alias("least"), F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 100 * ranges).alias("cuts")).first()
    least = cut["least"]
    cuts = sorted(set(cut["cuts"] or []) - {least})
    place = F.lit(0)
    if cuts:  # the number of cuts at or below the key, by halving
        bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts])
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(int(log2(len(cuts))) + 1))])
        place = F.coalesce(F.aggregate(steps, F.lit(0), lambda at, by: F.when(
            (at + by <= len(cuts)) & (F.get(bounds, at + by - 1) <= F.col(key)), at + by).otherwise(at)), F.lit(0))
    placed = rows.withColumn("_range", place).withColumn("_extra", F.lit(0))
    first = placed.filter(F.col(key).isin([*cuts, *([] if least is None else [least])]))
    before = first.withColumn("_range", F.when(F.col(key) == least, len(cuts)).otherwise(F.col("_range") - 1)).withColumn("_extra", F.lit(1))
    order = Window.partitionBy("_range").orderBy("_extra", F.col(key).asc_nulls_first(), *ties)
    following = {name: F.lead(column).over(order) for column, name in columns.items()}
    return placed.unionByName(before).withColumns(following).filter("_extra = 0").drop("_extra", "_range")
