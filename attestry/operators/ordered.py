"""Ordered scans: "the rows of my group before me", for groups of any size.

A window function sorts a whole group in one task. One issuer, element or milestone may hold a
third of the ledger, so groups above `hot_group_rows` are cut into chunks that follow the order:

1. count rows per group (map-side combined) and keep the groups above the limit;
2. cut each of those at approximate percentiles of its position along the order, four cuts per limit,
   so a burst at one time and a long quiet history give chunks of the same size;
3. run the window per (group, chunk), and one summary row per chunk carries the state over.

A hot group of n rows has 4n/limit cuts, so all cuts together number at most 4 rows/limit, and so do the
summary rows. Without a hot group the plan is the plain window. Chunks are a function of row values and of
the collected cuts, so re-running a lost task gives the same chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_ROWS_CONF = "spark.attestry.hotGroupRows"
HOT_ROWS = 5_000_000
BLOCK_PREFIX = "CAST(conv(substr(block_id, 3, 4), 16, 10) AS BIGINT)"


@dataclass(frozen=True)
class Order:
    """A total order of rows: sort columns, and two whole numbers, (coarse, fine), that never decrease along it."""

    cols: tuple[str, ...]
    coarse: str
    fine: str = "CAST(0 AS BIGINT)"


BY_POSITION = Order(("ms_index", "wf_index", "block_id"), "ms_index", "wf_index")
BY_SEQ = Order(("seq", "block_id"), "seq", BLOCK_PREFIX)
BY_TIME = Order(("ts", "block_id"), "ts", BLOCK_PREFIX)


@dataclass(frozen=True)
class Before:
    """A value folded over the rows before the current one: last, sum, max or min."""

    kind: str
    value: Column
    when: Column | None = None


def last(value: Column, when: Column | None = None) -> Before:
    return Before("last", value, when)


def total(value: Column) -> Before:
    return Before("sum", value)


def count() -> Before:
    return Before("sum", F.lit(1).cast("bigint"))


def running_max(value: Column, when: Column | None = None) -> Before:
    return Before("max", value, when)


def running_min(value: Column, when: Column | None = None) -> Before:
    return Before("min", value, when)


@dataclass(frozen=True)
class Cuts:
    """Where the hot groups are cut: per group the range of `fine` and the positions its chunks begin at."""

    keys: tuple[str, ...]
    order: Order
    schema: T.StructType
    groups: list[tuple] = field(default_factory=list)


def hot_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS)))


def _position(order: Order, lo: str, hi: str) -> Column:
    """A number that never decreases along the order: coarse, and fine as a fraction of its range in the group."""
    return F.expr(f"CAST({order.coarse} AS DOUBLE) + (CAST({order.fine} AS DOUBLE) - {lo}) / ({hi} - {lo} + 1)")


def measure(df: DataFrame, keys: Sequence[str], order: Order, limit: int | None = None) -> Cuts:
    """Find the groups of `keys` above the limit and where to cut them: at most 4 rows/limit numbers."""
    limit = limit or hot_group_rows(df.sparkSession)
    fine = F.expr(order.fine).cast("double")
    stats = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(fine).alias("_lo"), F.max(fine).alias("_hi"))
             .filter(F.col("_n") > limit))
    key_schema = T.StructType([T.StructField(k, df.schema[k].dataType, True) for k in keys])
    hot = [tuple(r) for r in stats.collect()]
    if not hot:
        return Cuts(tuple(keys), order, key_schema)
    fields = [*[T.StructField(f"_r_{f.name}", f.dataType, True) for f in key_schema.fields],
              T.StructField("_n", T.LongType()), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType())]
    side = F.broadcast(df.sparkSession.createDataFrame(hot, T.StructType(fields)))
    most = max(4 * r[len(keys)] // limit for r in hot)
    rows = _null_safe(df, side, [(k, f"_r_{k}") for k in keys], "inner")
    # every group at the percentiles of the largest one; the smaller ones keep as many as they need
    found = rows.groupBy(*keys).agg(F.first("_n").alias("_n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.percentile_approx(
        _position(order, "_lo", "_hi"), [(i + 1) / (most + 1) for i in range(most)], max(10_000, 100 * most)).alias("_cuts"))
    groups = []
    for r in found.collect():
        step = max(1, most * limit // (4 * r["_n"]))
        groups.append((*[r[k] for k in keys], r["_lo"], r["_hi"], sorted(set(r["_cuts"][::step]))))
    return Cuts(tuple(keys), order, key_schema, groups)


def _null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str) -> DataFrame:
    cond = None
    for a, b in pairs:
        one = left[a].eqNullSafe(right[b])
        cond = one if cond is None else cond & one
    return left.join(right, cond, how).drop(*[b for _, b in pairs])


def _side(cuts: Cuts, spark: SparkSession) -> DataFrame:
    """The cuts as a table of one row per hot group."""
    fields = [T.StructField(f"_r_{f.name}", f.dataType, True) for f in cuts.schema.fields]
    return spark.createDataFrame(cuts.groups, T.StructType([*fields, T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType()),
                                                            T.StructField("_cuts", T.ArrayType(T.DoubleType()))]))


def with_chunk(df: DataFrame, cuts: Cuts, name: str = "_chunk") -> DataFrame:
    """Add the chunk of each row, a number that never decreases along the order: 0 for ordinary groups."""
    if not cuts.groups:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    out = _null_safe(df, F.broadcast(_side(cuts, df.sparkSession)), [(k, f"_r_{k}") for k in cuts.keys], "left")
    out = out.withColumn("_cut_at", _position(cuts.order, "_lo", "_hi"))
    # the number of cuts at or below the row's position, by halving
    steps = ", ".join(str(1 << i) for i in reversed(range(max(len(g[-1]) for g in cuts.groups).bit_length())))
    chunk = F.expr(f"CAST(coalesce(aggregate(array({steps}), 0, (at, by) -> IF(at + by <= size(_cuts) AND get(_cuts, at + by - 1) <= _cut_at, at + by, at)), 0) AS BIGINT)")
    return out.withColumn(name, F.when(F.col("_cuts").isNull(), F.lit(0).cast("bigint")).otherwise(chunk)).drop("_lo", "_hi", "_cuts", "_cut_at")


def _fold(op: Before, over=None) -> Column:
    value = op.value if op.when is None else F.when(op.when, op.value)
    if op.kind == "last":
        boxed = F.struct(op.value.alias("v"))
        return F.last(boxed if op.when is None else F.when(op.when, boxed), ignorenulls=True).over(over)
    return {"sum": F.sum, "max": F.max, "min": F.min}[op.kind](value).over(over)


def _summary(op: Before, cols: Sequence[str], backwards: bool) -> Column:
    value = op.value if op.when is None else F.when(op.when, op.value)
    if op.kind == "last":
        boxed = F.struct(op.value.alias("v"))
        pick = F.min_by if backwards else F.max_by
        if op.when is None:
            return pick(boxed, F.struct(*cols))
        return pick(F.when(op.when, boxed), F.when(op.when, F.struct(*cols)))
    return {"sum": F.sum, "max": F.max, "min": F.min}[op.kind](value)


def scan(df: DataFrame, keys: Sequence[str], order: Order, outputs: dict[str, Before], *,
         cuts: Cuts | None = None, chunk: str | None = None, sizes: DataFrame | None = None,
         backwards: bool = False) -> DataFrame:
    """Add, per row, each output folded over the rows of its group strictly before it.

    `chunk` names a column (or SQL expression) that follows the order and bounds a chunk's rows by
    construction; otherwise the hot groups are measured, on `sizes` if given: a stored table with the
    same keys and order that has at least these rows, so that a derived input is not computed twice.
    `backwards` folds over the rows after it.
    """
    keys = list(keys)
    bounded = chunk is None
    if bounded:
        cuts = measure(df if sizes is None else sizes, keys, order) if cuts is None else cuts
        rows = with_chunk(df, cuts)
        carry_needed = bool(cuts.groups)
    else:
        rows = df.withColumn("_chunk", F.expr(chunk))
        carry_needed = True
    cols = [F.col(c).desc() if backwards else F.col(c).asc() for c in order.cols]
    part = [*keys, "_chunk"] if carry_needed else keys
    w = Window.partitionBy(*part).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select("*", *[_fold(op, w).alias(f"_l_{n}") for n, op in outputs.items()])
    if carry_needed:
        source = rows
        if bounded:
            hot = F.broadcast(_side(cuts, df.sparkSession).drop("_lo", "_hi", "_cuts"))
            source = _null_safe(rows, hot, [(k, f"_r_{k}") for k in keys], "inner")
        sums = source.groupBy(*keys, "_chunk").agg(
            *[_summary(op, order.cols, backwards).alias(n) for n, op in outputs.items()])
        by_chunk = F.col("_chunk").desc() if backwards else F.col("_chunk").asc()
        over = Window.partitionBy(*keys).orderBy(by_chunk).rowsBetween(Window.unboundedPreceding, -1)
        merged = {n: (F.last(n, ignorenulls=True) if op.kind == "last"
                      else {"sum": F.sum, "max": F.max, "min": F.min}[op.kind](n)).over(over)
                  for n, op in outputs.items()}
        carry = sums.select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("_chunk").alias("_r__chunk"),
                            *[c.alias(f"_c_{n}") for n, c in merged.items()])
        carry = F.broadcast(carry) if bounded else carry
        out = _null_safe(out, carry, [*[(k, f"_r_{k}") for k in keys], ("_chunk", "_r__chunk")], "left")
    final = []
    for n, op in outputs.items():
        local = F.col(f"_l_{n}")
        carried = F.col(f"_c_{n}") if carry_needed else None
        if op.kind == "last":
            final.append((local if carried is None else F.coalesce(local, carried)).getField("v").alias(n))
        elif op.kind == "sum":
            zero = F.lit(0)
            value = F.coalesce(local, zero) if carried is None else F.coalesce(local, zero) + F.coalesce(carried, zero)
            final.append(value.alias(n))
        elif carried is None:
            final.append(local.alias(n))
        else:
            final.append((F.greatest if op.kind == "max" else F.least)(local, carried).alias(n))
    kept = [c for c in df.columns if c not in outputs]
    return out.select(*kept, *final)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Order, values: dict[str, str], *,
         when: Column | None = None, inclusive: bool = False) -> DataFrame:
    """For each left row the values of the last right row of its group before it in the order.

    Both sides carry the key and order columns. One union and one ordered scan: no pairs, whatever
    the size of a group. `inclusive` also takes a right row at the same position.
    """
    keys = list(keys)
    shared = [*keys, *order.cols]
    boxed = F.struct(*[F.col(src).alias(name) for name, src in values.items()])
    probe = left.select(*shared, F.struct(*left.columns).alias("_row"), F.lit(1 if inclusive else 0).alias("_side"))
    kept = right if when is None else right.filter(when)
    hits = kept.select(*shared, boxed.alias("_hit"), F.lit(0 if inclusive else 1).alias("_side"))
    both = probe.unionByName(hits, allowMissingColumns=True)
    wide = Order((*order.cols, "_side"), order.coarse, order.fine)
    found = scan(both, keys, wide, {"_found": last(F.col("_hit"), F.col("_hit").isNotNull())})
    return (found.filter(F.col("_row").isNotNull())
            .select("_row.*", *[F.col(f"_found.{n}").alias(n) for n in values]))


def rank_by(df: DataFrame, keys: Sequence[str], order: Order, name: str = "position", **how) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … in order."""
    return scan(df, keys, order, {name: count()}, **how)


def latest(df: DataFrame, keys: Sequence[str], *order: Column, n: int = 1) -> DataFrame:
    """The first `n` rows per key under `order`. Spark prunes to n rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
