"""Global row positions without a single-partition window, and T7 thinning.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.
For row-level inputs the position is instead computed from a range
partitioning: sort within range partitions, number rows locally, add the
row count of all earlier partitions (a table with one row per partition,
so broadcasting it is bounded by the partition count, not by the data).
The ranged data is written to the shared folder first, so boundaries and
local numbering are fixed even if executors are lost and stages are
recomputed.  A row hash and a random number are the last sort keys, so a hot
date, and even one row repeated a million times, spreads over the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inspectkit.session import written


def with_global_index(df: DataFrame, order_cols: list[str], name: str = "pos") -> DataFrame:
    """Add a 0-based position in ``order_cols`` order (ties broken by a row hash, then at random)."""
    cols = list(df.columns)
    tied = df.select("*", F.xxhash64(*[F.col(f"`{c}`") for c in cols]).alias("__h"), F.rand(1).alias("__t"))
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in order_cols] + [F.col("__h").asc(), F.col("__t").asc()]
    ranged = tied.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = ranged.select(*[F.col(f"`{c}`") for c in cols], F.spark_partition_id().alias("__pid"),
                           F.monotonically_increasing_id().alias("__mid"))
    ranged = written(ranged, "ranged")
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"))
    local = F.col("__mid") - F.shiftleft(F.col("__pid").cast("bigint"), 33)
    return (
        ranged.join(F.broadcast(offsets), "__pid")
        .withColumn(name, (F.col("__off") + local).cast("bigint"))
        .drop("__pid", "__mid", "__off")
    )


def _positions(spark, n_df: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Positions kept when thinning n rows to k, per group: floor(i*(n-1)/(k-1))
    in double arithmetic for i < k-1 and n-1 last (``linspace`` with an
    integer dtype); every position when n <= k.  At most ``k`` rows per group."""
    step = (F.col("__n") - 1).cast("double") / F.lit(float(max(k - 1, 1)))
    grid = n_df.select(*by, "__n", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                        F.least(F.col("__n"), F.lit(k)).cast("bigint") - 1)).alias("__i"))
    grid = grid.filter(F.col("__n") > 0)
    pos = F.when(F.col("__n") <= k, F.col("__i")).when(
        F.col("__i") == k - 1, F.col("__n") - 1
    ).otherwise(F.floor(F.col("__i") * step).cast("bigint"))
    return grid.select(*by, pos.alias("__pos")).distinct()


def downsample_rows(df: DataFrame, order_cols: list[str], k: int, name: str = "pos") -> DataFrame:
    """T7 over row-level data: keep ``k`` evenly spaced rows in ``order_cols`` order."""
    spark = df.sparkSession
    idx = with_global_index(df, order_cols, name)
    n_df = idx.agg(F.count(F.lit(1)).alias("__n"))
    pos = _positions(spark, n_df, k, [])
    return idx.join(F.broadcast(pos), F.col(name) == F.col("__pos"), "left_semi")


def downsample_series(df: DataFrame, order_col: str, k: int, by: list[str] | tuple[str, ...] = (), name: str = "pos") -> DataFrame:
    """T7 over an aggregated series (one row per period, per ``by`` group):
    the per-group window holds at most the periods of one series."""
    by = list(by)
    spark = df.sparkSession
    w = Window.partitionBy(*by).orderBy(F.col(order_col).asc())
    idx = df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    n_df = idx.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    pos = _positions(spark, n_df, k, by)
    cond = [F.col(name) == F.col("__pos")] + [idx[b].eqNullSafe(pos[b]) for b in by]
    return idx.join(pos if by else F.broadcast(pos), cond, "left_semi")
