"""Parquet test tables and their mapping to the raw quality-record contract.

The driver's tables are a TPC-H-like star schema.  ``quality_raw`` maps
``lineitem ⋈ orders ⋈ part ⋈ supplier`` onto the raw alias columns that
``normalize`` understands.  Joins are plain equi-joins: Catalyst prunes each
scan to the columns used and AQE turns the dimension joins into broadcasts
only when their runtime size is under ``autoBroadcastJoinThreshold`` (a
size check, not a hint), so the plan also holds when ``part`` and
``supplier`` are far too large to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit.session import prepare

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_raw(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Raw quality records (alias names) derived from the star schema; ``lines``:
    line items that arrive as a stream, in place of the stored table.

    The NULLs are injected on purpose (fixed rule of the test fixtures):
    the source tables contain none.
    """
    prepare(spark)
    lines = read_table(spark, sf_dir, "lineitem") if lines is None else lines
    li = lines.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_shipdate",
    )
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    base = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .join(s, li.l_suppkey == s.s_suppkey)
    )
    nul = F.lit(None)
    return base.select(
        F.when(F.col("l_partkey") % 97 == 0, nul.cast("timestamp"))
        .otherwise(F.col("l_shipdate").cast("timestamp")).alias("InspectionDate"),
        F.when(F.col("l_suppkey") % 50 == 49, nul.cast("string"))
        .otherwise(F.col("s_name")).alias("SupplierName"),
        F.col("p_type").alias("PartType"),
        F.when(F.col("l_returnflag") != "N", F.col("p_brand")).alias("DefectType"),
        F.when(F.col("l_orderkey") % 41 == 0, nul.cast("string"))
        .otherwise(F.col("o_orderpriority")).alias("Severity"),
        F.substring_index(F.col("p_name"), " ", 1).alias("Material"),
        F.when(F.col("l_quantity") == 1, F.lit(0.0))
        .otherwise(F.col("l_quantity")).cast("double").alias("UnitsInspected"),
        F.when(F.col("l_returnflag") == "N", F.lit(0).cast("bigint"))
        .otherwise(F.floor(F.col("l_quantity") * F.col("l_tax")).cast("bigint")).alias("DefectCount"),
        (F.col("l_extendedprice") * F.col("l_discount") - F.lit(20.0)).alias("Cost_Impact_SGD"),
        F.datediff(F.col("l_shipdate"), F.col("o_orderdate")).cast("bigint").alias("DeliveryDelay"),
        F.when(F.col("l_partkey") % 53 == 0, nul.cast("double"))
        .otherwise(F.lit(100.0) * (F.lit(1.0) - F.col("l_discount"))).alias("Yield"),
        (F.col("p_size") * F.lit(2.0)).cast("double").alias("QualityScore"),
    )


def load_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised quality fact over the parquet test tables."""
    from inspectkit.operators.normalize import normalize

    return normalize(quality_raw(spark, sf_dir))


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality records derived from the ``events`` table (the stream fixture)."""
    prepare(spark)
    ev = read_table(spark, sf_dir, "events")
    return events_to_raw(ev)


def events_to_raw(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("event_id"),
        F.col("ts").cast("timestamp").alias("EventDate"),
        F.col("user_id").cast("string").alias("SupplierID"),
        F.col("event_type").alias("DefectType"),
        F.col("value").alias("Cost_Impact_SGD"),
        F.when(F.col("event_type") == "error", F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("DefectCount"),
    )
