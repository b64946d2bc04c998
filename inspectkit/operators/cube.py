"""K4 as a stored answer: the KPI cube kept as a table, looked up and merged.

The cube of one batch of rows (``kpi_cube``) is written under ``batch=<id>``,
partitioned by grouping id: the bits of the dimensions that are rolled up, the
first dimension in the highest bit.  Counts and sums are additive, so batches
that arrive later are aggregated alone and written beside the others; a batch
written twice replaces itself.  A filter state names one grouping id and one
value for each dimension it fixes: a lookup reads that partition of each batch
and adds up at most one row per batch, whatever the size of the fact.
``compact`` merges the batches into one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators.filters import _EQ_FILTERS as FILTERS
from inspectkit.operators.kpis import kpi_cube
from inspectkit.params import FilterState

MEASURES = ("Rows", "Defects", "COPQ")


def _grouping_id(dims: list[str]) -> Column:
    return sum((F.col(f"g_{d}") * F.lit(1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)), F.lit(0)).cast("int")


def write_cube(df: DataFrame, path: str, batch: int = 0) -> None:
    """Aggregate the rows of one batch and keep their cube under ``path``."""
    dims = C.present(df, list(C.FILTER_DIMS))
    cube = kpi_cube(df, dims).withColumn("gid", _grouping_id(dims)).drop(*[f"g_{d}" for d in dims])
    cube.write.mode("overwrite").partitionBy("gid").parquet(f"{path}/batch={int(batch)}")


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """The kept cells: the dimensions, Rows, Defects, COPQ, batch, gid."""
    return spark.read.parquet(path)


def _summed() -> list[Column]:
    return [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]


def lookup(spark: SparkSession, path: str, states: list[FilterState]) -> DataFrame:
    """(seq, Rows, Defects, COPQ) for each filter state: what filtering the rows
    of all batches and aggregating them would give.  A state with dates is
    refused, the cube has none; a dimension the cube lacks is ignored, as in F1."""
    cube = read_cube(spark, path)
    fixed = [(attr, dim, label) for attr, dim, label in FILTERS if dim in cube.columns]
    dims = [d for d in C.FILTER_DIMS if d in cube.columns]
    asked = []
    for seq, s in enumerate(states):
        if s.start_date is not None or s.end_date is not None:
            raise ValueError("a stored cube answers no date ranges; filter the rows")
        value = {dim: getattr(s, attr) for attr, dim, label in fixed if getattr(s, attr) not in (None, label)}
        gid = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in value)
        asked.append((seq, gid, *[value.get(d) for d in dims]))
    schema = ", ".join(["seq int", "q_gid int", *(f"`q_{d}` string" for d in dims)])
    wanted = spark.createDataFrame(asked, schema)
    cells = cube.where(F.col("gid").isin(sorted({a[1] for a in asked})))  # partitions
    same = [cells["gid"] == wanted["q_gid"], *[cells[d].cast("string").eqNullSafe(wanted[f"q_{d}"]) for d in dims]]
    # the states are parameters; each matches at most one cell of a batch
    found = cells.join(F.broadcast(wanted), same).select("seq", *MEASURES)
    nothing = wanted.select("seq", *[F.lit(0).cast(cells.schema[m].dataType).alias(m) for m in MEASURES])
    return found.unionByName(nothing).groupBy("seq").agg(*_summed())


def compact(spark: SparkSession, path: str, into: str) -> None:
    """Merge the batches under ``path`` into one cube under ``into``."""
    cube = read_cube(spark, path)
    dims = [d for d in C.FILTER_DIMS if d in cube.columns]
    merged = cube.groupBy("gid", *dims).agg(*_summed())
    merged.write.mode("overwrite").partitionBy("gid").parquet(f"{into}/batch=0")
