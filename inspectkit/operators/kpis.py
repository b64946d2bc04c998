"""K1-K4: defect count, cost of poor quality, executive KPIs, KPI cube.

Each is one aggregation (per ``by`` group when given).  K4 answers every
filter-bar state at once with ``cube`` over a finest-grain pre-aggregate,
so the grouping-set expansion multiplies dimension combinations, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators.qindex import INDEX, index_columns, quality_index
from inspectkit.params import DEFAULT_PARAMS, QualityParams


def defects_expr(df: DataFrame) -> Column:
    """K1 as an aggregate expression: sum(DefectCount) (NULL -> 0), else
    count of non-NULL Defect_Type, else row count; integer."""
    if C.has(df, C.DEFECT_COUNT):
        return F.coalesce(F.sum(C.DEFECT_COUNT), F.lit(0)).cast("bigint")
    if C.has(df, C.DEFECT_TYPE):
        return F.count(C.DEFECT_TYPE).cast("bigint")
    return F.count(F.lit(1)).cast("bigint")


def copq_expr(df: DataFrame) -> Column:
    """K2 as an aggregate expression: sum(CostImpact), NULL as 0; 0 if absent."""
    if C.has(df, C.COST_IMPACT):
        return F.coalesce(F.sum(F.col(C.COST_IMPACT).cast("double")), F.lit(0.0))
    return F.lit(0.0)


def _agg(df: DataFrame, by, *aggs: Column) -> DataFrame:
    by = list(by)
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def count_defects(df: DataFrame, by=()) -> DataFrame:
    """K1."""
    return _agg(df, by, defects_expr(df).alias("Defects"))


def total_copq(df: DataFrame, by=()) -> DataFrame:
    """K2."""
    return _agg(df, by, copq_expr(df).alias("COPQ"))


KPI_COLUMNS = (C.DEFECT_COUNT, C.DEFECT_TYPE, C.COST_IMPACT, C.ON_TIME_FLAG, C.YIELD)


def executive_kpis(df: DataFrame, params: QualityParams = DEFAULT_PARAMS, by=(), stored: bool = False) -> DataFrame:
    """K3: Rows, Defects, COPQ, OnTimeRate (mean x 100), YieldPct (mean),
    QualityIndex (mean of X1 with NULLs skipped).  Absent inputs give NULL.
    The columns read are written once, unless df is a written table (``stored``)."""
    by = list(by)
    if not stored:
        df = index_columns(df, [*by, *[c for c in KPI_COLUMNS if c != C.DEFECT_TYPE or not C.has(df, C.DEFECT_COUNT)]])
    q = quality_index(df, params, by, stored=True)
    aggs = [
        F.count(F.lit(1)).cast("double").alias("Rows"),
        defects_expr(df).cast("double").alias("Defects"),
        copq_expr(df).alias("COPQ"),
        (F.avg(F.col(C.ON_TIME_FLAG).cast("double")) * 100.0 if C.has(df, C.ON_TIME_FLAG)
         else F.lit(None).cast("double")).alias("OnTimeRate"),
        (F.avg(F.col(C.YIELD).cast("double")) if C.has(df, C.YIELD)
         else F.lit(None).cast("double")).alias("YieldPct"),
        F.avg(INDEX).alias("QualityIndex"),
    ]
    return _agg(q, by, *aggs)


def kpi_cube(df: DataFrame, dims: list[str] | tuple[str, ...] | None = None) -> DataFrame:
    """K4: Rows, Defects and COPQ for every combination of the filter-bar
    dimensions (each dimension either fixed to a value or 'all').  A
    ``g_<dim>`` flag is 1 where the dimension is rolled up, which tells the
    'all' cell apart from a NULL value.

    The rows are aggregated once at the finest grain (all dimensions); the
    2^d grouping sets are then expanded over those partial sums, whose
    count is the number of dimension combinations, not rows."""
    dims = C.present(df, list(dims) if dims is not None else list(C.FILTER_DIMS))
    if C.has(df, C.DEFECT_COUNT):
        d_part = F.sum(C.DEFECT_COUNT)
    elif C.has(df, C.DEFECT_TYPE):
        d_part = F.count(C.DEFECT_TYPE)
    else:
        d_part = F.count(F.lit(1))
    c_part = F.sum(F.col(C.COST_IMPACT).cast("double")) if C.has(df, C.COST_IMPACT) else F.lit(None).cast("double")
    fine = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("__n"), d_part.alias("__d"), c_part.alias("__c"))
    aggs = [
        F.sum("__n").alias("Rows"),
        F.coalesce(F.sum("__d"), F.lit(0)).cast("bigint").alias("Defects"),
        F.coalesce(F.sum("__c"), F.lit(0.0)).alias("COPQ"),
    ] + [F.grouping(d).cast("bigint").alias(f"g_{d}") for d in dims]
    return fine.cube(*dims).agg(*aggs)
