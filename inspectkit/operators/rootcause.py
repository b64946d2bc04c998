"""Pareto, part cost ranking, drill-down and cross-tabs.

All of these aggregate first (partial aggregation on the map side, so a hot
key is collapsed before the shuffle) and only then sort or window, so every
``Window`` without ``partitionBy`` runs on at most ``n`` aggregated rows.
Cross-tabs are long ``(row, col, n)`` tables whose axes are cut to a fixed
number of labels; the zero-filled grid of kept labels is bounded by those
cuts (``limit``-ed axis tables), never by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.params import DEFAULT_PARAMS, QualityParams
from inspectkit.session import empty, materialize

UNKNOWN = "Unknown"  # fixed value: label for a NULL category


def _defect_measure(df: DataFrame):
    """Sum of DefectCount when present, else a row count."""
    if C.has(df, C.DEFECT_COUNT):
        return F.coalesce(F.sum(C.DEFECT_COUNT), F.lit(0)).cast("bigint")
    return F.count(F.lit(1))


def defect_pareto(df: DataFrame, n: int | None = None, params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """Row counts per Defect_Type (NULL -> 'Unknown'), top ``n``,
    cumulative percent over the kept rows only (the last one is 100).
    Ties are broken by label."""
    n = params.max_category_labels if n is None else n
    if not C.has(df, C.DEFECT_TYPE):
        return empty(df.sparkSession, "Defect_Type string, Count bigint, CumulativePct double")
    counts = df.groupBy(F.coalesce(F.col(C.DEFECT_TYPE).cast("string"), F.lit(UNKNOWN)).alias(C.DEFECT_TYPE)).agg(
        F.count(F.lit(1)).alias("Count")
    )
    order = [F.col("Count").desc(), F.col(C.DEFECT_TYPE).asc()]
    top = counts.orderBy(*order).limit(n)
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy()
    return top.select(
        C.DEFECT_TYPE,
        "Count",
        (F.sum("Count").over(running).cast("double") * F.lit(100.0) / F.sum("Count").over(total).cast("double")).alias(
            "CumulativePct"
        ),
    )


def defect_cost_by_part(df: DataFrame, n: int | None = None, params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """Defects (sum DefectCount, else rows) and COPQ per non-NULL Part_Type, top ``n`` by Defects."""
    n = params.max_category_labels if n is None else n
    if not C.has(df, C.PART_TYPE):
        return empty(df.sparkSession, "Part_Type string, Defects bigint, COPQ double")
    aggs = [_defect_measure(df).alias("Defects")]
    if C.has(df, C.COST_IMPACT):
        aggs.append(F.coalesce(F.sum(C.COST_IMPACT), F.lit(0.0)).alias("COPQ"))
    else:
        aggs.append(F.lit(None).cast("double").alias("COPQ"))
    g = df.filter(F.col(C.PART_TYPE).isNotNull()).groupBy(C.PART_TYPE).agg(*aggs)
    return g.orderBy(F.col("Defects").desc(), F.col(C.PART_TYPE).asc()).limit(n)


def root_cause_drilldown(df: DataFrame, n: int = 20) -> DataFrame:
    """Counts by the present root-cause keys (at least two); a NULL in
    any key drops the row; top ``n`` by count, ties by keys."""
    keys = C.present(df, C.ROOT_CAUSE_DIMS)
    if len(keys) < 2:
        return empty(df.sparkSession, "Count bigint")
    g = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("Count"))
    return g.orderBy(F.col("Count").desc(), *[F.col(k).asc() for k in keys]).limit(n)


def crosstab_long(
    df: DataFrame,
    row_col: str,
    col_col: str,
    max_rows: int | None = 10,
    max_cols: int | None = 10,
    last_cols: bool = False,
    row_name: str = "row_key",
    col_name: str = "col_key",
) -> DataFrame:
    """Long cross-tab ``(row_key, col_key, n)`` with zero cells.

    NULL labels become 'Unknown'.  Axes are sorted by label; the first
    ``max_rows`` rows and the first (or, with ``last_cols``, the last)
    ``max_cols`` columns are kept.  With both axes capped, the grid is the
    kept row labels each exploded with the array of kept column labels (a
    1-row table), so zero cells appear and the grid size is bounded by the
    parameters; counts are aggregated before the join.  With an uncapped
    axis only observed cells are returned.
    """
    r = F.coalesce(F.col(row_col).cast("string"), F.lit(UNKNOWN)).alias(row_name)
    c = F.coalesce(F.col(col_col).cast("string"), F.lit(UNKNOWN)).alias(col_name)
    counts = df.groupBy(r, c).agg(F.count(F.lit(1)).alias("n"))
    if max_rows is not None or max_cols is not None:
        # label pairs, read by the axis cuts and the grid join: computed once
        counts = materialize(counts)
    if max_rows is None or max_cols is None:
        # unbounded axes: the observed cells only (absent pairs are zero);
        # a full grid would be a product of two data-sized label sets
        rows_ok = counts
        if max_rows is not None:
            keep = counts.select(row_name).distinct().orderBy(F.col(row_name).asc()).limit(max_rows)
            rows_ok = rows_ok.join(F.broadcast(keep), row_name, "left_semi")
        if max_cols is not None:
            order = F.col(col_name).desc() if last_cols else F.col(col_name).asc()
            keep = counts.select(col_name).distinct().orderBy(order).limit(max_cols)
            rows_ok = rows_ok.join(F.broadcast(keep), col_name, "left_semi")
        return rows_ok.select(row_name, col_name, F.col("n").cast("bigint").alias("n"))
    rows = counts.select(row_name).distinct().orderBy(F.col(row_name).asc()).limit(max_rows)
    order = F.col(col_name).desc() if last_cols else F.col(col_name).asc()
    cols = counts.select(col_name).distinct().orderBy(order).limit(max_cols)
    # grid: each kept row label x the (at most max_cols) kept column labels,
    # carried as one array in a 1-row table
    col_arr = cols.agg(F.collect_list(col_name).alias("__cols"))
    grid = rows.crossJoin(F.broadcast(col_arr)).select(row_name, F.explode("__cols").alias(col_name))
    out = grid.join(counts, [row_name, col_name], "left")
    return out.select(row_name, col_name, F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def root_cause_cooccurrence(df: DataFrame, params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """Cross-tab of the first two present root-cause columns, 10 x 10."""
    keys = C.present(df, C.ROOT_CAUSE_DIMS)
    if len(keys) < 2:
        return empty(df.sparkSession, "row_key string, col_key string, n bigint")
    k = params.max_category_labels
    return crosstab_long(df, keys[0], keys[1], k, k)


def severity_part_heatmap(df: DataFrame, params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """P5: Defect_Severity x Part_Type counts, 10 x 10."""
    if not C.has(df, C.DEFECT_SEVERITY, C.PART_TYPE):
        return empty(df.sparkSession, "row_key string, col_key string, n bigint")
    k = params.max_category_labels
    return crosstab_long(df, C.DEFECT_SEVERITY, C.PART_TYPE, k, k)


def monthly_severity_heatmap(df: DataFrame, params: QualityParams = DEFAULT_PARAMS, months: int = 12) -> DataFrame:
    """Defect_Severity x month ('yyyy-MM'); NULL dates dropped; first 10
    severities, the last ``months`` months that have data (no gap fill)."""
    if not C.has(df, C.DATE, C.DEFECT_SEVERITY):
        return empty(df.sparkSession, "row_key string, col_key string, n bigint")
    d = df.filter(F.col(C.DATE).isNotNull()).select(
        F.col(C.DEFECT_SEVERITY), F.date_format(C.DATE, "yyyy-MM").alias("_month")
    )
    return crosstab_long(d, C.DEFECT_SEVERITY, "_month", params.max_category_labels, months, last_cols=True)


def audit_focus(df: DataFrame, params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """The largest cell of P5; first in row-major label order on ties."""
    hm = severity_part_heatmap(df, params)
    return hm.orderBy(F.col("n").desc(), F.col("row_key").asc(), F.col("col_key").asc()).limit(1)
