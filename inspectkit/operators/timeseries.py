"""Gap-filled period series, rolling mean, control limits,
out-of-control points, classical seasonal decomposition and thinning.

A series is a DataFrame ``(by..., period DATE, value DOUBLE)`` with one row
per period, gaps filled with 0.  Aggregation happens first (map-side
partial sums), so every window afterwards is partitioned by the ``by``
keys and holds one series only: its size is bounded by the calendar span,
never by the row count.  The calendar is generated per group from the
group's own first and last period (``sequence`` + ``explode``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators.kpis import _agg
from inspectkit.operators.seriesidx import downsample_series
from inspectkit.params import DEFAULT_PARAMS, QualityParams
from inspectkit.session import empty, materialize

PERIOD = "period"
VALUE = "value"


def period_label(ts: Column, freq: str) -> Column:
    """Bucket label: 'D' day, 'W' week ending Sunday, 'M' month end."""
    f = freq.upper()
    if f == "D":
        return F.to_date(ts)
    if f == "W":
        return F.date_add(F.to_date(F.date_trunc("week", ts)), 6)
    if f in ("M", "ME", "MONTH"):
        return F.last_day(ts)
    raise ValueError(f"unsupported frequency {freq!r}")


def _calendar(bounds: DataFrame, freq: str, by: list[str]) -> DataFrame:
    f = freq.upper()
    if f == "D":
        seq = F.sequence(F.col("__mn"), F.col("__mx"), F.expr("INTERVAL 1 DAY"))
        return bounds.select(*by, F.explode(seq).alias(PERIOD))
    if f == "W":
        seq = F.sequence(F.col("__mn"), F.col("__mx"), F.expr("INTERVAL 7 DAYS"))
        return bounds.select(*by, F.explode(seq).alias(PERIOD))
    # month ends: step over month starts, then take each month's last day
    seq = F.sequence(F.trunc("__mn", "month"), F.trunc("__mx", "month"), F.expr("INTERVAL 1 MONTH"))
    starts = bounds.select(*by, F.explode(seq).alias("__ms"))
    return starts.select(*by, F.last_day("__ms").alias(PERIOD))


def gap_filled(df: DataFrame, value: Column, freq: str = "D", by=(), date_col: str = C.DATE) -> DataFrame:
    """Aggregate ``value`` (an aggregate expression) per period and fill
    missing periods between each group's first and last with 0."""
    by = list(by)
    d = df.filter(F.col(date_col).isNotNull())
    agg = d.groupBy(*by, period_label(F.col(date_col), freq).alias(PERIOD)).agg(value.cast("double").alias(VALUE))
    # periods x groups rows, read twice (bounds and join): computed once
    agg = materialize(agg)
    bounds = agg.groupBy(*by).agg(F.min(PERIOD).alias("__mn"), F.max(PERIOD).alias("__mx"))
    cal = _calendar(bounds, freq, by)
    right = agg.select(*[F.col(k).alias(f"__r_{k}") for k in by + [PERIOD]], F.col(VALUE).alias("__rv"))
    cond = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in by + [PERIOD]]
    return cal.join(right, cond, "left").select(
        *by, PERIOD, F.coalesce(F.col("__rv"), F.lit(0.0)).alias(VALUE)
    )


def trend_by_period(df: DataFrame, freq: str = "D", by=()) -> DataFrame:
    """Sum of DefectCount (else row count) per D/W/M period, gap-filled."""
    if not C.has(df, C.DATE):
        return empty(df.sparkSession, f"{PERIOD} date, {VALUE} double")
    v = F.sum(C.DEFECT_COUNT) if C.has(df, C.DEFECT_COUNT) else F.count(F.lit(1))
    return gap_filled(df, F.coalesce(v, F.lit(0)), freq, by)


def monthly_copq(df: DataFrame, by=()) -> DataFrame:
    """Sum of CostImpact (NULL as 0) per month, labelled by month end, gap-filled."""
    if not C.has(df, C.DATE, C.COST_IMPACT):
        return empty(df.sparkSession, f"{PERIOD} date, {VALUE} double")
    return gap_filled(df, F.sum(F.coalesce(F.col(C.COST_IMPACT), F.lit(0.0))), "M", by)


def daily_copq(df: DataFrame, by=()) -> DataFrame:
    """Daily CostImpact sums, gap-filled (input of the spike alert)."""
    if not C.has(df, C.DATE, C.COST_IMPACT):
        return empty(df.sparkSession, f"{PERIOD} date, {VALUE} double")
    return gap_filled(df, F.sum(F.coalesce(F.col(C.COST_IMPACT), F.lit(0.0))), "D", by)


def rolling_mean(series: DataFrame, window: int | None = None, by=(), params: QualityParams = DEFAULT_PARAMS,
                 name: str = "rolling_mean") -> DataFrame:
    """Trailing mean over the last ``w`` points (partial windows at the
    start); ``w`` = max(2, setting)."""
    by = list(by)
    w = max(2, params.rolling_window_points if window is None else window)
    win = Window.partitionBy(*by).orderBy(PERIOD).rowsBetween(-(w - 1), 0)
    return series.withColumn(name, F.avg(VALUE).over(win))


def control_limits(series: DataFrame, ddof: int | None = None, by=(), params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """T4: mean, ucl = mean + 3s, lcl = max(0, mean - 3s); s with ddof 1 or 0.
    Empty series -> zeros; one point (ddof 1) -> ucl NULL, lcl 0."""
    ddof = params.control_limits_ddof if ddof is None else ddof
    sd = F.stddev_samp(VALUE) if ddof == 1 else F.stddev_pop(VALUE)
    g = _agg(series, by, F.avg(VALUE).alias("__m"), sd.alias("__s"), F.count(F.lit(1)).alias("n"))
    m, s = F.col("__m"), F.col("__s")
    return g.select(
        *list(by),
        F.coalesce(m, F.lit(0.0)).alias("mean"),
        F.when(F.col("n") == 0, F.lit(0.0)).otherwise(m + F.lit(3.0) * s).alias("ucl"),
        F.coalesce(F.greatest(F.lit(0.0), m - F.lit(3.0) * s), F.lit(0.0)).alias("lcl"),
        "n",
    )


def out_of_control(series: DataFrame, ddof: int | None = None, by=(), params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """T5: points above ucl or below lcl, with the limits attached."""
    by = list(by)
    lim = control_limits(series, ddof, by, params).drop("n")
    if by:
        j = series.join(lim, by, "left")
    else:
        j = series.crossJoin(F.broadcast(lim))
    return j.filter((F.col(VALUE) > F.col("ucl")) | (F.col(VALUE) < F.col("lcl")))


def seasonal_decompose(series: DataFrame, period: int | None = None, by=(), min_points: int = 24) -> DataFrame:
    """Classical additive decomposition (centred moving-average trend,
    phase means of the detrended series centred to mean 0, residual).

    The period defaults to min(30, max(2, n // 3)) per series, and series
    shorter than ``min_points`` are skipped.  The centred moving average
    uses a variable width per series, so instead of a fixed window frame
    each point is joined to its neighbours: the series is exploded into
    (point, offset) pairs, at most ``period + 1`` per point, and equi-joined
    on (group, position) -- no pairs beyond the window are ever formed.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(PERIOD)
    wn = Window.partitionBy(*by)
    s = series.select(*by, PERIOD, VALUE, (F.row_number().over(w) - 1).alias("__i"),
                      F.count(F.lit(1)).over(wn).alias("__n"))
    if period is None:
        m = F.least(F.lit(30), F.greatest(F.lit(2), F.floor(F.col("__n") / 3).cast("int")))
        s = s.filter(F.col("__n") >= min_points)
    else:
        m = F.lit(int(period))
        s = s.filter(F.col("__n") >= 2 * int(period))
    s = s.withColumn("__m", m).withColumn("__h", F.floor(F.col("__m") / 2).cast("int"))
    # the indexed series feeds the neighbour join, the values and the phase
    # means: computed once (periods x groups rows)
    s = materialize(s)
    nb = s.select(*by, "__i", "__m", "__h", "__n",
                  F.explode(F.sequence(-F.col("__h"), F.col("__h"))).alias("__o"))
    wgt = F.when((F.col("__m") % 2 == 0) & (F.abs(F.col("__o")) == F.col("__h")), F.lit(0.5)).otherwise(F.lit(1.0))
    nb = nb.select(*by, "__i", "__m", "__h", "__n", (F.col("__i") + F.col("__o")).alias("__j"), wgt.alias("__w"))
    vals = s.select(*[F.col(b).alias(f"__b_{b}") for b in by], F.col("__i").alias("__j2"), F.col(VALUE).alias("__v"))
    cond = [F.col("__j") == F.col("__j2")] + [F.col(b).eqNullSafe(F.col(f"__b_{b}")) for b in by]
    trend = (
        nb.join(vals, cond, "inner")
        .groupBy(*by, "__i")
        .agg(
            (F.sum(F.col("__w") * F.col("__v")) / F.first("__m").cast("double")).alias("__t"),
            F.first("__h").alias("__h"), F.first("__n").alias("__n"),
        )
    )
    trend = trend.select(
        *by, "__i",
        F.when((F.col("__i") - F.col("__h") >= 0) & (F.col("__i") + F.col("__h") <= F.col("__n") - 1),
               F.col("__t")).alias("trend"),
    )
    d = s.join(trend, by + ["__i"], "inner") if by else s.join(trend, ["__i"], "inner")
    d = d.withColumn("__detr", F.col(VALUE) - F.col("trend")).withColumn("__ph", F.col("__i") % F.col("__m"))
    ph = d.groupBy(*by, "__ph").agg(F.avg("__detr").alias("__pa"))
    ph = ph.withColumn("seasonal", F.col("__pa") - F.avg("__pa").over(Window.partitionBy(*by)))
    out = d.join(ph.drop("__pa"), by + ["__ph"], "inner")
    return out.select(
        *by, PERIOD, VALUE, "trend", "seasonal",
        (F.col("__detr") - F.col("seasonal")).alias("resid"),
    )


def decomposition_summary(decomp: DataFrame, by=()) -> DataFrame:
    """Median of the trend component (the figure the reference reports)."""
    return _agg(decomp, by, F.percentile(F.col("trend"), 0.5).alias("median_trend"),
                F.count(F.lit(1)).alias("n"))


def thin_series(series: DataFrame, k: int | None = None, by=(), params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """T7 on a series: ``k`` evenly spaced points (linspace positions)."""
    k = params.max_points_line_chart if k is None else k
    return downsample_series(series, PERIOD, k, by)
