"""Cost-of-poor-quality scenarios and forecasts.

Forecasts are fitted per series with SQL regression aggregates
(``regr_slope`` / ``regr_intercept``), so thousands of series (``by``
groups) are fitted in one aggregation instead of one model per group on
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inspectkit.operators.kpis import _agg, copq_expr, defects_expr
from inspectkit.operators.timeseries import PERIOD, VALUE, monthly_copq
from inspectkit.params import DEFAULT_PARAMS, QualityParams


def copq_what_if(df: DataFrame, pct=None, by=(), params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """Baseline COPQ, savings = baseline * pct / 100, projected =
    max(0, baseline - savings); no savings when defects <= 0 or baseline <= 0.
    ``pct`` may be a list: every scenario from the same aggregate row
    (an exploded literal array)."""
    by = list(by)
    pcts = [params.roi_defect_reduction_pct] if pct is None else (list(pct) if isinstance(pct, (list, tuple)) else [pct])
    base = _agg(df, by, copq_expr(df).alias("baseline_copq"), defects_expr(df).alias("__defects"))
    j = base.select("*", F.explode(F.array(*[F.lit(float(p)) for p in pcts])).alias("reduction_pct"))
    none = (F.col("__defects") <= 0) | (F.col("baseline_copq") <= 0)
    sav = F.when(none, F.lit(0.0)).otherwise(F.col("baseline_copq") * (F.col("reduction_pct") / F.lit(100.0)))
    proj = F.when(none, F.col("baseline_copq")).otherwise(
        F.greatest(F.lit(0.0), F.col("baseline_copq") - F.col("baseline_copq") * (F.col("reduction_pct") / F.lit(100.0))))
    return j.select(*by, "baseline_copq", "reduction_pct", sav.alias("estimated_savings"), proj.alias("projected_copq"))


def _indexed(series: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(PERIOD)
    return series.select(*by, PERIOD, VALUE, (F.row_number().over(w) - 1).cast("double").alias("__x"))


def forecast_copq(df: DataFrame, months_ahead: int = 3, method: str | None = None, by=(),
                  params: QualityParams = DEFAULT_PARAMS, series: DataFrame | None = None) -> DataFrame:
    """Forecast the monthly COPQ series ``months_ahead`` month ends ahead.

    ``linear`` (and ``auto``, D5): least squares on the month index 0..n-1,
    needs n >= 3.  ``ar1``: differences d_t = y_t - y_(t-1), conditional least
    squares of d_t on d_(t-1), recursed forward and integrated; a constant
    regressor falls back to the mean difference.  Output
    ``(by..., period, forecast)``.
    """
    by = list(by)
    method = (method or params.forecast_method).lower()
    s = monthly_copq(df, by) if series is None else series
    idx = _indexed(s, by)
    h = int(months_ahead)
    steps = F.explode(F.sequence(F.lit(1), F.lit(h))).alias("__j")
    if method in ("auto", "linear"):
        fit = _agg(idx, by,
                   F.regr_slope(VALUE, "__x").alias("__b"), F.regr_intercept(VALUE, "__x").alias("__a"),
                   F.count(F.lit(1)).alias("__n"), F.max(PERIOD).alias("__last"))
        fit = fit.filter(F.col("__n") >= 3)
        out = fit.select(*by, "__a", "__b", "__n", "__last", steps)
        return out.select(
            *by,
            F.last_day(F.add_months(F.col("__last"), F.col("__j"))).alias(PERIOD),
            (F.col("__a") + F.col("__b") * (F.col("__n") - 1 + F.col("__j")).cast("double")).alias("forecast"),
        )
    if method != "ar1":
        raise ValueError(f"unknown forecast method {method!r}")
    w = Window.partitionBy(*by).orderBy(PERIOD)
    d = idx.withColumn("__d", F.col(VALUE) - F.lag(VALUE).over(w))
    d = d.withColumn("__dprev", F.lag("__d").over(w))
    fit = _agg(
        d, by,
        F.regr_slope("__d", "__dprev").alias("__b0"), F.regr_intercept("__d", "__dprev").alias("__a0"),
        F.avg("__d").alias("__dmean"), F.count(F.lit(1)).alias("__n"), F.max(PERIOD).alias("__last"),
        F.max_by(VALUE, PERIOD).alias("__ylast"), F.max_by("__d", PERIOD).alias("__dlast"),
    )
    fit = fit.filter(F.col("__n") >= 3).select(
        *by, "__n", "__last", "__ylast", "__dlast",
        F.coalesce(F.col("__b0"), F.lit(0.0)).alias("__b"),
        F.when(F.col("__b0").isNull(), F.col("__dmean")).otherwise(F.col("__a0")).alias("__a"),
    )
    st = fit.select("*", steps)
    b, a, j = F.col("__b"), F.col("__a"), F.col("__j").cast("double")
    bj = F.pow(b, j)
    dj = F.when(b == 1.0, a * j + F.col("__dlast")).otherwise(a * (F.lit(1.0) - bj) / (F.lit(1.0) - b) + bj * F.col("__dlast"))
    st = st.withColumn("__dj", dj)
    cum = Window.partitionBy(*by).orderBy("__j").rowsBetween(Window.unboundedPreceding, 0)
    return st.select(
        *by,
        F.last_day(F.add_months(F.col("__last"), F.col("__j"))).alias(PERIOD),
        (F.col("__ylast") + F.sum("__dj").over(cum)).alias("forecast"),
    )


def forecast_summary(forecast: DataFrame, by=()) -> DataFrame:
    """C4: mean of the forecast values."""
    return _agg(forecast, by, F.avg("forecast").alias("mean_forecast"), F.count(F.lit(1)).alias("months"))
