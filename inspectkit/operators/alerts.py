"""A1-A3: defect-rate and COPQ-spike alerts as DataFrames.

Output rows ``(key, message, value, threshold)``; no row means no alert.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators.timeseries import PERIOD, VALUE, daily_copq
from inspectkit.params import DEFAULT_PARAMS, QualityParams

ALERT_SCHEMA = "key string, message string, value double, threshold double"

# --- Fixed values: alert keys and message formats ---
KEY_DEFECT_RATE = "defect_rate"
KEY_COPQ_SPIKE = "copq_spike"
MSG_DEFECT_RATE = "High overall defect rate: %.2f%% (threshold %s%%)"
MSG_COPQ_SPIKE = "COPQ spike: today's cost %.0f vs 7-day avg %.0f"


def alert_defect_rate(df: DataFrame, params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """A1: mean(DefectRate) x 100 above the threshold."""
    if not C.has(df, C.DEFECT_RATE):
        return df.sparkSession.createDataFrame([], ALERT_SCHEMA)
    thr = float(params.alert_defect_rate_threshold)
    rate = df.agg((F.avg(F.col(C.DEFECT_RATE).cast("double")) * 100.0).alias("value"))
    return rate.filter(F.col("value").isNotNull() & (F.col("value") > F.lit(thr))).select(
        F.lit(KEY_DEFECT_RATE).alias("key"),
        F.format_string(MSG_DEFECT_RATE, F.col("value"), F.lit(repr(thr))).alias("message"),
        F.col("value"),
        F.lit(thr).alias("threshold"),
    )


def copq_spike_days(df: DataFrame, params: QualityParams = DEFAULT_PARAMS, by=(), series: DataFrame | None = None) -> DataFrame:
    """A3: every day whose COPQ exceeds its trailing 7-day mean (itself
    included, full windows only) by more than the threshold; only series
    longer than 7 days qualify."""
    by = list(by)
    s = daily_copq(df, by) if series is None else series
    thr = float(params.alert_copq_spike_threshold)
    w7 = Window.partitionBy(*by).orderBy(PERIOD).rowsBetween(-6, 0)
    wall = Window.partitionBy(*by)
    s = s.select(
        *by, PERIOD, VALUE,
        F.avg(VALUE).over(w7).alias("baseline"),
        F.count(F.lit(1)).over(w7).alias("__wn"),
        F.count(F.lit(1)).over(wall).alias("__n"),
        F.max(PERIOD).over(wall).alias("__last"),
    )
    return s.filter((F.col("__n") > 7) & (F.col("__wn") == 7)
                    & (F.col(VALUE) > F.col("baseline") + F.lit(thr))).select(
        *by, PERIOD, VALUE, "baseline", (F.col(PERIOD) == F.col("__last")).alias("is_last"))


def alert_copq_spike(df: DataFrame, params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """A2: the spike rule on the last day only."""
    if not C.has(df, C.DATE, C.COST_IMPACT):
        return df.sparkSession.createDataFrame([], ALERT_SCHEMA)
    thr = float(params.alert_copq_spike_threshold)
    last = copq_spike_days(df, params).filter(F.col("is_last"))
    return last.select(
        F.lit(KEY_COPQ_SPIKE).alias("key"),
        F.format_string(MSG_COPQ_SPIKE, F.col(VALUE), F.col("baseline")).alias("message"),
        F.col(VALUE).alias("value"),
        F.lit(thr).alias("threshold"),
    )


def alerts(df: DataFrame, params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """A1 + A2 in rule order."""
    parts = [alert_defect_rate(df, params), alert_copq_spike(df, params)]
    return reduce(lambda a, b: a.unionByName(b), parts)
