"""Registered queries: period series, control charts, decomposition,
COPQ scenarios and forecasts, alerts, and the thinned index series."""

from __future__ import annotations

from inspectkit import columns as C
from inspectkit.operators import alerts as A
from inspectkit.operators import copq as CQ
from inspectkit.operators import timeseries as TS
from inspectkit.operators.qindex import quality_index_series
from inspectkit.params import DEFAULT_PARAMS
from inspectkit.plans.catalog import fact, register, rounded
from inspectkit.plans.oracle import with_fact
from inspectkit.plans.q_basic import QI_CTE


def _series_cte(name: str, label: str, value: str, step: str, by: str | None = None, month_end: bool = False) -> str:
    """DuckDB twin of ``gap_filled``: aggregate per period, calendar per group."""
    key = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    start = "date_trunc('month', min(period))" if month_end else "min(period)"
    stop = "date_trunc('month', max(period))" if month_end else "max(period)"
    cal_val = "last_day(CAST(unnest(generate_series({s}, {e}, {step})) AS DATE))" if month_end else \
        "CAST(unnest(generate_series({s}, {e}, {step})) AS DATE)"
    cal_val = cal_val.format(s=start, e=stop, step=step)
    join = f"c.{by} IS NOT DISTINCT FROM a.{by} AND c.period = a.period" if by else "c.period = a.period"
    sel = f"c.{by}, " if by else ""
    return f"""{name}_agg AS (
  SELECT {key}{label} AS period, CAST({value} AS DOUBLE) AS value FROM fact WHERE "Date" IS NOT NULL
  GROUP BY {key}{label}
),
{name}_cal AS (SELECT {key}{cal_val} AS period FROM {name}_agg {grp}),
{name} AS (
  SELECT {sel}c.period, coalesce(a.value, 0.0) AS value FROM {name}_cal c LEFT JOIN {name}_agg a ON {join}
)"""


DAILY = _series_cte("daily", 'CAST("Date" AS DATE)', "coalesce(sum(DefectCount), 0)", "INTERVAL 1 DAY")
WEEKLY = _series_cte("weekly", 'CAST(date_trunc(\'week\', "Date") AS DATE) + 6', "coalesce(sum(DefectCount), 0)",
                     "INTERVAL 7 DAY")
MONTHLY_SUP = _series_cte("msup", 'last_day("Date")', "coalesce(sum(DefectCount), 0)", "INTERVAL 1 MONTH",
                          by="Supplier", month_end=True)
MCOPQ = _series_cte("mcopq", 'last_day("Date")', "sum(coalesce(CostImpact, 0.0))", "INTERVAL 1 MONTH", month_end=True)
DCOPQ = _series_cte("dcopq", 'CAST("Date" AS DATE)', "sum(coalesce(CostImpact, 0.0))", "INTERVAL 1 DAY")


# ---------------------------------------------------------------- T1-T3


@register("trend_daily", "T1", with_fact("SELECT period, round(value, 6) AS value FROM daily", DAILY))
def q_trend_daily(spark, sf_dir):
    return rounded(TS.trend_by_period(fact(spark, sf_dir), "D"))


@register("trend_weekly", "T1 W", with_fact("SELECT period, round(value, 6) AS value FROM weekly", WEEKLY))
def q_trend_weekly(spark, sf_dir):
    return rounded(TS.trend_by_period(fact(spark, sf_dir), "W"))


@register("trend_monthly_by_supplier", "T1 M by", with_fact(
    "SELECT Supplier, period, round(value, 6) AS value FROM msup", MONTHLY_SUP))
def q_trend_monthly_by_supplier(spark, sf_dir):
    return rounded(TS.trend_by_period(fact(spark, sf_dir), "M", by=[C.SUPPLIER]))


@register("monthly_copq", "T2", with_fact("SELECT period, round(value, 4) AS value FROM mcopq", MCOPQ))
def q_monthly_copq(spark, sf_dir):
    return rounded(TS.monthly_copq(fact(spark, sf_dir)), money=(TS.VALUE,))


@register("rolling_mean", "T3", with_fact("""
SELECT period, round(value, 6) AS value,
  round(avg(value) OVER (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling_mean
FROM daily""", DAILY))
def q_rolling_mean(spark, sf_dir):
    return rounded(TS.rolling_mean(TS.trend_by_period(fact(spark, sf_dir), "D")))


_LIMITS_SQL = """limits AS (
  SELECT coalesce(avg(value), 0.0) AS mean,
    CASE WHEN count(*) = 0 THEN 0.0 ELSE avg(value) + 3.0 * stddev_samp(value) END AS ucl,
    coalesce(greatest(0.0, avg(value) - 3.0 * stddev_samp(value)), 0.0) AS lcl, count(*) AS n
  FROM daily)"""


@register("control_limits", "T4", with_fact("""
SELECT round(mean, 6) AS mean, round(ucl, 6) AS ucl, round(lcl, 6) AS lcl, n FROM limits""", DAILY, _LIMITS_SQL))
def q_control_limits(spark, sf_dir):
    return rounded(TS.control_limits(TS.trend_by_period(fact(spark, sf_dir), "D")))


@register("out_of_control", "T5", with_fact("""
SELECT period, round(value, 6) AS value, round(mean, 6) AS mean, round(ucl, 6) AS ucl, round(lcl, 6) AS lcl
FROM daily CROSS JOIN limits WHERE value > ucl OR value < lcl""", DAILY, _LIMITS_SQL))
def q_out_of_control(spark, sf_dir):
    return rounded(TS.out_of_control(TS.trend_by_period(fact(spark, sf_dir), "D")))


# The twin is written for the period the default rule picks on these
# tables: n = number of days >= 90, so m = min(30, max(2, n // 3)) = 30.
_DECOMP_SQL = """
ix AS (SELECT period, value, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM daily),
tr AS (
  SELECT *, CASE WHEN i - 15 >= 0 AND i + 15 <= n - 1 THEN
    (sum(value) OVER (ORDER BY i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)
     - 0.5 * lag(value, 15) OVER (ORDER BY i) - 0.5 * lead(value, 15) OVER (ORDER BY i)) / 30.0 END AS trend
  FROM ix WHERE n >= 24
),
ph AS (SELECT i % 30 AS phase, avg(value - trend) AS pa FROM tr GROUP BY 1),
ph2 AS (SELECT phase, pa - avg(pa) OVER () AS seasonal FROM ph),
dec AS (
  SELECT tr.period, tr.value, tr.trend, ph2.seasonal, (tr.value - tr.trend) - ph2.seasonal AS resid
  FROM tr JOIN ph2 ON tr.i % 30 = ph2.phase
)"""


@register("seasonal_decompose", "T6", with_fact("""
SELECT period, round(value, 6) AS value, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal,
  round(resid, 6) AS resid FROM dec""", DAILY, _DECOMP_SQL))
def q_seasonal_decompose(spark, sf_dir):
    return rounded(TS.seasonal_decompose(TS.trend_by_period(fact(spark, sf_dir), "D")))


@register("decomposition_summary", "T6 summary", with_fact("""
SELECT round(quantile_cont(trend, 0.5), 6) AS median_trend, count(*) AS n FROM dec""", DAILY, _DECOMP_SQL))
def q_decomposition_summary(spark, sf_dir):
    d = TS.seasonal_decompose(TS.trend_by_period(fact(spark, sf_dir), "D"))
    return rounded(TS.decomposition_summary(d))


def _thin_sql(src: str, order: str, cols: str, k: int) -> str:
    return f"""
r AS (SELECT {cols}, row_number() OVER (ORDER BY {order}) - 1 AS pos, count(*) OVER () AS n FROM {src}),
nn AS (SELECT DISTINCT n FROM r),
keep AS (
  SELECT DISTINCT CASE WHEN nn.n <= {k} THEN i WHEN i = {k - 1} THEN nn.n - 1
         ELSE CAST(floor(i * (CAST(nn.n - 1 AS DOUBLE) / {float(k - 1)})) AS BIGINT) END AS kp
  FROM nn, range({k}) t(i) WHERE i < nn.n
)"""


@register("thin_daily_trend", "T7", with_fact("""
SELECT period, round(value, 6) AS value, CAST(pos AS BIGINT) AS pos FROM r WHERE pos IN (SELECT kp FROM keep)""",
    DAILY, _thin_sql("daily", "period", "period, value", 100)))
def q_thin_daily_trend(spark, sf_dir):
    return rounded(TS.thin_series(TS.trend_by_period(fact(spark, sf_dir), "D"), k=100))


@register("quality_index_series", "X4", with_fact("""
SELECT "Date", QualityIndex, CAST(pos AS BIGINT) AS pos FROM r WHERE pos IN (SELECT kp FROM keep)""",
    QI_CTE, """s AS (SELECT "Date", round(QualityIndex, 6) AS QualityIndex FROM qi
       WHERE "Date" IS NOT NULL AND QualityIndex IS NOT NULL)""",
    _thin_sql("s", '"Date", QualityIndex', '"Date", QualityIndex', 2500)))
def q_quality_index_series(spark, sf_dir):
    return quality_index_series(fact(spark, sf_dir), k=2500, digits=6)


# ---------------------------------------------------------------- C


@register("copq_what_if", "C1", with_fact("""
SELECT round(baseline_copq, 4) AS baseline_copq, reduction_pct,
  round(CASE WHEN d <= 0 OR baseline_copq <= 0 THEN 0.0 ELSE baseline_copq * (reduction_pct / 100.0) END, 4)
    AS estimated_savings,
  round(CASE WHEN d <= 0 OR baseline_copq <= 0 THEN baseline_copq
        ELSE greatest(0.0, baseline_copq - baseline_copq * (reduction_pct / 100.0)) END, 4) AS projected_copq
FROM (SELECT coalesce(sum(CostImpact), 0.0) AS baseline_copq, coalesce(sum(DefectCount), 0) AS d FROM fact),
     (SELECT CAST(p AS DOUBLE) AS reduction_pct FROM (VALUES (2.0), (5.0), (10.0)) t(p))"""))
def q_copq_what_if(spark, sf_dir):
    out = CQ.copq_what_if(fact(spark, sf_dir), pct=[2.0, 5.0, 10.0])
    return rounded(out, money=("baseline_copq", "estimated_savings", "projected_copq"))


_MIDX = """midx AS (SELECT period, value, CAST(row_number() OVER (ORDER BY period) - 1 AS DOUBLE) AS x FROM mcopq)"""


@register("forecast_linear", "C2", with_fact("""
SELECT last_day(CAST(last + to_months(CAST(j AS INTEGER)) AS DATE)) AS period,
  round(a + b * CAST(n - 1 + j AS DOUBLE), 4) AS forecast
FROM (SELECT regr_slope(value, x) AS b, regr_intercept(value, x) AS a, count(*) AS n, max(period) AS last FROM midx),
     generate_series(1, 3) t(j)
WHERE n >= 3""", MCOPQ, _MIDX))
def q_forecast_linear(spark, sf_dir):
    return rounded(CQ.forecast_copq(fact(spark, sf_dir), 3, "linear"), money=("forecast",))


_AR1 = """
d1 AS (SELECT period, value, value - lag(value) OVER (ORDER BY period) AS d FROM midx),
d2 AS (SELECT *, lag(d) OVER (ORDER BY period) AS dprev FROM d1),
fit AS (
  SELECT regr_slope(d, dprev) AS b0, regr_intercept(d, dprev) AS a0, avg(d) AS dmean, count(*) AS n,
         max(period) AS last, arg_max(value, period) AS ylast, arg_max(d, period) AS dlast FROM d2
),
f2 AS (SELECT n, last, ylast, dlast, coalesce(b0, 0.0) AS b, CASE WHEN b0 IS NULL THEN dmean ELSE a0 END AS a
       FROM fit WHERE n >= 3),
st AS (
  SELECT *, CASE WHEN b = 1.0 THEN a * j + dlast
            ELSE a * (1.0 - pow(b, j)) / (1.0 - b) + pow(b, j) * dlast END AS dj
  FROM f2, (SELECT CAST(generate_series AS DOUBLE) AS j FROM generate_series(1, 3))
),
ar1 AS (
  SELECT last_day(CAST(last + to_months(CAST(j AS INTEGER)) AS DATE)) AS period,
         ylast + sum(dj) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forecast FROM st
)"""


@register("forecast_ar1", "C3", with_fact("SELECT period, round(forecast, 4) AS forecast FROM ar1", MCOPQ, _MIDX, _AR1))
def q_forecast_ar1(spark, sf_dir):
    return rounded(CQ.forecast_copq(fact(spark, sf_dir), 3, "ar1"), money=("forecast",))


@register("forecast_summary", "C4", with_fact("""
SELECT round(avg(forecast), 4) AS mean_forecast, count(*) AS months FROM ar1""", MCOPQ, _MIDX, _AR1))
def q_forecast_summary(spark, sf_dir):
    return rounded(CQ.forecast_summary(CQ.forecast_copq(fact(spark, sf_dir), 3, "ar1")), money=("mean_forecast",))


# ---------------------------------------------------------------- A


@register("alert_defect_rate", "A1", with_fact("""
SELECT 'defect_rate' AS "key", printf('High overall defect rate: %.2f%% (threshold %s%%)', v, '1.0') AS message,
  round(v, 6) AS value, 1.0::DOUBLE AS threshold
FROM (SELECT avg(DefectRate) * 100.0 AS v FROM fact) WHERE v IS NOT NULL AND v > 1.0"""))
def q_alert_defect_rate(spark, sf_dir):
    return rounded(A.alert_defect_rate(fact(spark, sf_dir), DEFAULT_PARAMS.with_(alert_defect_rate_threshold=1.0)))


_SPIKE = """spk AS (
  SELECT period, value, avg(value) OVER w AS baseline, count(*) OVER w AS wn, count(*) OVER () AS n,
         max(period) OVER () AS last
  FROM dcopq WINDOW w AS (ORDER BY period ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
)"""


@register("copq_spike_days", "A3", with_fact("""
SELECT period, round(value, 4) AS value, round(baseline, 4) AS baseline, period = last AS is_last
FROM spk WHERE n > 7 AND wn = 7 AND value > baseline + 10000.0""", DCOPQ, _SPIKE))
def q_copq_spike_days(spark, sf_dir):
    return rounded(A.copq_spike_days(fact(spark, sf_dir)), money=("value", "baseline"))


@register("alert_copq_spike", "A2", with_fact("""
SELECT 'copq_spike' AS "key", printf('COPQ spike: today''s cost %.0f vs 7-day avg %.0f', value, baseline) AS message,
  round(value, 4) AS value, 10000.0::DOUBLE AS threshold
FROM spk WHERE n > 7 AND wn = 7 AND value > baseline + 10000.0 AND period = last""", DCOPQ, _SPIKE))
def q_alert_copq_spike(spark, sf_dir):
    return rounded(A.alert_copq_spike(fact(spark, sf_dir)), money=("value",))
