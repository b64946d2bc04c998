"""Registered queries: supplier scorecard, COPQ scenarios, quality index."""

from __future__ import annotations

from inspectkit.operators import qindex as X
from inspectkit.operators import suppliers as V
from inspectkit.plans.catalog import fact, register, rounded
from inspectkit.plans.oracle import with_fact
from inspectkit.plans.q_basic import QI_CTE

_SCORE_CTE = """
m AS (
  SELECT Supplier, count(*) AS Volume,
    coalesce(CAST(sum(DefectCount) AS DOUBLE) / nullif(CAST(sum(UnitsInspected) AS DOUBLE), 0.0), 0.0) AS DefectRate,
    coalesce(avg(OnTimeFlag), 0.0) AS OnTimeRate, coalesce(avg(CostImpact), 0.0) AS AvgCostImpact
  FROM fact WHERE Supplier IS NOT NULL GROUP BY Supplier
),
mm AS (
  SELECT min(DefectRate) AS mn_d, max(DefectRate) AS mx_d, min(OnTimeRate) AS mn_o, max(OnTimeRate) AS mx_o,
         min(AvgCostImpact) AS mn_c, max(AvgCostImpact) AS mx_c FROM m
),
sc AS (
  SELECT m.*,
    CASE WHEN mn_d IS NULL OR mx_d IS NULL OR mn_d = mx_d THEN 0.5 ELSE 1.0 - (DefectRate - mn_d) / (mx_d - mn_d) END AS DefectScore,
    CASE WHEN mn_o IS NULL OR mx_o IS NULL OR mn_o = mx_o THEN 0.5 ELSE (OnTimeRate - mn_o) / (mx_o - mn_o) END AS DeliveryScore,
    CASE WHEN mn_c IS NULL OR mx_c IS NULL OR mn_c = mx_c THEN 0.5 ELSE 1.0 - (AvgCostImpact - mn_c) / (mx_c - mn_c) END AS CostScore
  FROM m CROSS JOIN mm
),
sc2 AS (
  SELECT *,
    coalesce(DefectScore, 0.5) * 0.5 + coalesce(DeliveryScore, 0.5) * 0.3 + coalesce(CostScore, 0.5) * 0.2 AS TotalScore,
    least(greatest(DefectRate, 0.0), 1.0) AS p, greatest(CAST(Volume AS DOUBLE), 1.0) AS nn
  FROM sc
),
mon AS (
  SELECT Supplier, date_trunc('month', "Date") AS mth, CAST(coalesce(sum(DefectCount), 0) AS DOUBLE) AS v
  FROM fact WHERE Supplier IS NOT NULL AND "Date" IS NOT NULL GROUP BY 1, 2
),
rk AS (
  SELECT Supplier, v, row_number() OVER (PARTITION BY Supplier ORDER BY mth) AS ra,
         row_number() OVER (PARTITION BY Supplier ORDER BY mth DESC) AS rd FROM mon
),
tr AS (
  SELECT Supplier,
    CASE WHEN count(*) < 3 THEN '→'
         WHEN avg(CASE WHEN rd <= 3 THEN v END) > avg(CASE WHEN ra <= 3 THEN v END) THEN '↑'
         WHEN avg(CASE WHEN rd <= 3 THEN v END) < avg(CASE WHEN ra <= 3 THEN v END) THEN '↓'
         ELSE '→' END AS TrendArrow
  FROM rk GROUP BY Supplier
),
card AS (
  SELECT sc2.Supplier, Volume, DefectRate, OnTimeRate, AvgCostImpact, DefectScore, DeliveryScore, CostScore, TotalScore,
    greatest(p - 1.96 * sqrt(p * (1.0 - p) / nn), 0.0) AS DefectRateLower,
    least(p + 1.96 * sqrt(p * (1.0 - p) / nn), 1.0) AS DefectRateUpper,
    tr.TrendArrow,
    CASE WHEN TotalScore > -0.01 AND TotalScore <= 0.4 THEN 'High Risk'
         WHEN TotalScore > 0.4 AND TotalScore <= 0.7 THEN 'Moderate'
         WHEN TotalScore > 0.7 AND TotalScore <= 1.01 THEN 'Preferred' END AS RiskBand,
    Volume >= 5 AS RankEligible
  FROM sc2 LEFT JOIN tr ON sc2.Supplier = tr.Supplier
)"""

_CARD_COLS = """Supplier, Volume, round(DefectRate, 6) AS DefectRate, round(OnTimeRate, 6) AS OnTimeRate,
  round(AvgCostImpact, 6) AS AvgCostImpact, round(DefectScore, 6) AS DefectScore,
  round(DeliveryScore, 6) AS DeliveryScore, round(CostScore, 6) AS CostScore, round(TotalScore, 6) AS TotalScore,
  round(DefectRateLower, 6) AS DefectRateLower, round(DefectRateUpper, 6) AS DefectRateUpper,
  TrendArrow, RiskBand, RankEligible"""


@register("supplier_ranking", "V1-V6", with_fact(f"""
SELECT {_CARD_COLS} FROM card ORDER BY RankEligible DESC, TotalScore DESC, Supplier""", _SCORE_CTE))
def q_supplier_ranking(spark, sf_dir):
    return rounded(V.supplier_ranking(fact(spark, sf_dir)))


@register("supplier_radar", "V7", with_fact("""
SELECT Supplier, axis, round(score, 6) AS score FROM (
  SELECT * FROM card ORDER BY RankEligible DESC, TotalScore DESC, Supplier LIMIT 1) t,
  (VALUES ('Defect'), ('Delivery'), ('Cost'), ('Total')) ax(axis),
  LATERAL (SELECT CASE ax.axis WHEN 'Defect' THEN t.DefectScore WHEN 'Delivery' THEN t.DeliveryScore
                   WHEN 'Cost' THEN t.CostScore ELSE t.TotalScore END AS score) s""", _SCORE_CTE))
def q_supplier_radar(spark, sf_dir):
    return rounded(V.supplier_radar(V.supplier_scorecard(fact(spark, sf_dir))))


@register("supplier_trend", "V4", with_fact("""
SELECT Supplier, TrendArrow FROM tr""", _SCORE_CTE))
def q_supplier_trend(spark, sf_dir):
    return V.supplier_trend(fact(spark, sf_dir))


# ---------------------------------------------------------------- X


def _histogram_sql() -> str:
    return with_fact("""
SELECT bin, round(lo + (bin - 1) * (hi - lo) / 20.0, 6) AS bin_lo, round(lo + bin * (hi - lo) / 20.0, 6) AS bin_hi,
  coalesce(n, 0)::BIGINT AS count
FROM (SELECT *, unnest(range(1, 21))::INTEGER AS bin FROM r)
LEFT JOIN (
  SELECT least(floor((QualityIndex - lo) * 20.0 / (hi - lo))::INTEGER + 1, 20) AS bin, count(*) AS n
  FROM qi, r WHERE QualityIndex IS NOT NULL GROUP BY 1) USING (bin)""", QI_CTE, """r AS (
  SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
  FROM (SELECT min(QualityIndex) AS mn, max(QualityIndex) AS mx FROM qi) WHERE mn IS NOT NULL)""")


@register("quality_index_histogram", "X3", _histogram_sql())
def q_quality_index_histogram(spark, sf_dir):
    return rounded(X.quality_index_histogram(fact(spark, sf_dir)))



@register("supplier_metrics", "V1", with_fact("""
SELECT Supplier, Volume, round(DefectRate, 6) AS DefectRate, round(OnTimeRate, 6) AS OnTimeRate,
  round(AvgCostImpact, 6) AS AvgCostImpact FROM m""", _SCORE_CTE))
def q_supplier_metrics(spark, sf_dir):
    return rounded(V.supplier_metrics(fact(spark, sf_dir)))


@register("supplier_scores", "V2+V3+V5", with_fact("""
SELECT Supplier, round(DefectScore, 6) AS DefectScore, round(DeliveryScore, 6) AS DeliveryScore,
  round(CostScore, 6) AS CostScore, round(TotalScore, 6) AS TotalScore,
  round(DefectRateLower, 6) AS DefectRateLower, round(DefectRateUpper, 6) AS DefectRateUpper, RiskBand
FROM card""", _SCORE_CTE))
def q_supplier_scores(spark, sf_dir):
    from pyspark.sql import functions as F

    s = V.supplier_scores(V.supplier_metrics(fact(spark, sf_dir)))
    return rounded(s.select("Supplier", "DefectScore", "DeliveryScore", "CostScore", "TotalScore",
                            "DefectRateLower", "DefectRateUpper", V.risk_band(F.col("TotalScore")).alias("RiskBand")))


def _qi_sql():

    return with_fact("""
SELECT Supplier, Part_Type, "Date", DefectCount, round(QualityIndex, 6) AS QualityIndex FROM qi""", QI_CTE)


@register("quality_index", "X1", _qi_sql())
def q_quality_index(spark, sf_dir):
    shown = ["Supplier", "Part_Type", "Date", "DefectCount"]
    q = X.quality_index(X.index_columns(fact(spark, sf_dir), shown), stored=True)
    return rounded(q.select(*shown, X.INDEX))
