"""V1-V7: supplier scorecard.

Plan shape: ONE aggregation of the fact per (Supplier, month) (partial
aggregation collapses a hot supplier map-side before the shuffle); the
per-supplier metrics and the monthly trend are both re-aggregations of
those partials (rows = suppliers x months), and one global 1-row
aggregation of min/max over the per-supplier table is broadcast back (one
row: a proven size bound).  The partials are checkpointed once (column
pruning would otherwise make the three branches rescan the fact).  Nothing
uses a window over all suppliers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.params import DEFAULT_PARAMS, QualityParams
from inspectkit.session import empty, materialize

# --- Fixed values: trend arrows and risk bands (right-closed bins) ---
ARROW_UP = "↑"
ARROW_DOWN = "↓"
ARROW_FLAT = "→"
RISK_BANDS = ((-0.01, 0.4, "High Risk"), (0.4, 0.7, "Moderate"), (0.7, 1.01, "Preferred"))

SCORECARD_SCHEMA = (
    "Supplier string, Volume bigint, DefectRate double, OnTimeRate double, AvgCostImpact double, "
    "DefectScore double, DeliveryScore double, CostScore double, TotalScore double, "
    "DefectRateLower double, DefectRateUpper double, TrendArrow string, RiskBand string, RankEligible boolean"
)


def supplier_month_partials(df: DataFrame) -> DataFrame:
    """One aggregation of the fact per (Supplier, month): every scorecard
    input is a sum or count of these partials, so the fact is scanned and
    shuffled once for both the metrics (all rows, month NULL for undated
    rows) and the trend (dated months only)."""
    month = F.date_trunc("month", C.DATE) if C.has(df, C.DATE) else F.lit(None).cast("timestamp")
    aggs = [F.count(F.lit(1)).alias("__n")]
    if C.has(df, C.DEFECT_COUNT):
        aggs.append(F.sum(F.col(C.DEFECT_COUNT).cast("double")).alias("__d"))
    if C.has(df, C.UNITS_INSPECTED):
        aggs.append(F.sum(F.col(C.UNITS_INSPECTED).cast("double")).alias("__u"))
    if C.has(df, C.DEFECT_TYPE):
        aggs.append(F.count(C.DEFECT_TYPE).alias("__c"))
    if C.has(df, C.ON_TIME_FLAG):
        aggs += [F.sum(F.col(C.ON_TIME_FLAG).cast("double")).alias("__ot_s"), F.count(C.ON_TIME_FLAG).alias("__ot_n")]
    if C.has(df, C.COST_IMPACT):
        aggs += [F.sum(F.col(C.COST_IMPACT).cast("double")).alias("__ci_s"), F.count(C.COST_IMPACT).alias("__ci_n")]
    return df.filter(F.col(C.SUPPLIER).isNotNull()).groupBy(C.SUPPLIER, month.alias("__m")).agg(*aggs)


def supplier_metrics(df: DataFrame, partials: DataFrame | None = None) -> DataFrame:
    """V1: Volume, DefectRate, OnTimeRate, AvgCostImpact per non-NULL Supplier."""
    p = supplier_month_partials(df) if partials is None else partials
    cols = set(p.columns)
    has_units = {"__d", "__u"} <= cols
    aggs = [F.sum("__n").alias("Volume")]
    if has_units:
        aggs += [F.sum("__d").alias("__d"), F.sum("__u").alias("__u")]
    elif "__c" in cols:
        aggs.append(F.sum("__c").cast("double").alias("__c"))
    aggs.append((F.coalesce(F.sum("__ot_s") / F.nullif(F.sum("__ot_n").cast("double"), F.lit(0.0)), F.lit(0.0))
                 if "__ot_s" in cols else F.lit(None).cast("double")).alias("OnTimeRate"))
    aggs.append((F.coalesce(F.sum("__ci_s") / F.nullif(F.sum("__ci_n").cast("double"), F.lit(0.0)), F.lit(0.0))
                 if "__ci_s" in cols else F.lit(None).cast("double")).alias("AvgCostImpact"))
    g = p.groupBy(C.SUPPLIER).agg(*aggs)
    if has_units:
        rate = F.coalesce(F.col("__d") / F.nullif(F.col("__u"), F.lit(0.0)), F.lit(0.0))
        return g.select(C.SUPPLIER, "Volume", rate.alias("DefectRate"), "OnTimeRate", "AvgCostImpact")
    # without units: count relative to the largest supplier count (1-row broadcast)
    cnt = "__c" if "__c" in cols else "Volume"
    mx = g.agg(F.max(F.col(cnt).cast("double")).alias("__mx"))
    rate = F.coalesce(F.col(cnt).cast("double") / F.nullif(F.col("__mx"), F.lit(0.0)), F.lit(0.0))
    return g.crossJoin(F.broadcast(mx)).select(C.SUPPLIER, "Volume", rate.alias("DefectRate"), "OnTimeRate", "AvgCostImpact")


def _minmax_score(v: Column, lo: Column, hi: Column, higher_better: bool) -> Column:
    scaled = (v - lo) / F.nullif(hi - lo, F.lit(0.0))
    if not higher_better:
        scaled = F.lit(1.0) - scaled
    return F.when(lo.isNull() | hi.isNull() | (lo == hi), F.lit(0.5)).otherwise(scaled)


def supplier_scores(metrics: DataFrame, params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """V2 + V3: min-max scores across suppliers, weighted TotalScore, Wald CI."""
    mm = metrics.agg(
        *[f(F.col(c)).alias(f"__{n}_{c}") for c in ("DefectRate", "OnTimeRate", "AvgCostImpact")
          for n, f in (("mn", F.min), ("mx", F.max))]
    )
    j = metrics.crossJoin(F.broadcast(mm))

    def score(c: str, hb: bool) -> Column:
        return _minmax_score(F.col(c), F.col(f"__mn_{c}"), F.col(f"__mx_{c}"), hb)

    ds, dl, cs = score("DefectRate", False), score("OnTimeRate", True), score("AvgCostImpact", False)
    j = j.select(
        C.SUPPLIER, "Volume", "DefectRate", "OnTimeRate", "AvgCostImpact",
        ds.alias("DefectScore"), dl.alias("DeliveryScore"), cs.alias("CostScore"),
    )
    total = (
        F.coalesce(F.col("DefectScore"), F.lit(0.5)) * F.lit(params.weight_defect)
        + F.coalesce(F.col("DeliveryScore"), F.lit(0.5)) * F.lit(params.weight_delivery)
        + F.coalesce(F.col("CostScore"), F.lit(0.5)) * F.lit(params.weight_cost)
    )
    n = F.greatest(F.col("Volume").cast("double"), F.lit(1.0))
    p = F.least(F.greatest(F.col("DefectRate"), F.lit(0.0)), F.lit(1.0))
    margin = F.lit(params.confidence_z_score) * F.sqrt(p * (F.lit(1.0) - p) / n)
    return j.select(
        "*",
        total.alias("TotalScore"),
        F.greatest(p - margin, F.lit(0.0)).alias("DefectRateLower"),
        F.least(p + margin, F.lit(1.0)).alias("DefectRateUpper"),
    )


def supplier_trend(df: DataFrame, params: QualityParams = DEFAULT_PARAMS, partials: DataFrame | None = None) -> DataFrame:
    """V4: monthly defects per supplier (months with data only); with at
    least ``w`` months, mean of the last ``w`` vs the first ``w`` gives an
    up/down/flat arrow, else flat.  Suppliers without a dated row are absent
    (their arrow is NULL after the left join)."""
    w = params.supplier_trend_window
    p = supplier_month_partials(df) if partials is None else partials
    val = F.coalesce(F.col("__d"), F.lit(0.0)) if C.has(df, C.DEFECT_COUNT) else F.col("__n").cast("double")
    monthly = p.filter(F.col("__m").isNotNull()).select(C.SUPPLIER, "__m", val.alias("__v"))
    # per-supplier windows over that supplier's months only (bounded by the calendar)
    asc = Window.partitionBy(C.SUPPLIER).orderBy(F.col("__m").asc())
    desc = Window.partitionBy(C.SUPPLIER).orderBy(F.col("__m").desc())
    ranked = monthly.select(
        C.SUPPLIER, "__v", F.row_number().over(asc).alias("__ra"), F.row_number().over(desc).alias("__rd")
    )
    t = ranked.groupBy(C.SUPPLIER).agg(
        F.count(F.lit(1)).alias("__months"),
        F.avg(F.when(F.col("__rd") <= w, F.col("__v"))).alias("__recent"),
        F.avg(F.when(F.col("__ra") <= w, F.col("__v"))).alias("__first"),
    )
    arrow = (
        F.when(F.col("__months") < w, F.lit(ARROW_FLAT))
        .when(F.col("__recent") > F.col("__first"), F.lit(ARROW_UP))
        .when(F.col("__recent") < F.col("__first"), F.lit(ARROW_DOWN))
        .otherwise(F.lit(ARROW_FLAT))
    )
    return t.select(C.SUPPLIER, arrow.alias("TrendArrow"))


def risk_band(score: Column) -> Column:
    """V5: right-closed bands; outside (-0.01, 1.01] or NULL -> NULL."""
    out = None
    for lo, hi, label in RISK_BANDS:
        cond = (score > F.lit(lo)) & (score <= F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def supplier_scorecard(df: DataFrame, params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """V1-V5 + eligibility, unordered (use ``supplier_ranking`` for the order)."""
    if not C.has(df, C.SUPPLIER):
        return empty(df.sparkSession, SCORECARD_SCHEMA)
    # suppliers x months rows, read by the metrics, their min/max and the
    # trend: computed once, so the fact is scanned once
    partials = materialize(supplier_month_partials(df))
    s = supplier_scores(supplier_metrics(df, partials), params)
    if C.has(df, C.DATE):
        s = s.join(supplier_trend(df, params, partials), C.SUPPLIER, "left")
    else:
        s = s.withColumn("TrendArrow", F.lit(ARROW_FLAT))
    return s.select(
        "*",
        risk_band(F.col("TotalScore")).alias("RiskBand"),
        (F.col("Volume") >= F.lit(params.supplier_min_volume_for_ranking)).alias("RankEligible"),
    )


def supplier_ranking(df: DataFrame, params: QualityParams = DEFAULT_PARAMS) -> DataFrame:
    """V6: the scorecard ordered eligible first, then TotalScore desc, then
    Supplier (D2).  A global sort: range-partitioned, no single task."""
    sc = supplier_scorecard(df, params)
    return sc.orderBy(F.col("RankEligible").desc(), F.col("TotalScore").desc(), F.col(C.SUPPLIER).asc())


def supplier_radar(scores: DataFrame, supplier: str | None = None) -> DataFrame:
    """V7: the four scores of one supplier (default: the top-ranked) as rows."""
    if supplier is None:
        row = scores.orderBy(F.col("RankEligible").desc(), F.col("TotalScore").desc(), F.col(C.SUPPLIER).asc()).limit(1)
    else:
        row = scores.filter(F.col(C.SUPPLIER) == F.lit(supplier)).limit(1)
    return row.select(
        C.SUPPLIER,
        F.expr(
            "stack(4, 'Defect', DefectScore, 'Delivery', DeliveryScore, 'Cost', CostScore, 'Total', TotalScore)"
        ).alias("axis", "score"),
    )
