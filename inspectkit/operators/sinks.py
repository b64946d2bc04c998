"""Report bundle, report summary and narrative facts.

W1 writes each table with the DataFrame writer (parallel, one file per
partition, atomic job commit), so nothing passes through the driver and
there is no row cut; the summaries are computed from the written rows
table, so the input plan runs once.  W2/W3 are small long tables assembled from the
operators' (already aggregated) outputs with ``unionByName``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators.copq import copq_what_if
from inspectkit.operators.kpis import KPI_COLUMNS, executive_kpis
from inspectkit.operators.qindex import index_columns
from inspectkit.operators.rootcause import defect_cost_by_part, defect_pareto, root_cause_drilldown
from inspectkit.operators.suppliers import supplier_scorecard
from inspectkit.operators.timeseries import monthly_copq, out_of_control, trend_by_period
from inspectkit.params import DEFAULT_PARAMS, QualityParams
from inspectkit.session import written, written_columns

BUNDLE_TABLES = ("filtered_rows", "kpis", "pareto", "supplier_scores", "drilldown", "monthly_copq")
KPI_METRICS = ("Rows", "Defects", "COPQ", "OnTimeRate", "YieldPct", "QualityIndex")
NARRATIVE_COLUMNS = (C.PART_TYPE, C.DEFECT_TYPE, C.DEFECT_COUNT, C.COST_IMPACT, C.SUPPLIER, C.DATE, C.UNITS_INSPECTED, C.ON_TIME_FLAG)
WHAT_IF_METRICS = ("baseline_copq", "reduction_pct", "estimated_savings", "projected_copq")


def report_tables(df: DataFrame, params: QualityParams = DEFAULT_PARAMS) -> dict[str, DataFrame]:
    """The six tables of the analysis export (no row cap on the rows table)."""
    return {
        "filtered_rows": df,
        "kpis": executive_kpis(df, params),
        "pareto": defect_pareto(df, params=params),
        "supplier_scores": supplier_scorecard(df, params),
        "drilldown": root_cause_drilldown(df),
        "monthly_copq": monthly_copq(df),
    }


def write_report_bundle(df: DataFrame, out_dir: str, fmt: str = "parquet",
                        params: QualityParams = DEFAULT_PARAMS, mode: str = "overwrite") -> dict[str, str]:
    """Write the six tables under ``out_dir`` (parquet or csv).

    The rows table is written first; the five summaries are computed from
    that written table (for csv, which loses types, from a parquet copy in the
    shared folder), so the (possibly expensive) input plan runs once and the
    summaries' lineage starts at files.
    """
    spark = df.sparkSession
    base = out_dir.rstrip("/")

    def write(t: DataFrame, p: str) -> None:
        w = t.write.mode(mode)
        if fmt == "csv":
            w.option("header", True).csv(p)
        else:
            w.format(fmt).save(p)

    paths = {"filtered_rows": f"{base}/filtered_rows"}
    if fmt == "csv":
        src = written(df, "report-rows")
        write(src, paths["filtered_rows"])
    else:
        write(df, paths["filtered_rows"])
        src = spark.read.format(fmt).load(paths["filtered_rows"])
    for name, t in report_tables(src, params).items():
        if name == "filtered_rows":
            continue
        paths[name] = f"{base}/{name}"
        write(t, paths[name])
    return paths


def _long(df: DataFrame, section: str, metrics: tuple[str, ...]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("seq"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for i, m in enumerate(metrics)
    ])).alias("s")).select(F.lit(section).alias("section"), "s.seq", "s.metric", "s.value")


def report_summary(df: DataFrame, params: QualityParams = DEFAULT_PARAMS, top: int = 5) -> DataFrame:
    """KPIs, top Pareto entries and the what-if as ``(section, seq, metric, value)``.
    The columns that they read are written once."""
    df = index_columns(df, KPI_COLUMNS)
    kpis = _long(executive_kpis(df, params, stored=True), "kpis", KPI_METRICS)
    par = defect_pareto(df, params=params)
    from pyspark.sql import Window

    w = Window.orderBy(F.col("Count").desc(), F.col(C.DEFECT_TYPE).asc())
    # the Pareto table has at most max_category_labels rows
    par = par.select(F.lit("pareto").alias("section"), F.row_number().over(w).alias("seq"),
                     F.col(C.DEFECT_TYPE).alias("metric"), F.col("Count").cast("double").alias("value"))
    par = par.filter(F.col("seq") <= top)
    wi = _long(copq_what_if(df, params=params), "what_if", WHAT_IF_METRICS)
    return reduce(lambda a, b: a.unionByName(b), [kpis, par, wi])


def narrative_facts(df: DataFrame, params: QualityParams = DEFAULT_PARAMS, top: int = 5) -> DataFrame:
    """The facts the pages print, as ``(section, seq, label, value)``:
    highest-burden part type, top Pareto entries, top suppliers by rank,
    and trend counts (observations, mean daily defects, out-of-control points).
    The columns that they read are written once."""
    from pyspark.sql import Window

    df = written_columns(df, NARRATIVE_COLUMNS, "narrative-columns")
    part = defect_cost_by_part(df, 1, params).select(
        F.lit("top_part_type").alias("section"), F.lit(1).alias("seq"),
        F.col(C.PART_TYPE).alias("label"), F.col("Defects").cast("double").alias("value"))
    w = Window.orderBy(F.col("Count").desc(), F.col(C.DEFECT_TYPE).asc())
    par = defect_pareto(df, params=params).select(
        F.lit("pareto").alias("section"), F.row_number().over(w).alias("seq"),
        F.col(C.DEFECT_TYPE).alias("label"), F.col("CumulativePct").alias("value")).filter(F.col("seq") <= top)
    card = supplier_scorecard(df, params)
    sup = card.orderBy(F.col("RankEligible").desc(), F.col("TotalScore").desc(), F.col(C.SUPPLIER).asc()).limit(top)
    ws = Window.orderBy(F.col("RankEligible").desc(), F.col("TotalScore").desc(), F.col(C.SUPPLIER).asc())
    sup = sup.select(F.lit("top_suppliers").alias("section"), F.row_number().over(ws).alias("seq"),
                     F.col(C.SUPPLIER).alias("label"), F.col("TotalScore").alias("value"))
    daily = trend_by_period(df, "D")
    obs = daily.agg(F.count(F.lit(1)).cast("double").alias("observations"),
                    F.avg("value").alias("mean_daily_defects"))
    ooc = out_of_control(daily, params=params).agg(F.count(F.lit(1)).cast("double").alias("out_of_control"))
    tr = obs.crossJoin(ooc)
    tr = tr.select(F.explode(F.array(
        F.struct(F.lit(1).alias("seq"), F.lit("observations").alias("label"), F.col("observations").alias("value")),
        F.struct(F.lit(2).alias("seq"), F.lit("mean_daily_defects").alias("label"), F.col("mean_daily_defects").alias("value")),
        F.struct(F.lit(3).alias("seq"), F.lit("out_of_control").alias("label"), F.col("out_of_control").alias("value")),
    )).alias("s")).select(F.lit("trend").alias("section"), "s.seq", "s.label", "s.value")
    return reduce(lambda a, b: a.unionByName(b), [part, par, sup, tr])
