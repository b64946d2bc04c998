"""Registered queries: data-quality report (Q1-Q6) and report sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators import report as Q
from inspectkit.operators import sinks as W
from inspectkit.plans.catalog import fact, register, rounded
from inspectkit.plans.oracle import FACT_COLUMNS, with_fact
from inspectkit.plans.q_analytics import _SCORE_CTE
from inspectkit.plans.q_basic import QI_CTE
from inspectkit.plans.q_timeseries import _LIMITS_SQL, DAILY
from inspectkit.session import scratch_path

# Column order and types of the normalised fact built from the test tables
# (checked against the Spark schema in tests/test_plans.py).
def _missing_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(FACT_COLUMNS):
        cond = f'"{c}" IS NULL' + (f' OR isnan("{c}")' if t == "double" else "")
        parts.append(f"SELECT {i} AS seq, '{c}' AS \"column\", "
                     f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM fact")
    return "miss AS (\n" + "\nUNION ALL ".join(parts) + "\n),\nnrows AS (SELECT count(*) AS n FROM fact)"


_N_NUM = sum(1 for _, t in FACT_COLUMNS if t in ("double", "bigint"))
_N_CAT = sum(1 for _, t in FACT_COLUMNS if t == "string")

_REPORT_SQL = f"""rep AS (
  SELECT count(*) AS row_count, CAST({len(FACT_COLUMNS)} AS BIGINT) AS column_count,
    CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM fact)) AS BIGINT) AS duplicated_rows,
    'Date' AS detected_date_column,
    CAST(count(*) FILTER (WHERE Cost_Impact_SGD < 0) AS BIGINT) AS negative_costs,
    CAST(count(*) FILTER (WHERE UnitsInspected = 0) AS BIGINT) AS zero_inspected,
    CAST({_N_NUM} AS BIGINT) AS numeric_columns, CAST({_N_CAT} AS BIGINT) AS categorical_columns
  FROM fact)"""


@register("missing_by_column", "Q1", with_fact("""
SELECT seq, "column", coalesce(missing, 0) AS missing, round(CAST(missing AS DOUBLE) / nullif(CAST(n AS DOUBLE), 0.0), 6)
  AS missing_frac FROM miss CROSS JOIN nrows""", _missing_sql()))
def q_missing_by_column(spark, sf_dir):
    return rounded(Q.missing_by_column(fact(spark, sf_dir)))


@register("duplicate_rows", "Q2", with_fact("""
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM twice)) AS BIGINT) AS duplicated_rows FROM twice""",
    "twice AS (SELECT * FROM fact UNION ALL SELECT * FROM fact WHERE UnitsInspected = 7)"))
def q_duplicate_rows(spark, sf_dir):
    """Over all columns, of the table and a copy of a slice of it (the table
    itself holds no equal rows)."""
    f = fact(spark, sf_dir)
    return Q.duplicate_rows(f.union(f.where(F.col(C.UNITS_INSPECTED) == 7)))


@register("quality_report", "Q3 + Q4 + Q6", with_fact("SELECT * FROM rep", _REPORT_SQL))
def q_quality_report(spark, sf_dir):
    return Q.quality_report(fact(spark, sf_dir))


_WARNINGS_SQL = """
SELECT 3 AS seq, 'duplicates' AS code, format('{:,} duplicate rows detected.', duplicated_rows) AS message
  FROM rep WHERE duplicated_rows > 0
UNION ALL SELECT 5, 'high_missing', 'High missingness (>40%) in: ' || string_agg("column", ', ' ORDER BY seq)
  FROM (SELECT * FROM miss CROSS JOIN nrows WHERE n > 0 AND CAST(missing AS DOUBLE) / n > 0.4 ORDER BY seq LIMIT 8)
  HAVING count(*) > 0
UNION ALL SELECT 6, 'negative_costs', CAST(negative_costs AS VARCHAR) || ' rows have negative costs; set to 0.'
  FROM rep WHERE negative_costs > 0
UNION ALL SELECT 7, 'zero_inspected', CAST(zero_inspected AS VARCHAR) || ' rows have zero units inspected; defect rate missing.'
  FROM rep WHERE zero_inspected > 0"""


@register("quality_warnings", "Q5", with_fact(_WARNINGS_SQL, _REPORT_SQL, _missing_sql()))
def q_quality_warnings(spark, sf_dir):
    return Q.quality_warnings(fact(spark, sf_dir))


@register("report_text", "Q6 text", with_fact("""
SELECT seq, line FROM (
  SELECT 0 AS seq, format('Rows: {:,}', row_count) AS line FROM rep
  UNION ALL SELECT 1, 'Columns: ' || column_count FROM rep
  UNION ALL SELECT 2, 'Detected date column: ' || detected_date_column FROM rep
  UNION ALL SELECT 3, format('Duplicate rows: {:,}', duplicated_rows) FROM rep
  UNION ALL SELECT unnest([10, 11, 100, 101]), unnest(['', 'Key warnings:', '', 'Top missing-value columns:'])
  UNION ALL SELECT CAST(20 + row_number() OVER (ORDER BY seq) AS INTEGER), '• ' || message FROM warn
  UNION ALL SELECT 21, '• No major issues detected.' FROM (SELECT count(*) AS n FROM warn) WHERE n = 0
  UNION ALL SELECT CAST(110 + k AS INTEGER), '• ' || "column" || format(': {:,}', missing) FROM (
    SELECT *, row_number() OVER (ORDER BY missing DESC, seq) AS k FROM miss) WHERE k <= 10)""",
    _REPORT_SQL, _missing_sql(), f"warn AS ({_WARNINGS_SQL})"))
def q_report_text(spark, sf_dir):
    return Q.report_text(fact(spark, sf_dir))


# ---------------------------------------------------------------- W


@register("report_bundle", "W1", with_fact("""
SELECT 'filtered_rows' AS "table", count(*) AS "rows" FROM fact
UNION ALL SELECT 'kpis', 1
UNION ALL SELECT 'pareto', count(*) FROM (SELECT DISTINCT coalesce(Defect_Type, 'Unknown') FROM fact LIMIT 10)
UNION ALL SELECT 'supplier_scores', count(DISTINCT Supplier) FROM fact
UNION ALL SELECT 'drilldown', count(*) FROM (SELECT DISTINCT Defect_Type, Part_Type, Supplier, Defect_Severity FROM fact
  WHERE Defect_Type IS NOT NULL AND Part_Type IS NOT NULL AND Supplier IS NOT NULL AND Defect_Severity IS NOT NULL LIMIT 20)
UNION ALL SELECT 'monthly_copq', (date_diff('month', min("Date"), max("Date")) + 1) FROM fact"""))
def q_report_bundle(spark, sf_dir):
    """Write the six-table bundle to the shared scratch folder, read every
    table back and count its rows (the writer's output, not the plan)."""
    out = scratch_path(spark, "bundle")
    paths = W.write_report_bundle(fact(spark, sf_dir), out)
    counts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows")
              for n, p in paths.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@register("report_summary", "W2", with_fact("""
SELECT 'kpis' AS section, seq, metric, round(value, 4) AS value FROM (
  SELECT unnest([1, 2, 3, 4, 5, 6]) AS seq,
         unnest(['Rows', 'Defects', 'COPQ', 'OnTimeRate', 'YieldPct', 'QualityIndex']) AS metric,
         unnest([CAST(count(*) AS DOUBLE), CAST(coalesce(sum(DefectCount), 0) AS DOUBLE), coalesce(sum(CostImpact), 0.0),
                 avg(OnTimeFlag) * 100.0, avg(YieldPercentage), avg(QualityIndex)]) AS value
  FROM qi)
UNION ALL
SELECT 'pareto', CAST(row_number() OVER (ORDER BY cnt DESC, dt) AS INTEGER), dt, CAST(cnt AS DOUBLE) FROM (
  SELECT coalesce(Defect_Type, 'Unknown') AS dt, count(*) AS cnt FROM fact GROUP BY 1 ORDER BY cnt DESC, dt LIMIT 5)
UNION ALL
SELECT 'what_if', seq, metric, round(value, 4) FROM (
  SELECT unnest([1, 2, 3, 4]) AS seq,
         unnest(['baseline_copq', 'reduction_pct', 'estimated_savings', 'projected_copq']) AS metric,
         unnest([b, 2.0, CASE WHEN d <= 0 OR b <= 0 THEN 0.0 ELSE b * 0.02 END,
                 CASE WHEN d <= 0 OR b <= 0 THEN b ELSE greatest(0.0, b - b * 0.02) END]) AS value
  FROM (SELECT coalesce(sum(CostImpact), 0.0) AS b, coalesce(sum(DefectCount), 0) AS d FROM fact))""", QI_CTE))
def q_report_summary(spark, sf_dir):
    return rounded(W.report_summary(fact(spark, sf_dir)), digits=4)


@register("narrative_facts", "W3", with_fact("""
SELECT 'top_part_type' AS section, 1 AS seq, Part_Type AS label, CAST(d AS DOUBLE) AS value FROM (
  SELECT Part_Type, coalesce(sum(DefectCount), 0) AS d FROM fact WHERE Part_Type IS NOT NULL GROUP BY 1
  ORDER BY d DESC, Part_Type LIMIT 1)
UNION ALL
SELECT 'pareto', CAST(rn AS INTEGER), dt, round(cum, 6) FROM (
  SELECT dt, row_number() OVER (ORDER BY cnt DESC, dt) AS rn,
    CAST(sum(cnt) OVER (ORDER BY cnt DESC, dt ROWS UNBOUNDED PRECEDING) AS DOUBLE) * 100.0 / CAST(sum(cnt) OVER () AS DOUBLE) AS cum
  FROM (SELECT coalesce(Defect_Type, 'Unknown') AS dt, count(*) AS cnt FROM fact GROUP BY 1 ORDER BY cnt DESC, dt LIMIT 10))
  WHERE rn <= 5
UNION ALL
SELECT 'top_suppliers', CAST(row_number() OVER (ORDER BY RankEligible DESC, TotalScore DESC, Supplier) AS INTEGER),
  Supplier, round(TotalScore, 6) FROM (SELECT * FROM card ORDER BY RankEligible DESC, TotalScore DESC, Supplier LIMIT 5)
UNION ALL
SELECT 'trend', 1, 'observations', CAST(count(*) AS DOUBLE) FROM daily
UNION ALL
SELECT 'trend', 2, 'mean_daily_defects', round(avg(value), 6) FROM daily
UNION ALL
SELECT 'trend', 3, 'out_of_control', CAST(count(*) AS DOUBLE) FROM daily CROSS JOIN limits
  WHERE value > ucl OR value < lcl""", _SCORE_CTE, DAILY, _LIMITS_SQL))
def q_narrative_facts(spark, sf_dir):
    return rounded(W.narrative_facts(fact(spark, sf_dir)))
