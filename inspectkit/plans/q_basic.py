"""Registered queries: normalisation, filters, KPIs, Pareto and cross-tabs."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.functions import NUMBER_PATTERN, parse_date, safe_numeric
from inspectkit.operators import filters as FL
from inspectkit.operators import kpis as K
from inspectkit.operators import rootcause as P
from inspectkit.operators.normalize import detect_date_column, normalize
from inspectkit.operators.qindex import quality_index_stats
from inspectkit.params import FilterState
from inspectkit.plans.catalog import fact, register, rounded
from inspectkit.plans.oracle import FACT_COLUMNS, with_fact
from inspectkit.session import scratch_path, written
from inspectkit.sources.files import read_quality_csv
from inspectkit.sources.tables import quality_raw, read_table

# ---------------------------------------------------------------- N / S5


@register("normalized_fact_profile", "S5+N9", with_fact("""
SELECT count(*) AS n_rows,
  count("Date") AS n_date, count(Supplier) AS n_supplier, count(Defect_Type) AS n_defect_type,
  count(Defect_Severity) AS n_severity, count(DefectRate) AS n_defect_rate,
  CAST(sum(DefectCount) AS BIGINT) AS sum_defects,
  round(sum(CostImpact), 4) AS sum_cost, round(sum(OnTimeFlag), 6) AS sum_on_time,
  round(sum(DefectRate), 6) AS sum_defect_rate, round(sum(YieldPercentage), 4) AS sum_yield,
  round(sum(QualityScore), 4) AS sum_quality_score,
  CAST(min("Date") AS DATE) AS min_date, CAST(max("Date") AS DATE) AS max_date
FROM fact"""))
def q_normalized_fact_profile(spark, sf_dir):
    f = fact(spark, sf_dir)
    out = f.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(C.DATE).alias("n_date"), F.count(C.SUPPLIER).alias("n_supplier"),
        F.count(C.DEFECT_TYPE).alias("n_defect_type"), F.count(C.DEFECT_SEVERITY).alias("n_severity"),
        F.count(C.DEFECT_RATE).alias("n_defect_rate"),
        F.sum(C.DEFECT_COUNT).cast("bigint").alias("sum_defects"),
        F.sum(C.COST_IMPACT).alias("sum_cost"), F.sum(C.ON_TIME_FLAG).alias("sum_on_time"),
        F.sum(C.DEFECT_RATE).alias("sum_defect_rate"), F.sum(C.YIELD).alias("sum_yield"),
        F.sum(C.QUALITY_SCORE).alias("sum_quality_score"),
        F.to_date(F.min(C.DATE)).alias("min_date"), F.to_date(F.max(C.DATE)).alias("max_date"),
    )
    return rounded(out, money=("sum_cost", "sum_yield", "sum_quality_score"))


# ---------------------------------------------------------------- F


@register("filter_state", "F1+F2", with_fact("""
SELECT Supplier, count(*) AS n_rows, CAST(coalesce(sum(DefectCount), 0) AS BIGINT) AS defects,
       round(coalesce(sum(CostImpact), 0.0), 4) AS copq
FROM fact
WHERE CAST(Part_Type AS VARCHAR) = 'ECONOMY'
  AND CAST(Defect_Severity AS VARCHAR) = '1-URGENT'
  AND "Date" >= TIMESTAMP '1994-01-01 00:00:00' AND "Date" < TIMESTAMP '1998-01-01 00:00:00'
GROUP BY Supplier"""))
def q_filter_state(spark, sf_dir):
    f = fact(spark, sf_dir)
    st = FilterState(part_type="ECONOMY", severity="1-URGENT",
                     start_date="1994-01-01", end_date="1997-12-31")
    out = FL.apply_filters(f, st).groupBy(C.SUPPLIER).agg(
        F.count(F.lit(1)).alias("n_rows"), K.defects_expr(f).alias("defects"), K.copq_expr(f).alias("copq"))
    return rounded(out, money=("copq",))


def _search_sql(needle: str) -> str:
    """All columns as text, as the operator searches them (numbers print
    alike as far as the needle, which holds letters, is concerned)."""
    text = [f"strftime(\"{c}\", '%Y-%m-%d %H:%M:%S')" if t == "timestamp" else f'CAST("{c}" AS VARCHAR)' for c, t in FACT_COLUMNS]
    hit = " OR ".join(f"coalesce(contains(lower({x}), lower('{needle}')), false)" for x in text)
    return f"SELECT Supplier, Part_Type, Defect_Type, Defect_Severity, count(*) AS n_rows FROM fact WHERE {hit} GROUP BY ALL"


@register("search_rows", "F3", with_fact(_search_sql("Brand#2")))
def q_search_rows(spark, sf_dir):
    """The search box: any of all columns holds the text."""
    hit = FL.search_rows(fact(spark, sf_dir), "Brand#2")
    return hit.groupBy(C.SUPPLIER, C.PART_TYPE, C.DEFECT_TYPE, C.DEFECT_SEVERITY).agg(F.count(F.lit(1)).alias("n_rows"))


@register("unique_values", "F4", with_fact("""
SELECT DISTINCT trim(CAST(Defect_Severity AS VARCHAR)) AS value FROM fact
WHERE Defect_Severity IS NOT NULL AND trim(CAST(Defect_Severity AS VARCHAR)) <> ''"""))
def q_unique_values(spark, sf_dir):
    return FL.unique_values(fact(spark, sf_dir), C.DEFECT_SEVERITY)


_PRESETS_SQL = """
presets AS (
  SELECT 'part:' || Part_Type AS preset, Part_Type AS part_type, NULL AS severity,
         CAST(NULL AS DATE) AS start_d, CAST(NULL AS DATE) AS end_d
  FROM (SELECT DISTINCT Part_Type FROM fact WHERE Part_Type IS NOT NULL)
  UNION ALL
  SELECT 'sev:' || Defect_Severity || ':' || CAST(y AS VARCHAR), NULL, Defect_Severity,
         make_date(y, 1, 1), make_date(y, 12, 31)
  FROM (SELECT DISTINCT Defect_Severity, CAST(year("Date") AS INTEGER) AS y FROM fact
        WHERE Defect_Severity IS NOT NULL AND "Date" IS NOT NULL)
)"""


@register("apply_presets", "F5", with_fact("""
SELECT p.preset, count(*) AS n_rows, CAST(coalesce(sum(f.DefectCount), 0) AS BIGINT) AS defects,
       round(coalesce(sum(f.CostImpact), 0.0), 4) AS copq
FROM fact f JOIN presets p
  ON (p.part_type IS NULL OR CAST(f.Part_Type AS VARCHAR) = p.part_type)
 AND (p.severity IS NULL OR CAST(f.Defect_Severity AS VARCHAR) = p.severity)
 AND (p.start_d IS NULL OR f."Date" >= CAST(p.start_d AS TIMESTAMP))
 AND (p.end_d IS NULL OR f."Date" < CAST(p.end_d + INTERVAL 1 DAY AS TIMESTAMP))
GROUP BY p.preset""", _PRESETS_SQL))
def q_apply_presets(spark, sf_dir):
    """Presets derived from the data itself (one per part type, and one per
    severity and year with a date range), saved as JSON and read back.  The
    columns that presets and sums read are written once."""
    f = fact(spark, sf_dir)
    f = written(f.select(*C.FILTER_DIMS, C.DATE, C.DEFECT_COUNT, C.COST_IMPACT), "preset-columns")
    by_part = f.select(C.PART_TYPE).filter(F.col(C.PART_TYPE).isNotNull()).distinct().select(
        F.concat(F.lit("part:"), F.col(C.PART_TYPE)).alias("preset"), F.col(C.PART_TYPE).alias("part_type"),
        F.lit(None).cast("string").alias("defect_type"), F.lit(None).cast("string").alias("severity"),
        F.lit(None).cast("string").alias("material"),
        F.lit(None).cast("string").alias("start_date"), F.lit(None).cast("string").alias("end_date"))
    sy = f.filter(F.col(C.DEFECT_SEVERITY).isNotNull() & F.col(C.DATE).isNotNull()).select(
        C.DEFECT_SEVERITY, F.year(C.DATE).alias("y")).distinct()
    by_sev = sy.select(
        F.concat(F.lit("sev:"), F.col(C.DEFECT_SEVERITY), F.lit(":"), F.col("y").cast("string")).alias("preset"),
        F.lit("All Part Types").alias("part_type"), F.lit("All Defect Types").alias("defect_type"),
        F.col(C.DEFECT_SEVERITY).alias("severity"), F.lit("All Materials").alias("material"),
        F.format_string("%04d-01-01", F.col("y")).alias("start_date"),
        F.format_string("%04d-12-31", F.col("y")).alias("end_date"))
    path = scratch_path(spark, "presets")
    FL.write_presets(by_part.unionByName(by_sev), path)
    tagged = FL.apply_presets(f, FL.read_presets(spark, path))
    out = tagged.groupBy("preset").agg(F.count(F.lit(1)).alias("n_rows"), K.defects_expr(f).alias("defects"),
                                       K.copq_expr(f).alias("copq"))
    return rounded(out, money=("copq",))


@register("date_bounds", "F6", with_fact("""
SELECT min("Date") AS min_date, max("Date") AS max_date FROM fact"""))
def q_date_bounds(spark, sf_dir):
    return FL.date_bounds(fact(spark, sf_dir))


@register("top_rows", "F7", with_fact("""
SELECT Supplier, Part_Type, Defect_Type, round(CostImpact, 4) AS CostImpact, DefectCount, UnitsInspected
FROM fact ORDER BY CostImpact DESC NULLS LAST, Supplier NULLS LAST, Part_Type NULLS LAST,
  Defect_Type NULLS LAST, DefectCount NULLS LAST, UnitsInspected NULLS LAST LIMIT 100"""))
def q_top_rows(spark, sf_dir):
    f = fact(spark, sf_dir).select(C.SUPPLIER, C.PART_TYPE, C.DEFECT_TYPE, C.COST_IMPACT, C.DEFECT_COUNT,
                                   C.UNITS_INSPECTED)
    out = FL.top_rows(f, C.COST_IMPACT, ascending=False, n=100,
                      tiebreak=[C.SUPPLIER, C.PART_TYPE, C.DEFECT_TYPE, C.DEFECT_COUNT, C.UNITS_INSPECTED])
    return rounded(out, money=(C.COST_IMPACT,))


# ---------------------------------------------------------------- K


@register("count_defects", "K1", with_fact("""
SELECT CAST(coalesce(sum(DefectCount), 0) AS BIGINT) AS Defects FROM fact"""))
def q_count_defects(spark, sf_dir):
    return K.count_defects(fact(spark, sf_dir))


@register("total_copq", "K2", with_fact("""
SELECT round(coalesce(sum(CostImpact), 0.0), 4) AS COPQ FROM fact"""))
def q_total_copq(spark, sf_dir):
    return rounded(K.total_copq(fact(spark, sf_dir)), money=("COPQ",))


def qi_cte(group_col: str | None = None) -> str:
    """DuckDB twin of X1: quantiles per group (or global), then the index."""
    parts = (("DefectRate", False), ("QualityScore", True), ("YieldPercentage", True), ("OnTimeFlag", True))
    key = f"{group_col} AS k, " if group_col else ""
    grp = f" GROUP BY {group_col}" if group_col else ""
    join = f"LEFT JOIN qs ON f.{group_col} IS NOT DISTINCT FROM qs.k" if group_col else "CROSS JOIN qs"
    qcols = ", ".join(f"quantile_cont({c}, [0.05, 0.95]) AS q{i}" for i, (c, _) in enumerate(parts))
    scols = []
    for i, (c, hb) in enumerate(parts):
        lo, hi = f"qs.q{i}[1]", f"qs.q{i}[2]"
        clipped = f"(CASE WHEN f.{c} < {lo} THEN {lo} WHEN f.{c} > {hi} THEN {hi} ELSE f.{c} END)"
        scaled = f"({clipped} - {lo}) / ({hi} - {lo})"
        if not hb:
            scaled = f"1.0 - {scaled}"
        scols.append(f"CASE WHEN {lo} IS NULL OR {hi} IS NULL OR {lo} = {hi} THEN 0.5 "
                     f"ELSE CASE WHEN {scaled} < 0 THEN 0.0 WHEN {scaled} > 1 THEN 1.0 ELSE {scaled} END END AS s{i}")
    cnt = " + ".join(f"CASE WHEN s{i} IS NULL THEN 0 ELSE 1 END" for i in range(len(parts)))
    tot = " + ".join(f"coalesce(s{i}, 0.0)" for i in range(len(parts)))
    return f"""qs AS (SELECT {key}{qcols} FROM fact{grp}),
qparts AS (SELECT f.*, {", ".join(scols)} FROM fact f {join}),
qi AS (SELECT *, CASE WHEN ({cnt}) > 0 THEN ({tot}) / ({cnt}) * 100.0 END AS QualityIndex FROM qparts)"""


QI_CTE = qi_cte()


@register("executive_kpis", "K3", with_fact("""
SELECT CAST(count(*) AS DOUBLE) AS "Rows", CAST(CAST(coalesce(sum(DefectCount), 0) AS BIGINT) AS DOUBLE) AS Defects,
  round(coalesce(sum(CostImpact), 0.0), 4) AS COPQ, round(avg(OnTimeFlag) * 100.0, 6) AS OnTimeRate,
  round(avg(YieldPercentage), 6) AS YieldPct, round(avg(QualityIndex), 6) AS QualityIndex
FROM qi""", QI_CTE))
def q_executive_kpis(spark, sf_dir):
    return rounded(K.executive_kpis(fact(spark, sf_dir)), money=("COPQ",))


@register("executive_kpis_by_part", "K3 by", with_fact("""
SELECT Part_Type, CAST(count(*) AS DOUBLE) AS "Rows",
  CAST(CAST(coalesce(sum(DefectCount), 0) AS BIGINT) AS DOUBLE) AS Defects,
  round(coalesce(sum(CostImpact), 0.0), 4) AS COPQ, round(avg(OnTimeFlag) * 100.0, 6) AS OnTimeRate,
  round(avg(YieldPercentage), 6) AS YieldPct, round(avg(QualityIndex), 6) AS QualityIndex
FROM qi GROUP BY Part_Type""", qi_cte("Part_Type")))
def q_executive_kpis_by_part(spark, sf_dir):
    return rounded(K.executive_kpis(fact(spark, sf_dir), by=[C.PART_TYPE]), money=("COPQ",))


_CUBE_DIMS = (C.PART_TYPE, C.DEFECT_TYPE, C.DEFECT_SEVERITY, C.MATERIAL)


@register("kpi_cube", "K4", with_fact("""
SELECT Part_Type, Defect_Type, Defect_Severity, MaterialComposition,
  count(*) AS "Rows", CAST(coalesce(sum(DefectCount), 0) AS BIGINT) AS Defects,
  round(coalesce(sum(CostImpact), 0.0), 4) AS COPQ,
  CAST(GROUPING(Part_Type) AS BIGINT) AS g_Part_Type, CAST(GROUPING(Defect_Type) AS BIGINT) AS g_Defect_Type,
  CAST(GROUPING(Defect_Severity) AS BIGINT) AS g_Defect_Severity,
  CAST(GROUPING(MaterialComposition) AS BIGINT) AS g_MaterialComposition
FROM fact GROUP BY CUBE (Part_Type, Defect_Type, Defect_Severity, MaterialComposition)"""))
def q_kpi_cube(spark, sf_dir):
    return rounded(K.kpi_cube(fact(spark, sf_dir), _CUBE_DIMS), money=("COPQ",))


# ---------------------------------------------------------------- P


@register("defect_pareto", "P1", with_fact("""
SELECT Defect_Type, "Count",
  round(CAST(sum("Count") OVER (ORDER BY "Count" DESC, Defect_Type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
        * 100.0 / CAST(sum("Count") OVER () AS DOUBLE), 6) AS CumulativePct
FROM (SELECT coalesce(Defect_Type, 'Unknown') AS Defect_Type, count(*) AS "Count" FROM fact
      GROUP BY 1 ORDER BY "Count" DESC, Defect_Type LIMIT 10) t"""))
def q_defect_pareto(spark, sf_dir):
    return rounded(P.defect_pareto(fact(spark, sf_dir)))


@register("defect_cost_by_part", "P2", with_fact("""
SELECT Part_Type, CAST(coalesce(sum(DefectCount), 0) AS BIGINT) AS Defects,
  round(coalesce(sum(CostImpact), 0.0), 4) AS COPQ
FROM fact WHERE Part_Type IS NOT NULL GROUP BY Part_Type ORDER BY Defects DESC, Part_Type LIMIT 10"""))
def q_defect_cost_by_part(spark, sf_dir):
    return rounded(P.defect_cost_by_part(fact(spark, sf_dir)), money=("COPQ",))


@register("root_cause_drilldown", "P3", with_fact("""
SELECT Defect_Type, Part_Type, Supplier, Defect_Severity, count(*) AS "Count" FROM fact
WHERE Defect_Type IS NOT NULL AND Part_Type IS NOT NULL AND Supplier IS NOT NULL AND Defect_Severity IS NOT NULL
GROUP BY ALL ORDER BY "Count" DESC, Defect_Type, Part_Type, Supplier, Defect_Severity LIMIT 20"""))
def q_root_cause_drilldown(spark, sf_dir):
    return P.root_cause_drilldown(fact(spark, sf_dir))


def _crosstab_sql(rexpr: str, cexpr: str, src: str = "fact", where: str = "", col_desc: bool = False,
                  max_r: int = 10, max_c: int = 10) -> str:
    return f"""
SELECT r.row_key, c.col_key, CAST(coalesce(n.n, 0) AS BIGINT) AS n
FROM (SELECT DISTINCT {rexpr} AS row_key FROM {src} {where} ORDER BY row_key LIMIT {max_r}) r
CROSS JOIN (SELECT DISTINCT {cexpr} AS col_key FROM {src} {where} ORDER BY col_key {'DESC' if col_desc else ''} LIMIT {max_c}) c
LEFT JOIN (SELECT {rexpr} AS row_key, {cexpr} AS col_key, count(*) AS n FROM {src} {where} GROUP BY 1, 2) n
  ON n.row_key = r.row_key AND n.col_key = c.col_key"""


@register("root_cause_cooccurrence", "P4", with_fact(_crosstab_sql(
    "coalesce(Defect_Type, 'Unknown')", "coalesce(Part_Type, 'Unknown')")))
def q_root_cause_cooccurrence(spark, sf_dir):
    return P.root_cause_cooccurrence(fact(spark, sf_dir))


@register("severity_part_heatmap", "P5", with_fact(_crosstab_sql(
    "coalesce(Defect_Severity, 'Unknown')", "coalesce(Part_Type, 'Unknown')")))
def q_severity_part_heatmap(spark, sf_dir):
    return P.severity_part_heatmap(fact(spark, sf_dir))


@register("monthly_severity_heatmap", "P6", with_fact(_crosstab_sql(
    "coalesce(Defect_Severity, 'Unknown')", "strftime(\"Date\", '%Y-%m')", where='WHERE "Date" IS NOT NULL',
    col_desc=True, max_c=12)))
def q_monthly_severity_heatmap(spark, sf_dir):
    return P.monthly_severity_heatmap(fact(spark, sf_dir))


@register("crosstab_supplier_material", "P7", with_fact("""
SELECT coalesce(Supplier, 'Unknown') AS row_key, coalesce(MaterialComposition, 'Unknown') AS col_key,
  count(*) AS n FROM fact GROUP BY 1, 2"""))
def q_crosstab_supplier_material(spark, sf_dir):
    """P7 with unbounded axes: every observed supplier x material cell."""
    return P.crosstab_long(fact(spark, sf_dir), C.SUPPLIER, C.MATERIAL, None, None)


@register("audit_focus", "P8", with_fact("""
SELECT * FROM (""" + _crosstab_sql("coalesce(Defect_Severity, 'Unknown')", "coalesce(Part_Type, 'Unknown')") + """
) ORDER BY n DESC, row_key, col_key LIMIT 1"""))
def q_audit_focus(spark, sf_dir):
    return P.audit_focus(fact(spark, sf_dir))


# ---------------------------------------------------------------- X2 here (needs QI_CTE)


@register("quality_index_stats", "X2", with_fact("""
SELECT round(avg(QualityIndex), 6) AS mean, round(quantile_cont(QualityIndex, 0.5), 6) AS median,
  round(min(QualityIndex), 6) AS min, round(max(QualityIndex), 6) AS max, count(QualityIndex) AS n
FROM qi""", QI_CTE))
def q_quality_index_stats(spark, sf_dir):
    return rounded(quality_index_stats(fact(spark, sf_dir)))


# ---------------------------------------------------------------- S1, N2-N4 on text derived from the tables


def _text_lineitem(spark, sf_dir):
    """Every lineitem row with numbers and dates as text; the line number
    picks a spelling (a rule over all rows, not a subset): junk, a Spark-only
    suffix, padded, NaN, or plain; dates ISO or US style."""
    li = read_table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("string")
    ln = F.col("l_linenumber")
    units = (F.when(ln == 1, F.lit("abc")).when(ln == 2, F.concat(q, F.lit("d")))
             .when(ln == 3, F.concat(F.lit(" "), q, F.lit(" "))).when(ln == 4, F.lit("NaN")).otherwise(q))
    ship = F.when(ln % 2 == 0, F.date_format("l_shipdate", "MM/dd/yyyy")).otherwise(
        F.date_format("l_shipdate", "yyyy-MM-dd"))
    return li.select(units.alias("units_text"), ship.alias("ship_text"), "l_linenumber")


_TEXT_CTE = """txt AS (
  SELECT CASE l_linenumber WHEN 1 THEN 'abc' WHEN 2 THEN CAST(l_quantity AS VARCHAR) || 'd'
              WHEN 3 THEN ' ' || CAST(l_quantity AS VARCHAR) || ' ' WHEN 4 THEN 'NaN'
              ELSE CAST(l_quantity AS VARCHAR) END AS units_text,
         CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%m/%d/%Y') ELSE strftime(l_shipdate, '%Y-%m-%d') END
           AS ship_text, l_linenumber
  FROM lineitem)"""


@register("safe_numeric", "N3", with_fact(f"""
SELECT l_linenumber, count(*) AS n_rows, count(v) AS n_parsed, round(sum(v), 4) AS total FROM (
  SELECT l_linenumber, CASE WHEN regexp_matches(units_text, '{NUMBER_PATTERN}')
                            THEN TRY_CAST(trim(units_text) AS DOUBLE) END AS v FROM txt)
GROUP BY l_linenumber""", _TEXT_CTE))
def q_safe_numeric(spark, sf_dir):
    t = _text_lineitem(spark, sf_dir)
    v = safe_numeric("units_text", t.schema["units_text"].dataType)
    out = t.select("l_linenumber", v.alias("v")).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_parsed"), F.sum("v").alias("total"))
    return rounded(out, money=("total",))


@register("parse_date", "N4", with_fact("""
SELECT l_linenumber, count(*) AS n_rows, count(d) AS n_parsed, min(d) AS min_date, max(d) AS max_date FROM (
  SELECT l_linenumber, coalesce(try_strptime(ship_text, '%Y-%m-%d'), try_strptime(ship_text, '%m/%d/%Y')) AS d
  FROM txt)
GROUP BY l_linenumber""", _TEXT_CTE))
def q_parse_date(spark, sf_dir):
    t = _text_lineitem(spark, sf_dir)
    d = parse_date("ship_text", t.schema["ship_text"].dataType, ("MM/dd/yyyy",))
    return t.select("l_linenumber", d.alias("d")).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("d").alias("n_parsed"), F.min("d").alias("min_date"),
        F.max("d").alias("max_date"))


@register("detect_date_column", "N2", """
SELECT CASE WHEN count(*) = count(try_strptime(strftime(l_shipdate, '%m/%d/%Y'), '%Y-%m-%d')) THEN 'us_date_text'
            WHEN count(*) = count(try_strptime(strftime(l_shipdate, '%Y-%m-%d'), '%Y-%m-%d')) THEN 'iso_date_text' END AS detected
FROM lineitem""")
def q_detect_date_column(spark, sf_dir):
    """Which column normalisation would pick on a table with no candidate
    name: of two text columns the one that parses fully."""
    day = F.col("l_shipdate").cast("timestamp")
    t = read_table(spark, sf_dir, "lineitem").select(
        F.date_format(day, "MM/dd/yyyy").alias("us_date_text"), F.date_format(day, "yyyy-MM-dd").alias("iso_date_text"))
    return spark.createDataFrame([(detect_date_column(t),)], "detected string")


@register("csv_round_trip", "S1", with_fact("""
SELECT Part_Type, count(*) AS n_rows, CAST(coalesce(sum(DefectCount), 0) AS BIGINT) AS defects,
  round(coalesce(sum(CostImpact), 0.0), 4) AS copq, count("Date") AS n_dates
FROM fact GROUP BY Part_Type"""))
def q_csv_round_trip(spark, sf_dir):
    """The raw records written as CSV text to the shared folder, read
    back with header and an explicit schema, normalised and aggregated."""
    raw = quality_raw(spark, sf_dir)
    path = scratch_path(spark, "csv")
    raw.write.option("header", True).csv(path)
    back = read_quality_csv(spark, path + "/", schema=raw.schema)
    f = normalize(back)
    out = f.groupBy(C.PART_TYPE).agg(F.count(F.lit(1)).alias("n_rows"), K.defects_expr(f).alias("defects"),
                                     K.copq_expr(f).alias("copq"), F.count(C.DATE).alias("n_dates"))
    return rounded(out, money=("copq",))
