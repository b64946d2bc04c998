"""Registered queries: the KPI cube as a stored answer, and normalisation by one
inferred date format and without a defect count."""

from __future__ import annotations

from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.functions import infer_date_formats, parse_date_as
from inspectkit.operators import cube as Q
from inspectkit.operators.normalize import normalize
from inspectkit.params import FilterState
from inspectkit.plans.catalog import fact, register, rounded
from inspectkit.plans.oracle import with_fact
from inspectkit.plans.q_basic import _TEXT_CTE, _text_lineitem
from inspectkit.session import prepare, scratch_path, written
from inspectkit.sources.tables import quality_raw

_CELL = """((k & 8) = 0 OR Part_Type = p) AND ((k & 4) = 0 OR Defect_Type = d)
    AND ((k & 2) = 0 OR Defect_Severity = s) AND ((k & 1) = 0 OR MaterialComposition = m)"""


@register("kpi_cube_lookup", "K4 stored", with_fact(f"""
SELECT CAST(k AS INTEGER) AS seq, count(*) FILTER (WHERE {_CELL}) AS "Rows",
  CAST(coalesce(sum(DefectCount) FILTER (WHERE {_CELL}), 0) AS BIGINT) AS Defects,
  round(coalesce(sum(CostImpact) FILTER (WHERE {_CELL}), 0.0), 4) AS COPQ
FROM fact, range(16) t(k), chosen GROUP BY k""", """chosen AS (
  SELECT min(Part_Type) AS p, min(Defect_Type) AS d, min(Defect_Severity) AS s, min(MaterialComposition) AS m FROM fact)"""))
def q_kpi_cube_lookup(spark, sf_dir):
    """The fact arrives in three batches, each aggregated alone and kept; all 16
    combinations of fixed and open filters are answered from the kept cells.  The
    fact's columns are written once; batches and choice read those."""
    f, path = fact(spark, sf_dir), scratch_path(spark, "cube")
    arrives = F.pmod(F.xxhash64(C.SUPPLIER, C.DATE), F.lit(3)).alias("arrives")
    f = written(f.select(*C.FILTER_DIMS, C.DEFECT_COUNT, C.COST_IMPACT, arrives), "cube-columns")
    for batch in range(3):
        Q.write_cube(f.where(F.col("arrives") == batch).drop("arrives"), path, batch)
    one = f.agg(*[F.min(c).alias(c) for c in C.FILTER_DIMS]).first()
    names = ("part_type", "defect_type", "severity", "material")
    states = [FilterState(**{n: one[c] for i, (n, c) in enumerate(zip(names, C.FILTER_DIMS)) if k >> (3 - i) & 1}) for k in range(16)]
    return rounded(Q.lookup(spark, path, states), money=("COPQ",))


@register("parse_date_one_format", "N4 inferred", with_fact("""
SELECT l_linenumber, count(*) AS n_rows, count(d) AS n_parsed, min(d) AS min_date, max(d) AS max_date FROM (
  SELECT l_linenumber, CASE WHEN iso >= us AND iso >= eu THEN try_strptime(ship_text, '%Y-%m-%d')
    WHEN us >= eu THEN try_strptime(ship_text, '%m/%d/%Y') ELSE try_strptime(ship_text, '%d/%m/%Y') END AS d
  FROM txt, votes)
GROUP BY l_linenumber""", _TEXT_CTE, """votes AS (
  SELECT count(try_strptime(ship_text, '%Y-%m-%d')) AS iso, count(try_strptime(ship_text, '%m/%d/%Y')) AS us,
    count(try_strptime(ship_text, '%d/%m/%Y')) AS eu FROM txt)"""))
def q_parse_date_one_format(spark, sf_dir):
    """A column of mixed spellings read by the one most rows have; the others are NULL."""
    prepare(spark)
    t = _text_lineitem(spark, sf_dir)
    d = parse_date_as("ship_text", infer_date_formats(t, ["ship_text"])["ship_text"])
    return t.select("l_linenumber", d.alias("d")).groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("d").alias("n_parsed"), F.min("d").alias("min_date"), F.max("d").alias("max_date"))


@register("derive_defect_count", "N6", with_fact("""
SELECT Defect_Severity, count(*) AS n_rows, count(Defect_Type) AS defects,
  round(avg(CASE WHEN Defect_Type IS NULL THEN 0.0 ELSE 1.0 END / nullif(UnitsInspected, 0.0)), 6) AS mean_rate
FROM fact GROUP BY 1"""))
def q_derive_defect_count(spark, sf_dir):
    """Records without a defect count: one per row with a defect type, and the rate from it."""
    f = normalize(quality_raw(spark, sf_dir).drop(C.DEFECT_COUNT))
    return rounded(f.groupBy(C.DEFECT_SEVERITY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(C.DEFECT_COUNT).alias("defects"), F.avg(C.DEFECT_RATE).alias("mean_rate")))
