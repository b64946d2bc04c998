"""DuckDB twins of the registered queries (the correctness oracle).

Every statement starts from ``FACT_CTE``: the same mapping of the star
schema onto raw quality records as ``sources.tables.quality_raw`` followed
by the same normalisation as ``operators.normalize``.  Column names and
types are aliased/cast to match the Spark side exactly.
"""

from __future__ import annotations

FACT_CTE = """
raw AS (
  SELECT
    CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE l.l_shipdate END AS InspectionDate,
    CASE WHEN l.l_suppkey % 50 = 49 THEN NULL ELSE s.s_name END AS SupplierName,
    p.p_type AS PartType,
    CASE WHEN l.l_returnflag <> 'N' THEN p.p_brand END AS DefectType,
    CASE WHEN l.l_orderkey % 41 = 0 THEN NULL ELSE o.o_orderpriority END AS Severity,
    split_part(p.p_name, ' ', 1) AS Material,
    CAST(CASE WHEN l.l_quantity = 1 THEN 0.0 ELSE l.l_quantity END AS DOUBLE) AS UnitsInspected,
    CASE WHEN l.l_returnflag = 'N' THEN CAST(0 AS BIGINT)
         ELSE CAST(floor(l.l_quantity * l.l_tax) AS BIGINT) END AS DefectCount,
    l.l_extendedprice * l.l_discount - 20.0 AS Cost_Impact_SGD,
    CAST(date_diff('day', o.o_orderdate, l.l_shipdate) AS BIGINT) AS DeliveryDelay,
    CASE WHEN l.l_partkey % 53 = 0 THEN NULL ELSE 100.0 * (1.0 - l.l_discount) END AS Yield,
    CAST(p.p_size * 2.0 AS DOUBLE) AS QualityScore
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
fact AS (
  SELECT *,
    InspectionDate AS "Date",
    SupplierName AS Supplier,
    PartType AS Part_Type,
    DefectType AS Defect_Type,
    Severity AS Defect_Severity,
    Material AS MaterialComposition,
    CAST(CASE WHEN Cost_Impact_SGD < 0 THEN 0.0 ELSE Cost_Impact_SGD END AS DOUBLE) AS CostImpact,
    Yield AS YieldPercentage,
    CAST(CASE WHEN coalesce(DeliveryDelay, 999999) <= 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS OnTimeFlag,
    CAST(DefectCount AS DOUBLE) / nullif(UnitsInspected, 0.0) AS DefectRate
  FROM raw
)"""

EVENTS_CTE = """
evraw AS (
  SELECT event_id, ts AS EventDate, CAST(user_id AS VARCHAR) AS SupplierID,
         event_type AS DefectType, "value" AS Cost_Impact_SGD,
         CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS DefectCount
  FROM events
),
evfact AS (
  SELECT *, EventDate AS "Date", SupplierID AS Supplier, DefectType AS Defect_Type,
         CAST(CASE WHEN Cost_Impact_SGD < 0 THEN 0.0 ELSE Cost_Impact_SGD END AS DOUBLE) AS CostImpact
  FROM evraw
)"""


#: Columns of the fact, in order.
FACT_COLUMNS = (
    ("InspectionDate", "timestamp"), ("SupplierName", "string"), ("PartType", "string"),
    ("DefectType", "string"), ("Severity", "string"), ("Material", "string"),
    ("UnitsInspected", "double"), ("DefectCount", "bigint"), ("Cost_Impact_SGD", "double"),
    ("DeliveryDelay", "bigint"), ("Yield", "double"), ("QualityScore", "double"),
    ("CostImpact", "double"), ("Supplier", "string"), ("Part_Type", "string"),
    ("Defect_Type", "string"), ("Defect_Severity", "string"), ("MaterialComposition", "string"),
    ("YieldPercentage", "double"), ("Date", "timestamp"), ("OnTimeFlag", "double"), ("DefectRate", "double"),
)


def with_fact(body: str, *extra_ctes: str) -> str:
    """``WITH raw, fact[, extra...] <body>``."""
    ctes = [FACT_CTE.strip()] + [c.strip() for c in extra_ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


def with_events(body: str, *extra_ctes: str) -> str:
    ctes = [EVENTS_CTE.strip()] + [c.strip() for c in extra_ctes]
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
