"""Canonical column contract of the quality fact table."""

from __future__ import annotations

# --- Fixed values: canonical names and the ordered alias table ---
DATE = "Date"
SUPPLIER = "Supplier"
PART_TYPE = "Part_Type"
DEFECT_TYPE = "Defect_Type"
DEFECT_SEVERITY = "Defect_Severity"
MATERIAL = "MaterialComposition"
DEFECT_COUNT = "DefectCount"
UNITS_INSPECTED = "UnitsInspected"
COST_IMPACT = "CostImpact"
ON_TIME_FLAG = "OnTimeFlag"
YIELD = "YieldPercentage"
QUALITY_SCORE = "QualityScore"
DEFECT_RATE = "DefectRate"
DELIVERY_DELAY = "DeliveryDelay"

# (source, target) in priority order; a target is filled from the first
# source present, only when the target itself is absent.
COLUMN_ALIASES: tuple[tuple[str, str], ...] = (
    ("Cost_Impact_SGD", COST_IMPACT),
    ("SupplierID", SUPPLIER),
    ("SupplierName", SUPPLIER),
    ("PartType", PART_TYPE),
    ("DefectType", DEFECT_TYPE),
    ("Severity", DEFECT_SEVERITY),
    ("Material", MATERIAL),
    ("Yield", YIELD),
    ("QualityScore", QUALITY_SCORE),
    ("DefectRate", DEFECT_RATE),
    ("OnTimeFlag", ON_TIME_FLAG),
    ("DeliveryDelay", DELIVERY_DELAY),
    ("InspectionDate", DATE),
    ("EventDate", DATE),
    ("CreatedDate", DATE),
    ("TxnDate", DATE),
    ("DefectDate", DATE),
)

DATE_CANDIDATES: tuple[str, ...] = (
    DATE, "InspectionDate", "EventDate", "CreatedDate", "TxnDate", "DefectDate",
)

# Columns coerced to numbers during normalisation (OnTimeFlag added, D10).
NUMERIC_CANONICAL: tuple[str, ...] = (
    UNITS_INSPECTED, DEFECT_COUNT, COST_IMPACT, YIELD, QUALITY_SCORE, DEFECT_RATE, ON_TIME_FLAG,
)

ESSENTIAL_COLUMNS: tuple[str, ...] = (DEFECT_TYPE, SUPPLIER, COST_IMPACT, PART_TYPE)

# Root-cause dimensions in priority order.
ROOT_CAUSE_DIMS: tuple[str, ...] = (DEFECT_TYPE, PART_TYPE, SUPPLIER, DEFECT_SEVERITY)

# Filter-bar dimensions (also the default K4 cube).
FILTER_DIMS: tuple[str, ...] = (PART_TYPE, DEFECT_TYPE, DEFECT_SEVERITY, MATERIAL)

# Quality-index parts: (column, higher_is_better)
QUALITY_INDEX_PARTS: tuple[tuple[str, bool], ...] = (
    (DEFECT_RATE, False),
    (QUALITY_SCORE, True),
    (YIELD, True),
    (ON_TIME_FLAG, True),
)


def has(df, *names: str) -> bool:
    """Exact-case presence check on ``df.columns`` (pandas names are case-sensitive)."""
    cols = set(df.columns)
    return all(n in cols for n in names)


def present(df, names) -> list[str]:
    cols = set(df.columns)
    return [n for n in names if n in cols]
