"""Map any raw quality table onto the canonical column contract.

Everything is decided on the driver from ``df.columns`` / ``df.schema``
(names only, no data) and emitted as one projection that Catalyst collapses
into the scan's codegen stage.  The only data-dependent decision,
detecting a date column by parse success (N2), runs one aggregation and only
when no candidate name is present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectkit import columns as C
from inspectkit.functions import infer_date_formats, is_temporal_type, parse_date, parse_date_as, safe_divide, safe_numeric


def _check_case(df: DataFrame) -> None:
    low: dict[str, str] = {}
    for c in df.columns:
        k = c.lower()
        if k in low and low[k] != c:
            spark = df.sparkSession
            if spark.conf.get("spark.sql.caseSensitive", "false").lower() != "true":
                raise ValueError(
                    f"columns {low[k]!r} and {c!r} differ only in case; "
                    "set spark.sql.caseSensitive=true"
                )
        low[k] = c


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def alias_columns(df: DataFrame) -> DataFrame:
    """Fill each canonical target from its first present source alias."""
    _check_case(df)
    cols = list(df.columns)
    new: dict[str, Column] = {}
    for src, dst in C.COLUMN_ALIASES:
        if dst not in cols and dst not in new and src in cols:
            new[dst] = _q(src)
    return df.withColumns(new) if new else df


def detect_date_column(df: DataFrame) -> str | None:
    """A fixed candidate name, else the first '*date*' column that parses fully.

    Only date/timestamp/string columns qualify (D7).  For strings, one
    aggregation counts values that fail to parse for every candidate at once.
    """
    cols = list(df.columns)
    for c in C.DATE_CANDIDATES:
        if c in cols:
            return c
    types = {f.name: f.dataType for f in df.schema.fields}
    cands = [c for c in cols if "date" in c.lower()]
    text = []
    for c in cands:
        if is_temporal_type(types[c]):
            pass
        elif isinstance(types[c], T.StringType):
            text.append(c)
    failures: dict[str, int] = {}
    if text:
        row = df.agg(
            *[
                (F.count(_q(c)) - F.count(parse_date(c, types[c]))).alias(f"f{i}")
                for i, c in enumerate(text)
            ]
        ).first()
        failures = {c: row[f"f{i}"] for i, c in enumerate(text)}
    for c in cands:
        if is_temporal_type(types[c]) or failures.get(c, 1) == 0:
            return c
    return None


def normalize(df: DataFrame, date_formats: tuple[str, ...] | None = None, infer_date_format: bool = False) -> DataFrame:
    """N1..N8 in order, as one lazy projection.  ``infer_date_format``: dates
    in text are read by the one format that most of them have (an aggregation of the rows)."""
    df = alias_columns(df)
    cols = list(df.columns)
    date_col = detect_date_column(df)
    if date_col and date_col != C.DATE and C.DATE not in cols:
        df = df.withColumn(C.DATE, _q(date_col))
        cols.append(C.DATE)
    types = {f.name: f.dataType for f in df.schema.fields}

    upd: dict[str, Column] = {}
    if C.DATE in cols:
        upd[C.DATE] = parse_date(C.DATE, types[C.DATE], date_formats)
        if infer_date_format and isinstance(types[C.DATE], T.StringType):
            upd[C.DATE] = parse_date_as(C.DATE, infer_date_formats(df, [C.DATE])[C.DATE])
    if C.ON_TIME_FLAG not in cols and C.DELIVERY_DELAY in cols:
        delay = safe_numeric(C.DELIVERY_DELAY, types[C.DELIVERY_DELAY])
        upd[C.ON_TIME_FLAG] = (F.coalesce(delay.cast("double"), F.lit(999999.0)) <= 0).cast("double")
    if C.DEFECT_COUNT not in cols and C.DEFECT_TYPE in cols:
        upd[C.DEFECT_COUNT] = _q(C.DEFECT_TYPE).isNotNull().cast("bigint")
    if upd:
        df = df.withColumns(upd)
        cols = list(df.columns)
        types = {f.name: f.dataType for f in df.schema.fields}

    upd = {}
    for c in C.NUMERIC_CANONICAL:
        if c in cols:
            upd[c] = safe_numeric(c, types[c])
    if upd:
        df = df.withColumns(upd)
        cols = list(df.columns)

    upd = {}
    if C.UNITS_INSPECTED in cols and C.DEFECT_COUNT in cols and C.DEFECT_RATE not in cols:
        upd[C.DEFECT_RATE] = safe_divide(_q(C.DEFECT_COUNT), _q(C.UNITS_INSPECTED))
    if C.COST_IMPACT in cols:
        c = _q(C.COST_IMPACT).cast("double")
        upd[C.COST_IMPACT] = F.when(c < 0, F.lit(0.0)).otherwise(c)
    return df.withColumns(upd) if upd else df


def cost_source_column(raw: DataFrame) -> str | None:
    """Column holding cost values before the clamp: the alias source kept
    next to CostImpact after normalisation, else CostImpact itself."""
    cols = list(raw.columns)
    for src, dst in C.COLUMN_ALIASES:
        if dst == C.COST_IMPACT and src in cols:
            return src
    return C.COST_IMPACT if C.COST_IMPACT in cols else None
