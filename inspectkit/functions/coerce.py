"""Type coercion that never raises under ANSI mode.

Spark 4 runs with ANSI on: a plain ``cast`` of ``'abc'`` to double or a
division by zero raises.  These helpers return NULL instead, as the
reference's coercions do, and stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A decimal number with optional sign and exponent, surrounded by blanks.
# Spark's own string->double cast also accepts suffixes such as '1d'/'1f'
# and the words NaN/Infinity; the guard rejects those so that text that
# pandas would not parse becomes NULL.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

_NUMERIC = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.FloatType, T.DoubleType, T.DecimalType,
)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUMERIC)


def is_temporal_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def safe_numeric(col: str | Column, dtype: T.DataType) -> Column:
    """Coerce to a number; text that is not a number and NaN become NULL.

    Integral columns keep their type; decimals become double; strings are
    parsed behind a regex guard.
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    if isinstance(dtype, T.DecimalType):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))
    return F.lit(None).cast("double")


def parse_date(col: str | Column, dtype: T.DataType, formats: tuple[str, ...] | None = None) -> Column:
    """Coerce to a session-timezone timestamp; unparseable text -> NULL.

    ``timestamp_ntz`` and ``date`` are cast (the session timezone is UTC in
    every plan of this package, so wall-clock values are kept).  Strings are
    tried against ISO first, then each extra format in order.
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, T.TimestampType):
        return c
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    if isinstance(dtype, T.StringType):
        tries = [F.try_to_timestamp(F.trim(c))]
        for fmt in formats or ():
            tries.append(F.try_to_timestamp(F.trim(c), F.lit(fmt)))
        return F.coalesce(*tries) if len(tries) > 1 else tries[0]
    return F.lit(None).cast("timestamp")


#: Spellings a date column may have; at equal votes the earlier one is taken.
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "MM-dd-yyyy", "yyyyMMdd",
)


def infer_date_formats(df: DataFrame, columns: list[str], formats: tuple[str, ...] = DATE_FORMATS) -> dict[str, str | None]:
    """One format for each text column: the one that most of its values have, by
    a vote of all rows in one aggregation (columns x formats counts); None where no value has any."""
    votes = [F.count(F.try_to_timestamp(F.trim(F.col(f"`{c}`")), F.lit(f))).alias(f"n{i}_{k}")
             for i, c in enumerate(columns) for k, f in enumerate(formats)]
    row = df.agg(*votes).first() if columns else {}
    out = {}
    for i, c in enumerate(columns):
        counts = [row[f"n{i}_{k}"] for k in range(len(formats))]
        out[c] = formats[counts.index(max(counts))] if max(counts) else None
    return out


def parse_date_as(col: str | Column, fmt: str | None) -> Column:
    """Timestamps of the values that have the one format; others are NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(F.trim(c), F.lit(fmt)) if fmt else F.lit(None).cast("timestamp")


def safe_divide(num: Column, den: Column) -> Column:
    """``num / den`` with NULL for a zero or NULL denominator (no ANSI error)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
