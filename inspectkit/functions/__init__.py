"""Column-level helpers built only from ``pyspark.sql.functions`` (JVM side)."""

from inspectkit.functions.coerce import (  # noqa: F401
    DATE_FORMATS,
    NUMBER_PATTERN,
    infer_date_formats,
    is_numeric_type,
    is_temporal_type,
    parse_date,
    parse_date_as,
    safe_divide,
    safe_numeric,
)
