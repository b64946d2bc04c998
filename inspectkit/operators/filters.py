"""Filter state, date range, text search, value lists, presets,
date bounds and sorted previews.

Filters are plain ``Column`` predicates on the canonical columns, so
Catalyst pushes them through the normalising projection into the scan
where the column maps 1:1 onto a source column.
"""

from __future__ import annotations

import datetime as _dt
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectkit import columns as C
from inspectkit.functions import is_temporal_type
from inspectkit.params import (
    ALL_DEFECT_TYPES,
    ALL_MATERIALS,
    ALL_PART_TYPES,
    ALL_SEVERITIES,
    FilterState,
)

_EQ_FILTERS = (
    ("part_type", C.PART_TYPE, ALL_PART_TYPES),
    ("defect_type", C.DEFECT_TYPE, ALL_DEFECT_TYPES),
    ("severity", C.DEFECT_SEVERITY, ALL_SEVERITIES),
    ("material", C.MATERIAL, ALL_MATERIALS),
)


def _day(v) -> _dt.date | None:
    if v is None:
        return None
    if isinstance(v, _dt.datetime):
        return v.date()
    if isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v)[:10])


def filter_condition(df: DataFrame, state: FilterState, date_column: str = C.DATE) -> Column:
    """F1 + F2 as one conjunctive predicate.

    Equalities compare the column as text with the chosen value (a NULL
    never matches, D1).  The date range is inclusive by day: ``>= start``
    and ``< end + 1 day`` (D8).  A NULL date fails as soon as one bound is set.
    """
    cols = set(df.columns)
    conds: list[Column] = []
    for attr, col, all_label in _EQ_FILTERS:
        v = getattr(state, attr)
        if col in cols and v is not None and v != all_label:
            conds.append(F.col(col).cast("string") == F.lit(str(v)))
    if date_column in cols:
        s, e = _day(state.start_date), _day(state.end_date)
        if s is not None:
            conds.append(F.col(date_column) >= F.lit(_dt.datetime(s.year, s.month, s.day)))
        if e is not None:
            nxt = e + _dt.timedelta(days=1)
            conds.append(F.col(date_column) < F.lit(_dt.datetime(nxt.year, nxt.month, nxt.day)))
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def apply_filters(df: DataFrame, state: FilterState, date_column: str = C.DATE) -> DataFrame:
    """rows matching the filter state."""
    return df.filter(filter_condition(df, state, date_column))


def search_condition(df: DataFrame, text: str, columns: list[str] | None = None) -> Column:
    """F3 predicate: case-insensitive literal substring over columns as text.

    Timestamps print as ``yyyy-MM-dd HH:mm:ss``; NULL never matches (D1).
    Numbers print as Spark casts them (``1.0E-5`` where pandas prints
    ``1e-05``)."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(columns) if columns is not None else list(df.columns)
    needle = F.lower(F.lit(text))
    conds = []
    for c in cols:
        dt = types[c]
        if is_temporal_type(dt):
            s = F.date_format(F.col(f"`{c}`"), "yyyy-MM-dd HH:mm:ss")
        elif isinstance(dt, T.StringType):
            s = F.col(f"`{c}`")
        else:
            s = F.col(f"`{c}`").cast("string")
        conds.append(F.coalesce(F.lower(s).contains(needle), F.lit(False)))
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def search_rows(df: DataFrame, text: str, columns: list[str] | None = None) -> DataFrame:
    """rows where any column contains ``text`` (blank text keeps all)."""
    text = (text or "").strip()
    if not text:
        return df
    return df.filter(search_condition(df, text, columns))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """sorted distinct non-blank trimmed text values of a column."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "value string")
    v = F.trim(F.col(f"`{column}`").cast("string"))
    return df.select(v.alias("value")).filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct().orderBy("value")


PRESET_SCHEMA = T.StructType([
    T.StructField("preset", T.StringType()),
    T.StructField("part_type", T.StringType()),
    T.StructField("defect_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("material", T.StringType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
])


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """F5 source: a JSON object ``name -> {part_type, ..., end_date}``.

    Read by Spark as one whole-file text record parsed into a MAP of
    structs, exploded into one row per preset."""
    value = T.StructType([f for f in PRESET_SCHEMA.fields if f.name != "preset"])
    schema = T.StructType([T.StructField("presets", T.MapType(T.StringType(), value))])
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json(F.concat(F.lit('{"presets":'), F.col("value"), F.lit("}")),
                                    schema).alias("j"))
    return parsed.select(F.explode("j.presets").alias("preset", "s")).select(
        "preset", "s.part_type", "s.defect_type", "s.severity", "s.material", "s.start_date", "s.end_date"
    )


def write_presets(presets: DataFrame, path: str) -> None:
    """F5 sink: presets as a JSON object ``name -> {part_type, ..., end_date}``
    (of equal names the last in text order of the values stays).  Presets are
    a small user-made table; the object is one text record."""
    fields = [f.name for f in PRESET_SCHEMA.fields if f.name != "preset"]
    value = F.struct(*[F.col(c).cast("string").alias(c) for c in fields])
    named = presets.where(F.col("preset").isNotNull()).groupBy("preset").agg(F.max(value).alias("v"))
    one = named.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("preset", "v")))).alias("m"))
    one.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)


def apply_presets(df: DataFrame, presets: DataFrame, date_column: str = C.DATE) -> DataFrame:
    """every row tagged with each preset it satisfies, in one scan.

    A preset leaves a dimension open with an "All ..." label, with NULL, or
    where the table has no such column (as the single filter does); the date
    bounds are open alike.  Rows are exploded by the patterns of fixed
    dimensions that occur (16 at most, read in a tiny job) and equi-joined
    with the presets on pattern and fixed values; the date range is a residual
    condition.  The planner broadcasts the presets by their measured size or
    shuffles, splitting hot keys.
    """
    cols = set(df.columns)
    dims = [(a, col, lbl) for a, col, lbl in _EQ_FILTERS if col in cols]
    p = presets.select(
        "preset",
        *[F.when(F.col(a) != F.lit(lbl), F.col(a).cast("string")).alias(f"__p_{a}") for a, _, lbl in dims],
        F.to_date(F.col("start_date")).alias("__p_start"),
        F.date_add(F.to_date(F.col("end_date")), 1).alias("__p_end"),
    )
    pattern = F.concat(F.lit(""), *[F.when(F.col(f"__p_{a}").isNull(), F.lit("0")).otherwise(F.lit("1")) for a, _, _ in dims])
    p = p.withColumn("__pattern", pattern)
    patterns = sorted(r[0] for r in p.select("__pattern").distinct().collect())
    if not patterns:
        return df.limit(0).withColumn("preset", F.lit(None).cast("string"))
    p = p.withColumn("__key", F.struct("__pattern", *[F.coalesce(f"__p_{a}", F.lit("")).alias(a) for a, _, _ in dims]))
    # a row's key under a pattern: its values where fixed; none if one is NULL
    keys = []
    for mask in patterns:
        fixed = [(a, col, m == "1") for (a, col, _), m in zip(dims, mask)]
        values = [F.when(F.lit(on), F.col(col).cast("string")).otherwise(F.lit("")).alias(a) for a, col, on in fixed]
        known = reduce(lambda x, y: x & y, [F.col(col).isNotNull() for _, col, on in fixed if on], F.lit(True))
        keys.append(F.when(known, F.struct(F.lit(mask).alias("__pattern"), *values)))
    rows = df.withColumn("__key", F.explode(F.array(*keys))).where(F.col("__key").isNotNull())
    cond = rows["__key"] == p["__key"]
    if date_column in cols:
        d = rows[date_column]
        cond &= F.col("__p_start").isNull() | (d >= F.col("__p_start").cast("timestamp"))
        cond &= F.col("__p_end").isNull() | (d < F.col("__p_end").cast("timestamp"))
    return rows.join(p, cond, "inner").select(*[rows[f"`{c}`"] for c in df.columns], "preset")


def date_bounds(df: DataFrame, preferred: str = C.DATE) -> DataFrame:
    """min and max of the date column, NULLs ignored (one aggregation;
    ``bounds_from_footers`` reads no rows of a stored table)."""
    from inspectkit.operators.normalize import detect_date_column

    col = preferred if preferred in df.columns else detect_date_column(df)
    if not col:
        return df.sparkSession.createDataFrame([(None, None)], "min_date timestamp, max_date timestamp")
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


@contextmanager
def footer_aggregates(spark: SparkSession):
    """Parquet tables opened and queried inside answer MIN, MAX and COUNT from
    the statistics in their files' footers (the V2 reader pushes them down)."""
    settings = {"spark.sql.parquet.aggregatePushdown": "true",
                "spark.sql.sources.useV1SourceList": ",".join(
                    x for x in spark.conf.get("spark.sql.sources.useV1SourceList").split(",") if x.strip() != "parquet")}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def bounds_from_footers(spark: SparkSession, path: str, column: str) -> DataFrame:
    """F6 for a stored table: (min_value, max_value) of a DATE or numeric column, from
    the footers, one task per file group and no row read.  Footers say nothing sure about
    timestamps and text: those are aggregated from the column."""
    with footer_aggregates(spark):
        one = bounds_plan(spark, path, column)
        row = one.first()  # planned and run while the settings hold
    return spark.createDataFrame([tuple(row)], one.schema)


def bounds_plan(spark: SparkSession, path: str, column: str) -> DataFrame:
    c = f"`{column}`"
    return spark.read.parquet(path).agg(F.min(c).alias("min_value"), F.max(c).alias("max_value"))


def top_rows(df: DataFrame, column: str, ascending: bool = True, n: int = 100,
             tiebreak: list[str] | None = None) -> DataFrame:
    """the first ``n`` rows sorted by ``column`` (NULLs last both ways);
    ``tiebreak`` columns make ties deterministic.  Planned as
    ``TakeOrderedAndProject``: a per-partition top-n, then a merge of n rows
    per partition."""
    c = F.col(f"`{column}`")
    order = [c.asc_nulls_last() if ascending else c.desc_nulls_last()]
    order += [F.col(f"`{t}`").asc_nulls_last() for t in (tiebreak or [])]
    return df.orderBy(*order).limit(n)
