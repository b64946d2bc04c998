"""Q1-Q6: data-quality report.

The report (Q6) is one ``groupBy(all columns)`` -- the duplicate groups,
collapsed map-side so a group of copies holding a third of the table is
combined before the shuffle -- with every count a sum over those groups;
NULLs per column (Q1) are one more single-pass aggregation, or, where a report
needs both, sums over the same groups (equal rows miss the same columns).
Everything is derived from those results, never from a collect.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inspectkit import columns as C
from inspectkit.functions import is_numeric_type, is_temporal_type
from inspectkit.operators.normalize import cost_source_column, detect_date_column
from inspectkit.session import materialize

# --- Fixed values: warning texts (rule order as in the reference) ---
MSG_EMPTY = "Dataset is empty."
MSG_NO_DATE = "No date column detected. Trend analysis will be limited."
MSG_DUPLICATES = "%s duplicate rows detected."
MSG_MISSING_FIELDS = "Missing common quality fields: "
MSG_HIGH_MISSING = "High missingness (>40%) in: "
MSG_NEGATIVE = "%d rows have negative costs; set to 0."
MSG_ZERO_UNITS = "%d rows have zero units inspected; defect rate missing."
HIGH_MISSING_FRACTION = 0.4
HIGH_MISSING_LISTED = 8

# --- Fixed values: lines of the text report ---
TEXT_ROWS = "Rows: %s"
TEXT_COLUMNS = "Columns: %d"
TEXT_DATE = "Detected date column: %s"
TEXT_DUPLICATES = "Duplicate rows: %s"
TEXT_WARNINGS = "Key warnings:"
TEXT_NO_WARNING = "• No major issues detected."
TEXT_MISSING = "Top missing-value columns:"
TEXT_NO_MISSING = "• None"
WARNINGS_LISTED = 12
MISSING_LISTED = 10


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _is_missing(f: T.StructField) -> Column:
    c = _q(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_by_column(df: DataFrame) -> DataFrame:
    """Q1: ``(seq, column, missing, missing_frac)`` for every column, in one pass."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__rows")] + [
        F.sum(_is_missing(f).cast("bigint")).alias(f"__m{i}") for i, f in enumerate(fields)
    ]
    return _missing_long(df.agg(*aggs), fields)


def _missing_long(one: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """Q1 from one row: ``__rows`` and the missing values ``__m<i>`` of each column."""
    stacked = one.select(
        "__rows",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("seq"), F.lit(f.name).alias("column"),
                     F.coalesce(F.col(f"__m{i}"), F.lit(0)).alias("missing"))
            for i, f in enumerate(fields)
        ])).alias("s"),
    )
    return stacked.select(
        "s.seq", "s.column", "s.missing",
        (F.col("s.missing").cast("double") / F.nullif(F.col("__rows").cast("double"), F.lit(0.0))).alias("missing_frac"),
    )


def _row_hashes(df: DataFrame) -> list[Column]:
    """128 hash bits of a row: equal rows, equal bits; NULLs are told apart by
    their places.  Rows are compared by these instead of shuffling every
    column (and the raw alias columns next to their canonical copies)."""
    nulls = F.concat(F.lit(""), *[F.when(_q(c).isNull(), F.lit("0")).otherwise(F.lit("1")) for c in df.columns])
    return [F.xxhash64(F.lit(k), nulls, *[_q(c) for c in df.columns]).alias(f"__h{k}") for k in (1, 2)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Q2: rows equal to an earlier row in every column (NULLs equal)."""
    g = df.groupBy(*_row_hashes(df)).agg(F.count(F.lit(1)).alias("__n"))
    return g.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicated_rows"))


def column_class(dt: T.DataType) -> str:
    if is_numeric_type(dt):
        return "numeric"
    if is_temporal_type(dt):
        return "datetime"
    return "categorical"


def column_classes(df: DataFrame) -> DataFrame:
    """Q3: numeric / categorical split from the schema (datetimes in neither)."""
    rows = [(i, f.name, f.dataType.simpleString(), column_class(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "seq int, column string, spark_type string, dtype_class string")


def quality_report(df: DataFrame, cost_column: str | None = None) -> DataFrame:
    """Q4 + Q6: one row of row/column counts, duplicates, detected date
    column, negative costs (counted before the clamp, D3: on the raw source
    column that normalisation maps into CostImpact) and zero-unit rows.

    One aggregation of the table: rows grouped by 128 hash bits of all columns
    (the duplicate groups, combined map-side), and every count is a sum over
    those groups."""
    return _report_row(_duplicate_groups(df, cost_column).agg(*_report_sums()), df)


def _duplicate_groups(df: DataFrame, cost_column: str | None, *marks: Column) -> DataFrame:
    """Groups of equal rows: their number, and how many have negative costs or no
    units.  ``marks`` are functions of the row, alike in equal rows."""
    cost_column = cost_column or cost_source_column(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    if cost_column:
        from inspectkit.functions import safe_numeric

        negative = safe_numeric(cost_column, types[cost_column]) < 0
    else:
        negative = F.lit(False)
    zero = F.col(C.UNITS_INSPECTED) == 0 if C.has(df, C.UNITS_INSPECTED) else F.lit(False)
    return df.groupBy(*_row_hashes(df), *marks).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(negative).alias("__neg"), F.count_if(zero).alias("__zero"))


def _report_sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(a) for a, c in (
        ("row_count", F.col("__n")), ("duplicated_rows", F.col("__n") - 1),
        ("negative_costs", F.col("__neg")), ("zero_inspected", F.col("__zero")))]


def _report_row(counts: DataFrame, df: DataFrame) -> DataFrame:
    fields, date_col = df.schema.fields, detect_date_column(df)
    n_num = sum(1 for f in fields if column_class(f.dataType) == "numeric")
    n_cat = sum(1 for f in fields if column_class(f.dataType) == "categorical")
    return counts.select(
        "row_count",
        F.lit(len(fields)).cast("bigint").alias("column_count"),
        "duplicated_rows",
        F.lit(date_col).cast("string").alias("detected_date_column"),
        "negative_costs",
        "zero_inspected",
        F.lit(n_num).cast("bigint").alias("numeric_columns"),
        F.lit(n_cat).cast("bigint").alias("categorical_columns"),
    )


def report_and_missing(df: DataFrame, cost_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Q6 and Q1 from one aggregation of the table: the groups of equal rows carry a bit
    for each column that they miss."""
    fields = df.schema.fields
    word = lambda at: reduce(lambda a, b: a.bitwiseOR(b), [
        F.when(_is_missing(f), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, f in enumerate(fields[at:at + 62])])
    words = [word(at).alias(f"__miss{at // 62}") for at in range(0, len(fields), 62)]
    missing = [F.sum(F.when(F.col(f"__miss{i // 62}").bitwiseAND(F.lit(1 << i % 62)) != 0, F.col("__n")).otherwise(F.lit(0))).alias(f"__m{i}")
               for i in range(len(fields))]
    one = materialize(_duplicate_groups(df, cost_column, *words).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__rows"), *missing, *_report_sums()))
    return _report_row(one, df), _missing_long(one, fields) if fields else missing_by_column(df)


def quality_warnings(df: DataFrame, cost_column: str | None = None, rep: DataFrame | None = None,
                     miss: DataFrame | None = None) -> DataFrame:
    """Q5: ``(seq, code, message)`` in rule order, built from Q1 and Q6 (``miss`` and
    ``rep`` where they are known)."""
    if rep is None or miss is None:
        found = report_and_missing(df, cost_column)
        rep, miss = [known or new for known, new in zip((rep, miss), found)]
    high = miss.filter(F.col("missing_frac") > HIGH_MISSING_FRACTION).agg(
        F.sort_array(F.collect_list(F.struct("seq", "column"))).alias("__cols")
    )
    high = high.select(F.array_join(F.slice(F.col("__cols.column"), 1, HIGH_MISSING_LISTED), ", ").alias("__high"),
                       F.size("__cols").alias("__nh"))
    # one row, read by every rule: computed once
    r = materialize(rep.crossJoin(high))
    missing_fields = [c for c in C.ESSENTIAL_COLUMNS if c not in df.columns]

    def rule(seq: int, code: str, cond: Column, msg: Column) -> DataFrame:
        return r.filter(cond).select(F.lit(seq).alias("seq"), F.lit(code).alias("code"), msg.alias("message"))

    rules = [
        rule(1, "empty", F.col("row_count") == 0, F.lit(MSG_EMPTY)),
        rule(2, "no_date", F.col("detected_date_column").isNull(), F.lit(MSG_NO_DATE)),
        rule(3, "duplicates", F.col("duplicated_rows") > 0,
             F.format_string(MSG_DUPLICATES, F.format_number(F.col("duplicated_rows"), 0))),
        rule(4, "missing_fields", F.lit(bool(missing_fields)),
             F.lit(MSG_MISSING_FIELDS + ", ".join(missing_fields))),
        rule(5, "high_missing", (F.col("row_count") > 0) & (F.col("__nh") > 0),
             F.concat(F.lit(MSG_HIGH_MISSING), F.col("__high"))),
        rule(6, "negative_costs", F.col("negative_costs") > 0, F.format_string(MSG_NEGATIVE, F.col("negative_costs"))),
        rule(7, "zero_inspected", F.col("zero_inspected") > 0, F.format_string(MSG_ZERO_UNITS, F.col("zero_inspected"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), rules)


def report_text(df: DataFrame, cost_column: str | None = None) -> DataFrame:
    """Q6 as text: (seq, line) in order -- counts, the first warnings, the columns with most
    missing values (ties in column order).  Put together from Q1, Q5 and Q6 without a
    collect; seq leaves room in each section."""
    spark = df.sparkSession
    rep, miss = report_and_missing(df, cost_column)
    number = lambda c: F.format_number(c, 0)
    counts = [F.format_string(TEXT_ROWS, number("row_count")), F.format_string(TEXT_COLUMNS, "column_count"),
              F.format_string(TEXT_DATE, F.coalesce("detected_date_column", F.lit("None"))),
              F.format_string(TEXT_DUPLICATES, number("duplicated_rows"))]
    head = rep.select(F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), c.alias("line")) for i, c in enumerate(counts)])).alias("l")).select("l.*")
    fixed = spark.createDataFrame([(10, ""), (11, TEXT_WARNINGS), (100, ""), (101, TEXT_MISSING)], "seq int, line string")
    bullet = lambda text: F.concat(F.lit("• "), text)
    # a handful of warnings and one row per column: windows over these are small
    warned = materialize(quality_warnings(df, cost_column, rep, miss)).withColumn("k", F.row_number().over(Window.orderBy("seq")))
    warned = warned.where(F.col("k") <= WARNINGS_LISTED).select((F.col("k") + 20).alias("seq"), bullet(F.col("message")).alias("line"))
    none = warned.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(21).alias("seq"), F.lit(TEXT_NO_WARNING).alias("line"))
    lacking = miss.withColumn("k", F.row_number().over(Window.orderBy(F.desc("missing"), "seq")))
    lacking = lacking.where(F.col("k") <= MISSING_LISTED).select(
        (F.col("k") + 110).alias("seq"), bullet(F.format_string("%s: %s", F.col("column"), number("missing"))).alias("line"))
    if not df.columns:
        lacking = spark.createDataFrame([(111, TEXT_NO_MISSING)], "seq int, line string")
    return reduce(lambda a, b: a.unionByName(b), [head, fixed, warned, none, lacking]).select(F.col("seq").cast("int").alias("seq"), "line")
