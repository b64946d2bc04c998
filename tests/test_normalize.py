from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.functions import parse_date, safe_numeric
from inspectkit.operators.normalize import alias_columns, detect_date_column, normalize
from tests.conftest import SF001, ts


def test_alias_first_source_wins_and_source_kept(spark):
    df = spark.createDataFrame([("a", "b", 1.0)], "SupplierID string, SupplierName string, Cost_Impact_SGD double")
    out = alias_columns(df)
    assert out.columns == ["SupplierID", "SupplierName", "Cost_Impact_SGD", "CostImpact", "Supplier"]
    r = out.first()
    assert r["Supplier"] == "a" and r["SupplierName"] == "b"


def test_alias_not_applied_when_target_present(spark):
    df = spark.createDataFrame([("x", "y")], "Supplier string, SupplierName string")
    assert alias_columns(df).first()["Supplier"] == "x"


def test_case_only_duplicates_raise(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([(1, 2)], "`a` int, `A` int")
        spark.conf.set("spark.sql.caseSensitive", "false")
        with pytest.raises(ValueError):
            alias_columns(df)
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_detect_date_candidates_and_parse(spark):
    df = spark.createDataFrame([("2024-01-01", "x"), ("2024-01-02", "y")], "ship_date string, UpdateDate string")
    assert detect_date_column(df) == "ship_date"
    df2 = spark.createDataFrame([("x", "2024-01-01")], "ship_date string, other_date string")
    assert detect_date_column(df2) == "other_date"
    df3 = spark.createDataFrame([(1,)], "UpdateDate bigint")
    assert detect_date_column(df3) is None  # D7: numbers never qualify
    assert detect_date_column(spark.createDataFrame([(ts(2024, 1, 1),)], "EventDate timestamp")) == "EventDate"


def test_safe_numeric_rejects_spark_only_spellings(spark):
    df = spark.createDataFrame([("abc",), ("1d",), (" 12 ",), ("NaN",), ("-1.5e2",), (None,), (".5",)], "s string")
    got = [r[0] for r in df.select(safe_numeric("s", df.schema["s"].dataType)).collect()]
    assert got == [None, None, 12.0, None, -150.0, None, 0.5]


def test_safe_numeric_nan_double_to_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert [r[0] for r in df.select(safe_numeric("x", df.schema["x"].dataType)).collect()] == [None, 1.0]


def test_parse_date_formats(spark):
    df = spark.createDataFrame([("2024-02-01",), ("02/03/2024",), ("junk",)], "s string")
    got = [r[0] for r in df.select(parse_date("s", df.schema["s"].dataType, ("MM/dd/yyyy",))).collect()]
    assert got == [ts(2024, 2, 1), ts(2024, 2, 3), None]


def test_normalize_derivations(spark):
    rows = [(None, 5, 0.0, -5.0, "a"), (0, 1, 2.0, None, None), (1, 2, 4.0, 3.0, "b")]
    df = spark.createDataFrame(rows, "DeliveryDelay bigint, DefectCount bigint, UnitsInspected double, "
                                     "Cost_Impact_SGD double, DefectType string")
    out = normalize(df).select(C.ON_TIME_FLAG, C.DEFECT_RATE, C.COST_IMPACT, "Cost_Impact_SGD").collect()
    assert [r[0] for r in out] == [0.0, 1.0, 0.0]          # NULL delay -> 0.0; <= 0 -> 1.0
    assert [r[1] for r in out] == [None, 0.5, 0.5]          # units 0 -> NULL rate
    assert [r[2] for r in out] == [0.0, None, 3.0]          # clamp keeps NULL
    assert [r[3] for r in out] == [-5.0, None, 3.0]         # source kept


def test_normalize_defect_count_from_type(spark):
    df = spark.createDataFrame([("x",), (None,)], "DefectType string")
    assert [r[0] for r in normalize(df).select(C.DEFECT_COUNT).collect()] == [1, 0]


def test_fact_mapping_counts(spark):
    from inspectkit.sources.tables import load_fact

    f = load_fact(spark, SF001)
    r = f.agg(F.count(F.lit(1)).alias("n"), F.count(C.DATE).alias("d")).first()
    assert r["n"] > 0 and r["d"] < r["n"]
    assert dict(f.dtypes)[C.DATE] == "timestamp"
