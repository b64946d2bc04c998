"""Stored answers and per-file decisions: KPI cube (K4), CSV encodings (S1), footer
bounds (F6), one date format (N4), the text report, stored models (M7, M9, M10)."""

from __future__ import annotations

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.functions import infer_date_formats, parse_date_as
from inspectkit.operators import classify as CL
from inspectkit.operators import cube, filters, report
from inspectkit.operators import forest as FR
from inspectkit.operators import kpis as K
from inspectkit.operators.normalize import normalize
from inspectkit.params import DEFAULT_PARAMS, FilterState
from inspectkit.sources.files import files_not_utf8, read_quality_csv
from inspectkit.streaming import jobs as S
from tests.conftest import ts

FACT = "Part_Type string, Defect_Type string, Defect_Severity string, MaterialComposition string, DefectCount long, CostImpact double"


def _fact(spark, n=90):
    pick = lambda i, *v: v[i % len(v)]
    rows = [(pick(i, "p", "q", None), pick(i // 2, "a", "b"), pick(i // 3, "lo", "hi", None), pick(i // 5, "x", "y"), i % 4, float(i)) for i in range(n)]
    return spark.createDataFrame(rows, FACT).withColumn("i", F.monotonically_increasing_id())


def _direct(df, state):
    kept = filters.apply_filters(df, state)
    return tuple(kept.agg(F.count(F.lit(1)), K.defects_expr(df), K.copq_expr(df)).first())


def test_cube_lookup_equals_filtering_after_three_batches(spark, tmp_path):
    df, path = _fact(spark).cache(), str(tmp_path / "cube")
    values = {"part_type": ("p", "none such"), "defect_type": ("a",), "severity": ("hi",), "material": ("y",)}
    states = [FilterState(**{k: v for k, v in zip(values, combo) if v}) for combo in itertools.product(*[(None, *v) for v in values.values()])]
    for batch in range(3):
        cube.write_cube(df.where(F.col("CostImpact") % 3 == batch), path, batch)
        so_far = df.where(F.col("CostImpact") % 3 <= batch)
        got = {r.seq: (r.Rows, r.Defects, r.COPQ) for r in cube.lookup(spark, path, states).collect()}
        assert got == {i: _direct(so_far, s) for i, s in enumerate(states)}
    cube.write_cube(df.where(F.col("CostImpact") % 3 == 1), path, 1)  # a batch that is replayed
    cube.compact(spark, path, str(tmp_path / "one"))
    for where in (path, str(tmp_path / "one")):
        got = {r.seq: (r.Rows, r.Defects, r.COPQ) for r in cube.lookup(spark, where, states).collect()}
        assert got == {i: _direct(df, s) for i, s in enumerate(states)}
    assert cube.read_cube(spark, str(tmp_path / "one")).groupBy("gid", *C.FILTER_DIMS).count().where("count > 1").isEmpty()
    with pytest.raises(ValueError):
        cube.lookup(spark, path, [FilterState(start_date="2024-01-01")])


def test_cube_lookup_reads_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "cube")
    cube.write_cube(_fact(spark), path)
    plan = cube.lookup(spark, path, [FilterState(part_type="p")])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "gid" in plan.split("PartitionFilters")[1].split("]")[0]


def test_csv_encoding_is_decided_per_file(spark, tmp_path):
    """One UTF-8 file that holds a true U+FFFD, one Latin-1 file, one ASCII file."""
    d = tmp_path / "in"
    d.mkdir()
    head = "SupplierName,Note,Cost_Impact_SGD\n"
    (d / "a.csv").write_bytes((head + "Łódź,� kept,1.5\n").encode())
    (d / "b.csv").write_bytes((head + "Café,façade,2.5\n").encode("latin-1"))
    (d / "c.csv").write_bytes((head + "plain,ok,3\n").encode())
    for schema in (None, "SupplierName string, Note string, Cost_Impact_SGD double"):
        got = sorted(map(tuple, read_quality_csv(spark, str(d) + "/", schema).collect()))
        assert got == [("Café", "façade", 2.5), ("plain", "ok", 3.0), ("Łódź", "� kept", 1.5)]
    assert {os.path.basename(f) for f in files_not_utf8(spark, str(d) + "/")} == {"b.csv"}
    assert read_quality_csv(spark, str(d / "a.csv")).first().Note == "� kept"


def test_bounds_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.col("id")).repartition(3).write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    with filters.footer_aggregates(spark):
        plan = filters.bounds_plan(spark, path, "day")._jdf.queryExecution().toString()
    assert "PushedAggregation: [MIN(day), MAX(day)]" in plan and "ReadSchema: struct<min(day):date,max(day):date>" in plan.replace("`", "")
    r = filters.bounds_from_footers(spark, path, "day").first()
    assert (str(r.min_value), str(r.max_value)) == ("2024-01-01", "2026-09-26")
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    t = str(tmp_path / "u")  # timestamps: aggregated
    spark.createDataFrame([(ts(2024, 1, 2),), (None,), (ts(2023, 5, 1),)], "at timestamp").write.parquet(t)
    assert filters.bounds_from_footers(spark, t, "at").first().min_value == ts(2023, 5, 1)


def test_one_date_format_by_vote(spark):
    rows = [("03/14/2024", "x"), ("12/31/2023", None), ("2024-01-05", "y"), (" 01/02/2024 ", "2024"), (None, None), ("junk", "")]
    df = spark.createDataFrame(rows, "d string, none string")
    assert infer_date_formats(df, ["d", "none"]) == {"d": "MM/dd/yyyy", "none": None}
    got = [r[0] for r in df.select(parse_date_as("d", "MM/dd/yyyy")).collect()]
    assert got == [ts(2024, 3, 14), ts(2023, 12, 31), None, ts(2024, 1, 2), None, None]
    n = normalize(df.withColumnRenamed("d", "InspectionDate"), infer_date_format=True)
    assert [r.Date for r in n.collect()] == got
    assert normalize(df.limit(0).withColumnRenamed("d", "InspectionDate"), infer_date_format=True).select("Date").collect() == []


def test_report_text(spark):
    df = spark.createDataFrame([(1.0, None)] * 1200 + [(2.0, "x")], "CostImpact double, Supplier string")
    lines = [r.line for r in report.report_text(df).orderBy("seq").collect()]
    assert lines[:6] == ["Rows: 1,201", "Columns: 2", "Detected date column: None", "Duplicate rows: 1,199", "", "Key warnings:"]
    assert lines[6] == "• No date column detected. Trend analysis will be limited."
    assert lines[-3:] == ["Top missing-value columns:", "• Supplier: 1,200", "• CostImpact: 0"]
    ok = spark.createDataFrame([(ts(2024, 1, d), "a", 1.0, "p", "t") for d in (1, 2)], "Date timestamp, Supplier string, CostImpact double, Part_Type string, Defect_Type string")
    assert "• No major issues detected." in [r.line for r in report.report_text(ok).collect()]


# ---------------------------------------------------------------- models


def _labelled(n=400):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        kind = ("red", "green", "blue", None)[int(rng.integers(4))]
        x = float(rng.normal())
        rows.append((x if i % 11 else None, kind, float(rng.normal()), "yes" if (kind == "red") != (x > 1.0) else "no"))
    return rows


SMALL = DEFAULT_PARAMS.with_(classifier_trees=8, classifier_max_depth=5)


def test_importances_add_up_by_slots(spark):
    df = spark.createDataFrame(_labelled(), "x double, kind string, noise double, t string")
    r = CL.train_defect_classifier(df, ["kind", "x", "noise"], "t", SMALL)
    imp = {i.feature: i.importance for i in r.importance.collect()}
    forest = r.model.stages[-2].featureImportances.toArray()
    assert set(imp) == {"kind", "x", "noise"} and sum(imp.values()) == pytest.approx(1.0)
    assert len(forest) > 3 and imp["kind"] == pytest.approx(forest[2:].sum())  # x, noise, then the slots of kind
    assert max(imp, key=imp.get) == "kind" and r.metrics.first().accuracy > 0.8


def test_model_is_stored_per_table_version_and_scores_streams(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    schema = "x double, kind string, noise double, t string"
    spark.createDataFrame(_labelled(), schema).repartition(2).write.parquet(path)
    trained = []
    real = CL.train_defect_classifier
    monkeypatch.setattr(CL, "train_defect_classifier", lambda *a: trained.append(1) or real(*a))
    features = ["x", "kind", "noise"]
    first = CL.trained_classifier(spark.read.parquet(path), features, "t", SMALL)
    again = CL.trained_classifier(spark.read.parquet(path), features, "t", SMALL)
    assert trained == [1] and first.classes == again.classes == ["no", "yes"]
    assert first.metrics.collect() == again.metrics.collect() and first.importance.collect() == again.importance.collect()
    # unseen values and nulls are scored too; a stream as a batch
    new = spark.createDataFrame([(0.1, "red", 0.0, "k1"), (None, None, None, "k2"), (5.0, "mauve", 1.0, "k3"), (9.0, "red", 0.0, "k4")] * 5, "x double, kind string, noise double, id string")
    src = str(tmp_path / "arrivals")
    for part in (0, 1):
        new.where(F.col("id").isin(["k1", "k2"]) if part else F.col("id").isin(["k3", "k4"])).write.mode("append").parquet(src)
    batch = sorted((r.id, r.prediction) for r in CL.score_defects(again.model, new).collect())
    sdf = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(src)
    stream = S.run_to_table(spark, CL.score_defects(again.model, sdf).select("id", "prediction"), "append", "scored")
    assert sorted(map(tuple, stream.collect())) == batch and len(batch) == 20
    assert not [c for c in CL.score_defects(again.model, new).columns if c.startswith("__")]
    spark.createDataFrame(_labelled(50), schema).write.mode("append").parquet(path)  # another version of the table
    CL.trained_classifier(spark.read.parquet(path), features, "t", SMALL)
    assert trained == [1, 1]


def test_values_out_of_range_are_refused(spark):
    df = spark.createDataFrame(_labelled(40), "x double, kind string, noise double, t string")
    for bad in ({"model_test_size": 0.0}, {"classifier_max_depth": 31}):
        with pytest.raises(ValueError):
            CL.train_defect_classifier(df, ["x"], "t", SMALL.with_(**bad))
    with pytest.raises(ValueError):
        FR.detect_anomalies(df, contamination=0.0)
    from inspectkit.operators.qindex import quality_index

    with pytest.raises(ValueError):
        quality_index(spark.createDataFrame([(1.0,)], "QualityScore double"), DEFAULT_PARAMS.with_(quantile_method="guess"))


def test_forest_pool_is_drawn_without_a_shuffle_of_rows(spark):
    """The plan of the pool holds no exchange before the top-n by random key."""
    df = spark.range(5000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).repartition(4)
    drawn = FR.drawn_pool(df, 100, 7)
    assert drawn.count() == 100
    plan = FR.pool_plan(df.where("a >= 0"), 100, 5000, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Window" not in plan
