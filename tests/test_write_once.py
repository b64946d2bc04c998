"""Operators of several passes compute their input once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators import classify as CL
from inspectkit.operators import forest as FR
from inspectkit.operators import kpis as K
from inspectkit.operators import multivariate as M
from inspectkit.operators import qindex as X
from inspectkit.operators import report as Q
from inspectkit.operators import sinks as W
from inspectkit.params import DEFAULT_PARAMS
from inspectkit.plans import q_analytics, q_basic, q_stored, q_timeseries

ROWS = 300


def _counted(spark):
    """Records, and how often a row of them was computed."""
    rows = [(f"s{i % 7}", f"p{i % 3}", f"d{i % 5}" if i % 4 else None, "low" if i % 2 else "high", f"m{i % 2}",
             f"2024-0{1 + i % 9}-11 00:00:00", float(i % 50) if i % 50 else 0.0, i % 3, float(i % 97) - 5.0,
             max(float(i % 97) - 5.0, 0.0), 90.0 + i % 11 if i % 53 else None, float(i % 40), float(i % 2), (i % 3) / 7.0)
            for i in range(ROWS)]
    df = spark.createDataFrame(rows, "Supplier string, Part_Type string, Defect_Type string, Defect_Severity string, MaterialComposition string, "
                                     "d string, UnitsInspected double, DefectCount bigint, Cost_Impact_SGD double, CostImpact double, "
                                     "YieldPercentage double, QualityScore double, OnTimeFlag double, DefectRate double")
    df = df.withColumn(C.DATE, F.to_timestamp("d")).drop("d")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema), seen


OPERATORS = {
    "pca_projection": lambda df: M.pca_projection(df)[0],
    "pca_explained_variance": lambda df: M.pca_projection(df)[1],
    "numeric_correlation": M.correlation_long,
    "top_correlations": M.top_correlations,
    "candidate_targets": M.candidate_targets,
    "executive_kpis": K.executive_kpis,
    "executive_kpis_by_part": lambda df: K.executive_kpis(df, by=[C.PART_TYPE]),
    "report_summary": W.report_summary,
    "narrative_facts": W.narrative_facts,
    "quality_index_series": X.quality_index_series,
    "quality_index_histogram": X.quality_index_histogram,
    "detect_anomalies": lambda df: FR.detect_anomalies(df, n_trees=5),
    "anomaly_summary": lambda df: FR.anomaly_summary(FR.detect_anomalies(df, n_trees=5, keep=[])),
    "report_text": Q.report_text,
    "quality_warnings": Q.quality_warnings,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_computes_its_input_once(spark, name):
    df, seen = _counted(spark)
    assert OPERATORS[name](df).collect()
    assert seen.value == ROWS


@pytest.mark.parametrize("module, query", [(q_basic, "q_apply_presets"), (q_stored, "q_kpi_cube_lookup"), (q_analytics, "q_quality_index"),
                                           (q_timeseries, "q_quality_index_series")])
def test_query_computes_the_fact_once(spark, monkeypatch, module, query):
    df, seen = _counted(spark)
    monkeypatch.setattr(module, "fact", lambda *_: df)
    assert getattr(module, query)(spark, "").collect()
    assert seen.value == ROWS


def test_missing_values_from_the_groups_of_equal_rows(spark):
    """More columns than a word has bits, NaN, equal rows; as counted column by column."""
    wide = spark.createDataFrame([(1.0, None), (float("nan"), "a"), (float("nan"), "a"), (None, None)], "x double, t string")
    wide = wide.select("*", *[F.when(F.col("t") == "a", F.lit(i)).alias(f"c{i}") for i in range(130)])
    rep, miss = Q.report_and_missing(wide)
    assert sorted(miss.collect()) == sorted(Q.missing_by_column(wide).collect())
    assert rep.collect() == Q.quality_report(wide).collect() and rep.first().duplicated_rows == 1
    rep, miss = Q.report_and_missing(wide.limit(0))
    assert sorted(miss.collect(), key=lambda r: r.seq) == sorted(Q.missing_by_column(wide.limit(0)).collect(), key=lambda r: r.seq)


def test_tables_without_the_columns(spark):
    """Rows count where no column is read; a column without a type stays one."""
    df = spark.range(3).select(F.col("id").alias("other"))
    r = K.executive_kpis(df).first()
    assert (r.Rows, r.Defects, r.QualityIndex) == (3.0, 3.0, None)
    assert W.report_summary(df).where("metric = 'Rows'").first().value == 3.0
    void = df.withColumn(C.YIELD, F.lit(None))
    assert K.executive_kpis(void).first().YieldPct is None
    assert M.candidate_targets(void).collect() == [(0, "other", 3)]


def test_group_bounds_are_joined_without_a_shuffle_of_rows(spark):
    """The bounds of a few groups are broadcast; before, their size was unknown."""
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("QualityScore"))
    plan = X.quality_index(df, by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_training_computes_its_rows_once(spark):
    df, seen = _counted(spark)
    r = CL.train_defect_classifier(df, [C.PART_TYPE, C.YIELD], C.DEFECT_SEVERITY, DEFAULT_PARAMS.with_(classifier_trees=3, classifier_max_depth=3))
    assert r.metrics.first().test_rows == 90 and seen.value == ROWS
    assert r.model.stages[-2].getCacheNodeIds()


def test_node_ids_of_many_rows_are_not_kept(spark):
    assert CL.node_ids_fit(spark, 100_000, 150) and not CL.node_ids_fit(spark, 25_000_000, 150)
