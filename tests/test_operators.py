"""Hand-sized edge frames (FIXTURES.md §3) for the batch operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators import alerts as A
from inspectkit.operators import copq as CQ
from inspectkit.operators import filters as FL
from inspectkit.operators import kpis as K
from inspectkit.operators import qindex as X
from inspectkit.operators import report as Q
from inspectkit.operators import rootcause as P
from inspectkit.operators import suppliers as V
from inspectkit.operators import timeseries as TS
from inspectkit.operators.multivariate import correlation_long, top_correlations
from inspectkit.operators.seriesidx import downsample_rows, downsample_series
from inspectkit.params import FilterState
from tests.conftest import ts


def test_pareto_tie_and_null(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "Defect_Type string")
    got = [tuple(r) for r in P.defect_pareto(df).collect()]
    assert got == [("a", 2, 40.0), ("b", 2, 80.0), ("Unknown", 1, 100.0)]


def test_pareto_cut_uses_kept_rows_only(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "Defect_Type string")
    assert [tuple(r) for r in P.defect_pareto(df, n=1).collect()] == [("a", 2, 100.0)]


def test_pareto_missing_column_is_empty_with_schema(spark):
    out = P.defect_pareto(spark.createDataFrame([(1,)], "x int"))
    assert out.count() == 0 and out.columns == ["Defect_Type", "Count", "CumulativePct"]


def test_crosstab_includes_zero_cells_and_cuts(spark):
    df = spark.createDataFrame([("s1", "p1"), ("s2", "p2"), (None, "p1")], "Defect_Severity string, Part_Type string")
    cells = {(r.row_key, r.col_key): r.n for r in P.severity_part_heatmap(df).collect()}
    assert cells == {("Unknown", "p1"): 1, ("Unknown", "p2"): 0, ("s1", "p1"): 1, ("s1", "p2"): 0,
                     ("s2", "p1"): 0, ("s2", "p2"): 1}
    assert sum(cells.values()) == 3


def test_audit_focus_row_major_tie(spark):
    rows = [("r1", "c1")] * 1 + [("r1", "c2")] * 5 + [("r2", "c1")] * 5 + [("r2", "c2")] * 2
    df = spark.createDataFrame(rows, "Defect_Severity string, Part_Type string")
    r = P.audit_focus(df).first()
    assert (r.row_key, r.col_key, r.n) == ("r1", "c2", 5)


def test_drilldown_drops_null_keys(spark):
    df = spark.createDataFrame([("a", "p"), ("a", None), ("a", "p")], "Defect_Type string, Part_Type string")
    assert [tuple(r) for r in P.root_cause_drilldown(df).collect()] == [("a", "p", 2)]


def test_trend_gap_filled(spark):
    df = spark.createDataFrame([(ts(2024, 1, 1), 1), (ts(2024, 1, 3), 1), (None, 7)], "Date timestamp, DefectCount bigint")
    assert [r.value for r in TS.trend_by_period(df, "D").orderBy("period").collect()] == [1.0, 0.0, 1.0]


def test_monthly_cost_month_ends(spark):
    df = spark.createDataFrame([(ts(2024, 1, 15), 1.0), (ts(2024, 3, 2), 2.0), (ts(2024, 3, 5), None)],
                               "Date timestamp, CostImpact double")
    got = [(r.period, r.value) for r in TS.monthly_copq(df).orderBy("period").collect()]
    assert got == [(dt.date(2024, 1, 31), 1.0), (dt.date(2024, 2, 29), 0.0), (dt.date(2024, 3, 31), 2.0)]


def test_weekly_label_is_sunday(spark):
    df = spark.createDataFrame([(ts(2024, 1, 1), 1), (ts(2024, 1, 7), 1), (ts(2024, 1, 8), 1)],
                               "Date timestamp, DefectCount bigint")
    got = [(r.period, r.value) for r in TS.trend_by_period(df, "W").orderBy("period").collect()]
    assert got == [(dt.date(2024, 1, 7), 2.0), (dt.date(2024, 1, 14), 1.0)]


def _series(spark, values):
    start = dt.date(2024, 1, 1)
    return spark.createDataFrame([(start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)],
                                 "period date, value double")


def test_rolling_mean_partial_windows(spark):
    got = [r.rolling_mean for r in TS.rolling_mean(_series(spark, range(9)), 7).orderBy("period").collect()]
    assert got == [0, .5, 1, 1.5, 2, 2.5, 3, 4, 5]


def test_control_limits_one_point_and_empty(spark):
    r = TS.control_limits(_series(spark, [3])).first()
    assert (r.mean, r.ucl, r.lcl) == (3.0, None, 0.0)
    e = TS.control_limits(spark.createDataFrame([], "period date, value double")).first()
    assert (e.mean, e.ucl, e.lcl) == (0.0, 0.0, 0.0)


def test_seasonal_decompose_adds_up(spark):
    vals = [(i % 7) * 2.0 + i * 0.5 for i in range(60)]
    d = TS.seasonal_decompose(_series(spark, vals)).orderBy("period").collect()
    assert len(d) == 60
    for r in d:
        if r.trend is not None:
            assert abs(r.trend + r.seasonal + r.resid - r.value) < 1e-9
    assert TS.seasonal_decompose(_series(spark, range(10))).count() == 0  # n < 24


def test_thinning_positions_linspace(spark):
    kept = [r.pos for r in downsample_series(_series(spark, range(11)), "period", 4).orderBy("pos").collect()]
    assert kept == [0, 3, 6, 10]
    kept = [r.pos for r in downsample_series(_series(spark, range(31)), "period", 23).orderBy("pos").collect()]
    import numpy as np
    assert kept == sorted(set(np.linspace(0, 30, 23, dtype=int).tolist()))


def test_row_level_thinning_matches_series_thinning(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v")).repartition(7)
    kept = [r.pos for r in downsample_rows(df, ["v"], 10).orderBy("pos").collect()]
    import numpy as np
    assert kept == np.linspace(0, 999, 10, dtype=int).tolist()


def test_quality_index_constant_and_null(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, 1.0), (5.0, 0.0)], "QualityScore double, OnTimeFlag double")
    p = X.DEFAULT_PARAMS.with_(quality_index_winsorize=False)
    got = [r.QualityIndex for r in X.quality_index(df, p).collect()]
    assert got == [50.0, 75.0, 25.0]


def test_winsor_limits(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (3.0,), (100.0,)], "QualityScore double")
    q = df.agg(X.quantiles(F.col("QualityScore"), [0.05, 0.95], X.DEFAULT_PARAMS).alias("q")).first().q
    assert q[0] == pytest.approx(1.15) and q[1] == pytest.approx(85.45)


def test_index_in_range_and_histogram_sums(spark):
    from inspectkit.sources.tables import load_fact
    from tests.conftest import SF001

    f = load_fact(spark, SF001)
    q = X.quality_index(f)
    r = q.agg(F.min(X.INDEX), F.max(X.INDEX), F.count(X.INDEX)).first()
    assert 0 <= r[0] <= r[1] <= 100
    h = X.histogram(q, X.INDEX, 20).collect()
    assert len(h) == 20 and sum(b["count"] for b in h) == r[2]


def test_risk_band_edges(spark):
    vals = [-0.01, 0.0, 0.4, 0.40001, 0.7, 1.0, 1.01, 1.2, None]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = [r[0] for r in df.select(V.risk_band(F.col("s"))).collect()]
    assert got == [None, "High Risk", "High Risk", "Moderate", "Moderate", "Preferred", "Preferred", None, None]


def test_supplier_zero_units_and_no_dates(spark):
    df = spark.createDataFrame([("s", None, 0, 0.0, 1.0)], "Supplier string, Date timestamp, DefectCount bigint, "
                                                          "UnitsInspected double, CostImpact double")
    r = V.supplier_scorecard(df).first()
    assert r.DefectRate == 0.0 and r.TrendArrow is None
    assert (r.DefectScore, r.DeliveryScore, r.CostScore, r.TotalScore) == (0.5, 0.5, 0.5, 0.5)


def test_supplier_trend_arrows(spark):
    rows = []
    for m, v in enumerate([1, 1, 1, 5, 5, 5]):
        rows.append(("up", ts(2024, m + 1, 1), v))
    for m, v in enumerate([5, 5]):
        rows.append(("short", ts(2024, m + 1, 1), v))
    df = spark.createDataFrame(rows, "Supplier string, Date timestamp, DefectCount bigint")
    got = {r.Supplier: r.TrendArrow for r in V.supplier_trend(df).collect()}
    assert got == {"up": "↑", "short": "→"}


def test_filters_null_date_dropped_and_equalities(spark):
    df = spark.createDataFrame([("A", ts(2024, 1, 1, 23, 59, 59)), ("A", None), ("B", ts(2024, 1, 2))],
                               "Part_Type string, Date timestamp")
    st = FilterState(part_type="A", start_date="2024-01-01", end_date="2024-01-01")
    assert FL.apply_filters(df, st).count() == 1
    assert FL.apply_filters(df, FilterState()).count() == 3


def test_search_null_never_matches(spark):
    df = spark.createDataFrame([(None, ts(2024, 5, 6, 7, 8, 9)), ("Nothing", None)], "t string, d timestamp")
    assert FL.search_rows(df, "no").count() == 1
    assert FL.search_rows(df, "2024-05-06 07:08").count() == 1


def test_unique_values_trimmed_sorted(spark):
    df = spark.createDataFrame([(" b ",), ("a",), ("",), (None,), ("b",)], "x string")
    assert [r.value for r in FL.unique_values(df, "x").collect()] == ["a", "b"]


def test_presets_wildcards_and_dates(spark, tmp_path):
    p = tmp_path / "presets.json"
    p.write_text('{"all": {"part_type": "All Part Types"}, "a_jan": {"part_type": "A", '
                 '"start_date": "2024-01-01", "end_date": "2024-01-31"}}')
    presets = FL.read_presets(spark, str(p))
    df = spark.createDataFrame([("A", ts(2024, 1, 31, 12)), ("A", ts(2024, 2, 1)), ("B", None)],
                               "Part_Type string, Date timestamp")
    got = sorted((r.preset, r.Part_Type) for r in FL.apply_presets(df, presets).collect())
    assert got == [("a_jan", "A"), ("all", "A"), ("all", "A"), ("all", "B")]
    big = FL.apply_presets(df, presets)
    assert sorted((r.preset, r.Part_Type) for r in big.collect()) == got


def test_top_rows_nulls_last(spark):
    df = spark.createDataFrame([(None,), (2.0,), (1.0,)], "x double")
    assert [r.x for r in FL.top_rows(df, "x", False, 3).collect()] == [2.0, 1.0, None]
    assert [r.x for r in FL.top_rows(df, "x", True, 3).collect()] == [1.0, 2.0, None]


def test_count_defects_fallbacks(spark):
    assert K.count_defects(spark.createDataFrame([("a",), (None,)], "Defect_Type string")).first()[0] == 1
    assert K.count_defects(spark.createDataFrame([(1,), (2,)], "x int")).first()[0] == 2
    assert K.total_copq(spark.createDataFrame([(1,)], "x int")).first()[0] == 0.0


def test_kpi_cube_grouping_flags(spark):
    df = spark.createDataFrame([("A", None, 1, 2.0)], "Part_Type string, Defect_Type string, DefectCount bigint, "
                                                     "CostImpact double")
    rows = K.kpi_cube(df, [C.PART_TYPE, C.DEFECT_TYPE]).collect()
    assert len(rows) == 4
    null_vs_all = {(r.g_Defect_Type, r.Defect_Type) for r in rows if r.Part_Type == "A"}
    assert null_vs_all == {(0, None), (1, None)}


def test_what_if_no_defects_and_scenarios(spark):
    df = spark.createDataFrame([(0, 10.0)], "DefectCount bigint, CostImpact double")
    r = CQ.copq_what_if(df).first()
    assert (r.estimated_savings, r.projected_copq) == (0.0, 10.0)
    df2 = spark.createDataFrame([(1, 100.0)], "DefectCount bigint, CostImpact double")
    got = {r.reduction_pct: r.projected_copq for r in CQ.copq_what_if(df2, pct=[2.0, 50.0]).collect()}
    assert got == {2.0: 98.0, 50.0: 50.0}


def test_linear_forecast(spark):
    s = spark.createDataFrame([(dt.date(2024, 1, 31), 1.0), (dt.date(2024, 2, 29), 2.0), (dt.date(2024, 3, 31), 3.0)],
                              "period date, value double")
    got = [(r.period, round(r.forecast, 9)) for r in CQ.forecast_copq(None, 3, "linear", series=s).orderBy("period").collect()]
    assert got == [(dt.date(2024, 4, 30), 4.0), (dt.date(2024, 5, 31), 5.0), (dt.date(2024, 6, 30), 6.0)]
    assert CQ.forecast_copq(None, 3, "linear", series=s.limit(2)).count() == 0


def test_ar1_forecast_recursion(spark):
    vals = [1.0, 2.0, 4.0, 7.0, 11.0]   # differences 1,2,3,4 -> d = d_prev + 1
    s = spark.createDataFrame([(dt.date(2024, i + 1, 1), v) for i, v in enumerate(vals)], "period date, value double")
    got = [round(r.forecast, 6) for r in CQ.forecast_copq(None, 3, "ar1", series=s).orderBy("period").collect()]
    assert got == [16.0, 22.0, 29.0]


def test_copq_spike_rules(spark):
    seven = [(ts(2024, 1, 1 + i), 0.0) for i in range(7)]
    df = spark.createDataFrame(seven, "Date timestamp, CostImpact double")
    assert A.alert_copq_spike(df).count() == 0  # needs more than 7 days
    df2 = spark.createDataFrame(seven + [(ts(2024, 1, 8), 20000.0)], "Date timestamp, CostImpact double")
    r = A.alert_copq_spike(df2).first()
    assert r.key == "copq_spike" and round(r.value) == 20000
    assert r.message == "COPQ spike: today's cost 20000 vs 7-day avg 2857"


def test_defect_rate_alert(spark):
    df = spark.createDataFrame([(0.1,), (0.2,)], "DefectRate double")
    r = A.alert_defect_rate(df).first()
    assert r.message == "High overall defect rate: 15.00% (threshold 5.0%)"


def test_correlation_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "a double, b double")
    cells = {(r.col_a, r.col_b): r.corr for r in correlation_long(df).collect()}
    assert cells[("a", "b")] is None and cells[("b", "b")] == 1.0
    assert top_correlations(df).count() == 0


def test_report_counts_and_warnings(spark):
    rows = [(1.0, -1.0, "x", None), (1.0, -1.0, "x", None), (0.0, None, None, 90.0)]
    raw = spark.createDataFrame(rows, "UnitsInspected double, Cost_Impact_SGD double, DefectType string, Yield double")
    from inspectkit.operators.normalize import normalize

    f = normalize(raw)
    r = Q.quality_report(f).first()
    assert (r.row_count, r.duplicated_rows, r.negative_costs, r.zero_inspected) == (3, 1, 2, 1)
    codes = [w.code for w in Q.quality_warnings(f).orderBy("seq").collect()]
    assert codes == ["no_date", "duplicates", "missing_fields", "high_missing", "negative_costs", "zero_inspected"]
    msg = [w.message for w in Q.quality_warnings(f).collect() if w.code == "high_missing"][0]
    assert msg == "High missingness (>40%) in: Yield, YieldPercentage"
    miss = {m.column: m.missing for m in Q.missing_by_column(f).collect()}
    assert miss["DefectType"] == 1 and miss["DefectRate"] == 1


def test_crosstab_unbounded_axes_are_sparse(spark):
    df = spark.createDataFrame([("s1", "p1"), ("s2", "p2"), ("s2", "p2")], "a string, b string")
    got = sorted(tuple(r) for r in P.crosstab_long(df, "a", "b", None, None).collect())
    assert got == [("s1", "p1", 1), ("s2", "p2", 2)]


def test_presets_bucket_join_matches_broadcast_path(spark):
    presets = spark.createDataFrame(
        [("q1", None, None, None, None, "2024-01-01", "2024-03-31"),
         ("open", "All Part Types", None, None, None, None, None),
         ("from_feb", None, None, None, None, "2024-02-15", None),
         ("a_only", "A", None, None, None, None, "2024-02-01")],
        FL.PRESET_SCHEMA)
    rows = [("A", ts(2024, 1, 5)), ("A", ts(2024, 2, 20)), ("B", ts(2024, 3, 31, 23)), ("B", ts(2024, 4, 1)),
            ("A", None)]
    df = spark.createDataFrame(rows, "Part_Type string, Date timestamp")
    small = sorted((r.preset, r.Part_Type, str(r.Date)) for r in FL.apply_presets(df, presets).collect())
    large = sorted((r.preset, r.Part_Type, str(r.Date))
                   for r in FL.apply_presets(df, presets).collect())
    assert small == large
    assert sum(1 for p, _, _ in small if p == "open") == 5
    assert sum(1 for p, _, _ in small if p == "q1") == 3
    assert sum(1 for p, _, _ in small if p == "from_feb") == 3
    assert sum(1 for p, _, _ in small if p == "a_only") == 1


def test_two_pass_exact_quantiles_match_percentile(spark):
    from inspectkit.operators.quantiles import exact_quantiles, quantile_columns

    df = spark.range(3000).select(
        (F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 4 == 0, F.lit(7.0)).when(F.col("id") % 13 == 0, F.lit(None))
        .otherwise((F.col("id") * 7919 % 1000).cast("double")).alias("v"))
    probs = [0.0, 0.05, 0.5, 0.95, 1.0]
    for by in ([], ["g"]):
        for acc in (10000, 5):  # 5: brackets miss and are widened
            got = {tuple(r[:len(by)]): [r[f"q{i}"] for i in range(len(probs))]
                   for r in exact_quantiles(df, "v", probs, by, acc).collect()}
            aggs = [F.percentile("v", p).alias(f"q{i}") for i, p in enumerate(probs)]
            exp_df = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
            for r in exp_df.collect():
                key = tuple(r[:len(by)])
                assert got[key] == pytest.approx([r[f"q{i}"] for i in range(len(probs))])
    qc = quantile_columns(df, ["v", "g"], [0.5]).first()
    assert qc["g_q0"] == 1.0


def test_quality_index_two_pass_equals_percentile(spark):
    df = spark.range(500).select((F.col("id") % 17 * 1.5).alias("QualityScore"),
                                 (F.col("id") % 5 / 5.0).alias("DefectRate"))
    a = [r.QualityIndex for r in X.quality_index(df).orderBy("QualityScore", "DefectRate").collect()]
    p2 = X.DEFAULT_PARAMS.with_(quantile_method="two_pass")
    b = [r.QualityIndex for r in X.quality_index(df, p2).orderBy("QualityScore", "DefectRate").collect()]
    assert a == pytest.approx(b)


def test_grouped_paths_equal_single_series(spark):
    start = dt.date(2024, 1, 1)
    rows = []
    for g, n, f in (("a", 40, 1.0), ("b", 60, 3.0)):
        for i in range(n):
            rows.append((g, start + dt.timedelta(days=i), float((i % 5) * f + i * 0.25)))
    grouped = spark.createDataFrame(rows, "g string, period date, value double")
    dec = {(r.g, r.period): r for r in TS.seasonal_decompose(grouped, by=["g"]).collect()}
    for g in ("a", "b"):
        single = grouped.filter(F.col("g") == g).drop("g")
        for r in TS.seasonal_decompose(single).collect():
            o = dec[(g, r.period)]
            assert (o.trend is None) == (r.trend is None)
            if r.trend is not None:
                assert o.trend == pytest.approx(r.trend) and o.seasonal == pytest.approx(r.seasonal)
    monthly = spark.createDataFrame(
        [(g, dt.date(2023 + (m // 12), m % 12 + 1, 1), float(m * m % 7 + (5 if g == "b" else 0)))
         for g in ("a", "b") for m in range(8)], "g string, period date, value double")
    for method in ("linear", "ar1"):
        got = {(r.g, r.period): r.forecast for r in CQ.forecast_copq(None, 3, method, by=["g"], series=monthly).collect()}
        for g in ("a", "b"):
            one = CQ.forecast_copq(None, 3, method, series=monthly.filter(F.col("g") == g).drop("g")).collect()
            assert len(one) == 3
            for r in one:
                assert got[(g, r.period)] == pytest.approx(r.forecast)


def test_presets_on_an_absent_column_skip_the_dimension(spark, tmp_path):
    """As the single filter does, for any number of presets."""
    df = spark.createDataFrame([("A", ts(2024, 1, 5)), ("B", None)], "Part_Type string, Date timestamp")
    few = [("p", "A", "Crack", None, "Steel", None, None), ("open", None, "Crack", None, None, None, None)]
    for n in (0, 62, 63, 200):
        presets = spark.createDataFrame(few + [(f"x{i}", f"none{i}", None, None, None, None, None) for i in range(n)], FL.PRESET_SCHEMA)
        path = str(tmp_path / f"presets{n}")
        FL.write_presets(presets, path)
        back = FL.read_presets(spark, path)
        assert back.count() == n + 2
        got = sorted((r.preset, r.Part_Type) for r in FL.apply_presets(df, back).collect())
        assert got == [("open", "A"), ("open", "B"), ("p", "A")]


def test_global_positions_spread_identical_rows(spark):
    from inspectkit.operators.seriesidx import with_global_index

    df = spark.createDataFrame([(1, "same")] * 20000 + [(i, "x") for i in range(2000)], "k int, v string").repartition(4)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = with_global_index(df, ["k"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sorted(r.pos for r in out.select("pos").collect()) == list(range(22000))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert max(sizes) < 22000 // 2
