"""Anomalies, classifier, streaming and sources."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from inspectkit import columns as C
from inspectkit.operators import classify as CL
from inspectkit.operators import forest as FR
from inspectkit.sources.files import quote_identifier, read_quality_csv
from inspectkit.streaming import jobs as S
from tests.conftest import SF001, ts


def test_anomalies_small_input_gives_no_flags(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(9)], "a double, b double")
    out = FR.detect_anomalies(df)
    assert out.filter("is_anomaly").count() == 0
    assert out.filter(F.col("anomaly_score").isNotNull()).count() == 0


def test_anomalies_flag_outlier_and_are_repeatable(spark):
    rows = [(float(i % 10), float((i * 7) % 10)) for i in range(400)] + [(500.0, -500.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    a = FR.detect_anomalies(df, n_trees=30, contamination=0.01)
    b = FR.detect_anomalies(df.repartition(5), n_trees=30, contamination=0.01)
    top = a.orderBy(F.col("anomaly_score").desc()).first()
    assert (top.a, top.b) == (500.0, -500.0) and top.is_anomaly
    sa = sorted((r.a, r.b, round(r.anomaly_score, 12)) for r in a.collect())
    sb = sorted((r.a, r.b, round(r.anomaly_score, 12)) for r in b.collect())
    assert sa == sb
    s = FR.anomaly_summary(a).first()
    assert s.rows == 401 and 1 <= s.anomalies <= 8


def test_anomalies_null_rows_not_flagged(spark):
    rows = [(float(i), float(i % 3)) for i in range(50)] + [(None, 1.0)]
    out = FR.detect_anomalies(spark.createDataFrame(rows, "a double, b double"), n_trees=10)
    r = out.filter(F.col("a").isNull()).first()
    assert r.anomaly_score is None and r.is_anomaly is False


def test_classifier_guards(spark):
    df = spark.createDataFrame([(1.0, "x")], "f double, t string")
    assert CL.train_defect_classifier(df, [], "t").error == "No feature columns selected"
    assert CL.train_defect_classifier(df, ["t"], "t").error == "Target column cannot also be a feature"
    assert CL.train_defect_classifier(df, ["nope"], "t").error == "Missing columns: nope"
    df2 = spark.createDataFrame([(1.0, None)], "f double, t string")
    assert CL.train_defect_classifier(df2, ["f"], "t").error == "Target column contains only missing values."


def test_stratified_split_exact_and_repeatable(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label string")
    tr, te = CL.stratified_split(df, "label", 0.3, 42)
    counts = {r.label: r["count"] for r in te.groupBy("label").count().collect()}
    assert counts == {"a": 60, "b": 30}
    assert tr.count() + te.count() == 300
    _, te2 = CL.stratified_split(df.repartition(7), "label", 0.3, 42)
    assert sorted(r.id for r in te.collect()) == sorted(r.id for r in te2.collect())


def test_classifier_trains_and_scores(spark):
    from inspectkit.params import DEFAULT_PARAMS
    from inspectkit.sources.tables import load_fact

    f = load_fact(spark, SF001)
    p = DEFAULT_PARAMS.with_(classifier_trees=10, classifier_max_depth=4)
    r = CL.train_defect_classifier(f, [C.PART_TYPE, C.QUALITY_SCORE, C.YIELD], C.DEFECT_SEVERITY, p)
    assert r.success and len(r.classes) == 5
    m = r.metrics.first()
    assert 0.0 <= m.accuracy <= 1.0 and m.test_rows > 0 and m.train_rows > m.test_rows
    imp = {x.feature: x.importance for x in r.importance.collect()}
    assert set(imp) == {C.PART_TYPE, C.QUALITY_SCORE, C.YIELD}
    assert abs(sum(imp.values()) - 1.0) < 1e-6
    scored = CL.score_defects(r.model, f)
    assert scored.filter(F.col("prediction").isNull()).count() == 0


def _write_batches(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "Date timestamp, CostImpact double, DefectRate double").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(folder, f"b{i}"))


def test_stream_daily_equals_batch(spark):
    from inspectkit.operators.timeseries import trend_by_period
    from inspectkit.plans.q_stream import events_stream
    from inspectkit.sources.tables import events_raw
    from inspectkit.operators.normalize import normalize

    got = S.run_to_table(spark, S.stream_daily(events_stream(spark, SF001)), "append", "t")
    batch = trend_by_period(normalize(events_raw(spark, SF001)), "D").collect()
    b = {r.period: r.value for r in batch}
    assert got.count() > 0
    for r in got.collect():
        assert float(r.Defects) == b[r.day]


def test_csv_latin1_fallback(spark):
    d = tempfile.mkdtemp(prefix="inspectkit-csv-")
    p = os.path.join(d, "data.csv")
    with open(p, "wb") as fh:
        fh.write("SupplierName,Cost_Impact_SGD\nCaf\xe9,1.5\n".encode("latin-1"))
    df = read_quality_csv(spark, p)
    assert df.first()["SupplierName"] == "Café"
    try:
        read_quality_csv(spark, os.path.join(d, "x.json"))
        raise AssertionError("expected ValueError")
    except ValueError:
        pass


def test_quote_identifier():
    assert quote_identifier('a"b') == '"a""b"'


def test_date_bounds(spark):
    from inspectkit.operators.filters import date_bounds

    df = spark.createDataFrame([(ts(2024, 1, 2),), (None,), (ts(2023, 5, 1),)], "Date timestamp")
    r = date_bounds(df).first()
    assert (r.min_date, r.max_date) == (dt.datetime(2023, 5, 1), dt.datetime(2024, 1, 2))


def test_stream_restart_on_same_checkpoint_adds_nothing(spark):
    from inspectkit.plans.q_stream import events_stream
    from inspectkit.session import scratch_path

    base = scratch_path(spark, "restart")
    for _ in range(2):  # second run: same checkpoint, no new files -> no new epochs
        q = S.write_epochs(S.stream_daily(events_stream(spark, SF001)), f"{base}/out", f"{base}/ckpt")
        q.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    assert out.count() == out.select("day").distinct().count() > 0


def test_flagged_share_with_identical_rows(spark):
    """A third of equal rows is drawn in its share: about the contamination is
    flagged, whatever the seed."""
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [tuple(map(float, v)) for v in rng.normal(size=(2100, 3))] + [(0.1, 0.2, 0.3)] * 900
    df = spark.createDataFrame(rows, "a double, b double, c double").coalesce(2).cache()
    for seed in range(5):
        s = FR.anomaly_summary(FR.detect_anomalies(df, n_trees=20, sample_rows=64, seed=seed)).first()
        assert abs(s.anomaly_pct - 10.0) < 1.0
    df.unpersist()


def test_forest_pool_draws_equal_rows_in_their_share(spark):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(700)] + [(-1.0, 5.0)] * 300, "a double, b double")
    nodes, psi, _ = FR.fit_isolation_forest(df, n_trees=10, sample_rows=50, seed=3)
    assert psi == 50 and nodes.select("tree_id").distinct().count() == 10


def test_session_keeps_the_launchers_settings(spark):
    from inspectkit.session import get_session

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "4000")
        assert get_session("local[2]", shuffle_partitions=8).conf.get("spark.sql.shuffle.partitions") == "4000"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_pca_scores_have_the_explained_variances(spark):
    """Against the eigenvalues of the correlation matrix."""
    import numpy as np

    from inspectkit.operators.multivariate import pca_projection

    x = np.random.default_rng(2).normal(size=(200, 4)) @ np.array([[1, 0.5, 0, 0], [0, 1, 0.3, 0], [0, 0, 1, 2], [0, 0, 0, 0.5]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    scores, ratio = pca_projection(df, 3)
    values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
    assert np.allclose([r.explained_ratio for r in ratio.orderBy("component").collect()], values[:3] / 4)
    got = np.array([tuple(r) for r in scores.collect()])
    assert np.allclose((got**2).sum(0) / 199, values[:3]) and np.allclose(got.T @ got, np.diag(np.diag(got.T @ got)), atol=1e-8)


def test_classifier_invariants(spark):
    """Split counts, importances that sum to one, a prediction for every row."""
    from inspectkit.params import DEFAULT_PARAMS

    rows = [(float(i % 7), "u" if i % 3 else "v", "yes" if (i % 7) > 3 else "no") for i in range(300)]
    df = spark.createDataFrame(rows, "f double, g string, t string")
    r = CL.train_defect_classifier(df, ["f", "g"], "t", DEFAULT_PARAMS.with_(classifier_trees=5))
    m = r.metrics.first()
    assert m.test_rows + m.train_rows == 300 and m.accuracy > 0.95 and r.classes == ["no", "yes"]
    assert abs(sum(x.importance for x in r.importance.collect()) - 1.0) < 1e-9
    scored = CL.score_defects(r.model, df)
    assert scored.count() == 300 and scored.where("prediction is null").isEmpty()
