"""Exact quantiles from KLL sketches and counting passes; the index over written columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectkit.operators import qindex as X
from inspectkit.operators import quantiles as Q

PROBS = [0.0, 0.05, 0.5, 0.731, 0.95, 1.0]


def _columns(n=9000):
    rng = np.random.default_rng(4)
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n))  # a value held by 40 % of the rows
    return {"smooth": rng.normal(size=n) * 1e3, "hot": hot, "few": rng.integers(0, 3, n).astype(float), "one": np.full(n, 2.5)}


@pytest.mark.parametrize("k,held", [(Q.K, Q.HELD), (64, 200), (16, 20), (8, 5)])
def test_columns_equal_numpy(spark, monkeypatch, k, held):
    """One round, several rounds, and brackets that miss."""
    monkeypatch.setattr(Q, "HELD", held)
    cols = _columns()
    rows = [tuple(map(float, r)) for r in zip(*cols.values())] + [(None,) * 4, (float("nan"),) * 4]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = Q.column_quantiles(df, list(cols), PROBS, k)
    for c, v in cols.items():
        assert got[c] == pytest.approx(np.quantile(v, PROBS).tolist()), c


def test_missed_brackets_are_counted_again(spark, monkeypatch):
    monkeypatch.setattr(Q, "rank_error", lambda k: 1e-5)  # a sketch that promises too much
    cols = _columns(5000)
    df = spark.createDataFrame([(float(x),) for x in cols["smooth"]], "v double").repartition(3)
    monkeypatch.setattr(Q, "HELD", 50)
    got = Q.column_quantiles(spark.createDataFrame(df.collect() * 30, "v double").repartition(3), ["v"], [0.3, 0.5], 8)
    assert got["v"] == pytest.approx(np.quantile(np.tile(cols["smooth"], 30), [0.3, 0.5]).tolist())


def test_no_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert Q.column_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [1.5]}
    assert Q.column_quantiles(df.limit(0), ["a", "b"], [0.5]) == {"a": [None], "b": [None]}


def test_index_is_counted_over_a_written_column(spark):
    """No predicate of the median's passes holds the index expression."""
    df = spark.range(400).select((F.col("id") % 17 * 1.5).alias("QualityScore"), (F.col("id") % 5 / 5.0).alias("DefectRate"))
    plan = X.histogram(X.written(X.quality_index(df).select(X.INDEX), "index"), X.INDEX, 4)._jdf.queryExecution().toString()
    assert "DefectRate" not in plan and "QualityScore" not in plan
    s = X.quality_index_stats(df).first()
    v = np.array([r[0] for r in X.quality_index(df).select(X.INDEX).collect()])
    assert (s.mean, s.median, s.min, s.max, s.n) == (pytest.approx(v.mean()), pytest.approx(np.median(v)), v.min(), v.max(), len(v))
    by = {r.g: r.median for r in X.quality_index_stats(df.withColumn("g", F.col("DefectRate") > 0.3), by=["g"]).collect()}
    assert set(by) == {True, False}
