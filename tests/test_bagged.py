"""The classifier's forest grown over binned rows, and its votes."""

from __future__ import annotations

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectkit.operators import bagged as B
from inspectkit.operators import classify as CL
from inspectkit.params import DEFAULT_PARAMS

SMALL = DEFAULT_PARAMS.with_(classifier_trees=8, classifier_max_depth=4)
SCHEMA = "x double, kind string, small int, t string"


def _rows(n=600):
    rng = np.random.default_rng(5)
    kinds = ["red", "green", "blue", None]
    out = []
    for i in range(n):
        x, kind, small = float(rng.integers(0, 20)), kinds[rng.integers(0, 4)], int(rng.integers(0, 3))
        t = "high" if (kind == "red") != (x > 8) else "low" if small else "mid"
        out.append((x if i % 13 else None, kind, small, t if rng.random() < 0.9 else "odd"))
    return out


def _trees(r):
    return [t.toDebugString.split("\n", 1)[1] for t in r.model.stages[-2].trees]


def _train(spark, monkeypatch, most, params=SMALL, parts=4):
    monkeypatch.setattr(CL, "MOST_DRAWS", most)
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(parts)
    return CL.train_defect_classifier(df, ["x", "kind", "small"], "t", params)


@pytest.mark.parametrize("depth", [1, 5, 12])
def test_single_tree_is_the_tree_of_spark_ml(spark, monkeypatch, depth):
    """Without draws of rows and, for one tree, of slots: node for node, both forests are equal."""
    monkeypatch.setattr(CL, "RandomForestClassifier", partial(CL.RandomForestClassifier, bootstrap=False))
    one = SMALL.with_(classifier_trees=1, classifier_max_depth=depth, classifier_impute_strategy="median")
    kept, grown = (_train(spark, monkeypatch, most, one) for most in (2**24, 0))
    assert _trees(kept) == _trees(grown) and "If" in _trees(grown)[0]
    assert kept.metrics.collect() == grown.metrics.collect()
    want, got = ({i.feature: i.importance for i in r.importance.collect()} for r in (kept, grown))
    assert got == pytest.approx(want)


def test_many_draws_train_without_keeping_them(spark, monkeypatch):
    fits = []
    real = CL.RandomForestClassifier.fit
    monkeypatch.setattr(CL.RandomForestClassifier, "fit", lambda self, *a: fits.append(1) or real(self, *a))
    r = _train(spark, monkeypatch, 0)
    m = r.metrics.first()
    assert not fits and r.success and m.train_rows + m.test_rows == 600 and m.accuracy > 0.6
    assert len(r.model.stages[-2].trees) == 8 and sum(i.importance for i in r.importance.collect()) == pytest.approx(1.0)
    assert _train(spark, monkeypatch, 2**24).success and fits


def test_forest_is_the_same_for_other_partitions_passes_and_chunks(spark, monkeypatch):
    trees = _trees(_train(spark, monkeypatch, 0))
    assert len(set(trees)) == 8
    monkeypatch.setattr(B, "CELLS", 300)
    monkeypatch.setattr(B, "PART_CELLS", 50)
    assert _trees(_train(spark, monkeypatch, 0, parts=9)) == trees


@pytest.mark.parametrize("two", [False, True])
def test_votes_are_those_of_spark_ml(spark, monkeypatch, two):
    """Nulls, NaN and values not seen in training too; number for number.  With two classes
    Spark ML orders the categories of a slot by class."""
    rows = [(x, k, s, "high" if two and t != "low" else t) for x, k, s, t in _rows()]
    monkeypatch.setitem(globals(), "_rows", lambda n=600: rows[:n])
    new = spark.createDataFrame([*(r[:3] for r in _rows(200)), (None, None, None), (float("nan"), "mauve", 9), (1e300, "red", -5)], "x double, kind string, small int")
    for most in (2**24, 0):
        model = _train(spark, monkeypatch, most).model
        columns = ["rawPrediction", "probability", "prediction"]
        want, got = model.transform(new), CL.score_defects(model, new)
        assert got.select(columns).collect() == want.select(columns).collect()
        assert got.columns == [c for c in want.columns if not c.startswith("__")]


def test_bootstrap_weights():
    bits, table = B.mixed(np.arange(200_000), 42), B._poisson()
    w = [B.weights(bits, t, 42, table).astype(float) for t in range(4)]
    assert all(abs(x.mean() - 1) < 0.02 and abs(x.var() - 1) < 0.03 for x in w)
    assert np.abs(np.corrcoef(w) - np.eye(4)).max() < 0.02
    assert np.abs(np.corrcoef(w[0][1:], w[0][:-1])[0, 1]) < 0.02


def test_bounds_of_bins():
    assert B.bounds_of(np.array([1.0, 3.0, np.nan, 3.0, 7.0])) == (2.0, 5.0)
    assert B.bounds_of(np.full(5, 2.0)) == () and B.bounds_of(np.array([np.nan])) == ()
    many = B.bounds_of(np.arange(100_000.0))
    assert len(many) == 31 and np.allclose(np.diff(many), 3125, atol=2)
    assert B.bounds_of(np.array([1.0, np.inf])) == (1.0,)


def test_many_slots_and_a_tree_without_a_split(spark, monkeypatch):
    monkeypatch.setattr(CL, "MOST_DRAWS", 0)
    df = spark.range(400).select(F.concat(F.lit("v"), F.col("id") % 60).alias("g"), F.lit(1.0).alias("same"),
                                 F.when(F.col("id") % 60 < 20, "a").otherwise("b").alias("t"))
    r = CL.train_defect_classifier(df, ["g", "same"], "t", SMALL)
    assert r.model.stages[-2].numFeatures > 40 and r.metrics.first().accuracy > 0.5
    r = CL.train_defect_classifier(df, ["same"], "t", SMALL)
    assert r.model.stages[-2].totalNumNodes == 8
    assert {x.prediction for x in CL.score_defects(r.model, df).select("prediction").collect()} == {"b"}
