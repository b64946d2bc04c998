"""Toxicity (3) and quality (6): held-out accuracy and defined cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectkit.llm import corpus as C
from inspectkit.llm import quality, toxicity

from . import data

SF = "/root/testdata/sf0.1"


def test_fold():
    assert toxicity.fold("1d10t ѕcum TR4SH 2024 $tupid ａb") == "idiot scum trash 2o2a stupid ab"


def test_matching():
    lexicon = toxicity.Lexicon({"bad": 2.0, "worse": 3.0, "stem*": 1.0}, frozenset({"not bad"}), -1.0, (1.0, 0.5))
    m = toxicity.Matcher(lexicon)
    assert m.matches("A BAD badge, b4d! stemming worse") == (6, 4, 8.0)
    assert m.matches("this is not bad at all")[1:] == (0, 0.0)
    assert m.matches("") == (0, 0, 0.0)
    assert m.score(6, 8.0) > m.score(600, 8.0) > m.score(600, 0.0)


def test_held_out_accuracy(spark):
    labels = C.load(spark, SF, "labels")
    got = toxicity.query(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() / got.predicted.sum() > 0.9 and hit.sum() / got.toxic.sum() > 0.8
    assert got.score.between(0, 1).all()


def test_toxicity_edge_rows(spark):
    df = data.documents(spark)
    labels = spark.createDataFrame([(1, None, 0), (3, 1, 1), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(df, labels, min_weight=0.1, min_z=0.1)
    rows = toxicity.score(df, lexicon).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.fit(df, labels.limit(0))
    assert none.weights == {} and {r.score for r in toxicity.score(df, none).collect()} == {0.5}
    assert toxicity.score(data.empty(spark), lexicon).collect() == []


def test_quality_held_out(spark):
    docs, labels = C.load(spark, SF, "documents"), C.load(spark, SF, "labels")
    model = quality.fit(docs, labels.where(~toxicity.held_out()))
    got = quality.resample(docs, model).join(labels.where(toxicity.held_out()), "doc_id").toPandas()
    assert got[got.quality == 1].selected.mean() > 0.98
    assert got[got.quality == 0].selected.mean() < 0.3


def test_quality_model_by_hand(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    buckets = 64
    model = quality.fit(df, labels, buckets)
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for text, is_target in (("a b", True), ("a c c", False)):
        b = np.frombuffer(text.encode(), np.uint8)
        at, _ = quality.buckets_of(b, np.array([0, len(b)]), buckets)
        raw += np.bincount(at, minlength=buckets)
        target += is_target * np.bincount(at, minlength=buckets)
    assert raw.sum() == 8 and target.sum() == 3  # tokens and neighbouring pairs
    prior = (raw + 1) / (raw.sum() + buckets)
    want = np.log((target + prior * buckets) / (3 + buckets)) - np.log((raw + prior * buckets) / (8 + buckets))
    assert np.allclose(model.ratio, want)
    rows = {r.doc_id: r for r in quality.resample(df, model, k=2).collect()}
    assert rows[3].n_grams == 0 and rows[3].log_weight == 0 and sum(r.selected for r in rows.values()) == 2


def test_quality_edge_rows(spark):
    df = data.documents(spark)
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (9, None)], "doc_id long, quality int")
    rows = quality.resample(df, quality.fit(df, labels)).collect()
    assert len(rows) == df.count()
    none = quality.fit(df, labels.limit(0))
    assert not none.ratio.any()
    assert quality.resample(data.empty(spark), none).collect() == []


@pytest.mark.parametrize("k", [1, 5, 500, 999, 1000, 5000])
def test_kth_largest(spark, k, monkeypatch):
    monkeypatch.setattr(quality, "FEW", 20)
    monkeypatch.setattr(quality, "BINS", 7)
    values = [float(v) for v in np.random.default_rng(1).normal(size=990)] + [0.25] * 10
    df = spark.createDataFrame([(v,) for v in values], "key double")
    assert quality.kth_largest(df, "key", k) == sorted(values, reverse=True)[min(k, 1000) - 1]


def test_ties_are_all_taken(spark):
    rows = spark.range(1000).select(F.lit(1.5).alias("key"))
    assert quality.kth_largest(rows.union(rows).union(rows).union(rows).union(rows).union(rows), "key", 10) == 1.5


def test_sample_of_labelled_rows_is_bounded(spark):
    """Rows of a hot labelled id count one for each text, and are bounded too."""
    rows = [(1, f"text {i % 30}") for i in range(300)] + [(2, "other"), (3, "not labelled")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    chosen = spark.createDataFrame([(1, True), (1, True), (2, False)], "doc_id long, label boolean")
    assert C.labelled(docs, chosen, 10).count() == 10
    every = [tuple(r) for r in C.labelled(docs, chosen, 1000).collect()]
    assert sorted(every) == sorted([(f"text {i}", True) for i in range(30)] + [("other", False)])


def test_texts_without_n_grams_among_mostly_bad_labels(spark):
    """The labelled shares say nothing about a text that has no n-grams."""
    rows = [(i, f"clean words about rivers and hills number {i} " * 5) for i in range(4)]
    rows += [(i, f"buy now !!! $$$ cheap {i} " * 9) for i in range(4, 40)] + [(40, None), (41, ""), (42, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(40)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.prior < -1
    kept = {r.doc_id for r in quality.resample(docs, model).where("selected").collect()}
    assert kept == {0, 1, 2, 3, 40, 41, 42}


def naive(lexicon, text):
    """(matches, weight), word by word: the best entry that a word equals or begins with,
    unless the word and a neighbour are an exception."""
    s = toxicity.fold(text)
    spans = [(m.start(), m.group()) for m in re.finditer(r"[^\W_]+", s)]
    words, n, total = [w for _, w in spans], 0, 0.0
    for i, w in enumerate(words):
        entries = [v for t, v in lexicon.weights.items() if t == w or t.endswith("*") and w.startswith(t[:-1])]
        pairs = [" ".join(words[max(i - 1, 0) : i + 1]) if i else "", " ".join(words[i : i + 2])]
        if entries and max(entries) > 0 and not any(p in lexicon.exceptions for p in pairs if " " in p):
            n, total = n + 1, total + max(entries)
    return n, total


def test_matcher_equals_a_naive_one():
    rng = random.Random(6)
    parts = ["bad", "scum", "ug", "ly", "0k", "b4d", "$cum", "fine", "é", "сat"]
    vocabulary = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(30)]
    for _ in range(40):
        terms = {toxicity.fold(w) for w in rng.sample(vocabulary, 8)}
        weights = {t: rng.choice([2.0, 2.5, 3.0]) for t in terms if re.fullmatch(r"[^\W_]+", t)} | {f"{toxicity.fold(w)[:4]}*": 2.2 for w in rng.sample(vocabulary, 4) if len(w) >= 5}
        weights = {t: v for t, v in weights.items() if re.fullmatch(r"[^\W_]+\*?", t)}
        folded = [w for x in vocabulary for w in re.findall(r"[^\W_]+", toxicity.fold(x))]
        exceptions = frozenset(f"{rng.choice(folded)} {rng.choice(folded)}" for _ in range(60))
        lexicon = toxicity.Lexicon(weights, exceptions, 0.0, (1.0, 1.0))
        matcher = toxicity.Matcher(lexicon)
        for _ in range(20):
            gap = rng.choice([" ", "  ", ", ", " " * 200, "-_-"])
            text = gap.join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))
            _, n, total = matcher.matches(text)
            assert (n, pytest.approx(total)) == naive(lexicon, text), text


def test_gumbel_draws_differ_near_the_cut_and_follow_the_weights(spark):
    """Two seeds select different documents; inclusion follows the weights."""
    docs = spark.createDataFrame([(i, ("good " if i % 3 else "bad ") * (1 + i % 4) + f"x{i}") for i in range(400)], "doc_id long, text string")
    ratio = np.zeros(quality.BUCKETS)
    for word, value in (("good", 0.8), ("bad", -0.8)):
        raw = np.frombuffer(word.encode(), np.uint8)
        ratio[quality.buckets_of(raw, np.array([0, len(raw)]), quality.BUCKETS)[0]] = value
    model = quality.Model(ratio, 0.0)
    drawn = {}
    for seed in range(12):
        rows = quality.resample(docs, model, temperature=1.0, k=100, seed=seed).collect()
        drawn[seed] = {r.doc_id for r in rows if r.selected}
        weight = {r.doc_id: r.log_weight for r in rows}
        assert len(drawn[seed]) == 100
        kept = {r.doc_id for r in quality.sample(docs, model, temperature=1.0, k=100, seed=seed).collect()} if seed < 2 else drawn[seed]
        assert kept == drawn[seed]
    assert drawn[0] != drawn[1]
    times = {d: sum(d in s for s in drawn.values()) for d in weight}
    groups = {}
    for d, w in weight.items():
        groups.setdefault(round(w, 1), []).append(times[d])
    means = [np.mean(groups[w]) for w in sorted(groups) if len(groups[w]) >= 20]
    assert len(means) > 3 and all(b > a - 0.2 for a, b in zip(means, means[1:])) and means[-1] > means[0] + 5
