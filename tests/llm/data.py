"""Small tables for the corpus operators: the cases every operator defines."""

from __future__ import annotations

import random

WORDS = "the of and to in is was für èau rem foo Bar BAZ x1 q".split()


def documents(spark, rows=None):
    """Nulls, empty and long texts, repeated rows, ids that are shared or null,
    ties, and extra columns whose names clash with the operators' own."""
    if rows is None:
        rng = random.Random(5)
        base = " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(120))
        other = " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(90))
        rows = [
            (1, base), (2, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "one two"), (9, "One Two"),
            (10, other + " " + base[: len(base) // 2]), (10, "same id, other text " + other), (None, base), (None, None), (None, "free"),
            (11, (base + " ") * 40), (12, "é" * 700), (13, "é́\U0001f600 \x00 \x1c ok"), (14, "word " * 900), (15, "a" * 5000),
        ]
    data = [(i, t, "en", "src", len(t or ""), "ver", 1, 2, "k", 3, 4, "m") for i, t in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, ver string, dest int, n int, key string, node int, grp int, kept string")


def empty(spark, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([], schema)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def small_corpus(seed, n=60, words=6, longest=40):
    """Texts over a tiny vocabulary, so that repeats of all kinds occur."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    out = []
    for i in range(n):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(longest))]
        if out and rng.random() < 0.4:
            old = rng.choice(out)[1].split()
            t = old[: rng.randrange(len(old) + 1)] + t[: rng.randrange(5)] + old[rng.randrange(len(old) + 1):]
        out.append((i if rng.random() < 0.95 else rng.randrange(n), "  ".join(t)))
    return out
