"""Exact dedup (13) against brute force."""

import hashlib
import string
from collections import defaultdict

from pyspark.sql import functions as F

from inspectkit.llm import copies

from . import data

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    """Sorted (doc_id, keep_id, size, kept rows of the group's text)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    out = []
    for text, ids in groups.items():
        best = max((d for d in ids if d is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(digest, d, best, len(ids)) for d in ids]
    return sorted(out, key=repr), {hashlib.sha256(t.encode()).hexdigest() for t in groups}


def check(df, rows):
    found = copies.find_copies(df, {"h": F.sha2(copies.lowered(F.col("text")), 256)}).collect()
    want, texts = brute(rows)
    assert sorted(((r.h, r.doc_id, r.keep_id, r.group_size) for r in found), key=repr) == want
    kept = [r for r in found if r.kept]
    assert sorted(r.h for r in kept) == sorted(texts)  # one row of each group stays ...
    assert all(r.doc_id == r.keep_id for r in kept)  # ... with the largest id


def test_small_corpora(spark):
    for seed in (1, 2, 3):
        rows = data.small_corpus(seed, n=80, words=2, longest=4)
        check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_edge_rows(spark):
    df = data.documents(spark)
    check(df, data.pairs(df))


def test_refinement_levels(spark):
    """Same length, same prefix, same text: each level tells more apart."""
    head = "h" * copies.PREFIX
    rows = [(1, head + "a"), (2, head + "b"), (3, head + "A"), (4, "x" * len(head + "a")), (5, "short"), (6, "É"), (7, "é"), (8, "SHORT")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    open_ = copies._open(df, F.col("text")).where("__key is not null").select("doc_id").collect()
    assert {r.doc_id for r in open_} >= {1, 2, 3, 5, 8}


def test_hot_group_and_long_text(spark):
    long = "Long text " * 600_000  # beyond a slice of the other operators
    rows = [(i, "same" if i % 3 == 0 else f"own {i}") for i in range(3000)] + [(5000, long), (5001, long.upper()), (5002, long[:-1])]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows)


def test_deduplicate(spark):
    df = data.documents(spark)
    kept = copies.deduplicate(df)
    assert kept.columns == df.columns
    want, texts = brute(data.pairs(df))
    assert len(kept.collect()) == len(texts)
    best = {(h, b) for h, _, b, _ in want}
    assert {(hashlib.sha256((r.text or "").translate(LOWER).encode()).hexdigest(), r.doc_id) for r in kept.collect()} == best


def test_empty(spark):
    assert copies.find_copies(data.empty(spark)).collect() == []
    assert copies.deduplicate(data.empty(spark)).collect() == []
