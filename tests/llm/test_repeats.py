"""Substring dedup (8) and byte repeats (7) against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inspectkit.llm import arrays as A
from inspectkit.llm import substring, suffix

from . import data


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def key(row):
    return repr(row)


def brute_words(rows, window):
    docs = [(-1 if d is None else d, t or "") for d, t in rows]
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((None if d == -1 else d, len(w), len(gone), kept))
    return sorted(out, key=key)


def brute_bytes(rows, length):
    docs = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[i : i + length] for _, b in docs for i in range(len(b) - length + 1))
    out = []
    for d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return sorted(out, key=key)


def got_words(df, window):
    found = substring.per_row(substring.dedup_substrings(df, window)).select("doc_id", "n_words", "n_removed", "kept")
    return sorted(map(tuple, found.collect()), key=key)


def got_bytes(df, length, **kw):
    found = suffix.remove_repeats(df, length, **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return sorted(((*r[:4], bytes(r[4])) for r in found), key=key)


@pytest.mark.parametrize("seed,window", [(1, 5), (2, 7), (3, 12), (4, 20)])
def test_word_windows(spark, seed, window):
    rows = data.small_corpus(seed)
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_words(df, window) == brute_words(rows, window)


@pytest.mark.parametrize("seed,length", [(1, 9), (2, 24), (3, 61)])
def test_byte_strings(spark, seed, length):
    rows = data.small_corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_bytes(df, length) == brute_bytes(rows, length)
    assert got_bytes(df, length, piece=30) == brute_bytes(rows, length)  # long texts in pieces


def test_edge_rows(spark):
    df = data.documents(spark)
    rows = data.pairs(df)
    assert got_bytes(df, 200) == brute_bytes(rows, 200)
    assert got_words(df, 20) == brute_words(rows, 20)


def test_empty_tables(spark):
    assert suffix.remove_repeats(data.empty(spark)).collect() == []
    assert substring.dedup_substrings(data.empty(spark)).collect() == []


def test_hot_passage(spark):
    """A passage in a third of the rows costs an entry per slice."""
    hot = " ".join(f"h{k}" for k in range(30))
    rows = [(i, f"u{i} v{i} " + (hot if i % 3 == 0 else "") + f" x{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = substring.dedup_substrings(df).where("n_removed > 0")
    assert found.count() == 99 and found.agg(F.min("n_removed"), F.max("n_removed")).first() == (30, 30)


def test_covers_are_difference_covers():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_array_helpers():
    a = np.random.default_rng(0).integers(0, 9, 500).astype(np.uint64)
    for w in (1, 2, 7, 101):
        assert suffix.sliding_min(a, w).tolist() == [a[i : i + w].min() for i in range(len(a) - w + 1)]
        hashes, seen = A.windows(A.mix(a % np.uint64(3)), w), {}
        for i, h in enumerate(hashes.tolist()):
            assert seen.setdefault((a[i : i + w] % np.uint64(3)).tobytes(), h) == h
        assert len(set(hashes.tolist())) == len(seen)


def test_digests(spark, tmp_path):
    df = data.documents(spark).drop("ver", "dest", "n", "key", "node", "grp", "kept")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    rows = data.pairs(df)
    want = sorted(((d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in brute_words(rows, 20)), key=key)
    assert sorted(map(tuple, substring.query(spark, str(tmp_path)).collect()), key=key) == want
    want = sorted(((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in brute_bytes(rows, 200)), key=key)
    assert sorted(map(tuple, suffix.query(spark, str(tmp_path)).collect()), key=key) == want
