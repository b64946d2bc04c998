"""Ranked lexical search (12) against brute force."""

import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from inspectkit.llm import arrays as A
from inspectkit.llm import search

from . import data

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_all, l_all = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, c in counts:
            m = 50 + (50 * sum(c.values()) * n_all) // l_all
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, -math.inf if d is None else d, d))
        found.sort()
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:k])]
    return sorted(out, key=repr)


def got(spark, docs, items, k, shard_bytes):
    d = spark.createDataFrame([(i, t, "en", 1, 2, "x") for i, t in docs], "doc_id long, text string, ver string, sh int, term int, kind string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, floor int")
    found = search.search(d, q, k, shard_bytes)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()), key=repr)


@pytest.mark.parametrize("seed,k,shard_bytes", [(1, 5, 1 << 20), (2, 3, 900), (3, 7, 90)])
def test_equals_brute_force(spark, monkeypatch, seed, k, shard_bytes):
    monkeypatch.setattr(search, "FAN", 4)  # several rounds
    docs = data.small_corpus(seed, n=120, words=12)
    items = data.small_corpus(seed + 50, n=9, words=14, longest=9)
    assert got(spark, docs, items, k, shard_bytes) == brute(docs, items, k)


def test_edge_rows(spark):
    docs = data.pairs(data.documents(spark))
    items = [(1, "THE of x1 Bar12"), (1, "in is"), (1, "in is"), (2, None), (None, "foo3 was5 the11"), (3, ""), (4, "für9 für11 èau3 ..."), (5, "one two ONE"), (6, docs[0][1])]
    assert got(spark, docs, items, 4, 1 << 20) == brute(docs, items, 4)


def test_text_beyond_a_slice(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(60))) for i in range(30)]
    docs.append((77, " ".join(f"w{rng.randrange(50)}" for _ in range(1_500_000))))
    items = [(1, "w1 w2 w3 w4 w5 w6"), (2, "w7")]
    assert got(spark, docs, items, 10, search.SHARD_BYTES) == brute(docs, items, 10)


def test_empty(spark):
    items = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert search.search(data.empty(spark), items).collect() == []
    assert search.search(data.documents(spark), items.limit(0)).collect() == []


def _shard(seed=0, n=900):
    """A shard of two terms that rarely meet and one rare term."""
    rng = np.random.default_rng(seed)
    row, term, tf = [], [], []
    for i in range(n):
        here = {1: 1 + int(rng.integers(9))} if i % 2 else {2: 1 + int(rng.integers(9))}
        if i % 90 == 0:
            here[3] = 5
        for t, c in here.items():
            row.append(i), term.append(t), tf.append(c)
    packet = {"doc": np.arange(n), "size": np.full(n, 20), "row": np.array(row, np.int32), "term": np.array(term, np.uint64), "tf": np.array(tf)}
    packet = {k: np.ascontiguousarray(v.astype(np.int64) if k in ("doc", "size", "tf") else v).tobytes() for k, v in packet.items()}
    frequent = [(1, 700), (2, 690)]
    return search.Shard(search.build_shard([packet], n, 20 * n, frequent), [t for t, _ in frequent])


def test_pair_bounds_are_bounds_and_tighter():
    shard = _shard()
    terms_, weights = np.array([1, 2, 3], np.uint64), np.array([700, 690, 4000])
    units, bound, at, w = shard.units_of(terms_, weights)
    assert (0, 1) in units
    single = np.zeros(shard.blocks, np.int64)
    exact = np.zeros(len(shard.doc), np.int64)
    for i in range(3):
        a, b = shard.starts[at[i]], shard.starts[at[i] + 1]
        impact = w[i] * shard.units[a:b].astype(np.int64)
        exact[shard.docs[a:b]] += impact
        top = np.zeros(shard.blocks, np.int64)
        np.maximum.at(top, shard.docs[a:b] // search.BLOCK, impact)
        single += top
    assert (bound.sum(axis=0) < single).all()
    padded = np.zeros(shard.blocks * search.BLOCK, np.int64)
    padded[: len(exact)] = exact
    assert (bound.sum(axis=0) >= padded.reshape(-1, search.BLOCK).max(axis=1)).all()
    ids, scores = shard.search(terms_, weights, 0, 20)
    want = np.lexsort((np.arange(len(exact)), -exact))[:20]
    assert ids.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
    floor = int(scores[4])
    assert shard.search(terms_, weights, floor, 20)[1].tolist() == [s for s in scores.tolist() if s >= floor]


def test_joint_maxima():
    a, b = np.zeros(128, np.int64), np.zeros(128, np.int64)
    a[[3, 70]], b[[4, 70]] = 5, 7
    blocks, best = search.joint_maxima(a, b)
    assert blocks.tolist() == [1] and best.tolist() == [12]


def test_term_bytes():
    raw = np.frombuffer("Ab1 c—d\x7fé´x_Y".encode(), np.uint8)
    starts, ends, _, _ = A.words(raw, np.array([0, len(raw)]), lower=True, apart=search.APART)
    assert [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)] == TERM.findall("Ab1 c—d\x7fé´x_Y")
