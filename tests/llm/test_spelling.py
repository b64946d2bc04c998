"""Spelling variant grouping (11) against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from inspectkit.llm import spelling

from . import data

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_counts(rows, damage, least):
    total = Counter()
    for d, t in rows:
        for w in RUN.findall(t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                total[w] += 1
    return total


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_groups(count):
    near = {w: [x for x in count if abs(len(w) - len(x)) < 2 and distance(w, x) == 1] for w in count}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 2 * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


def similar_words(seed, n, letters="abeioü"):
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(4, 8)))
        out[w] = rng.choice([3, 4, 7, 9, 20, 41, 90])
    return out


@pytest.mark.parametrize("subtrie", [20_000, 60, 3])
def test_groups(spark, monkeypatch, subtrie):
    """Few levels, more levels, and classes cut into parts."""
    monkeypatch.setattr(spelling, "SUBTRIE", subtrie)
    words = similar_words(subtrie, 160) | {"a" * 70: 5, "a" * 71: 12, "a" * 70 + "b": 3, "x" + "a" * 69: 8, "ab": 4, "": 3, "éàü": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert got(spelling.group_variants(df)) == brute_groups(words)


@pytest.mark.parametrize("damage", [0, 2, 5])
def test_documents(spark, damage, tmp_path):
    rng = random.Random(damage)
    words = list(similar_words(1, 60, "AbeÉüñ"))
    rows = [(i if i % 9 else None, " ".join(rng.choice(words) for _ in range(40)) + "_x1-Zé×÷") for i in range(40)]
    rows += data.pairs(data.documents(spark))
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n long, word string").repartition(3)
    count = brute_counts(rows, damage, 5)
    assert Counter(dict(map(tuple, spelling.count_words(df, damage).collect()))) == count
    count = {w: n for w, n in count.items() if n >= 3}
    assert got(spelling.variants(df, damage)) == brute_groups(count)


def test_query(spark, tmp_path):
    rows = [(i, "colour colours color " * (1 + i % 3) + f"Colour{'abcdefgh'[i % 8]} theatre theater") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    count = {w: n for w, n in brute_counts(rows, 97, 5).items() if n >= 3}
    assert got(spelling.query(spark, str(tmp_path))) == brute_groups(count)


def test_long_text_and_hot_word(spark):
    """A text beyond a slice of the other operators; a word in every row."""
    rows = [(1, "lengthy " * 700_000 + "lenghty lenghty lenghty")] + [(i, "frequent word frequen") for i in range(2, 2000)]
    count = {w: n for w, n in brute_counts(rows, 97, 5).items() if n >= 3}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(spelling.variants(df)) == brute_groups(count)


def test_empty(spark):
    assert spelling.variants(data.empty(spark)).collect() == []


def test_chain_of_forms(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "zzzzz": 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r.word: r.root for r in spelling.group_variants(df).collect()}
    assert found == {w: "bbbbb" if w != "zzzzz" else w for w in words}


def test_trie_search_reaches_exactly_the_budget():
    words = list(similar_words(9, 120))
    trie, v = spelling.Trie(words, np.ones(len(words), np.int64)), spelling.vectors(words)
    tv = spelling.vectors(trie.words)
    found = {(int(r), int(a)) for row, leaf in trie.leaves(v) for r, l in zip(row, leaf) for a in range(trie.first[l], trie.first[l + 1])}
    diff = tv[None, :, :] - v[:, None, :]
    want = (np.maximum(diff, 0).sum(axis=2) <= 1) & (np.maximum(-diff, 0).sum(axis=2) <= 1)
    assert found == set(zip(*(x.tolist() for x in np.nonzero(want))))
