"""N-gram Jaccard join (5) against brute force."""

import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inspectkit.llm import arrays as A
from inspectkit.llm import corpus as C
from inspectkit.llm import graph, jaccard

from . import data


def brute(rows, k=3, num=90, den=100):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((-1 if d is None else d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and len(a & b) * den >= num * len(a | b):
                x, y = label[i], label[j]
                label = [y if v == x else v for v in label]
    least = {}
    for (d, s), v in zip(sets, label):
        least[v] = min(least.get(v, d), d)
    back = lambda d: None if d == -1 else d
    return sorted(((back(d), len(s), back(least[v] if s else d)) for (d, s), v in zip(sets, label)), key=repr)


def got(df, *args, **kw):
    return sorted(map(tuple, jaccard.components(df, *args, **kw).collect()), key=repr)


@pytest.mark.parametrize("seed,k,num", [(1, 3, 90), (2, 2, 70), (3, 1, 50)])
def test_components(spark, seed, k, num):
    rows = data.small_corpus(seed, n=120, words=25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, k, num) == brute(rows, k, num)


def test_groups_in_blocks(spark):
    """Groups cut into blocks give the same components."""
    rows = data.small_corpus(4, n=150, words=12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, 1, 60, block_nodes=4) == brute(rows, 1, 60)
    assert got(df, 1, 60, block_members=20) == brute(rows, 1, 60)


def test_searches_pass_by_a_block():
    """Across blocks, each batch of searches is answered before the next is read."""
    rng = np.random.default_rng(11)
    sets = [np.sort(rng.integers(0, 1 << 60, 40).astype(np.uint64)) for _ in range(20)]
    read = []

    def batches():
        for query, start in [(0, 0), (1, 100), (1, 200), (1, 300)]:
            read.append(start)
            rows = [{"grp": 1, "blk": 0, "query": query, "comp": start + i, "members": s.tobytes()} for i, s in enumerate(sets)]
            yield pa.RecordBatch.from_pylist(rows)

    for k, out in enumerate(jaccard._across(80, 100)(batches())):
        assert len(read) == k + 2
        assert out.to_pylist() == [{"u": 100 * (k + 1) + i, "v": i} for i in range(20)]
    assert k == 2


def test_searches_go_where_a_key_is_shared(spark):
    keys = spark.createDataFrame([(1, 0, 10, 7), (1, 1, 11, 7), (1, 1, 12, 7), (1, 2, 13, 8), (2, 5, 14, 7)], "grp long, blk long, node long, key long")
    to = jaccard._routes(spark.createDataFrame([(1, 10), (1, 13)], "grp long, node long"), keys)
    assert sorted(map(tuple, to.collect())) == [(1, 0, 10), (1, 1, 10), (1, 2, 13)]


def test_rare_fine_parts_meet_all_links():
    """Sets that link have one of their rarest parts in common, in any order of the keys."""
    rng = np.random.default_rng(17)
    tried = 0
    while tried < 300:
        n, num = int(rng.integers(1, 120)), int(rng.choice([60, 80, 90]))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone, more = int(rng.integers(0, n // 6 + 2)), int(rng.integers(0, n // 6 + 2))
        y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
        same = len(np.intersect1d(x, y))
        if not len(y) or same * 100 < num * (len(x) + len(y) - same):
            continue
        tried += 1
        key, row, kind, kept = jaccard.fine_parts(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), num, 100)
        for salt in range(3):
            order = np.argsort((key * np.uint64(2 * salt + 3)) ^ np.uint64(salt))
            chosen = []
            for r in (0, 1):
                mine = set()
                for c in np.unique(kind[row == r]):
                    at = order[(row[order] == r) & (kind[order] == c)]
                    mine |= set(key[at[: kept[at[0]]]].tolist())
                chosen.append(mine)
            assert chosen[0] & chosen[1]


def test_only_shared_parts_are_stored(spark):
    """Of the rarest parts, those that one set alone has count and are not stored; the
    others are those that a count of all parts gives."""
    rng = np.random.default_rng(23)
    base = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    rows, entries = [], []
    for i in range(40):
        own = rng.integers(0, 1 << 63, int(rng.integers(0, 12))).astype(np.uint64)
        s = np.unique(np.concatenate([base[rng.random(len(base)) < 0.85], own]))
        grp, blk, node = i % 2, i % 5, int(rng.integers(-(1 << 62), 1 << 62))
        rows.append((grp, blk, node, bytearray(s.tobytes())))
        key, _, kind, kept = jaccard.fine_parts(s, np.array([0, len(s)]), 80, 100)
        key = A.mix(key ^ A.mix(np.full(len(key), grp, np.int64).view(np.uint64)))
        entries += [(grp, blk, node, int(c), int(k), int(n)) for c, k, n in zip(kind, key, kept)]
    times, of_set = Counter(e[4] for e in entries), {}
    for grp, blk, node, kind, key, kept in entries:
        of_set.setdefault((grp, blk, node, kind, kept), []).append((times[key], key))
    want = set()
    for (grp, blk, node, _, kept), keys in of_set.items():
        want |= {(grp, blk, node, int(np.uint64(key).view(np.int64))) for n, key in sorted(keys)[:kept] if n > 1}
    sets = spark.createDataFrame(rows, "grp long, blk long, node long, members binary").repartition(3)
    found = sorted(map(tuple, jaccard._rare_keys(sets, 4, 80, 100).collect()))
    assert found == sorted(want) and 0 < len(want) < len({e[2:5] for e in entries}) // 3


def test_lists_need_few_bytes_a_posting():
    """Building a block's lists takes 40 bytes a posting at most beside the sets (before: over 60)."""
    sets = [np.sort(np.random.default_rng(k).integers(0, 1 << 62, 4000).astype(np.uint64)) for k in range(100)]
    tracemalloc.start()
    jaccard.Lists(sets)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 40 * 400_000


def test_shared_boilerplate_sends_few_searches(spark, monkeypatch):
    """400 documents that share 80 % of their words, in 20 blocks: what all hold sends
    nobody anywhere (by any shared part it was 399 searchers x 20 blocks)."""
    sent, real = [], jaccard._routes

    def counted(*args):
        found = real(*args)
        sent.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_routes", counted)
    base = [f"b{k}" for k in range(160)]
    rng = np.random.default_rng(5)
    rows = []
    for d in range(400):
        own = [f"u{d}x{k}" for k in range(40)]
        at = sorted(rng.choice(200, 40, replace=False).tolist())
        words = base.copy()
        for k, w in zip(at, own):
            words.insert(min(k, len(words)), w)
        rows.append((d, " ".join(words)))
    rows += [(500 + d, rows[d][1] + " tail") for d in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df, 1, 90, block_nodes=20) == brute(rows, 1, 90)
    assert sent and max(sent) < 430 * 3


def _recorded(monkeypatch):
    """The rows of the tables that the operator writes, by their name."""
    rows, real = {}, C.saved

    def saved(df, name):
        out = real(df, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(C, "saved", saved)
    return rows


def test_shared_passages_join_no_groups(spark, monkeypatch):
    """Documents made of passages that many share, each with near copies: the passages join nobody
    (before, by equal rests of parts, all documents were one group, cut into blocks)."""
    rng = np.random.default_rng(29)
    passages = [[f"p{p}x{k}" for k in range(60)] for p in range(60)]
    rows = []
    for d in range(60):
        words = [w for p in rng.choice(60, 4, replace=False) for w in passages[p]] + [f"u{d}x{k}" for k in range(60)]
        rows.append((2 * d, " ".join(words)))
        words[int(rng.integers(0, len(words)))] = "changed"
        rows.append((2 * d + 1, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    written = _recorded(monkeypatch)
    assert got(df, 1, 80, block_nodes=20) == brute(rows, 1, 80)
    assert written["able"] == [120] and "rare-keys" not in written and "set-rows" not in written


def test_only_texts_of_able_sets_meet_the_join(spark, monkeypatch):
    """Of 300 texts, 298 cannot link: they meet no join (before: all did)."""
    rows = [(d, " ".join(f"u{d}x{k}" for k in range(20))) for d in range(298)]
    rows += [(300, " ".join(f"n{k}" for k in range(40))), (301, " ".join(f"n{k}" for k in range(41)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    met, real = [], jaccard._representatives

    def counted(ids, wanted, repeated):
        met.append(ids.count())
        return real(ids, wanted, repeated)

    monkeypatch.setattr(jaccard, "_representatives", counted)
    assert got(df, 2, 80) == brute(rows, 2, 80)
    assert len(met) == 1 and 2 <= met[0] < 20


def test_edge_rows(spark):
    df = data.documents(spark)
    assert got(df) == brute(data.pairs(df))
    assert got(df, 5, 80) == brute(data.pairs(df), 5, 80)


def test_rests_find_all_links():
    """Sets that link share a part's rest, whatever their sizes."""
    rng = np.random.default_rng(7)
    for _ in range(400):
        n = int(rng.integers(1, 90))
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        gone, more = int(rng.integers(0, n // 6 + 2)), int(rng.integers(0, n // 6 + 2))
        y = np.unique(np.concatenate([x[gone:], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
        same = len(np.intersect1d(x, y))
        if not len(y) or same * 100 < 80 * (len(x) + len(y) - same):
            continue
        key, row = jaccard.rests(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 80, 100)
        assert set(key[row == 0]) & set(key[row == 1])


def test_empty_table(spark):
    assert got(data.empty(spark)) == []


def test_group_components_by_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        change = rng.integers(0, 80, rng.integers(0, 9))
        s[change] = rng.integers(0, 1 << 60, len(change)).astype(np.uint64)
        sets.append(np.unique(s))
    label = jaccard.group_components(sets, 85, 100)
    want = list(range(60))
    for i in range(60):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if n * 100 >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = want[i], want[j]
                want = [b if v == a else v for v in want]
    assert len({(a, b) for a, b in zip(label.tolist(), want)}) == len(set(want)) == len(set(label.tolist()))


def test_size_classes_cover_links():
    for num, den in ((90, 100), (80, 100), (50, 100), (97, 100)):
        bounds, parts = jaccard.size_classes(num, den, 400)
        kind = lambda n: int(np.searchsorted(bounds, n, side="right")) - 1
        for x in range(1, 400):
            for y in range(x, min(400, x * den // num + 1)):
                if x * den >= num * y:
                    assert kind(y) - kind(x) in (0, 1)
                    most = max(x + y - 2 * n for n in range(x + 1) if n * den >= num * (x + y - n))
                    assert most < parts[kind(y)]


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 100), (7, 7)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {n for n, r in found.items() if r == 1} == set(range(1, 41)) and found[103] == found[101] == 100
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_representatives_of_a_hot_id(spark):
    """A node meets its own row only, once, though many rows have that id."""
    rows = [(None, 1, "a")] * 3 + [(None, v, f"t{v}") for v in range(2, 50)] + [(4, 9, "b")]
    ids = spark.createDataFrame([(-1 if d is None else d, v, t) for d, v, t in rows], "doc_id long, ver long, text string")
    wanted = spark.createDataFrame([(100, -1, 1, 3), (101, -1, 7, 1), (102, 4, 9, 1)], "node long, doc_id long, ver long, copies long")
    found = jaccard._representatives(ids, wanted, True).select("node", "text")
    assert sorted(map(tuple, found.collect())) == [(100, "a"), (101, "t7"), (102, "b")]
