"""Decontamination (2), sharding (4), top-k (9), WARC (10): brute force."""

import base64
import hashlib
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from inspectkit.llm import contamination, sharding, topk, warc
from inspectkit.session import scratch_path

from . import data


def edit_distance(p, t):
    """Least edit distance of p to a part of t."""
    before = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        now = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            now[j] = min(before[j - 1] + (p[i - 1] != t[j - 1]), before[j] + 1, now[j - 1] + 1)
        before = now
    return min(before)


def normal(t):
    raw = np.frombuffer(t.encode(), np.uint8)
    return contamination.normalised(raw, np.array([0, len(raw)]))[0].tobytes()


def test_normalised():
    assert normal("  A--B,c\n\nÉÀ ×x ") == "a b c éà ×x".encode()


def test_decontamination(spark):
    rng = random.Random(2)
    letters = "abcdefgh "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(40, 160)))) for i in range(25)] + [(90, "short"), (91, None), (None, "x" * 50)]
    rows = []
    for d in range(80):
        t = list("".join(rng.choice(letters) for _ in range(rng.randrange(200))))
        if d % 2:
            leak = list(items[rng.randrange(25)][1])
            for _ in range(rng.randrange(0, 1 + len(leak) // 7)):
                k = rng.randrange(len(leak))
                leak[k : k + rng.randrange(2)] = rng.choice(letters) * rng.randrange(2)
            t += leak
            if d % 4 == 1:
                t += "".join(rng.choice(letters) for _ in range(rng.randrange(100)))
        rows.append((d, "".join(t).upper() if d % 5 == 0 else "".join(t)))
    rows += [(1, rows[1][1]), (None, items[0][1]), (200, None), (201, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t in rows:
        for i, s in items:
            if i is None or s is None or len(normal(s)) < contamination.MIN_ITEM:
                continue
            p = normal(s)
            e = min(int(len(p) * contamination.BUDGET), (len(p) - contamination.Q) // contamination.Q)
            n = edit_distance(p, normal(t or ""))
            if n <= e:
                want.append((d, i, n))
    for block_bytes in (1 << 20, 700):
        got = contamination.find(docs, bench, block_bytes=block_bytes).collect()
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=repr) == sorted(want, key=repr)
    assert len({w[0] for w in want}) > 20
    texts = dict(rows)
    assert all(normal(texts[r.doc_id].encode()[r.start : r.stop].decode()) == normal(dict(items)[r.item_id]) for r in got if r.distance == 0)


def plain_normal(t):
    """Folding and separators, character by character."""
    out = []
    for c in t:
        kind = unicodedata.category(c)
        if c.isascii() and not c.isalnum() or kind[0] == "Z" or kind[0] == "P" and not c.isascii() or kind in ("Cc", "Cf"):
            out.append(" ")
            continue
        low = c.casefold() if ord(c) > 0xFF and len(c.casefold()) == 1 else c.lower()
        same = len(low) != 1 or len(low.encode()) > len(c.encode()) or c == "\xb5"
        out.append(c if same else low)
    return " ".join("".join(out).split())


def test_normalised_in_every_script():
    texts = ["ПРИВЕТ, мир!", "ΟΔΥΣΣΕΥΣ οδυσσευς", "a\u00a0b\u2003c\u200bd", "«цитата» — да…", "Ÿ ÿ ẞ ß K Å Ω µ", "ԱԲ աբ ა Ა", "中文，句子。", "😀 x😀", "é ÉÀÞ×÷", "\u00ad\u0085 tab\tx", "ȺȾ ⱥⱦ", "𐐀𐐨"]
    for t in texts:
        got = normal(t).decode()
        assert got == " ".join(got.split(" ")) and normal(got).decode() == got
        assert got.replace("Ⱥ", "ⱥ").replace("Ⱦ", "ⱦ") == plain_normal(t).replace("Ⱥ", "ⱥ").replace("Ⱦ", "ⱦ"), t
    assert normal("ПРИВЕТ МИР") == normal("привет\u00a0мир") and normal("ΣΟΦΟΣ") == normal("σοφος")
    raw = [t.encode() for t in texts]
    s, ends, source = contamination.normalised(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [s[a:b].tobytes() for a, b in zip(ends, ends[1:])] == [normal(t) for t in texts]  # many texts at once


def test_decontamination_of_short_and_recased_items(spark):
    items = [
        (1, "What is the capital of France?"), (2, "ПРИМЕР ДЛИННОГО ВОПРОСА НА РУССКОМ ЯЗЫКЕ"), (3, "Ποιος είναι ο βασιλιάς της Ισπανίας σήμερα"),
        (4, "ΑΒΓΔ εζ"), (5, "one two"), (6, "cat dogs!"),
    ]
    rows = [
        (1, "He asked: what is the\u00a0capital of FRANCE? Nobody knew."), (2, "x what is the capital of francex"), (3, "что " + items[1][1].lower() + " ."),
        (4, "— «Пример длинного\u2003вопроса на русском языке»"), (5, items[2][1].upper()), (6, "αβγδ ΕΖ και"), (7, "αβγδ ΕΖη"), (8, "hot cat dogs"), (9, "scat dogs, cat dogs"),
        (10, "what is the capitol of France?"), (11, "one two"),
    ]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in contamination.find(docs, bench).collect()}
    # below 8 bytes (5) nothing is searched; short items need their words whole
    assert set(got) == {(1, 1), (3, 2), (4, 2), (5, 3), (6, 4), (8, 6), (9, 6)}
    texts = dict(rows)
    assert texts[1].encode()[got[1, 1].start : got[1, 1].stop].decode() == "what is the\u00a0capital of FRANCE"
    assert texts[9].encode()[got[9, 6].start : got[9, 6].stop].decode() == "cat dogs" and got[9, 6].start == 11
    assert texts[4].encode()[got[4, 2].start : got[4, 2].stop].decode() == "Пример длинного\u2003вопроса на русском языке"


def test_decontamination_beyond_ascii(spark):
    """Brute force over Cyrillic, Greek, no-break spaces and signs, changed and recased."""
    rng = random.Random(8)
    letters = "абвгдежзАБВαβγδΣσς\u00a0\u2003 —é"
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(30, 90)))) for i in range(12)]
    rows = []
    for d in range(40):
        t = list("".join(rng.choice(letters) for _ in range(rng.randrange(80))))
        leak = list(items[rng.randrange(12)][1])
        for _ in range(rng.randrange(4)):
            leak[rng.randrange(len(leak))] = rng.choice(letters)
        t = "".join(t + leak)
        rows.append((d, t.upper() if d % 3 == 0 else t.lower() if d % 3 == 1 else t))
    want = []
    for d, t in rows:
        for i, s in items:
            p = normal(s)
            e = min(int(len(p) * contamination.BUDGET), (len(p) - contamination.Q) // contamination.Q)
            n = edit_distance(p, normal(t))
            if len(p) >= contamination.MIN_BUDGET and n <= e:
                want.append((d, i, n))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in contamination.find(docs, bench).collect())
    assert got == sorted(want) and len(want) > 15


def test_decontamination_edge_rows(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert contamination.find(data.documents(spark), bench).collect() == []
    assert contamination.find(data.empty(spark), bench).collect() == []
    assert contamination.find(data.documents(spark), bench.limit(0)).collect() == []


def test_sharding(spark):
    df = data.documents(spark, [(i, "x" * (i % 50)) for i in range(4000)] + [(None, None)] * 300 + [(7, "x" * 7)] * 900).repartition(7)
    rows = sharding.place(df, sharding.tree(16)).collect()
    assert len(rows) == 5200
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(16))
    for r in rows:
        text = b"" if r.doc_id is None else b"x" * (r.doc_id % 50)
        assert (r["size"], r.text_crc32) == (len(text) + 1, zlib.crc32(text))
    shard = Counter(r.shard for r in rows if r.doc_id is not None and r.doc_id != 7)
    assert max(shard.values()) < 1.4 * 4000 / 16
    assert sharding.place(data.empty(spark), sharding.tree(16)).collect() == []


def test_movement_stays_in_changed_subtrees(spark):
    keys = spark.range(5000)
    old = sharding.tree(16)
    heavy = tuple(sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in old)
    moved = keys.select(sharding.shard_of(keys["id"], old).alias("a"), sharding.shard_of(keys["id"], heavy).alias("b")).where("a <> b").collect()
    assert moved and all(r.b // 8 == 0 for r in moved)  # into the region of shard 5 only
    assert all(r.b // 4 == 1 for r in moved if r.a // 8 == 0)  # inside it, into its rack
    weights = Counter(r.b for r in keys.select(sharding.shard_of(keys["id"], heavy).alias("b")).collect())
    assert 2.2 < weights[5] / (5000 / 18) < 3.8


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "FAN", 3)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=24).astype(float).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(200)]  # ties
    rows += [(700, None), (701, [1.0, None] * 12), (702, [float("nan")] * 24), (703, [1.0, 2.0]), (800, [0.5, 2.0]), (None, rows[0][1]), (705, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(5)
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and None not in v and not np.isnan(np.array(v, float)).any()]
    want = []
    for q, x in good:
        if q % 20 == 0:
            near = sorted((-int(x @ y), c) for c, y in good if c != q and len(x) == len(y))[:10]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(near)]
    for block, shard_rows in ((1024, 16384), (7, 16384), (5, 40)):  # the last: 16 shards, four rounds
        got = topk.search(df, df["vec_id"] % 20 == 0, block=block, shard_rows=shard_rows)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(df.limit(0), df["vec_id"] % 20 == 0).collect() == []


@pytest.mark.parametrize("piece", ["128m", "3k"])
def test_warc(spark, piece):
    rng = random.Random(1)
    fake = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    bodies = ["", "x", "é" * 50, fake, fake * 3, warc.MAGIC, warc.MAGIC * 2, "a\r\n\r\n" + warc.MAGIC + "b", "\r\n\r\n" + fake, "q" * 5000, "z" * 3000 + fake + "y" * 3000, ("k" * 50 + warc.MAGIC) * 100]
    rows = [(i, f"http://e/{i}\r\nX: y" if i % 3 else None, rng.choice(bodies) + (f"#{rng.randrange(40)}" if rng.random() < 0.7 else "")) for i in range(60)]
    rows += [(500, "u", None), (None, "u", "only"), (None, "u", "x"), (501, "u", "dup"), (501, "u", "dup"), (502, "u", "dup")]
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        revisit = f is not None and i != f
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    path = scratch_path(spark, "warc")
    warc.write(df, path, file_records=30)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert sorted(map(tuple, warc.read(spark, path).collect()), key=repr) == sorted(want, key=repr)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_warc_empty_and_least_size(spark):
    path = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).collect() == []
    path = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), path, min_bytes=3)
    assert {r.record_type for r in warc.read(spark, path).collect()} == {"response"}
