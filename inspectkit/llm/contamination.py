"""Benchmark decontamination by the q-gram lemma.

Documents and benchmark items are compared as normalised UTF-8: letters
lowered in every script (those with a simple lower-case letter of their own), every run of
separators one space.  Separators are ASCII characters that are neither letters nor digits, and
characters of the Unicode classes separator, punctuation and control.  An item is found in a
document when some region of it is within the item's edit budget, ``budget``
of the item's length; an item below ``MIN_BUDGET`` bytes has a budget of 0 and is found only
between word boundaries.

Method.  An alignment with at most e edits keeps len - q + 1 - q * e of the
item's q-grams, all on diagonals at most e apart.  The q-grams that a slice of
documents shares with the benchmark are looked up by their bytes, counted per
item in bands of 2(e + 1) diagonals that overlap by half, and a band that
meets the bound becomes a region.  Regions are verified by an edit distance
computed in the band only.

Plan.  One map over the documents for each block of the benchmark.  A block
holds at most ``block_bytes`` of items and is sent to all tasks; a larger
benchmark is cut into blocks by a hash of its ids, so what is sent at once is
bounded whatever its size.  No shuffle, but for the least distance of each
(document, item).

Defined cases.  Null and empty texts hold nothing.  Items with fewer than
``min_item`` normalised bytes (8: one q-gram), and null items, are not searched.  Repeated
rows are each reported; (doc_id, item_id) pairs come once for each row.  An
empty table or benchmark gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit.llm import arrays as A
from inspectkit.llm import corpus as C

Q = 8  # bytes: a q-gram is one 64-bit number
BUDGET = 0.10
MIN_ITEM, MIN_BUDGET = 8, 32
BLOCK_BYTES = 8 << 20
SLICE = 2 << 20
_FILTER_BITS = 20

RESULT = "doc_id long, ver int, item_id long, distance int, start int, stop int"

_FOLD = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


_WIDE = 0xC4  # the first byte of a character beyond Latin-1
_CLASSES = ("Zs", "Zl", "Zp", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Cc", "Cf")
_LATIN_GAP = np.zeros(256, bool)  # second byte of a separator U+0080 to U+00BF
for _a in range(0x80, 0xC0):
    _LATIN_GAP[_a] = unicodedata.category(chr(_a)) in _CLASSES


@functools.cache
def _folds() -> np.ndarray:
    """Per code point up to U+1FFFF what it is compared as: 0x20 for separators, else
    the lower-case letter or itself; never one with more bytes than it has."""
    size = lambda c: len(c.encode("utf-8", "surrogatepass"))
    out = np.arange(0x20000, dtype=np.uint32)
    for k in range(0x100, 0x20000):
        c = chr(k)
        if unicodedata.category(c) in _CLASSES:
            out[k] = 0x20
            continue
        low = c.casefold() if len(c.casefold()) == 1 else c.lower()
        if len(low) == 1 and low != c:
            if size(low) <= size(c):
                out[k] = ord(low)
            else:
                out[ord(low)] = k
    return out


def _fold_wide(s: np.ndarray, keep: np.ndarray) -> None:
    """Characters beyond Latin-1, in place: bytes that a shorter character
    leaves over are marked in ``keep``."""
    at = np.flatnonzero(s >= _WIDE)
    if not len(at):
        return
    lead, n = s[at].astype(np.uint32), np.where(s[at] >= 0xF0, 4, np.where(s[at] >= 0xE0, 3, 2))
    byte = lambda k: (s[np.minimum(at + k, len(s) - 1)] & 0x3F).astype(np.uint32)
    code = np.where(n == 2, (lead & 0x1F) << 6 | byte(1), np.where(
        n == 3, (lead & 0x0F) << 12 | byte(1) << 6 | byte(2), (lead & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)))
    folds = _folds()
    to = np.where(code < len(folds), folds[np.minimum(code, len(folds) - 1)], code)
    some = to != code
    at, n, to = at[some], n[some], to[some]
    gap = to == 0x20
    for k in range(4):
        s[(at + k)[gap & (n > k)]] = 0x20
    at, n, to = at[~gap], n[~gap], to[~gap]
    size = np.where(to < 0x80, 1, np.where(to < 0x800, 2, np.where(to < 0x10000, 3, 4)))
    head = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[size]
    for k in range(4):
        rows = size > k
        rest = to[rows] >> (6 * (size[rows] - 1 - k)).astype(np.uint32)
        s[at[rows] + k] = (head[rows] | rest if k == 0 else rest & 0x3F | 0x80).astype(np.uint8)
        over = (size <= k) & (n > k)
        keep[at[over] + k] = False


def normalised(raw: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets, source positions) with runs of separators as one space;
    every text starts and ends without one."""
    s = _FOLD[raw]
    # U+00C0 to U+00DE but the multiplication sign: 0xC3 and a second byte
    upper = (s[1:] >= 0x80) & (s[1:] <= 0x9E) & (s[1:] != 0x97) & (s[:-1] == 0xC3)
    s[1:][upper] += 0x20
    mark = np.flatnonzero(s[:-1] == 0xC2)
    mark = mark[_LATIN_GAP[s[mark + 1]]]
    s[mark], s[mark + 1] = 0x20, 0x20
    whole = np.ones(len(s), bool)
    _fold_wide(s, whole)
    gap = s == 0x20
    keep = ~gap
    lead = np.zeros(len(s), bool)
    lead[1:] = gap[1:] & ~gap[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(s)]
    lead[cuts] = False
    keep |= lead
    at = np.flatnonzero(keep & whole)
    ends = np.searchsorted(at, offsets)
    # a space that ends a text goes
    last = ends[1:][np.diff(ends) > 0] - 1
    drop = last[s[at[last]] == 0x20]
    at = np.delete(at, drop)
    return s[at], np.searchsorted(at, offsets), at


def grams(s: np.ndarray) -> np.ndarray:
    """The Q bytes from every position as one number."""
    g = s.astype(np.uint64)
    for k in (1, 2, 4):
        if len(g) <= k:
            return np.empty(0, np.uint64)
        g = g[:-k] | (g[k:] << np.uint64(8 * k))
    return g


class Items:
    """The searched items of a block, with the places of their q-grams."""

    def __init__(self, ids: list[int], texts: list[str], budget: float, min_item: int):
        self.ids, self.text = [], []
        for i, t in zip(ids, texts):
            raw = np.frombuffer(t.encode(), np.uint8)
            s, _, _ = normalised(raw, np.array([0, len(raw)]))
            if len(s) >= min_item:
                self.ids.append(i)
                self.text.append(s)
        size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.minimum((size * budget).astype(np.int64), (size - Q) // Q)
        self.edits[size < MIN_BUDGET] = 0
        self.least = size - Q + 1 - Q * self.edits
        g = [grams(t) for t in self.text]
        value = np.concatenate(g) if g else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(g)), [len(x) for x in g])
        place = A.spans(np.array([len(x) for x in g], np.int64))
        order = np.argsort(value, kind="stable")
        self.item, self.place, value = item[order], place[order], value[order]
        self.value, self.start = np.unique(value, return_index=True)
        self.start = np.append(self.start, len(value))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self._slot(self.value)] = True

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)

    def regions(self, s: np.ndarray):
        """(item, first diagonal) of the bands that meet their item's bound."""
        g = grams(s)
        at = np.flatnonzero(self.filter[self._slot(g)])
        found = np.searchsorted(self.value, g[at])
        hit = found < len(self.value)
        hit[hit] = self.value[found[hit]] == g[at[hit]]
        at, found = at[hit], found[hit]
        n = self.start[found + 1] - self.start[found]
        k = np.repeat(self.start[found], n) + A.spans(n)
        item = self.item[k]
        step = self.edits[item] + 1
        # diagonals are moved up by a multiple of the step to be above 0
        band = (np.repeat(at, n) - self.place[k]) // step
        low = int(band.min()) - 1 if len(band) else 0
        key = item * np.int64(1 << 40) + (band - low)
        key, count = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        item = key >> 40
        enough = count >= self.least[item]
        item, band = item[enough], (key[enough] & ((1 << 40) - 1)) + low
        return item, band * (self.edits[item] + 1)


def banded_distance(item: np.ndarray, region: np.ndarray, edits: int) -> tuple[int, int, int]:
    """Least edit distance of the item to a part of the region, (distance,
    start, stop) in the region, over the diagonals of the region and ``edits``
    more on either side.  More than ``edits`` may be inexact."""
    width = max(1, len(region) + 2 * edits - len(item) + 1)
    padded = np.zeros(len(item) + width, np.uint8)  # 0 equals no normalised byte
    padded[edits : edits + len(region)] = region
    k = np.arange(width)
    d, origin = np.zeros(width, np.int64), k
    for i in range(len(item)):
        swap = d + (padded[i : i + width] != item[i])
        drop = np.append(d[1:], len(item) + width) + 1
        best = np.minimum(swap, drop)
        come = np.where(swap <= drop, origin, np.append(origin[1:], width))
        lead = best - k
        low = np.minimum.accumulate(lead)
        first = np.maximum.accumulate(np.where(lead == low, k, 0))
        d, origin = low + k, come[first]
        if d.min() > edits:
            break
    at = int(d.argmin())
    start = min(max(int(origin[at]) - edits, 0), len(region))
    return int(d[at]), start, min(max(len(item) + at - edits, start), len(region))


def _character_end(raw: np.ndarray, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _search(shared, budget: float, min_item: int):
    def run(batches):
        items = Items(*shared.value, budget, min_item)
        for doc, ver, raw, offsets in C.text_batches(batches, SLICE) if items.ids else ():
            for a, b in A.slices(offsets, SLICE):
                base = offsets[a]
                s, ends, source = normalised(raw[base : offsets[b]], offsets[a : b + 1] - base)
                found = {}
                for item, diagonal in zip(*(x.tolist() for x in items.regions(s))):
                    text, e = items.text[item], int(items.edits[item])
                    # the band starts inside or before one text, and ends in it or in the next
                    low, high = diagonal - e, diagonal + 2 * (e + 1) + len(text) + e
                    first = max(0, int(np.searchsorted(ends, max(low, 0), side="right")) - 1)
                    for row in range(first, min(len(ends) - 1, int(np.searchsorted(ends, high)))):
                        if found.get((row, item), (1,))[0] == 0:
                            continue
                        x, y = max(low, int(ends[row])), min(high, int(ends[row + 1]))
                        if y - x < len(text) - e:
                            continue
                        if len(text) < MIN_BUDGET:  # one space on either side, or an end of the text
                            u, v = max(x - 1, int(ends[row])), min(y + 1, int(ends[row + 1]))
                            first_word = int(u == ends[row])
                            whole = b" " * first_word + s[u:v].tobytes() + b" " * int(v == ends[row + 1])
                            place = whole.find(b" " + text.tobytes() + b" ")
                            if place >= 0:
                                place += u + 1 - first_word
                                found[row, item] = (0, int(source[place]), int(source[place + len(text) - 1]) + 1)
                            continue
                        exact = s[x:y].tobytes().find(text.tobytes())
                        distance, start, stop = (0, exact, exact + len(text)) if exact >= 0 else banded_distance(text, s[x:y], e)
                        if distance <= e and distance < found.get((row, item), (e + 1,))[0]:
                            found[row, item] = (distance, int(source[min(x + start, y - 1)]), int(source[max(x + stop, x + 1) - 1]) + 1)
                if found:
                    part = raw[base : offsets[b]]
                    found = {k: (d, p, _character_end(part, q)) for k, (d, p, q) in found.items()}
                    rows = [(int(doc[a + r]), int(ver[a + r]), items.ids[i], d, p + int(base - offsets[a + r]), q + int(base - offsets[a + r])) for (r, i), (d, p, q) in sorted(found.items())]
                    cols = list(zip(*rows))
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], types[0], mask=np.array(cols[0]) == A.NULL_ID), *(pa.array(c, t) for c, t in zip(cols[1:], types[1:]))],
                        names=["doc_id", "ver", "item_id", "distance", "start", "stop"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, min_item: int = MIN_ITEM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row and item found in it: doc_id, ver, item_id,
    distance, and the bytes [start, stop) of the text that hold it."""
    if not 0 <= budget < 1 / Q:
        raise ValueError(f"the budget is below 1/{Q}, or the bound says nothing")
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    _, size = C.measure(items)
    blocks = max(1, math.ceil(size / block_bytes))
    docs = C.versioned(docs)
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))
        part = docs.mapInArrow(_search(shared, budget, min_item), RESULT)
        out = part if out is None else out.union(part)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "benchmark"))
    return found.drop("ver")
