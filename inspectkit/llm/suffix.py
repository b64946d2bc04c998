"""Removal of repeated byte strings, by distributed prefix doubling.

Every byte covered by a ``length``-byte string that also starts anywhere else
(the same document included) goes; strings are judged on the input and never
cross documents.

Method.  Prefix doubling ranks positions by their first h bytes, then by the
pair (rank of h bytes here, rank of h bytes at the offset h), and drops
positions once their rank is unique.  Ranks here are fingerprints (equal
strings, equal rank), so lengths up to length/2 are ranked where the text is;
Spark groups positions by rank at length/2 and, for the survivors, by rank
pairs at the full length.

* Round 1 ranks one position per stretch of text: the position with the least
  rank among the length/2-byte strings inside a window (the same choice
  wherever the window occurs).  Neighbouring windows with the same chosen
  position form a stretch of at most 1.5 * length bytes.  A stretch whose
  whole content repeats is decided at once; a stretch whose chosen rank is
  unique in the corpus leaves; if all stretches that share a rank are alike,
  nothing is open either.
* Round 2 ranks each position of the stretches left open (the borders of
  repeated regions) by its pair of ranks.  A rank held twice is a repeat.

Plan.  Per round one shuffle of packed entries to buckets of their rank and
one of the findings back to the block of the document.  Equal ranks are
reduced to one entry within each map slice before the shuffle, both by rank
and by content, so a hot string costs an entry per slice, not per occurrence.

Defined cases.  Null and empty texts have no bytes.  Repeated rows are
documents of their own: all bytes of a repeated text of ``length`` or more
go.  Null ids are kept as null; an empty table gives an empty result; further
columns are ignored.  Equality is that of 64-bit fingerprints.  Longer texts
than ``piece`` bytes are ranked in overlapping pieces, so ranking needs the
memory of a piece; cutting needs some 50 bytes per byte of the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit.llm import arrays as A
from inspectkit.llm import corpus as C

LENGTH = 200
SLICE = 2 << 20
FLUSH = 1 << 18
_LOW = np.uint64(0xFFFFFFFF)
_ENTRY = {"key": np.uint64, "sup": np.uint64, "doc_id": np.int64, "ver": np.int32, "lo": np.uint32, "span": np.uint8, "kind": np.uint8, "flags": np.uint8}
_MESSAGE = {"doc_id": np.int64, "ver": np.int32, "lo": np.uint32, "span": np.uint8, "flags": np.uint8}
#: Kinds of entries: decided; by whole content (one or several in the slice);
#: by the chosen rank (one content in the slice, or several).
KNOWN, CONTENT, CONTENTS, RANK, RANK_MIXED = 0, 1, 2, 3, 4
#: Findings about a stretch: repeats; an equal one stands for it; others share its rank.
COVERED, REPRESENTED, MIXED = 1, 2, 4

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = len(a) - w + 1
    pad = np.full(-len(a) % w, np.iinfo(a.dtype).max, a.dtype)
    rows = np.concatenate([a, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def stretches(raw: np.ndarray, offsets: np.ndarray, length: int):
    """(row, lo, hi, rank, content): maximal runs of window starts lo..hi that
    share their chosen position, its rank, and a hash of the run's bytes."""
    half = (length + 1) // 2
    empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    long = np.flatnonzero(np.diff(offsets) >= length)
    if not len(long):
        return empty
    sums = A.prefix_hash(raw)
    at = np.arange(len(raw) - half + 1)
    ranks = A.span_hash(sums, at, at + half)
    chosen = sliding_min((ranks & ~_LOW) | at.astype(np.uint64), length - half + 1) & _LOW
    inside = A.covered(offsets[long], offsets[long + 1] - length + 1, len(chosen))
    p = np.flatnonzero(inside)
    c = chosen[p]
    new = np.ones(len(p), bool)
    new[1:] = (c[1:] != c[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    lo, hi = p[first], p[np.append(first[1:], len(p)) - 1]
    spot = c[first].astype(np.int64)
    content = A.mix(A.span_hash(sums, lo, hi + length) + (spot - lo).astype(np.uint64))
    return np.searchsorted(offsets, lo, side="right") - 1, lo, hi, ranks[spot], content


def _heads(*keys: np.ndarray):
    """Order by the keys, whether each entry opens a group of the first key,
    and the number of its group."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    main = keys[0][order]
    new = np.ones(len(main), bool)
    new[1:] = main[1:] != main[:-1]
    return order, new, np.cumsum(new) - 1


def _same(e, a, b):
    return (e["doc_id"][a] == e["doc_id"][b]) & (e["ver"][a] == e["ver"][b]) & (e["lo"][a] == e["lo"][b])


def pieces(raw: np.ndarray, offsets: np.ndarray, length: int, piece: int):
    """(first row, byte it starts at, stretches) of groups of texts of ``piece``
    bytes at most; a longer text comes in pieces that overlap by a string."""
    for a, b in A.slices(offsets, piece):
        base, size = int(offsets[a]), int(offsets[b] - offsets[a])
        if size <= 2 * piece:
            yield a, base, stretches(raw[base : base + size], offsets[a : b + 1] - base, length)
            continue
        for s in range(0, size - length + 1, piece):
            part = raw[base + s : base + min(size, s + piece + length - 1)]
            yield a, base + s, stretches(part, np.array([0, len(part)]), length)


def _first_round(length: int, buckets: int, piece: int):
    def reduced(parts):
        e = {k: np.concatenate([p[k] for p in parts]) for k in ("rank", "sup", "doc_id", "ver", "lo", "span")}
        n = len(e["rank"])
        # by content: the first stands for all
        order, new, group = _heads(e["sup"], e["doc_id"], e["lo"])
        size = np.bincount(group)
        first = np.empty(n, np.int64)
        first[order] = order[np.flatnonzero(new)][group]
        several = np.empty(n, bool)
        several[order] = size[group] > 1
        is_first = np.zeros(n, bool)
        is_first[order[new]] = True
        # by rank, among the firsts: one content or several
        f = np.flatnonzero(is_first)
        order, new, group = _heads(e["rank"][f])
        mixed = np.empty(len(f), bool)
        mixed[order] = np.bincount(group)[group] > 1
        opens = np.zeros(len(f), bool)
        opens[order[new]] = True

        def rows(at, kind, flags, key=None, sup=None):
            zero = np.zeros(len(at), np.uint64)
            return {"key": zero if key is None else key, "sup": zero if sup is None else sup, "kind": np.full(len(at), kind, np.uint8), "flags": flags.astype(np.uint8)} | {k: e[k][at] for k in ("doc_id", "ver", "lo", "span")}

        other = np.flatnonzero(~is_first)
        none = np.zeros(0)
        out = [
            rows(other, KNOWN, np.where(_same(e, other, first[other]), COVERED, COVERED | REPRESENTED) if len(other) else none),
            rows(f[mixed], KNOWN, np.full(int(mixed.sum()), MIXED)),
            rows(f[~several[f]], CONTENT, np.zeros(int((~several[f]).sum())), key=e["sup"][f[~several[f]]]),
            rows(f[several[f]], CONTENTS, np.zeros(int(several[f].sum())), key=e["sup"][f[several[f]]]),
            rows(f[~mixed], RANK, np.zeros(int((~mixed).sum())), key=e["rank"][f[~mixed]], sup=e["sup"][f[~mixed]]),
            rows(f[mixed & opens], RANK_MIXED, np.zeros(int((mixed & opens).sum())), key=e["rank"][f[mixed & opens]]),
        ]
        return _routed({k: np.concatenate([o[k] for o in out]) for k in _ENTRY}, buckets)

    def run(batches):
        parts, held = [], 0
        for doc, ver, raw, offsets in C.text_batches(batches):
            for a, base, (row, lo, hi, rank, content) in pieces(raw, offsets, length, piece):
                row = row + a
                parts.append({"rank": rank, "sup": content, "doc_id": doc[row], "ver": ver[row], "lo": (lo + base - offsets[row]).astype(np.uint32), "span": (hi - lo).astype(np.uint8)})
                held += len(row)
            if held >= FLUSH:
                yield reduced(parts)
                parts, held = [], 0
        if held:
            yield reduced(parts)

    return run


def _routed(e: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    dest = np.where(e["kind"] == KNOWN, A.mix(e["doc_id"].view(np.uint64)), e["key"] >> np.uint64(7)) % np.uint64(buckets)
    return A.packed(dest.astype(np.int64), **e)


def _messages(blocks: int, e: dict[str, np.ndarray], flags: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(flags)
    doc, ver = e["doc_id"][at], e["ver"][at]
    return A.packed(C.block_of(doc, ver, blocks), doc_id=doc, ver=ver, lo=e["lo"][at], span=e["span"][at], flags=flags[at].astype(np.uint8))


def _findings(blocks: int):
    """Per rank and per content, what the whole corpus says about a stretch."""

    def run(batches):
        e = A.gathered(batches, **_ENTRY)
        yield _messages(blocks, e, np.where(e["kind"] == KNOWN, e["flags"], 0))
        c = {k: v[(e["kind"] == CONTENT) | (e["kind"] == CONTENTS)] for k, v in e.items()}
        if len(c["key"]):
            order, new, group = _heads(c["key"], c["doc_id"], c["ver"], c["lo"])
            repeats = np.bincount(group, (c["kind"][order] == CONTENTS) + 1.0)[group] > 1
            head = order[np.flatnonzero(new)][group]
            flags = np.zeros(len(order), np.uint8)
            flags[order] = np.where(repeats, np.where(_same(c, order, head), COVERED, COVERED | REPRESENTED), 0)
            yield _messages(blocks, c, flags)
        r = {k: v[(e["kind"] == RANK) | (e["kind"] == RANK_MIXED)] for k, v in e.items()}
        if len(r["key"]):
            order, new, group = _heads(r["key"], r["sup"])
            sup = r["sup"][order]
            change = np.zeros(len(order))
            change[1:] = (sup[1:] != sup[:-1]) & ~new[1:]
            change += r["kind"][order] == RANK_MIXED
            flags = np.zeros(len(order), np.uint8)
            flags[order] = np.where((np.bincount(group, change)[group] > 0) & (r["kind"][order] == RANK), MIXED, 0)
            yield _messages(blocks, r, flags)

    return run


class Found:
    """Findings of a block by document, one per stretch."""

    def __init__(self, table: pa.Table):
        m = A.gathered(table.to_batches(), **_MESSAGE)
        ident = C.ident(m["doc_id"], m["ver"])
        order = np.lexsort((m["span"], m["lo"], ident))
        ident, lo, span = ident[order], m["lo"][order].astype(np.int64), m["span"][order].astype(np.int64)
        new = np.ones(len(order), bool)
        new[1:] = (ident[1:] != ident[:-1]) | (lo[1:] != lo[:-1]) | (span[1:] != span[:-1])
        at = np.flatnonzero(new)
        self.ident, self.lo, self.span = ident[at], lo[at], span[at]
        self.flags = np.bitwise_or.reduceat(m["flags"][order], at) if len(at) else m["flags"]

    def of(self, doc: np.ndarray, ver: np.ndarray, offsets: np.ndarray):
        """(row, first start, last start, flags) in a slice of texts."""
        ident = C.ident(doc, ver)
        a = np.searchsorted(self.ident, ident)
        n = np.searchsorted(self.ident, ident, side="right") - a
        at, row = np.repeat(a, n) + A.spans(n), np.repeat(np.arange(len(doc)), n)
        lo = self.lo[at] + offsets[row]
        return row, lo, lo + self.span[at], self.flags[at]


def _second_round(length: int, buckets: int, piece: int):
    half = (length + 1) // 2

    def run(block: pa.Table, messages: pa.Table) -> pa.Table:
        found, parts = Found(messages), []
        open_ = ((found.flags & MIXED) > 0) & ((found.flags & REPRESENTED) == 0)
        found.ident, found.lo, found.span, found.flags = (x[open_] for x in (found.ident, found.lo, found.span, found.flags))
        for doc, ver, raw, offsets in C.unpacked(block) if len(found.ident) else ():
            row, lo, hi, _ = found.of(doc, ver, offsets)
            if not len(row):
                continue
            n = hi - lo + 1
            p, row = np.repeat(lo, n) + A.spans(n), np.repeat(row, n)
            pair = np.empty(len(p), np.uint64)
            for s in range(0, len(raw), piece):
                here = np.flatnonzero((p >= s) & (p < s + piece))
                if len(here):
                    sums, at = A.prefix_hash(raw[s : s + piece + length]), p[here] - s
                    pair[here] = A.joined(A.span_hash(sums, at, at + half), A.span_hash(sums, at + length - half, at + length))
            parts.append({"key": A.mix(pair), "doc_id": doc[row], "ver": ver[row], "lo": (p - offsets[row]).astype(np.uint32)})
        if not parts:
            return A.packed(np.empty(0, np.int64), **{k: np.empty(0, t) for k, t in _ENTRY.items()}).schema.empty_table()
        e = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        order, new, group = _heads(e["key"])
        many = np.empty(len(order), bool)
        many[order] = np.bincount(group)[group] > 1
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        e["kind"] = np.where(many, np.where(first, CONTENTS, KNOWN), CONTENT).astype(np.uint8)
        e["flags"] = np.where(many & ~first, COVERED, 0).astype(np.uint8)
        e["span"] = np.zeros(len(order), np.uint8)
        e["sup"] = np.zeros(len(order), np.uint64)
        return pa.Table.from_batches([_routed({k: e[k] for k in _ENTRY}, buckets)])

    return run


def _cut(length: int):
    def run(block: pa.Table, messages: pa.Table) -> pa.Table:
        found, out = Found(messages), []
        for doc, ver, raw, offsets in C.unpacked(block):
            _, lo, hi, flags = found.of(doc, ver, offsets)
            repeats = (flags & COVERED) > 0
            gone = A.covered(lo[repeats], hi[repeats] + length, len(raw))
            sums = np.concatenate([[0], np.cumsum(gone)])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            cuts = offsets[:-1][offsets[:-1] < len(raw)]
            opens[cuts] = gone[cuts]
            runs = np.concatenate([[0], np.cumsum(opens)])
            removed = np.diff(sums[offsets])
            ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[~gone]))])
            out.append(pa.table({
                "doc_id": pa.array(doc, mask=doc == A.NULL_ID), "n_bytes": np.diff(offsets).astype(np.int64),
                "n_removed": removed.astype(np.int64), "n_spans": np.diff(runs[offsets]).astype(np.int64), "kept": kept,
            }))
        return pa.concat_tables(out)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, piece: int = SLICE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and
    ``kept``, the remaining bytes."""
    if not 2 <= length <= 500:
        raise ValueError("length is 2 to 500 bytes")
    spark: SparkSession = docs.sparkSession
    docs = C.versioned(docs)
    _, size = C.measure(docs)
    blocks, tasks = C.n_blocks(size), C.partitions(spark, size)
    entry, message = A.packed_schema(*_ENTRY), A.packed_schema(*_MESSAGE)
    with C.shuffle_cleanup(spark):
        first = docs.mapInArrow(_first_round(length, tasks, piece), entry).repartitionById(tasks, "dest")
        first = C.saved(first.mapInArrow(_findings(blocks), message), "ranks")
        second = C.with_messages(docs, blocks, first, _second_round(length, tasks, piece), entry).repartitionById(tasks, "dest")
        second = C.saved(second.mapInArrow(_findings(blocks), message), "rank-pairs")
    return C.with_messages(docs, blocks, first.union(second), _cut(length), RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(C.load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
