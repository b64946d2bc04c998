"""Substring dedup on words, by difference-cover anchors.

A window is ``window`` consecutive words of one document.  A word goes when a
window covering it has a word sequence that starts earlier (smaller doc_id,
or the same document and an earlier start), judged on the input.

Method.  Hashes of ``window - period + 1`` words are taken only at word
positions that fall in a difference cover modulo ``period``.  For any two
equal windows, whatever their positions, some offset below ``period`` puts
both on the cover, so every repeated window holds an anchor that repeats;
windows without a repeated anchor are out.  The remaining windows around the
anchors are extended to their full length, hashed and compared by start.

Plan.  Three shuffles, each of packed arrays: anchor hashes to hash buckets
and the repeated ones back to the block of their document; hashes of
candidate windows likewise; flagged windows to the texts.  Within a map slice
(and within a block) equal hashes are reduced to one entry before the
shuffle, so a passage held by a third of all documents costs an entry per
slice, not per document.  Blocks hold about 4 MB of text at any input size.

Defined cases.  Null and empty texts have no words.  Documents shorter than
the window keep every word.  Rows with a null doc_id sort before all ids.
Repeated rows (same id and text) are one document given ``copies`` times;
rows that share an id but not a text are separate documents, and a window of
one is not earlier than a window of the other at the same start.  An empty
table gives an empty result; further columns are ignored.  Equality is that
of 64-bit hashes of the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit.llm import arrays as A
from inspectkit.llm import corpus as C

SLICE = 1 << 20  # bytes of text whose words are looked at together
WINDOW = 20
#: Difference covers: every residue modulo the period is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
FLUSH = 1 << 20
_ENTRY = {"key": np.uint64, "doc_id": np.int64, "ver": np.int32, "pos": np.uint32, "state": np.uint8}
_MESSAGE = {"doc_id": np.int64, "ver": np.int32, "pos": np.uint32}
#: Of an entry: the only one with its hash in its slice, the first of several, one known to repeat.
ONE, FIRST, KNOWN = 0, 1, 2

RESULT = "doc_id long, ver int, copies long, n_words long, n_removed long, kept string"


def cover_period(window: int) -> int:
    return max(p for p in COVERS if p <= max(1, window - 4))


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by the keys (the first is the main one), the index in that
    order of each entry's group head, and the size of its group."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    main = keys[0][order]
    new = np.ones(len(main), bool)
    new[1:] = main[1:] != main[:-1]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(main)))
    return order, np.repeat(heads, sizes), np.repeat(sizes, sizes)


def _routed(entries: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Entries to the bucket of their hash; those already decided go anywhere."""
    known = entries["state"] == KNOWN
    dest = np.where(known, A.mix(entries["doc_id"].view(np.uint64)), entries["key"] >> np.uint64(7)) % np.uint64(buckets)
    return A.packed(dest.astype(np.int64), **entries)


def _messages(blocks: int, keep: np.ndarray, e: dict[str, np.ndarray]) -> pa.RecordBatch:
    doc, ver, pos = e["doc_id"][keep], e["ver"][keep], e["pos"][keep]
    return A.packed(C.block_of(doc, ver, blocks), doc_id=doc, ver=ver, pos=pos)


def _anchors(window: int, period: int, buckets: int):
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    size = window - period + 1

    def reduced(parts):
        e = {k: np.concatenate([p[k] for p in parts]) for k in _ENTRY if k != "state"}
        order, head, n = _groups(e["key"])
        e = {k: v[order] for k, v in e.items()}
        first = head == np.arange(len(head))
        e["state"] = np.where(n == 1, ONE, np.where(first, FIRST, KNOWN)).astype(np.uint8)
        return _routed(e, buckets)

    def run(batches):
        parts, held = [], 0
        for doc, ver, raw, offsets in C.text_batches(batches, SLICE):
            _, _, h, first = A.words(raw, offsets)
            hashes, row = A.windows(h, size), A.row_of(first)
            place = np.arange(len(h)) - first[:-1][row]
            left = np.diff(first)[row] - place
            at = np.flatnonzero(cover[place % period] & (left >= size) & (np.diff(first)[row] >= window))
            parts.append({"key": hashes[at], "doc_id": doc[row[at]], "ver": ver[row[at]], "pos": place[at].astype(np.uint32)})
            held += len(at)
            if held >= FLUSH:
                yield reduced(parts)
                parts, held = [], 0
        if held:
            yield reduced(parts)

    return run


def _repeated(blocks: int):
    """Anchors whose hash repeats, to the block of their document."""

    def run(batches):
        e = A.gathered(batches, **_ENTRY)
        known = e["state"] == KNOWN
        yield _messages(blocks, known, e)
        e = {k: v[~known] for k, v in e.items()}
        if len(e["key"]):
            order, _, n = _groups(e["key"])
            keep = np.zeros(len(order), bool)
            keep[order] = n > 1
            yield _messages(blocks, keep | (e["state"] == FIRST), e)

    return run


def _later(blocks: int):
    """Windows that start after the earliest one with their hash."""

    def run(batches):
        e = A.gathered(batches, **_ENTRY)
        known = e["state"] == KNOWN
        yield _messages(blocks, known, e)
        e = {k: v[~known] for k, v in e.items()}
        if len(e["key"]):
            yield _messages(blocks, _not_first(e), e)

    return run


def _not_first(e: dict[str, np.ndarray]) -> np.ndarray:
    order, head, _ = _groups(e["key"], e["doc_id"], e["pos"])
    doc, pos = e["doc_id"][order], e["pos"][order]
    later = (doc != doc[head]) | (pos != pos[head])
    out = np.zeros(len(order), bool)
    out[order] = later
    return out


class Flags:
    """Flagged word positions of a block, found by document."""

    def __init__(self, table: pa.Table):
        m = A.gathered(table.to_batches(), **_MESSAGE)
        ident = C.ident(m["doc_id"], m["ver"])
        order = np.argsort(ident, kind="stable")
        self.ident, self.pos = ident[order], m["pos"][order].astype(np.int64)

    def words(self, doc: np.ndarray, ver: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Indexes into a slice's words."""
        ident = C.ident(doc, ver)
        a = np.searchsorted(self.ident, ident)
        n = np.searchsorted(self.ident, ident, side="right") - a
        return self.pos[np.repeat(a, n) + A.spans(n)] + np.repeat(first[:-1], n)


def _candidates(window: int, period: int, buckets: int):
    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        flags, parts = Flags(found), []
        for doc, ver, raw, offsets in C.unpacked(block) if len(flags.pos) else ():
            _, _, h, first = A.words(raw, offsets)
            anchors = flags.words(doc, ver, first)
            if not len(anchors):
                continue
            row = A.row_of(first)
            lowest = np.maximum(anchors - (period - 1), first[:-1][row[anchors]])
            starts = np.flatnonzero(A.covered(lowest, anchors + 1, len(h)))
            starts = starts[first[1:][row[starts]] - starts >= window]
            parts.append({"key": A.windows(h, window)[starts], "doc_id": doc[row[starts]], "ver": ver[row[starts]], "pos": (starts - first[:-1][row[starts]]).astype(np.uint32)})
        if not parts or not sum(len(p["key"]) for p in parts):
            return A.packed(np.empty(0, np.int64), **{k: np.empty(0, t) for k, t in _ENTRY.items()}).schema.empty_table()
        e = {k: np.concatenate([p[k] for p in parts]) for k in _ENTRY if k != "state"}
        later = _not_first(e)
        e["state"] = np.where(later, KNOWN, FIRST).astype(np.uint8)
        return pa.Table.from_batches([_routed(e, buckets)])

    return run


def _cut(window: int):
    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        flags, out = Flags(found), []
        for doc, ver, raw, offsets in C.unpacked(block):
            starts, ends, _, first = A.words(raw, offsets)
            at = flags.words(doc, ver, first)
            gone = A.covered(at, at + window, len(starts))
            total = np.diff(first)
            sums = np.concatenate([[0], np.cumsum(gone)])
            kept = np.flatnonzero(~gone)
            sizes = ends[kept] - starts[kept] + 1
            flat = raw[np.minimum(np.repeat(starts[kept], sizes) + A.spans(sizes), len(raw) - 1)] if len(kept) else raw[:0]
            stops = np.cumsum(sizes)
            flat = flat.copy()
            flat[stops - 1] = 0x20  # one space after each word; the last of a document goes below
            n_kept = total - np.diff(sums[first])
            size = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(n_kept)])]
            last = (size[1:] - 1)[n_kept > 0]
            text = np.delete(flat, last)
            offs = np.concatenate([[0], np.cumsum(np.diff(size) - (n_kept > 0))]).astype(np.int32)
            column = pa.Array.from_buffers(pa.string(), len(doc), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(text))])
            out.append(pa.table({"doc_id": doc, "ver": ver, "n_words": total.astype(np.int64), "n_removed": np.diff(sums[first]).astype(np.int64), "kept": column}))
        whole = pa.concat_tables(out)
        return _one_per_document(whole)

    return run


def _one_per_document(t: pa.Table) -> pa.Table:
    """Repeated rows of a block become one with their number."""
    key = C.ident(t["doc_id"].to_numpy(), t["ver"].to_numpy())
    order, head, n = _groups(key)
    at = np.flatnonzero(head == np.arange(len(head)))
    t = t.take(pa.array(order[at]))
    doc = t["doc_id"].to_numpy()
    return pa.table({
        "doc_id": pa.array(doc, mask=doc == A.NULL_ID), "ver": t["ver"], "copies": pa.array(n[at].astype(np.int64)),
        "n_words": t["n_words"], "n_removed": t["n_removed"], "kept": t["kept"],
    })


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, ver, copies, n_words,
    n_removed and ``kept``, the remaining words joined by one space."""
    if window < 5:
        raise ValueError("a window needs five words or more")
    spark: SparkSession = docs.sparkSession
    docs = C.versioned(docs)
    _, size = C.measure(docs)
    period, blocks, tasks = cover_period(window), C.n_blocks(size), C.partitions(spark, size)
    entry, message = A.packed_schema(*_ENTRY), A.packed_schema(*_MESSAGE)

    def exchanged(entries: DataFrame, reduce) -> DataFrame:
        return entries.repartitionById(tasks, "dest").mapInArrow(reduce, message)

    with C.shuffle_cleanup(spark):
        anchors = docs.mapInArrow(_anchors(window, period, tasks), entry)
        anchors = C.saved(exchanged(anchors, _repeated(blocks)), "anchors")
        starts = C.with_messages(docs, blocks, anchors, _candidates(window, period, tasks), entry)
        starts = C.saved(exchanged(starts, _later(blocks)), "windows")
    return C.with_messages(docs, blocks, starts, _cut(window), RESULT)


def per_row(found: DataFrame) -> DataFrame:
    """As many rows per document as the input had."""
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(C.load(spark, sf_dir, "documents"))
    return per_row(found.select("doc_id", "copies", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d
), h AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM s
), f AS (
  SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY k) AS earliest FROM h
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS p FROM f WHERE (doc_id, i) > earliest
), g AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
         list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
