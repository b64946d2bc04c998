"""Ranked lexical search: MaxScore with pair bounds.

A document's score for an item is the sum, over the item's distinct terms, of
an impact: the term's weight times a whole number that saturates with the
term's occurrences and falls with the document's length.

Index.  Documents are dealt to shards of about ``SHARD_BYTES`` of text.  A
shard's index has a list per term (document, impact before the weight) with
the largest impact of every block of ``BLOCK`` documents, and, precomputed, an
intersection list for each pair of the corpus' ``FREQUENT`` terms of the most
documents: the blocks where both occur in one document, with the largest joint
impact there.  Those are the long lists, of which every item has some.

Search.  The bound of a block is the sum of its terms' largest impacts.  Two
frequent terms a, b together add at most max(a, b, joint) instead of a + b; of
the item's frequent terms those pairs are bound together that gain most.  Blocks
whose bound is below the score to reach are skipped.  Within the rest, units
(pairs, single terms) are ordered by their bounds; the units whose bounds
together don't reach the score are not essential, documents that hold only
those are never looked at, and the others leave as soon as what they have and
the bounds of the units still to come don't reach it.  Equal scores stay.

Plan.  Texts are cut into terms once, postings go to their shards packed, an
entry for each slice and shard.  Only terms that some item may have are kept:
a bitmap of ``BITS`` hashed terms (512 KB) is sent to the tasks, whatever the
number of items.  Items stay a table; each goes to the shards in two steps of
``FAN`` copies, so nothing of it passes through the driver and no task sends
all.  A task holds one shard and takes the items one by one.  Rounds cover 1,
64, 4096 ... shards; the best of a round give the scores to reach for the next,
so what a round returns stays near ``FAN`` times the result.

Defined cases.  Null and empty texts have no terms: such a document is never
found and counts nowhere, such an item finds nothing.  A null doc_id comes before
any other among equal scores; repeated documents are found as often as they
are.  Rows of the benchmark that share id and text count once, texts that
share an id are ranked each for itself.  Empty tables give an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inspectkit.llm import arrays as A
from inspectkit.llm import corpus as C

TOP = 50
SHARD_BYTES = 16 << 20
BLOCK = 64
FREQUENT = 32
BITS = 1 << 22
FAN = 64

# What separates terms: ASCII but digits and letters.
APART = np.ones(256, bool)
APART[0x80:] = False
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    APART[_a : _b + 1] = False


def _bit(terms: np.ndarray) -> np.ndarray:
    return (A.mix(terms) & np.uint64(BITS - 1)).astype(np.int64)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, ver, term, bit): the distinct terms of every distinct item."""
    rows = items.select(items["item_id"].cast("long").alias("doc_id"), F.coalesce(items["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.distinct().select("doc_id", F.xxhash64("text").alias("ver"), "text")

    def run(batches):
        for b in batches:
            raw, offsets = A.bytes_of(b.column(2))
            _, _, h, first = A.words(raw, offsets, lower=True, apart=APART)
            row, at = A.row_of(first), np.lexsort((h, A.row_of(first)))
            row, h = row[at], h[at]
            new = np.ones(len(h), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            row, h = pa.array(row[new]), h[new]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(row), b.column(1).take(row), pa.array(h.view(np.int64)), pa.array(_bit(h))], names=["item_id", "ver", "term", "bit"])

    return rows.mapInArrow(run, "item_id long, ver long, term long, bit long")


def _bitmap(asked: DataFrame) -> np.ndarray:
    """Bit by bit, whether a term with that hash is asked for: BITS of them."""
    at = F.col("bit") + 1
    parts = asked.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(BITS, bool)
    for r in parts.collect():
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        out[(r.part - 1) * len(bits) : r.part * len(bits)] = bits[: BITS - (r.part - 1) * len(bits)]
    return out


_PACKET = "sh int, n_docs long, n_terms long, doc binary, size binary, row binary, term binary, tf binary"


def _packets(docs: DataFrame, wanted: np.ndarray, shards: int) -> DataFrame:
    """Postings of the wanted terms, packed by slice and shard, with the number
    of documents that have terms and of all their terms.  Rows are dealt by
    their place, so copies spread."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        wanted, seen = np.unpackbits(shared.value).view(bool), 0
        task = A.mix(np.array([TaskContext.get().partitionId() + 1], np.uint64))
        for b in batches:
            ids, (raw_all, offsets_all) = A.ids_of(b.column(0)), A.bytes_of(b.column(1))
            for x, y in A.slices(offsets_all):
                offsets = offsets_all[x : y + 1] - offsets_all[x]
                _, _, h, first = A.words(raw_all[offsets_all[x] : offsets_all[y]], offsets, lower=True, apart=APART)
                size, row = np.diff(first), A.row_of(first)
                keep = wanted[_bit(h)]
                dest = (A.mix(task + np.arange(seen, seen + y - x, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shards)).astype(np.int64)
                seen += y - x
                order = np.argsort(dest, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                row, h = place[row[keep]], h[keep]  # rows in the order of their shards
                at = np.lexsort((h, row))
                row, h = row[at], h[at]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, np.int64)
                tf = np.diff(np.append(new, len(h)))
                row, h = row[new], h[new]
                to = dest[order]
                begin = np.flatnonzero(np.diff(to, prepend=-1))
                end = np.append(begin[1:], len(to))
                cut = np.searchsorted(row, np.append(begin, len(to)))
                n = np.diff(cut)
                row = row - np.repeat(begin, n)
                sizes = size[order]
                yield pa.RecordBatch.from_arrays([
                    pa.array(to[begin].astype(np.int32)), pa.array(np.add.reduceat((sizes > 0).astype(np.int64), begin)), pa.array(np.add.reduceat(sizes, begin)),
                    A.binary(ids[x:y][order], end - begin), A.binary(sizes.astype(np.int64), end - begin),
                    A.binary(row.astype(np.int32), n), A.binary(h, n), A.binary(tf.astype(np.int64), n)], names=_names(_PACKET))

    return C.texts(docs).mapInArrow(run, _PACKET)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _frequencies(packets: DataFrame) -> DataFrame:
    """(term, df): documents that hold the term, summed within a batch first."""

    def run(batches):
        for b in batches:
            terms, n = np.unique(A.numbers(b.column(0), np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

    return packets.select("term").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


_INDEX = "sh int, doc binary, terms binary, starts binary, docs binary, units binary, pair binary, pair_starts binary, pair_block binary, pair_joint binary"


def joint_maxima(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks in which both impact rows (one value a document, padded to whole
    blocks) are above 0 in one document, and the largest sum there."""
    best = np.where((a > 0) & (b > 0), a + b, 0).reshape(-1, BLOCK).max(axis=1)
    blocks = np.flatnonzero(best)
    return blocks, best[blocks]


def build_shard(packets: list[dict], n_all: int, l_all: int, frequent: list[tuple[int, int]]) -> dict[str, np.ndarray]:
    """The index of one shard: lists by term, and the pair lists of the
    ``frequent`` (term, weight)."""
    doc, size, row, base = [], [], [], 0
    for p in packets:
        doc.append(np.frombuffer(p["doc"], np.int64))
        size.append(np.frombuffer(p["size"], np.int64))
        row.append(np.frombuffer(p["row"], np.int32).astype(np.int64) + base)
        base += len(doc[-1])
    doc, size, row = map(np.concatenate, (doc, size, row))
    term = np.concatenate([np.frombuffer(p["term"], np.uint64) for p in packets])
    tf = np.concatenate([np.frombuffer(p["tf"], np.int64) for p in packets])
    long = 50 + (50 * size * n_all) // max(l_all, 1)
    unit = (1_000_000_000 * tf) // (1000 * tf + 20 * long[row])
    at = np.lexsort((row, term))
    terms, starts = np.unique(term[at], return_index=True)
    starts = np.append(starts, len(term)).astype(np.int64)
    docs, units = row[at].astype(np.int32), unit[at].astype(np.int32)
    wide = -(-max(len(doc), 1) // BLOCK) * BLOCK
    dense = []
    for t, w in frequent:
        line, i = np.zeros(wide, np.int64), int(np.searchsorted(terms, np.uint64(t)))
        if i < len(terms) and terms[i] == np.uint64(t):
            line[docs[starts[i] : starts[i + 1]]] = w * units[starts[i] : starts[i + 1]].astype(np.int64)
        dense.append(line)
    pair, pair_starts, blocks, joints = [], [0], [], []
    for i in range(len(frequent)):
        for j in range(i + 1, len(frequent)):
            b, top = joint_maxima(dense[i], dense[j])
            if len(b):
                pair.append(i * FREQUENT + j)
                blocks.append(b)
                joints.append(top)
                pair_starts.append(pair_starts[-1] + len(b))
    none = np.empty(0, np.int64)
    return {
        "doc": doc, "terms": terms, "starts": starts, "docs": docs, "units": units,
        "pair": np.array(pair, np.int64), "pair_starts": np.array(pair_starts, np.int64),
        "pair_block": np.concatenate(blocks or [none]).astype(np.int32), "pair_joint": np.concatenate(joints or [none]),
    }


_DTYPES = {"doc": np.int64, "terms": np.uint64, "starts": np.int64, "docs": np.int32, "units": np.int32,
           "pair": np.int64, "pair_starts": np.int64, "pair_block": np.int32, "pair_joint": np.int64}


class Shard:
    """A shard's index, ready to be searched."""

    def __init__(self, cols: dict[str, np.ndarray], frequent: list[int]):
        self.__dict__.update(cols)
        self.frequent = {t: i for i, t in enumerate(frequent)}
        self.blocks = -(-max(len(self.doc), 1) // BLOCK)
        self.pairs = {int(p): (a, b) for p, a, b in zip(self.pair, self.pair_starts[:-1], self.pair_starts[1:])}
        # largest unit of each (term, block)
        key = np.repeat(np.arange(len(self.terms)) * self.blocks, np.diff(self.starts)) + self.docs // BLOCK
        new = np.flatnonzero(np.diff(key, prepend=-1))
        self.top = np.maximum.reduceat(self.units, new).astype(np.int64) if len(new) else np.empty(0, np.int64)
        self.top_block = key[new] % self.blocks
        self.top_starts = np.searchsorted(new, self.starts)
        self.scores = np.zeros(len(self.doc), np.int64)

    def joint(self, i: int, j: int) -> np.ndarray:
        """Per block, the largest joint impact of two frequent terms."""
        out = np.zeros(self.blocks, np.int64)
        a, b = self.pairs.get(min(i, j) * FREQUENT + max(i, j), (0, 0))
        out[self.pair_block[a:b]] = self.pair_joint[a:b]
        return out

    def units_of(self, terms: np.ndarray, weights: np.ndarray) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray]:
        """(units, their bound in each block, list and weight of each term): a
        unit is one term or two that are bound together."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        here = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        at, weights, terms = at[here], weights[here], terms[here]
        bound = np.zeros((len(at), self.blocks), np.int64)
        n = self.top_starts[at + 1] - self.top_starts[at]
        flat = np.repeat(self.top_starts[at], n) + A.spans(n)
        line = np.repeat(np.arange(len(at)), n)
        bound[line, self.top_block[flat]] = self.top[flat] * weights[line]
        own = [(i, self.frequent[t]) for i, t in enumerate(terms.view(np.int64).tolist()) if t in self.frequent]
        gains = []
        for k, (i, f) in enumerate(own):
            for j, g in own[k + 1 :]:
                both = np.maximum(np.maximum(bound[i], bound[j]), self.joint(f, g))
                gain = int((bound[i] + bound[j] - both).sum())
                if gain > 0:
                    gains.append((gain, i, j, both))
        taken, units, rows = set(), [], []
        for _, i, j, both in sorted(gains, key=lambda x: (-x[0], x[1], x[2])):
            if i not in taken and j not in taken:
                taken |= {i, j}
                units.append((i, j))
                rows.append(both)
        for i in range(len(at)):
            if i not in taken:
                units.append((i,))
                rows.append(bound[i])
        return units, np.array(rows, np.int64).reshape(len(units), self.blocks), at, weights

    def add(self, unit: tuple[int, ...], at: np.ndarray, weights: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
        """Add the impacts of a unit's terms to the documents that ``inside``
        (a flag per document) holds; those documents, list by list."""
        out = []
        for i in unit:
            a, b = self.starts[at[i]], self.starts[at[i] + 1]
            docs = self.docs[a:b]
            keep = inside[docs]
            docs = docs[keep]
            self.scores[docs] += weights[i] * self.units[a:b][keep].astype(np.int64)  # a document is once in a list
            out.append(docs)
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, floor: int, k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """(doc ids, scores) of the k best with a score of ``floor`` or more."""
        floor = max(1, floor)
        units, bound, at, weights = self.units_of(terms, weights)
        whole = bound.sum(axis=0)
        open_ = np.flatnonzero(whole >= floor)
        open_ = open_[np.argsort(-whole[open_], kind="stable")]
        ids, scores, step, x = np.empty(0, np.int64), np.empty(0, np.int64), 4, 0
        while x < len(open_):
            blocks = open_[x : x + step]
            x, step = x + step, step * 4
            blocks = blocks[whole[blocks] >= floor]
            if not len(blocks):
                break  # the rest is bounded by less
            found = self._blocks(units, bound, at, weights, blocks, floor)
            ids, scores = np.concatenate([ids, self.doc[found]]), np.concatenate([scores, self.scores[found]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                floor = max(floor, int(scores[-1]))
        return ids, scores

    def _blocks(self, units, bound, at, weights, blocks: np.ndarray, floor: int) -> np.ndarray:
        """Documents of the blocks that reach the floor (scores are left in place)."""
        most = bound[:, blocks].max(axis=1)
        order = np.argsort(most, kind="stable")
        below = np.cumsum(most[order])  # bound of the units up to each
        essential = int(np.searchsorted(below, floor))
        inside = np.zeros(self.blocks, bool)
        inside[blocks] = True
        inside = np.repeat(inside, BLOCK)[: len(self.doc)]
        self.scores[inside] = 0
        held = [d for u in order[essential:] if most[u] for d in self.add(units[u], at, weights, inside)]
        cand = np.unique(np.concatenate(held)) if held else np.empty(0, np.int32)
        for u in range(essential - 1, -1, -1):
            cand = cand[self.scores[cand] + below[u] >= floor]
            if not len(cand) or not below[u]:
                break
            left = np.zeros(len(self.doc), bool)
            left[cand] = True
            self.add(units[order[u]], at, weights, left)
        return cand[self.scores[cand] >= floor]


def _sorted_runs(df: DataFrame, parts: int, run, schema: str) -> DataFrame:
    return df.repartition(parts, "sh").sortWithinPartitions("sh", "kind").mapInArrow(run, schema)


_FOUND = "item_id long, ver long, doc_id long, score long"


def _searcher(frequent: list[int], k: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        shard, now = None, None
        for (sh, kind), piece in C.pieces(batches, ("sh", "kind")):
            if kind == 0:
                row = piece.slice(0, 1).to_pylist()[0]
                shard, now = Shard({c: np.frombuffer(row[c] or b"", t) for c, t in _DTYPES.items()}, frequent), sh
                continue
            if now != sh:
                continue  # a shard without documents
            col = {c: piece.column(i) for i, c in enumerate(piece.schema.names)}
            out = {"line": [], "doc": [], "score": []}
            for i, (floor, terms, weights) in enumerate(zip(col["floor"].to_pylist(), col["item_terms"], col["item_weights"])):
                terms, weights = (x.values.to_numpy(zero_copy_only=False) for x in (terms, weights))
                ids, scores = shard.search(terms.view(np.uint64), weights, floor or 0, k)
                out["line"].append(np.full(len(ids), i))
                out["doc"].append(ids)
                out["score"].append(scores)
            line, ids, scores = (np.concatenate(v).astype(np.int64) for v in out.values())
            doc = pa.array(ids, pa.int64(), mask=ids == A.NULL_ID)
            line = pa.array(line)
            yield pa.RecordBatch.from_arrays([col["item_id"].take(line), col["ver"].take(line), doc, pa.array(scores)], names=["item_id", "ver", "doc_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id", "ver").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """The written index of a table of documents for the terms asked for."""

    def __init__(self, docs: DataFrame, asked: DataFrame, shard_bytes: int = SHARD_BYTES):
        spark = docs.sparkSession
        rows, size = C.measure(C.texts(docs))
        self.shards = max(1, math.ceil(size / shard_bytes))
        packets = C.saved(_packets(docs, _bitmap(asked), self.shards), "postings")
        n_all, l_all = (int(x or 0) for x in packets.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        weight = F.floor(1000 * F.log(F.lit(2.0 * n_all + 2) / (2.0 * F.col("df") + 1))).cast("long")
        df = _frequencies(packets).join(asked.select("term").distinct(), "term", "left_semi")
        self.weights = C.saved(df.select("term", "df", weight.alias("w")).where("w > 0"), "term-weights")
        top = [(r.term & (2**64 - 1), r.w) for r in self.weights.orderBy(F.desc("df"), "term").limit(FREQUENT).collect()]
        self.frequent = [t - (t >> 63 << 64) for t, _ in top]

        def build(batches):
            held, now = [], None

            def one():
                cols = build_shard(held, n_all, l_all, top)
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([cols[c].tobytes()], pa.binary()) for c in _names(_INDEX)[1:])], names=_names(_INDEX))

            for (sh,), piece in C.pieces(batches, ("sh",)):
                if held and sh != now:
                    yield one()
                    held = []
                now = int(sh)
                held += piece.to_pylist()
            if held:
                yield one()

        dealt = packets.drop("n_docs", "n_terms").repartition(C.partitions(spark, size), "sh").sortWithinPartitions("sh")
        self.table = C.saved(dealt.mapInArrow(build, _INDEX), "index")
        self.parts = C.partitions(spark, size)

    def search(self, items: DataFrame, low: int, high: int, k: int) -> DataFrame:
        """Best of the shards low <= sh < high for items (item_id, ver, floor,
        item_terms, item_weights): ``_FOUND`` rows."""
        spark, n = self.table.sparkSession, high - low
        fan = math.ceil(n / FAN)
        sent = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))))
        if fan > 1:
            sent = sent.repartition(C.partitions(spark, 0), "item_id", "ver", "part")
        first = F.lit(low) + F.col("part") * FAN
        sent = sent.withColumn("sh", F.explode(F.sequence(first, F.least(first + FAN - 1, F.lit(high - 1))))).withColumn("kind", F.lit(1)).drop("part")
        lists = self.table.where(F.col("sh").between(low, high - 1)).withColumn("kind", F.lit(0))
        both = lists.unionByName(sent, allowMissingColumns=True)
        return _sorted_runs(both, min(self.parts, n), _searcher(self.frequent, k), _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """item_id, ver, rank, doc_id, score: the k best documents (doc_id, text)
    with a score above 0 for every item (item_id, text)."""
    asked = C.saved(item_terms(items), "item-terms")
    index = Index(docs, asked, shard_bytes)
    pair = F.sort_array(F.collect_list(F.struct("term", "w")))
    items = asked.join(index.weights, "term").groupBy("item_id", "ver").agg(pair.alias("p"))
    items = C.saved(items.select("item_id", "ver", F.col("p.term").alias("item_terms"), F.col("p.w").alias("item_weights")), "items")
    best, low, high = None, 0, 1
    while low < index.shards:
        high = min(high, index.shards)
        reach = items.withColumn("floor", F.lit(0).cast("long"))
        if best is not None:
            floors = best.groupBy("item_id", "ver").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
            floors = floors.withColumnsRenamed({"item_id": "f_id", "ver": "f_ver"})
            reach = items.join(floors, items["item_id"].eqNullSafe(floors["f_id"]) & (items["ver"] == floors["f_ver"]), "left").select(*items.columns, "floor")
        found = index.search(reach, low, high, k)
        best = C.saved(_ranked(found if best is None else best.drop("rank").unionByName(found), k), "best")
        low, high = high, high * FAN
    return best.select("item_id", "ver", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.load(spark, sf_dir, "documents"), C.load(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH tokens AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), d AS (SELECT doc_id, r, len(ts)::BIGINT AS n, ts FROM tokens WHERE len(ts) > 0
), stat AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark
), p AS (
  SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS t FROM d) GROUP BY ALL
), w AS (
  SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, stat WHERE t IN (SELECT t FROM q) GROUP BY t, nn
), s AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t), stat GROUP BY item_id, r, doc_id
), k AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""
