"""Exact top-k inner products, by multi-resolution segment statistics.

Vectors become the integers floor(scale * x).  For a segment of l components
with means m and deviations s,

    |q - x|^2 >= sum l * ((mq - mx)^2 + (sq - sx)^2),

which is, with the norms known, an upper bound of the inner product:
q.x <= sum l * (mq * mx + sq * sx).  Bounds are taken with few long segments
first and with more, shorter ones for the pairs still open; pairs whose bound
is below the k-th best score so far leave, and the rest are computed exactly.
The bound with a margin for rounding never drops a pair that belongs.

Plan.  Candidates are dealt to shards of ``shard_rows`` rows at most, by their place.
Queries stay a table; each goes to the shards in two steps of ``FAN`` copies, so
none passes through the driver, and the plan is the same for any number of
them.  A task holds one shard and takes the queries block by block.  Rounds
cover 1, 64, 4096 ... shards: the k-th best score of a query so far is the floor
that its next shards start with, so what a round returns stays near ``FAN`` times
the result.

Defined cases.  Vectors that are null or hold null or non-finite components,
and rows with a null id, take no part.  Scores are between vectors of equal
length.  A candidate with the query's own id is the query's own row.  Of query rows that
share an id one counts, repeated candidates as often as they are.  Ties go to the
smaller id.  An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inspectkit.llm import corpus as C

K, SCALE = 10, 1024.0
QUERY_BLOCK = 1024
SEGMENTS = (1, 4, 16)
CHUNK = 2048
SHARD_ROWS, LEAST_ROWS = 16384, 512
FAN = 64
_EXACT = float(1 << 53)


def vectors(ids: pa.Array, lists: pa.Array, scale: float):
    """(ids, matrix of integer-valued doubles) for each length, usable rows only."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = pa.compute.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are nan
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    known = ~np.asarray(ids.is_null())
    number = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    for d in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero((size == d) & known)
        x = flat[start[at][:, None] + np.arange(d)[None, :]]
        fine = np.isfinite(x).all(axis=1)
        yield d, number[at[fine]], np.floor(scale * x[fine])


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment sqrt(l) * mean and sqrt(l) * deviation: the dot product of
    two such rows is the bound."""
    d = x.shape[1]
    cuts = np.unique(np.linspace(0, d, min(segments, max(d, 1)) + 1).astype(int))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = x[:, a:b]
        out += [part.mean(axis=1) * math.sqrt(b - a), part.std(axis=1) * math.sqrt(b - a)]
    return np.stack(out, axis=1) if out else np.zeros((len(x), 1))


class Best:
    """The k best candidates of every query of a block, with at least its floor."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, x, k
        self.levels = [statistics(x, s) for s in SEGMENTS]
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.open = np.zeros(len(SEGMENTS) + 1, np.int64)  # pairs: all, and open after each level
        self.query = np.empty(0, np.int64)
        self.cand = np.empty(0, np.int64)
        self.score = np.empty(0, object)

    def _exact(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if x.size and float(np.abs(x).max()) * float(np.abs(self.x).max()) * x.shape[1] >= _EXACT:
            return np.array([sum(int(a) * int(b) for a, b in zip(x[p], self.x[q])) for p, q in zip(i, j)], object)
        out = np.empty(len(i), np.int64)
        for a in range(0, len(i), 1 << 15):
            b = slice(a, a + (1 << 15))
            out[b] = np.einsum("nd,nd->n", x[i[b]], self.x[j[b]]).astype(np.int64)
        return out

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm = np.sqrt((x * x).sum(axis=1))
        slack = 1e-9 * np.outer(norm + 1, self.norm + 1) + 1e-6
        open_ = ids[:, None] != self.ids[None, :]
        rows = np.arange(len(ids))
        self.open[0] += open_.sum()
        for level, (segments, own) in enumerate(zip(SEGMENTS, self.levels)):
            bound = statistics(x[rows], segments) @ own.T + slack[rows]
            open_[rows] &= bound >= self.floor[None, :]
            self.open[level + 1] += open_[rows].sum()
            rows = rows[open_[rows].any(axis=1)]
            if not len(rows):
                return
        i, j = np.nonzero(open_)
        score = self._exact(x, i, j)
        keep = np.array(score >= self.floor[j], bool)
        self._merge(j[keep], ids[i[keep]], score[keep])

    def _merge(self, query: np.ndarray, cand: np.ndarray, score: np.ndarray) -> None:
        query, cand = np.concatenate([self.query, query]), np.concatenate([self.cand, cand])
        score = np.concatenate([self.score, score]) if len(self.score) else score
        order = np.lexsort((cand, -score, query))
        query, cand, score = query[order], cand[order], score[order]
        first = np.searchsorted(query, np.arange(len(self.ids) + 1))
        rank = np.arange(len(query)) - first[query]
        keep = rank < self.k
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[query[last]] = score[last].astype(float)
        self.query, self.cand, self.score = query[keep], cand[keep], score[keep]


_FOUND = "query_id long, vec_id long, score long"


def _searcher(k: int, scale: float, block: int):
    """From rows sorted by (sh, kind): a shard's candidates (kind 0), then its queries."""

    def best_of(shard, ids, x, floor):
        best = Best(ids, x, k, floor)
        step, a = 64, 0  # a few first, so that floors are up for the rest
        while a < len(shard[0]):
            best.add(shard[0][a : a + step], shard[1][a : a + step])
            a, step = a + step, min(CHUNK, step * 4)
        return best

    def run(batches):
        shard, now = {}, None
        for (sh, kind), piece in C.pieces(batches, ("sh", "kind")):
            if sh != now:
                shard, now = {}, sh
            ids, lists = piece.column(2), piece.column(3)
            if kind == 0:
                for d, own, x in vectors(ids, lists, scale):
                    shard.setdefault(d, []).append((own, x))
                continue
            shard = {d: v if isinstance(v, tuple) else tuple(map(np.concatenate, zip(*v))) for d, v in shard.items()}
            for a in range(0, len(ids), block):
                # of one block, by length; floors are found again by id
                floors = dict(zip(ids[a : a + block].to_pylist(), piece.column(4)[a : a + block].to_pylist()))
                for d, own, x in vectors(ids[a : a + block], lists[a : a + block], scale):
                    if d not in shard:
                        continue
                    floor = np.array([-np.inf if floors[i] is None else np.nextafter(float(floors[i]), -np.inf) for i in own.tolist()])
                    best = best_of(shard[d], own, x, floor)
                    if len(best.query):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(best.ids[best.query]), pa.array(best.cand), pa.array([int(s) for s in best.score], pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def _round(dealt: DataFrame, asked: DataFrame, low: int, high: int, k: int, scale: float, block: int) -> DataFrame:
    """Best of the shards low <= sh < high for the queries (vec_id, embedding, floor)."""
    tasks = C.partitions(dealt.sparkSession, 0)
    fan = math.ceil((high - low) / FAN)
    sent = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))))
    if fan > 1:
        sent = sent.repartition(tasks, "vec_id", "part")
    first = F.lit(low) + F.col("part") * FAN
    sh = F.explode(F.sequence(first, F.least(first + FAN - 1, F.lit(high - 1)))).alias("sh")
    sent = sent.select(sh, F.lit(1).alias("kind"), "vec_id", "embedding", "floor")
    held = dealt.where(F.col("sh").between(low, high - 1)).select("sh", F.lit(0).alias("kind"), "vec_id", "embedding", F.lit(None).cast("long").alias("floor"))
    rows = held.unionByName(sent).repartition(min(high - low, 4 * tasks), "sh").sortWithinPartitions("sh", "kind")
    return rows.mapInArrow(_searcher(k, scale, block), _FOUND)


def search(rows: DataFrame, is_query: Column, k: int = K, scale: float = SCALE, block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows (vec_id,
    embedding) for every row that ``is_query`` holds for."""
    asked = rows.where(is_query).select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"]).where("vec_id is not null").dropDuplicates(["vec_id"])
    asked = C.saved(asked, "queries")
    rows = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["embedding"])
    n, tasks = rows.count(), C.partitions(rows.sparkSession, 0)
    shards = max(1, math.ceil(n / shard_rows), min(tasks, n // LEAST_ROWS))
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")
    dealt = C.saved(rows.withColumn("sh", place), "vectors")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best, low, high = None, 0, 1
    while low < shards:
        high = min(high, shards)
        reach = asked.withColumn("floor", F.lit(None).cast("long"))
        if best is not None:
            floors = best.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
            reach = asked.join(floors, "vec_id", "left")
        found = _round(dealt, reach, low, high, k, scale, block)
        found = found if best is None else best.drop("rank").unionByName(found)
        best = C.saved(found.withColumn("rank", rank).where(F.col("rank") <= k), "best")
        low, high = high, high * FAN
    return best.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
