"""Quality by importance resampling.

Two generative models over hashed n-grams (single tokens and neighbouring
pairs, ``buckets`` hash buckets, smoothed multinomials): one of the target
text, one of the raw corpus.  A document's log importance weight is the sum of
log p_target - log p_raw over its n-grams.  Documents are sampled without
replacement in proportion to their weights by Gumbel top-k: noise
-ln(-ln u), u hashed from the document, is added to the weight, and the k
largest keys are taken.

The weight is measured against ``cut``, the log ratio per n-gram that separates
target from other labelled text best of those that keep a share ``KEEP`` of the
labelled target rows or more, the log odds of the labelled shares are added
(so a few n-grams don't outweigh what is known beforehand).  ``k`` is a
parameter, by default the number of documents above the cut; at a ``temperature`` of 1
documents are drawn in proportion to their weights.  So documents near the
k-th key are sampled, and long texts far from it are as good as certain.

Learning.  The raw model counts every whole text of the corpus.  Target model
and cut come from at most ``sample_rows`` labelled rows (chosen by a hash of
the id; a documented bound).  Counts are summed on Spark; the driver gets two
numbers per bucket and two per sampled row.

Plan.  Two maps over the texts (counts, weights).  The k-th largest key is
found by counting keys in ever finer bins, each a small aggregate; keys never
gather in one place.

Defined cases.  Null and empty texts have no n-grams, a weight of 0, no prior
and are above the cut.  Rows tied with the k-th key are all taken, repeated rows
alike.  Null ids are scored like others.  Without labelled target rows all
weights are 0.  An empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit.llm import arrays as A
from inspectkit.llm import corpus as C

BUCKETS = 1 << 14
SAMPLE_ROWS = 20_000
SMOOTHING = 1.0
KEEP = 0.995
TEMPERATURE = 1.0
SEED = 6
BINS, FEW = 4096, 4096
SLICE = 1 << 20

_SPACE, _WORD, _SIGN = 0, 1, 2
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[0x80:] = _WORD
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _KIND[_a:_b] = _WORD
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_REPEAT = np.uint64(0x2545F4914F6CDD1D)


def buckets_of(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of the n-grams of consecutive texts; a token is a run of
    letters and digits, or of signs.  A token twice in a row is the same pair
    whichever token it is."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _KIND[raw]
    edge = np.ones(len(raw), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    start = np.flatnonzero(edge)
    sums = A.prefix_hash(raw)
    h = A.span_hash(sums, start, np.append(start[1:], len(raw)))
    token = kind[start] != _SPACE
    start, h = start[token], h[token]
    row = np.searchsorted(offsets, start, side="right") - 1
    pair = np.where(h[1:] == h[:-1], _REPEAT, A.mix(A.joined(h[:-1], h[1:])))[row[1:] == row[:-1]]
    value = np.concatenate([h, pair])
    return (value % np.uint64(buckets)).astype(np.int64), np.concatenate([row, row[1:][row[1:] == row[:-1]]])


def _counted(buckets: int):
    """One count per bucket for each task."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = A.bytes_of(batch.column(batch.schema.get_field_index("text")))
            for a, b in A.slices(offsets, SLICE):
                total += np.bincount(buckets_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run


def counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """n-grams of all texts by bucket."""
    rows = docs.select("text").mapInArrow(_counted(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    with C.shuffle_cleanup(docs.sparkSession):
        for r in rows.collect():  # one row per bucket
            out[r.bucket] = r.n
    return out


def _weighed(shared, buckets: int, keep_text: bool = False):
    def run(batches):
        ratio = shared.value
        for batch in batches:
            raw, offsets = A.bytes_of(batch.column(batch.schema.get_field_index("text")))
            n, w = [], []
            for a, b in A.slices(offsets, SLICE):
                bucket, row = buckets_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets)
                n.append(np.bincount(row, minlength=b - a))
                w.append(np.bincount(row, ratio[bucket], minlength=b - a))
            rest = [(c, batch.column(i)) for i, c in enumerate(batch.schema.names) if keep_text or c != "text"]
            n, w = (np.concatenate(x) if x else np.zeros(0) for x in (n, w))
            yield pa.RecordBatch.from_arrays([*(x for _, x in rest), pa.array(n.astype(np.int64)), pa.array(w.astype(np.float64))], names=[*(c for c, _ in rest), "n_grams", "log_weight"])

    return run


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    cut: float
    prior: float = 0.0


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample_rows: int = SAMPLE_ROWS, smoothing: float = SMOOTHING) -> Model:
    """Models and cut; ``labels`` (doc_id, quality) says which rows are target (1)."""
    spark = docs.sparkSession
    docs = C.texts(docs)
    chosen = labels.where("doc_id is not null and quality is not null").select(labels["doc_id"].cast("long").alias("doc_id"), (labels["quality"] > 0).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = C.labelled(docs, chosen, sample_rows)
    raw, target = counts(docs, buckets), counts(rows.where("label"), buckets)
    if not target.sum():
        return Model(np.zeros(buckets), 0.0)

    def logs(c: np.ndarray) -> np.ndarray:
        # smoothed towards the raw corpus, so a bucket unseen in either says little
        prior = (raw + 1.0) / (raw.sum() + buckets)
        return np.log((c + smoothing * prior * buckets) / (c.sum() + smoothing * buckets))

    ratio = logs(target) - logs(raw)
    shared = spark.sparkContext.broadcast(ratio)
    seen = rows.mapInArrow(_weighed(shared, buckets), "label boolean, n_grams long, log_weight double").where("n_grams > 0").toPandas()
    mean = (seen.log_weight / seen.n_grams).to_numpy(float)
    label = seen.label.to_numpy(bool)
    return Model(ratio, _best_cut(mean, label), float(np.log((label.sum() + 1) / ((~label).sum() + 1))))


def _best_cut(value: np.ndarray, label: np.ndarray) -> float:
    """The value, halfway between two neighbours, that has the largest sum of
    both rates among those that keep a share KEEP of the labelled."""
    if label.all() or not label.any():
        return float(value.min()) - 1e-9 if len(value) else 0.0
    order = np.argsort(value, kind="stable")
    v, y = value[order], label[order]
    kept = 1 - np.concatenate([[0], np.cumsum(y)]) / y.sum()
    gone = np.concatenate([[0], np.cumsum(~y)]) / (~y).sum()
    at = int(np.argmax(np.where(kept >= KEEP, kept + gone, -1.0)))
    if at in (0, len(v)):
        return float(v[0] - 1e-9 if at == 0 else v[-1] + 1e-9)
    return float((v[at - 1] + v[at]) / 2)


def weigh(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ver, n_grams, log_weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)
    return C.versioned(docs).mapInArrow(_weighed(shared, len(model.ratio)), "doc_id long, ver int, n_grams long, log_weight double")


def _gumbel(seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "ver", F.lit(seed)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest of a double column, by ever finer bins."""
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    while True:
        here = rows.where((F.col(key) >= low) & (F.col(key) <= high))
        width = (high - low) / BINS
        if n <= FEW or width <= 0 or low + width == low:
            return sorted((r[0] for r in here.select(key).collect()), reverse=True)[k - 1] if n <= FEW else high
        bin_ = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)).alias("bin")
        found = here.groupBy(bin_).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("bin")).collect()
        for r in found:
            if k <= r.n:
                low, high, n = r.low, r.high, r.n
                break
            k -= r.n


def _keyed(rows: DataFrame, model: Model, temperature: float, seed: int) -> DataFrame:
    """rows (doc_id, ver, n_grams, log_weight) with margin and key."""
    prior = F.when(F.col("n_grams") > 0, F.lit(model.prior)).otherwise(F.lit(0.0))
    margin = F.col("log_weight") - F.lit(model.cut) * F.col("n_grams") + prior
    return rows.withColumn("margin", margin).withColumn("key", F.col("margin") / F.lit(temperature) + _gumbel(seed))


def _drawn(docs: DataFrame, model: Model, temperature: float, k: int | None, seed: int) -> tuple[DataFrame, Column]:
    """(stored weights and keys of all rows, whether a key is among the k largest)."""
    with C.shuffle_cleanup(docs.sparkSession):
        rows = C.saved(_keyed(weigh(docs, model), model, temperature, seed), "weights")
    if k is None:
        k = rows.where("margin >= 0").count()
    least = kth_largest(rows, "key", k)
    return rows, F.lit(False) if least is None else F.col("key") >= F.lit(least)


def resample(docs: DataFrame, model: Model, temperature: float = TEMPERATURE, k: int | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, ver, n_grams, log_weight, key and selected of every row: the k
    (by default as many as lie above the cut) largest keys are selected."""
    rows, selected = _drawn(docs, model, temperature, k, seed)
    return rows.select("doc_id", "ver", "n_grams", "log_weight", "key", selected.alias("selected"))


def sample(docs: DataFrame, model: Model, temperature: float = TEMPERATURE, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of docs that ``resample`` selects, with all their columns.  A row's
    key follows from its id and text alone, so it is computed again beside the text
    and compared with the k-th largest; nothing is joined or shuffled."""
    _, selected = _drawn(docs, model, temperature, k, seed)
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)
    other = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("other")
    rows = docs.select(other, docs["text"].cast("string").alias("text"))
    schema = f"other {rows.schema['other'].dataType.simpleString()}, text string, n_grams long, log_weight double"
    rows = rows.mapInArrow(_weighed(shared, len(model.ratio), keep_text=True), schema)
    whole = F.coalesce("text", F.lit(""))
    rows = rows.withColumns({"doc_id": F.col("other.doc_id").cast("long"), "ver": C.version(whole)})
    kept = _keyed(rows, model, temperature, seed).where(selected)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"other.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.load(spark, sf_dir, "documents")
    return resample(docs, fit(docs, C.load(spark, sf_dir, "labels"))).drop("ver")
