"""Shared pieces of the corpus operators: input columns, sizes, text blocks
and shared-folder tables.

Documents are identified inside an operator by (doc_id, ver): ``ver`` is 31
hash bits of the text, so rows that share a doc_id but not a text stay apart,
and repeated rows are one document given twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit.llm import arrays as A
from inspectkit.session import scratch_path

BLOCK_BYTES = 4 << 20
BATCH = "8m"
MOST_BITS = 1 << 27
BITS_A_KEY = 64


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only: further columns, whatever their names, are left out."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def version(text: Column) -> Column:
    """31 hash bits of a text that is not null."""
    return F.shiftrightunsigned(F.xxhash64(text), 33).cast("int")


def versioned(docs: DataFrame) -> DataFrame:
    """(doc_id, ver, text): ver tells apart texts that share a doc_id."""
    return texts(docs).select("doc_id", version(F.col("text")).alias("ver"), "text")


def labelled(docs: DataFrame, chosen: DataFrame, sample_rows: int) -> DataFrame:
    """(text, label) of the rows of ``docs`` with a chosen (doc_id, label): one
    row per distinct (doc_id, text), label; at most ``sample_rows``, by a hash."""
    docs = texts(docs).select("doc_id", F.xxhash64("text").alias("ver"), "text").join(F.broadcast(chosen), "doc_id")
    key = ["doc_id", "ver", "label"]
    keys = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("doc_id", "ver"), *key).limit(sample_rows)
    keys = saved(keys, "labelled-keys")
    rows = docs.join(F.broadcast(keys), key)
    if not keys.where("n > 1").isEmpty():
        rows = rows.where("n = 1").union(rows.where("n > 1").dropDuplicates(key))
    return saved(rows.select("text", "label"), "labelled")


def measure(docs: DataFrame) -> tuple[int, int]:
    """(rows, UTF-8 bytes) of the texts: one aggregate row for sizing."""
    n, b = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return int(n or 0), int(b or 0)


def partitions(spark: SparkSession, size: int, per: int = 12 << 20) -> int:
    """Tasks for ``size`` bytes of working data: never fewer than the session's
    own number, more where a task's share would exceed ``per`` bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / per), 1)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write into the shared folder and read back: cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class KeyBitmap:
    """A stored table of distinct keys (one long column, ``key``) as a bitmap of their
    hashes: some 64 bits a key and MOST_BITS (16 MB) at most, so it can be
    broadcast whatever the number of keys.  No key of the table is missed; of
    other keys few share a bit (more, once the bitmap no longer grows)."""

    def __init__(self, keys: DataFrame):
        self.bits = min(MOST_BITS, max(1 << 15, 1 << (BITS_A_KEY * keys.count()).bit_length()))
        at = self.position(F.col("key"))
        bitmap = keys.groupBy(F.bitmap_bucket_number(at).alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
        self.bitmap = saved(bitmap, "bitmap")

    def position(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits)) + 1

    def mark(self, rows: DataFrame, key: Column) -> DataFrame:
        """rows with ``__open``: false where the key is none of the table's."""
        rows = rows.withColumn("__at", self.position(key)).withColumn("__part", F.bitmap_bucket_number("__at"))
        bit = F.bitmap_bit_position("__at")
        byte = F.conv(F.hex(F.expr("substring(__bits, cast(bitmap_bit_position(__at) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        is_set = F.getbit(byte, (bit % 8).cast("int")) == 1
        marked = rows.join(F.broadcast(self.bitmap), "__part", "left").withColumn("__open", F.coalesce(is_set, F.lit(False)))
        return marked.drop("__at", "__part", "__bits")


@contextmanager
def settings(spark: SparkSession, new: dict[str, str]):
    """The jobs inside run with these settings."""
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def shuffle_cleanup(spark: SparkSession):
    """Shuffle files of the jobs inside go when each job ends (their results
    are tables in the shared folder by then), so rounds don't add up on disk;
    and texts go to Python workers in batches of ``BATCH`` bytes (or one text)."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": BATCH})


def ident(doc_id: np.ndarray, ver: np.ndarray) -> np.ndarray:
    """One key per (doc_id, ver), for lookups inside one block."""
    return A.mix(A.mix(doc_id.view(np.uint64)) ^ (ver.astype(np.int64).view(np.uint64) << np.uint64(17)))


def block_of(doc_id: np.ndarray, ver: np.ndarray, n_blocks: int) -> np.ndarray:
    return (ident(doc_id, ver) % np.uint64(n_blocks)).astype(np.int64)


def n_blocks(size: int) -> int:
    return max(1, math.ceil(size / BLOCK_BYTES))


def text_batches(batches, most: int = A.SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, ver, bytes, offsets) of slices of (doc_id, ver, text) batches, of ``most`` bytes or one text."""
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        doc, ver = A.ids_of(col["doc_id"]), col["ver"].to_numpy(zero_copy_only=False)
        raw, offsets = A.bytes_of(col["text"])
        for a, b in A.slices(offsets, most):
            yield doc[a:b], ver[a:b], raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


BLOCK_SCHEMA = "dest int, doc_id binary, ver binary, size binary, text binary"


def blocked(docs: DataFrame, blocks: int) -> DataFrame:
    """Texts gathered by block of documents, compressed: one row per slice and
    block.  A block holds about BLOCK_BYTES of text whatever the input size."""

    def pack(batches):
        codec = pa.Codec("zstd", 1)
        for doc, ver, raw, offsets in text_batches(batches):
            dest = block_of(doc, ver, blocks)
            order = np.argsort(dest, kind="stable")
            sizes = np.diff(offsets)[order]
            flat = raw[np.repeat(offsets[:-1][order], sizes) + A.spans(sizes)] if len(raw) else raw
            out = A.packed(dest, doc_id=doc, ver=ver, size=np.diff(offsets))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = np.flatnonzero(np.diff(dest[order], prepend=-1))
            cut = ends[np.append(at, len(order))]
            data = [codec.compress(flat[x:y].tobytes(), asbytes=True) for x, y in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(data, pa.binary())], names=[*out.schema.names, "text"])

    return docs.mapInArrow(pack, BLOCK_SCHEMA)


def unpacked(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, ver, bytes, offsets) of each packed row of a block."""
    codec = pa.Codec("zstd")
    for row in table.select(["doc_id", "ver", "size", "text"]).to_pylist():
        sizes = np.frombuffer(row["size"], np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(codec.decompress(row["text"], int(offsets[-1]), asbytes=True), np.uint8) if offsets[-1] else np.empty(0, np.uint8)
        yield np.frombuffer(row["doc_id"], np.int64), np.frombuffer(row["ver"], np.int32), raw, offsets


def with_messages(docs: DataFrame, blocks: int, messages: DataFrame, fn, schema: str) -> DataFrame:
    """Bring messages (dest = block, packed columns) to the texts they are
    about and apply ``fn(block table, message table)``; every group is one
    bounded block and what was found about its documents."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return fn(left, right)

    return blocked(docs, blocks).groupBy("dest").cogroup(messages.groupBy("dest")).applyInArrow(both, schema)


def pieces(batches, keys: tuple[str, ...]):
    """(key values, slice of a batch) of neighbouring rows that share the keys."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new), b.num_rows]
        for x, y in zip(cuts[:-1], cuts[1:]):
            yield tuple(c[x] for c in cols), b.slice(x, y - x)


def runs(batches, keys: tuple[str, ...]):
    """Tables of the rows that share the keys, from batches sorted by them."""
    held, last = [], None
    for now, piece in pieces(batches, keys):
        if held and now != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(piece)
        last = now
    if held:
        yield pa.Table.from_batches(held)
