"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards; a node weighs what its shards weigh.
A row descends from the root: at each level every child draws
-ln(u) / weight, with u in (0, 1) hashed from the row's key and the child's
name, and the least draw wins, so children win in proportion to their weights.
A draw depends on nothing but the key, the child and its weight: when weights
change in one subtree, rows move only into or out of that subtree (and between
children inside it), and a subtree that is added takes rows only into itself.

``grown`` adds a shard as a region of its own.  No weight of the old tree
changes by that, so one more shard takes rows only into itself.  (Added to an
old rack it would raise that rack's and region's weight; rows drawn to the
region could then land on its other shards.)

Slots number the rows of a shard from 0 without gaps: rows are numbered inside
their task, the numbered rows are written to the shared folder once, and the
counts per task and shard (tasks x shards rows) give each task its offset.  No
shard passes through one task.  Placement is column expressions; the numbering
keeps one counter per shard.

Defined cases.  Null texts have size 1 and the checksum of no bytes.  Rows
with a null key go to one shard, as rows with any other equal key do, and each
row has its own slot.  An empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inspectkit.llm import corpus as C

SHARDS = 16
RACK_SHARDS, REGION_RACKS = 4, 2
LAW = "key"


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int = SHARDS, rack_shards: int = RACK_SHARDS, region_racks: int = REGION_RACKS) -> tuple[Shard, ...]:
    """Equal shards 0..n-1, filled rack by rack."""
    return tuple(Shard(i // (rack_shards * region_racks), i // rack_shards % region_racks, i) for i in range(shards))


def grown(old: tuple[Shard, ...], weight: float = 1.0) -> tuple[Shard, ...]:
    """One more shard, as a region of its own."""
    return (*old, Shard(max(s.region for s in old) + 1, 0, max(s.shard for s in old) + 1, weight))


def _least(key: Column, children: list[tuple[str, int, float]]) -> Column:
    """The child (name, value, weight) with the least draw, as its value."""
    if len(children) == 1:
        return F.lit(children[0][1])
    draws = []
    for name, value, weight in children:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
        draws.append(F.struct((-F.log(u) / F.lit(weight)).alias("draw"), F.lit(value).alias("value")))
    return F.array_min(F.array(*draws))["value"]


def shard_of(key: Column, shards: tuple[Shard, ...]) -> Column:
    """The shard of a key, descending region, rack and shard."""
    shards = tuple(s for s in shards if s.weight > 0)
    if not shards or len({s.shard for s in shards}) < len(shards):
        raise ValueError("shards need distinct numbers, one of them a weight above 0")

    def weight(chosen) -> float:
        return float(sum(s.weight for s in chosen))

    def chain(of: Column, branches: dict[int, Column]) -> Column:
        (first, *rest) = branches.items()
        out = first[1]
        for value, branch in rest:
            out = F.when(of == value, branch).otherwise(out)
        return out

    regions = sorted({s.region for s in shards})
    inside = {}
    for g in regions:
        here = [s for s in shards if s.region == g]
        racks = sorted({s.rack for s in here})
        last = {k: _least(key, [(f"s{s.shard}", s.shard, float(s.weight)) for s in here if s.rack == k]) for k in racks}
        rack = _least(key, [(f"k{g}.{k}", k, weight(s for s in here if s.rack == k)) for k in racks])
        inside[g] = chain(rack, last)
    region = _least(key, [(f"g{g}", g, weight(s for s in shards if s.region == g)) for g in regions])
    return chain(region, inside).cast("int")


def _numbered():
    def run(batches):
        next_free: dict[int, int] = {}
        for b in batches:
            shard = b.column(b.schema.get_field_index("shard")).to_numpy()
            seq = np.empty(len(shard), np.int64)
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                first = next_free.get(int(s), 0)
                seq[at] = np.arange(first, first + len(at))
                next_free[int(s)] = first + len(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq)], names=[*b.schema.names, "seq"])

    return run


def place(docs: DataFrame, shards: tuple[Shard, ...], more: tuple[Shard, ...] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard: the shard
    under the tree ``more`` (by default one more shard of weight 1)."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    utf8 = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    key = F.col("doc_id")
    rows = docs.select(
        "doc_id", (F.octet_length(utf8).cast("long") + 1).alias("size"), F.crc32(utf8).alias("text_crc32"),
        shard_of(key, shards).alias("shard"), shard_of(key, more or grown(shards)).alias("grown_shard"),
        F.spark_partition_id().alias("task"),
    )
    schema = "doc_id long, size long, text_crc32 long, shard int, grown_shard int, task int, seq long"
    rows = C.saved(rows.mapInArrow(_numbered(), schema), "placed")
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("task", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("task", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return rows.join(counts, ["task", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("offset") + F.col("seq")).alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(C.load(spark, sf_dir, "documents"), tree(SHARDS))
