"""Exact dedup by progressive refinement: length, prefix hash, full hash.

Texts are equal if they are identical after A-Z became a-z.  Rows are grouped
by the length of their text, then those of shared lengths by a hash of length
and first characters, and only the rows whose prefix group has company have
their whole text hashed (SHA-256); the groups of that hash are the answer.

Plan.  Every refinement is an aggregate of one number per row, combined before
its shuffle.  Which groups have company goes back to the rows as a bitmap of
hashed keys: at most ``corpus.MOST_BITS`` bits (16 MB) whatever the input, so it is
broadcast and no text is ever shuffled.  A key that meets another's bit keeps
its rows one round longer and changes nothing.  The last scan writes a narrow
table (id, hash, what the caller wants beside them); groups are aggregated
from it and joined back to it.  Of the groups with a thousandth of all rows or
more there are a thousand at most: those are broadcast, so no join key is hot.

Defined cases.  A null text is an empty one, equal to every empty text.  A null
id is smaller than any other, and a group without ids keeps one row and names
no id.  Of rows that share the largest id of their group, exactly one stays.
An empty table gives an empty result; further columns, whatever their names,
are ignored by ``find_copies`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit.llm import corpus as C
from inspectkit.llm.arrays import NULL_ID

PREFIX = 128  # characters
HOT = 1000


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def by_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def by_prefix(text: Column) -> Column:
    return F.xxhash64(F.octet_length(text), lowered(F.substring(text, 1, PREFIX)))


class Company(C.KeyBitmap):
    """Bitmap of the keys that more than one row has."""

    def __init__(self, keys: DataFrame):
        many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        super().__init__(C.saved(many, "company"))


def _open(rows: DataFrame, text: Column) -> DataFrame:
    """rows with ``__key``: the hash of the whole text, null where length and
    prefix already show that no other row equals it."""
    lengths = Company(rows.select(by_length(text).alias("key")))
    shared = lengths.mark(rows.select(text.alias("__text")), by_length(F.col("__text"))).where("__open")
    prefixes = Company(shared.select(by_prefix(F.col("__text")).alias("key")))
    marked = prefixes.mark(rows, by_prefix(text))
    return marked.withColumn("__key", F.when(F.col("__open"), F.unhex(F.sha2(lowered(text), 256)))).drop("__open")


def find_copies(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept.  ``carry``:
    further columns of the result, computed from doc_id and text in the scan."""
    carry = carry or {}
    rows = _open(C.texts(docs), F.col("text")).withColumns(carry)
    table = C.saved(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "__key", *carry), "copies")
    order = F.coalesce("doc_id", F.lit(int(NULL_ID)))
    groups = table.where("__key is not null").groupBy("__key").agg(
        F.max_by("doc_id", order).alias("keep_id"), F.max_by("row", order).alias("keep_row"), F.count(F.lit(1)).alias("n"))
    groups = C.saved(groups.where("n > 1"), "copy-groups")
    total = table.count()
    hot = F.broadcast(groups.where(F.col("n") * HOT >= total))
    alone = table.where("__key is null").select("*", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), F.lit(None).cast("long").alias("n"))
    table = table.where("__key is not null")
    few = table.join(hot.select("__key"), "__key", "left_anti").join(groups.where(F.col("n") * HOT < total), "__key", "left")
    joined = alone.unionByName(table.join(hot, "__key", "inner")).unionByName(few)
    single = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        *carry,
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.  Only texts that may
    have a copy are shuffled, to where one row of each group is chosen."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    marked = _open(docs.withColumn("__whole", text), F.col("__whole"))
    rows = marked.withColumn("__id", F.coalesce(docs["doc_id"].cast("long"), F.lit(int(NULL_ID))))
    open_ = rows.where("__key is not null")
    best = C.saved(open_.groupBy("__key").agg(F.max("__id").alias("__id")), "kept-copies")
    kept = open_.join(best, ["__key", "__id"], "left_semi").dropDuplicates(["__key"])
    return rows.where("__key is null").select(docs.columns).unionByName(kept.select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(C.load(spark, sf_dir, "documents"), {"text_sha256": F.sha2(lowered(F.col("text")), 256)})


SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
