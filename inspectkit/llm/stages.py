"""Pipeline stages: (spark, docs, sf_dir) -> DataFrame with the documents' columns.

Each stage runs its operator with production parameters over all rows it is
given and applies the operator's decisions.  Rows are matched to decisions by
(doc_id, version of the text), null ids included, so repeated rows and rows
that share an id with another text get their own decision.  Whole texts are
joined only where a decision may concern them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inspectkit.llm import bpe, contamination, jaccard, quality, substring
from inspectkit.llm import corpus as C

#: Near duplicates of the pipeline: five words, a similarity of 0.8.
NEAR_SHINGLE, NEAR_NUM, NEAR_DEN = 5, 80, 100
READ_ROWS = "512"


def _bounded(stage: Callable) -> Callable:
    """The jobs that a stage runs take few rows at a time: a batch of whole texts is
    held by the reader, on its way to Python and there.  Shuffle files go when a job ends."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with C.shuffle_cleanup(spark), C.settings(spark, {"spark.sql.parquet.columnarReaderBatchSize": READ_ROWS}):
            return stage(spark, docs, sf_dir)

    return run


def _keyed(docs: DataFrame, version: Column) -> DataFrame:
    """docs with what operators identify a row by, in names no table has."""
    return docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__ver": version})


def _matched(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """docs (keyed) joined with found (doc_id, ver, ...)."""
    found = found.withColumnsRenamed({"doc_id": "__f_doc", "ver": "__f_ver"})
    return docs.join(found, docs["__doc"].eqNullSafe(found["__f_doc"]) & (docs["__ver"] == found["__f_ver"]), how)


def _parted(keyed: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (keyed) that are none of ``found`` (doc_id, ver; stored), and those that
    may be: few more than ``found`` has.  Only the latter, with their texts,
    need a join; which they are is told by a bitmap of bounded size."""
    keys = found.select(F.xxhash64("doc_id", "ver").alias("key")).distinct()
    marked = C.KeyBitmap(C.saved(keys, "keys")).mark(keyed, F.xxhash64("__doc", "__ver"))
    return marked.where("not __open").drop("__open"), marked.where("__open").drop("__open")


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    rest, maybe = _parted(keyed, gone)
    return rest.unionByName(_matched(maybe, gone, "left_anti"))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


@_bounded
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling rejects go."""
    drawn = quality.resample(docs, quality.fit(docs, C.load(spark, sf_dir, "labels")))
    rejected = C.saved(drawn.where("not selected").select("doc_id", "ver").distinct(), "rejected")
    return _without(_keyed(docs, C.version(_text())), rejected).select(docs.columns)


@_bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the
    smallest id (none before all), of those the one with the least version.
    Of repeated rows one stays; documents without words stay, each row of them
    if it has no id either.  Versions are 64 bits here: an id, or no id, may be
    that of any share of the rows."""
    found = jaccard.decisions(docs, NEAR_SHINGLE, NEAR_NUM, NEAR_DEN)
    stays = F.expr("n = 0 or (doc_id <=> rep_id and ver = rep_ver)").alias("stays")
    decided = found.groupBy("doc_id", "ver", stays, F.expr("n > 0 or doc_id is not null").alias("once")).agg(F.count(F.lit(1)).alias("rows"))
    decided = C.saved(decided.where("not stays or (once and rows > 1)"), "near-duplicates")
    kept = _without(_keyed(docs, jaccard.version(F.col("text"))), decided.where("not stays").select("doc_id", "ver"))
    repeats = decided.where("stays").select("doc_id", "ver")
    if repeats.isEmpty():
        return kept.select(docs.columns)
    rest, maybe = _parted(kept, repeats)
    once = _matched(maybe, repeats, "left_semi").dropDuplicates(["__doc", "text"])
    return rest.unionByName(once).unionByName(_matched(maybe, repeats, "left_anti")).select(docs.columns)


@_bounded
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated word windows leave the texts; the first occurrence stays.  The
    words of every text are joined by one space."""
    found = substring.dedup_substrings(docs).where("n_removed > 0").select("doc_id", "ver", F.col("kept").alias("__kept"))
    found = C.saved(found, "cut-texts")
    rest, maybe = _parted(_keyed(docs, C.version(_text())), found)
    words = F.trim(F.regexp_replace(_text(), r"[\x20\x09-\x0D]+", " "))
    cut = _matched(maybe, found, "left").withColumn("text", F.coalesce("__kept", words)).select(docs.columns)
    out = rest.withColumn("text", words).select(docs.columns).unionByName(cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


@_bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contamination.find(docs, C.load(spark, sf_dir, "benchmark")).select("doc_id", "ver").distinct()
    return _without(_keyed(docs, C.version(_text())), C.saved(found, "contaminated")).select(docs.columns)


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked by decoding them."""
    return bpe.digests(bpe.encode(docs, bpe.vocabulary_path()))
