"""The corpus pipeline: each stage reads what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inspectkit.llm import corpus as C
from inspectkit.llm import stages

STAGES = [
    ("quality_filter", stages.quality_filter),
    ("near_duplicates", stages.near_duplicates),
    ("substring_dedup", stages.substring_dedup),
    ("decontamination", stages.decontamination),
    ("bpe_codec", stages.bpe_codec),
]

#: SQL cannot express the stages (a trained model, similarity components, edit
#: distance, BPE merges); tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's result is written to the
    shared folder and read by the next."""
    docs = C.load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
