"""The pipeline's stages: decisions take effect, columns stay, rows add up."""

import corpus_pipeline
from inspectkit.llm import corpus as C
from inspectkit.llm import bpe, contamination, jaccard, stages, substring

from . import data

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_duplicates", "substring_dedup", "decontamination", "bpe_codec"]


def test_run_over_the_small_table(spark):
    docs = C.load(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = C.saved(stage(spark, docs, SF), name)
        assert after.columns == COLUMNS and 0 < after.count() <= docs.count()
        before, docs = docs, after
        if name == "near_duplicates":
            left = jaccard.components(docs, 5, 80, 100)
            assert left.where("doc_id <> component_id").isEmpty()
            found = jaccard.components(before, 5, 80, 100).where("doc_id = component_id")
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in found.collect())
        if name == "substring_dedup":
            want = {r.doc_id: r.kept for r in substring.dedup_substrings(before).collect()}
            assert all(r.text == want[r.doc_id] and r.n_chars == len(r.text) for r in docs.collect())
        if name == "decontamination":
            assert contamination.find(docs, C.load(spark, SF, "benchmark")).isEmpty()
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert got == sorted(map(tuple, bpe.digests(bpe.encode(docs, bpe.vocabulary_path())).collect()))


def test_edge_rows_pass_every_stage(spark):
    docs = data.documents(spark)
    kept = stages.near_duplicates(spark, docs, SF).collect()
    ids = [r.doc_id for r in kept]
    assert {4, 5, 6, 7, 8} <= set(ids) and 9 not in ids  # "One Two" equals "one two"
    cut = stages.substring_dedup(spark, docs, SF)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert stages.decontamination(spark, docs, SF).count() == docs.count()
    judged = stages.quality_filter(spark, docs, SF)
    assert judged.columns == docs.columns and judged.where("text is null").count() == 2


def test_empty_table(spark):
    docs = data.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def near(seed, change=()):
    """A text of 200 words, and copies of it with some words changed."""
    words = [f"w{seed}x{k}" for k in range(200)]
    for k in change:
        words[k] = f"changed{k}"
    return " ".join(words)


def test_near_duplicates_of_rows_that_share_an_id(spark):
    """Each (id, text) has its own decision: of a group one row stays, whatever its id."""
    rows = [
        (0, near(1)), (1, near(1, [50])), (1, near(2)), (5, near(2, [7])),  # U of id 1 is its group's least
        (1, near(3)), (1, near(4)), (1, near(4)),  # clean; clean and repeated
        (None, near(5)), (None, near(5)), (None, near(5, [9])), (None, near(6)), (9, near(6, [3])),
        (None, None), (None, None), (8, ""), (8, None), (8, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = data.pairs(stages.near_duplicates(spark, docs, SF))
    sure = [(0, near(1)), (1, near(2)), (1, near(3)), (1, near(4)), (None, near(6)), (None, None), (None, None), (8, ""), (8, None)]
    (one,) = [r for r in kept if r in rows[7:10]]
    assert sorted(kept, key=repr) == sorted([*sure, one], key=repr)
