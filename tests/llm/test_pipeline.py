"""The pipeline stage by stage against plain versions, on the smallest tables."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelflow.llm.common import materialize
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_follow_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality_rules":
            rows = [r for r in rows if brute.kept(r[1])]
        elif name == "near_duplicates":
            root = brute.components([(r[0], r[1]) for r in rows], 5, 80, 100)
            rows = [r for r in rows if root[r[0]] == r[0]]
        elif name == "repeated_passages":
            cut = [(r[0], k.decode("utf-8", "ignore") if gone else r[1], *r[2:4]) for r, (k, _, gone, _) in zip(rows, brute.removed([(r[0], r[1]) for r in rows]), strict=True)]
            rows = [(*r, len(r[1])) for r in cut if brute.words(r[1])]
        elif name == "source_mix":
            mixed = brute.taken([(r[0], r[1], r[3]) for r in rows])
            rows = [r for r, (n, _, _, took, _) in zip(rows, mixed, strict=True) for _ in range(-(-took // n))]
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert Counter(tuple(r) for r in docs.collect()) == Counter(rows), name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert Counter(r["doc_id"] for r in packed.collect()) == Counter(r[0] for r in rows)


def test_stages_keep_clashing_columns(spark):
    """Extra columns with the names that stages use themselves: the same documents, and the columns as they were."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    extra = {c: F.lit("x") for c in ("n_words", "_text", "rejected_by", "_id", "_times", "_turn", "id", "times", "turn", "c0", "component_id", "spans", "target", "taken", "size")}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, odd = stage(spark, docs, SF), stage(spark, docs.withColumns(extra), SF)
        assert odd.columns == [*docs.columns, *extra]
        assert Counter(map(tuple, odd.collect())) == Counter((*r, *["x"] * len(extra)) for r in map(tuple, plain.collect())), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.withColumns(extra), SF).count() == docs.count()


def test_run_and_odd_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    text = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(None, text, "en", "a", 1), (1, text + " again", None, None, None), (1, text + " again", None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("rep", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
