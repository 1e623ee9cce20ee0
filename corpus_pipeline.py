"""A corpus from raw documents to packed batches, in five stages; each is written as Parquet and read again by the next.

quality rules -> n-gram Jaccard join -> suffix-array dedup -> mixing sources -> packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.llm import jaccard, mixing, packing, quality, suffix_dedup
from panelflow.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. A null text counts as empty and goes; repeated rows, null ids and further columns stay as they are."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id.

    Rows with a null id belong to no group and stay; of equal rows with one id, one stays.
    """
    stay = jaccard.join_documents(docs, n=5, num=80, den=100).where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that an earlier document has; documents without a word left go."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes some of it: a source's words exceed its target by less than a document, and none is lost.

    Documents without a word go; of rows that repeat an id, each counts as often as the most taken of them; the null source is a
    source like others, and so is the null id an id; an empty table stays empty.
    """
    mixed = mixing.mix_sources(docs.select("doc_id", "text", "source")).where("size > 0")
    mixed = mixed.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("times")).where("times > 0")
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of docs clashes
    out = docs.toDF(*names).join(mixed, F.col(names[docs.columns.index("doc_id")]).eqNullSafe(F.col("id")))
    return out.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*names).toDF(*docs.columns)


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket and batch of each document; null and empty texts, repeated rows and null ids are packed each, an empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("batches", batches),
]

#: SQL can't shuffle bytes of overlapping passages away in reasonable time; tests/llm hold it against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
