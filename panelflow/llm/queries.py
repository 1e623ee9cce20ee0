"""The registered queries of this subpackage: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.llm import centroids, html_extract, jaccard, langid, lm_score, mixing, packing, quality, ranked_search, suffix_dedup, token_counts, topk, toxicity
from panelflow.llm.common import learn_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(learn_fold(F.col("doc_id"))))
    return langid.predict(documents, model).select("doc_id", (~learn_fold(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    fold = learn_fold(F.col("doc_id"))
    model = toxicity.fit(documents.where(fold), _table(spark, sf_dir, "labels").where(fold))
    scored = toxicity.predict(documents, model)
    return scored.select("doc_id", (~fold).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & topk.usable(F.col("embedding")))
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), topk.quantize(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    vocabulary = lm_score.count_words(documents)
    coded = lm_score.encode(documents, vocabulary)
    return lm_score.score(documents, vocabulary, lm_score.train(documents, vocabulary, coded=coded), coded=coded)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_slot")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digest(_table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), token_counts.public_vocabulary("byte_bpe_50k.json"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_top_k": op4_top_k,
    "op5_lm_score": op5_lm_score,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mix": op7_source_mix,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_html_extract": op9_html_extract,
    "op10_packing": op10_packing,
    "op11_centroids": op11_centroids,
    "op12_token_counts": op12_token_counts,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": jaccard.ORACLE_SQL,
    "op4_top_k": topk.ORACLE_SQL,
    "op6_quality_rules": quality.ORACLE_SQL,
    "op7_source_mix": mixing.ORACLE_SQL,
    "op8_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op10_packing": packing.oracle_sql(),
    "op11_centroids": centroids.oracle_sql(),
    "op13_ranked_search": ranked_search.ORACLE_SQL,
}
