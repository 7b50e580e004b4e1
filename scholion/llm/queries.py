"""The registered queries of the operators, each over its whole table, and SQL where it can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import language_id, license_scan, oracles as sql, oracles_exact as exact, quality
from scholion.llm.common import bucket, table
from scholion.llm.decontamination import find_leaks
from scholion.llm.embedding_dedup import link_embeddings
from scholion.llm.html_text import extract
from scholion.llm.merkle import audit
from scholion.llm.minhash_dedup import near_duplicates
from scholion.llm.packing import pack_documents
from scholion.llm.resampling import resample
from scholion.llm.sharding import shard_rows
from scholion.llm.suffix_dedup import span_report
from scholion.llm.token_counts import token_report


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_report(table(spark, sf_dir, "documents"), vocabulary)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").where(bucket("doc_id", 5) != 0)
    scored = quality.score(docs, quality.fit(docs, learn), quality.THRESHOLD)
    return scored.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs.select("doc_id", "text"), docs.where(bucket("doc_id", 3) != 1))
    return found.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(table(spark, sf_dir, "documents"), length=50)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"), 0.93)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that add up to the number of rows: the law is `rows`."""
    placed = shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_token_counts,
        op3_quality_classifier,
        op4_decontamination,
        op5_license_scan,
        op6_language_id,
        op7_minhash_dedup,
        op8_suffix_array_dedup,
        op9_html_extraction,
        op10_embedding_dedup,
        op11_sharding,
        op12_importance_resampling,
        op13_merkle_manifest,
    )
}
ORACLES: dict[str, str] = {
    "op5_license_scan": license_scan.oracle(),
    "op7_minhash_dedup": sql.near_duplicates(width=3, percent=85),
    "op8_suffix_array_dedup": sql.repeated_spans(length=50),
    "op10_embedding_dedup": sql.embedding_links(0.93),
    "op11_sharding": exact.sharding(),
    "op12_importance_resampling": exact.resampling(),
    "op13_merkle_manifest": exact.merkle(),
}


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
