"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame; all but the last return the columns of documents. The caller stores each result and hands
it to the next stage as docs; run() does so in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm import quality
from scholion.llm.common import table
from scholion.llm.decontamination import find_leaks
from scholion.llm.minhash_dedup import near_duplicates
from scholion.llm.packing import pack_documents
from scholion.llm.suffix_dedup import strip_repeats
from scholion.session import persist_shared


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects. It learns from the table labels.

    Null and empty texts are judged as one empty passage, rows without a doc_id and repeated rows each by
    their text. Without documents of both labels there is no classifier and all rows stay; an empty table
    stays empty. Other columns, also ones named like the classifier's own, pass through.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if model is None:
        return docs
    # The row travels as one column, so that columns named like the classifier's own stay as they are.
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    return quality.score(rows, model).where("predicted = 1").select("row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of near-duplicates (five words, similarity 0.8).

    Rows that repeat a doc_id are one document: of differing ones the least by the hash of its text, then
    of its other columns, stays. Null, blank and empty texts are like no other and stay, as do rows
    without a doc_id; an empty table stays empty.
    """
    kept = near_duplicates(docs, width=5, percent=80).where("kept").select("doc_id")
    unnamed = docs.where("doc_id is null")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = F.struct(F.xxhash64("text"), F.xxhash64(F.to_json(F.struct(F.lit(0), *others))))
    # Dealt by ranges of ids, so that the next stage finds neighbouring ids together.
    one = (
        docs.join(kept, "doc_id", "left_semi")
        .select("doc_id", F.struct(*docs.columns).alias("row"), least.alias("least"))
        .repartitionByRange("doc_id")
        .groupBy("doc_id")
        .agg(F.min_by("row", "least").alias("row"))
    )
    return one.select("row.*").unionByName(unnamed)


def strip_repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out of each text what an earlier document holds in stretches of 50 bytes or more.

    Null, empty and short texts stay as they are, as do rows without a doc_id; repeated rows lose the
    same bytes; a table without repeats, or without rows, comes back unchanged. n_chars follows the text.
    """
    return strip_repeats(docs, length=50)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item.

    Null and empty texts hold none, and rows without a doc_id stay, as no decision can name them; an
    empty benchmark drops nothing, an empty table stays empty.
    """
    leaked = persist_shared(
        find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaked"
    )
    return docs.join(leaked, "doc_id", "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left into sequences of 4096 tokens.

    Null and empty texts are one end token; every row is packed, repeated ones and those without a
    doc_id too; an empty table gives an empty result.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_distinct),
    ("suffix-array dedup", strip_repeated),
    ("benchmark decontamination", keep_unleaked),
    ("best-fit packing", pack_sequences),
]

#: Trained models, merged transforms and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = persist_shared(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
