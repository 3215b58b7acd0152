"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as
Parquet to the shared folder and reads it again as the next one's documents. All stages but the last
return the columns of ``documents``, under whatever names, and each row is judged for itself: neither a null
nor a repeated ``doc_id`` decides about another row. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkquill.llm import decontaminate, near_dup, packing, pii, quality
from sparkquill.session import ship, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled rows outside the held-out fold, rejects go.

    Null and empty texts have the model's bias as their score; equal texts have equal scores.
    """
    ship(spark)
    return quality.good(docs, table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Among equal ids it is the first row, null ids come last. Texts without words are in no group and stay.
    """
    ship(spark)
    return near_dup.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go, whole; null and empty texts stay."""
    ship(spark)
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes. Null texts stay null, ``n_chars`` is counted anew."""
    ship(spark)
    return pii.mask(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null text is one with the end id alone."""
    ship(spark)
    return packing.pack(docs, "byte_bpe_50k.json")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

#: A learned classifier, a learned tagger and a packing plan cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of a data directory."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
