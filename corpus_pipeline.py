"""From raw documents to token digests, in four stages.

Every stage takes what the one before it kept, written as Parquet and read
again. The first three return the columns of ``documents``; the last returns
token counts and digests.

Null and empty texts have no word: they are good, near nothing and clean, and
have no token. Texts of any length are read whole. Rows with a null ``doc_id``
are judged by their texts and never dropped as near copies. Rows with equal
``doc_id`` are one document to the near-duplicate stage: they stay or go
together; other stages judge each row alone. Of equal texts the least ``doc_id``
stays. Further columns, whatever their names, are passed on untouched. Empty
tables give an empty result; without labels the classifier keeps everything.
The stages' tables stay in the shared folder, because the result reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import byte_bpe, decontaminate, near_dedup, quality
from heliograph.llm.session import new_path


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the least id. Shingles of five words, similarity 0.8."""
    return near_dedup.kept_documents(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten benchmark words."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    import public_tokenizers

    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_filter),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", tokens),
]

#: The classifier and the encoder have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
