"""A pipeline over documents: each stage calls one operator of quire.llm on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last have the columns of documents. Rows keep their
doc_id; n_chars follows the text. A null text is empty for every stage and stays null where its row is kept; repeated rows and
rows that share a doc_id or have none are judged by their texts; of equal texts one row stays. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, common, decontaminate, quality, simhash_dedup, suffix_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (low quality or toxic) go."""
    return quality.accepted(docs, _table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that with the least doc_id."""
    return simhash_dedup.first_of_group(docs).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, its text without what repeats an earlier 100 bytes."""
    return suffix_dedup.replaced(docs).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.without_leaks(docs, _table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    return bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, *bpe.SMALL)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE", byte_level_bpe),
]

#: The classifier and the tokenizer are beyond SQL: tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once a stage is written, what came before it is removed from the shared folder."""
    docs, mark = _table(spark, sf_dir, "documents"), len(common.PATHS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs, f"stage-{i}")
            common.remove_since(spark, mark, keep=common.PATHS[-1])
    return docs
