"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what the one before kept, written as Parquet and read again, so a lost executor repeats one stage's tasks
and not the chain.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsudoi.llm import decontaminate, packing, secret_scan, similar, toxicity
from tsudoi.llm.common import scratch, stored, table
from tsudoi.llm.tokens import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned classifier calls toxic go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 at least) stays, that with the smallest id."""
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced by a mark and n_chars follows."""
    return secret_scan.without_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids and their places in sequences."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # a learned classifier and token ids aren't SQL; tests/llm holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    folder, docs = scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{n}-{name}")
    return docs
