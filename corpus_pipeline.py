"""A corpus from documents: filter, clean, deduplicate, decontaminate, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Every
stage's result is written as Parquet below the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padron.llm import bpe, decontamination, jaccard_join, line_dedup, quality_classifier
from padron.llm.queries import WORD_BPE, table
from padron.session import saved


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly trained classifier rejects go."""
    return quality_classifier.kept(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat go."""
    rebuilt = line_dedup.deduplicated(docs)
    if "n_chars" not in docs.columns:
        return rebuilt
    kind = docs.schema["n_chars"].dataType
    return rebuilt.withColumn("n_chars", F.char_length("text").cast(kind))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8) stays: that of the smallest id."""
    return jaccard_join.first_of_copies(docs, words=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, digest of the ids and of the decoded text."""
    return bpe.token_digest(docs, WORD_BPE)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding", encode_stage),
]

#: The classifier, the latent search and the encoder are not SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
