"""A training-corpus pipeline over documents: five stages, each an operator of the library.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame; it is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crowdloom.llm import mixing, neardup, packing, private, toxicity
from crowdloom.llm.common import drop_settled, read_documents, settle, settled


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the severity model rejects."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group alike in five-word shingles."""
    return neardup.drop_near_duplicates(docs)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return private.redact(docs, private.fit())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and draws documents to the sources' target weights."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all pieces into sequences of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", redact_private),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: The models and the packing are not expressible in SQL: tests/llm/test_pipeline.py
#: compares every stage with plain Python on a small corpus.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage wrote for itself is deleted once its result is
    written, and so is its input; the last stage's result reads what that stage wrote."""
    docs, kept = read_documents(spark, sf_dir), set(settled())
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
        result = settled()[-1]
        drop_settled(spark, [path for path in settled() if path not in kept and path != result])
    return STAGES[-1][1](spark, docs, sf_dir)
