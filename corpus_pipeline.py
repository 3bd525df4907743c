"""Corpus pipeline over ``documents``: toxic documents go, one document of each group of
near-duplicates stays, documents with benchmark passages go, personal data is replaced,
and what is left is encoded.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskprice.llm import bpe, common, decontaminate, pii, simhash, toxicity
from riskprice.llm.queries import TIKTOKEN_RANKS


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked fingerprints."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and what points to it replaced in their texts."""
    return pii.sanitise(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the token ids and of the bytes decoded from them."""
    return bpe.encode_digests(docs, TIKTOKEN_RANKS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("encoding", encoding_stage),
]

# Training, alignment and pair merging are not expressible in SQL; the stages are tested
# against plain versions of themselves instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
