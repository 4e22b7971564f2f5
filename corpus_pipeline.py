"""A training corpus from raw documents in five stages.

Quality rules drop repetitive and very short documents; of every group of near
duplicates one document stays; personal data and terms that reveal it are taken
out of the texts; sources are mixed to their target weights, by repeating some
documents and leaving others out; the rest is encoded and decoded by byte BPE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.byte_bpe import round_trip
from tidelog.llm.common import cut, table
from tidelog.llm.jaccard import one_per_group
from tidelog.llm.mixing import repeat_documents
from tidelog.llm.pii import sanitise_documents
from tidelog.llm.quality import keep_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_per_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with sanitised texts."""
    return sanitise_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return repeat_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes."""
    return round_trip(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE", tokens),
]

#: SQL can't express the sanitising and token stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs, f"pipeline-{number}")
    return docs
