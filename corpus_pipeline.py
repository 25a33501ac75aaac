"""From raw documents to token ids: language ID, near-dedup, decontamination, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rentlens.llm import decontaminate, language, mixing, near_dups, tokens
from rentlens.llm.common import scratch, ship, stored, table
from rentlens.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with an uncertain one, go."""
    ship(spark)
    return language.accepted(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    ship(spark)
    return near_dups.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    ship(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn towards tempered shares of source, language and topic."""
    ship(spark)
    return mixing.sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, read back: a row per document."""
    ship(spark)
    return tokens.encoded(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("decontamination", decontaminated),
    ("mixing", mix),
    ("token_ids", encode),
]
#: SQL has no tokenizer and no sampling by signatures; tests compare with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
