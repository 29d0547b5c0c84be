"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept as ``docs``. All but the last return the columns of
``documents``; the last returns one row per piece of a document in a sequence, with its token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sediment.llm import decontaminate, packing, quality_rules, sanitise, similar_dups
from sediment.llm.common import stored, table
from sediment.session import prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; trusted text is that of labels with quality 1."""
    return quality_rules.keep_good(docs, table(prepare(spark), sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles with a similarity of 0.8 or more."""
    prepare(spark)
    return similar_dups.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, table(prepare(spark), sf_dir, "benchmark"))


def hide_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data and what discloses it replaced in their texts."""
    prepare(spark)
    return sanitise.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("simhash_dups", keep_one_of_each),
    ("decontaminate", drop_leaks),
    ("sanitise", hide_private_data),
    ("packing", pack),
]

#: Hashes, likelihoods and tokens of these stages have no SQL form; tests compare them with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read back."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
