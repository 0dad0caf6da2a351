"""The corpus pipeline: documents through five operators, each stage written and read again.

Defined cases: null and empty texts fail the quality rules and go; a null doc_id is a document, but never
the one that a near-duplicate group keeps unless the group has no other; repeated rows are exact copies, of which
one stays; further columns are carried to the mix; an empty table gives no sequences; without labels only the
base rules decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import exact_dedup, mixing, packing, quality, simhash
from factweave.llm.common import materialize, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules; trusted documents come from `labels`."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with equal text."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of texts that share 0.8 of their five-word shingles."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources until no source is read more than twice, in the order of the mix; drops none."""
    return mixing.realise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays the documents out in sequences, block by block in reading order: one row per sequence with its texts."""
    return packing.sequences(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("mixing", mixed_sources),
    ("packing", packed),
]

# n-gram scores, fingerprint components and bin packing have no SQL; tests hold the rows against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scratch(spark):  # what a stage wrote on the way goes once its result is written
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{i}", outlive=True)
    return docs
