"""A corpus pipeline: quality, toxicity, near duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import bagminhash, packing, quality, toxicity
from keyloom.llm.shared import as_table

# no SQL can train the two classifiers; tests/llm hold the stages against plain versions
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts stay, with all their columns.

    Labels are read from ``labels``; the rows they train on are among ``docs``. Null and empty texts get the bias's score,
    texts of any length are scored whole, repeated rows go or stay alike, and no rows give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.fitted(docs, labels))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic stay, with all their columns; null, empty and wordless texts stay, repeated rows go or stay alike, no rows give none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep(docs, toxicity.fitted(docs, labels))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays, with all its columns: that with the smallest doc_id, rows without one last.

    Rows of one doc_id with unrelated texts all stay; null texts count as empty; no rows give none.
    """
    return bagminhash.deduplicate(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1,024 tokens; null and empty texts are one end id, no rows give no pieces."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("dedup", dedup_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each one's rows are written and read again as the next one's. Rows as ``packing_stage`` returns them.

    Nulls in any column, repeated rows and further columns of any name are allowed in every stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
