"""Corpus preparation: quality filter, line dedup, near-duplicate removal, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's ``docs``.  All stages but the
last return the columns of ``documents``.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty
tables and extra columns of any name.  What each makes of them is told at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm.common import bound_batches, materialize, table
from feedloom.llm.line_dedup import dedup_lines
from feedloom.llm.packing import pack_documents
from feedloom.llm.quality import keep_good
from feedloom.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored like any other, on their statistics; repeated rows get
    equal scores, so all stay or all go.  Without labels that may be learned from, every
    document gets the same score.
    """
    bound_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines held by many documents go from all but one of them.

    A null text stays null; rows without a doc_id neither count nor lose lines; rows with
    the same doc_id and text lose the same lines.
    """
    bound_batches(spark)
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one with the smallest doc_id stays.

    Null and empty texts are one group.  Of repeated rows one stays; a doc_id with texts of
    several groups is looked at text by text.  Rows without a doc_id stay.
    """
    bound_batches(spark)
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and placed in sequences.

    A null text is empty: its end alone is packed.  Repeated rows are packed as often as
    they occur; texts longer than a sequence are cut into pieces.
    """
    bound_batches(spark)
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Trained trees, fingerprints and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
