"""The document pipeline: quality rules, toxicity, near-duplicates, packing.

Every stage takes the documents that its predecessor kept, all of them, and all but the last return
documents with the columns they came with, clashing or extra ones too. Null texts count as empty
ones: the quality rules reject them. Rows are judged one by one, so repeated rows share a fate up to
the near-duplicate stage, where one row of each group stays (the least id, then the least hash of
its columns); an id repeated with texts that nothing links keeps a row for each. Rows with a null id
are never duplicates of others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import packing, quality, simhash, toxicity
from vellum.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_quality(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Labels are those of the table; the model is fitted on the labelled documents that are left."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_each(docs, id_is_document=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("packing", pack)]

#: Scores, fingerprints and token ids are not expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
