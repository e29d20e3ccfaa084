"""A corpus pipeline of five operators, near duplicates included.

Each stage takes the documents that its predecessor kept and decides on all of them.  All stages
but the last return the columns of documents.  Null and empty texts fail the quality rules; equal
rows are near duplicates; an empty table runs through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read_table, written
from tidemark.llm.jaccard_join import one_of_each
from tidemark.llm.packing import pack
from tidemark.llm.quality_rules import keep_good
from tidemark.llm.queries import vocabulary
from tidemark.llm.secrets_scan import redact
from tidemark.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for toxic go."""
    return reject_toxic(docs, read_table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or keep too few words without frequent lines, go; a line stays in its first document, so that a group of near copies keeps one."""
    return keep_good(docs, first_keeps=True)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least id."""
    return one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs, vocabulary("byte_bpe_50k.json"), limit=2048, end_id=1)


STAGES = [("toxicity", toxicity), ("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("secret_scans", secret_scans), ("packing", packing)]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's output but the last is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
