"""From raw documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, as a table with the columns of documents;
the last returns the packed bins. Stages are written as Parquet between each other, in
the shared folder of the session, so that a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm.classifier import drop_rejected
from tagloom.llm.common import stored, table
from tagloom.llm.decontaminate import remove_contaminated
from tagloom.llm.packing import pack
from tagloom.llm.pii import redact_pii
from tagloom.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, accepts."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in bins of equal capacity."""
    return pack(docs)


STAGES = [("quality_classifier", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("packing", packing)]

#: The classifier, the recursion and the rounds of packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
