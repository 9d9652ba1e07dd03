"""The cleaning pipeline over ``documents``: each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, localpack, pii, simhash
from millrace.llm import toxicity as toxic
from millrace.llm.common import table
from millrace.session import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the labelled ones among ``docs``.

    Equal ids, null ones too, go together; null and empty texts are clean; without labels of both
    classes all stay. Extra columns stay as they are, an empty table stays empty.
    """
    return toxic.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays.

    Rows that share that id all stay; a null id stays only in a group of nulls. Null and empty texts are
    one group. Extra columns stay as they are, an empty table stays empty.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Equal ids, null ones too, go together; null and empty texts hold nothing; without items all stay.
    Extra columns stay as they are, an empty table stays empty.
    """
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; ``n_chars`` follows.

    Null texts stay null, every row stays, repeated rows are masked alike. Extra columns stay as they
    are, an empty table stays empty.
    """
    return pii.mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' token pieces with their places in sequences.

    Null and empty texts are one token, their end. Null ids and repeated rows are packed like others.
    Other columns are left out, no rows give no rows.
    """
    return localpack.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; every result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
