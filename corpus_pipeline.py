"""A corpus pipeline of the llm operators: each stage works on all that the one before it kept.

Cases that all stages share. Other columns than doc_id, text, source and n_chars pass through untouched, whatever their names.
A null text is an empty one to the rules, and stays null where its row stays. Rows that repeat are judged row by row,
except that of exact copies the near-duplicate stage keeps one. Null ids are no error: such rows link with nothing. Texts are
taken whole, however long. An empty table gives an empty one through all stages. Each stage's docstring says the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwise.llm import neardup, packing, pii, quality, toxicity
from spanwise.llm.common import materialise, spread, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more as toxic go; null and empty texts score like texts without known terms. Without labels none goes."""
    return toxicity.kept_documents(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules go, so null and empty texts do; of a host that fails more than others, also those that fail any rule. Null is a host."""
    return quality.kept_documents(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the smallest doc_id, ties by the digest of the set.

    Sets are of five-word shingles here. Rows without words or without doc_id link with nothing and stay.
    """
    return neardup.kept_documents(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data, and each secret, is replaced by its kind in brackets; n_chars follows where the text changed."""
    return pii.redacted(docs, pii.train(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the packed sequences; a null or empty text is its closing id alone."""
    return packing.pack(docs, packing.default_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("personal_data", pii_stage),
    ("packing", packing_stage),
]

#: Scores, minimum hashes and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
