"""The corpus pipeline: quality, toxicity, line dedup, near-duplicate removal, packing.

Every stage takes the documents that the one before kept and returns documents with the same columns; the last returns
the packed pieces. Classifiers learn from the labels of the whole table, outside the held-out quarter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import lines, neardup, packing, quality, toxicity
from vellum.llm.shared import materialize, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.remove(docs, removed_col="__removed").drop("__removed")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good), ("toxicity", clean), ("lines", without_boilerplate), ("near", without_near_copies), ("packing", packed)]

#: Classifiers and packing can't be expressed in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
