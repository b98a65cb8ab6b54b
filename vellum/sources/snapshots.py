"""Versions of a table as Parquet folders. A version counts once its number is in the log, so readers never see half of one."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "version bigint, folder string"


def log(spark: SparkSession, root: str) -> DataFrame:
    """(version, folder) of what was committed; empty for a new table."""
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def commit(spark: SparkSession, table: DataFrame, root: str) -> int:
    """Write the table as the next version and return its number. One writer at a time."""
    version = (log(spark, root).agg(F.max("version")).first()[0] or 0) + 1
    folder = f"{root}/data-{version}-{uuid.uuid4().hex}"
    table.write.parquet(folder)
    spark.createDataFrame([(version, folder)], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return version


def current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The last version, or the one named."""
    entries = log(spark, root)
    last = (entries if version is None else entries.filter(F.col("version") == version)).agg(F.max_by("folder", "version")).first()[0]
    if last is None:
        raise ValueError(f"no version of {root}")
    return spark.read.parquet(last)
