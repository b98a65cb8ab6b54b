"""Places for what jobs write."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; where that is unset, a temporary one on a local master and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/vellum-shared"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored_once(inputs: DataFrame, kind: str, build: Callable[[str], None]) -> str:
    """The folder that ``build`` fills from these inputs, filled once: its name follows from the paths, sizes and times of the input files.

    It is filled under another name and renamed when whole, so a job that breaks off leaves nothing that looks finished, and of two jobs one wins.
    """
    spark = inputs.sparkSession
    conf, paths = spark._jsparkSession.sessionState().newHadoopConf(), spark._jvm.org.apache.hadoop.fs
    seen = []
    for name in sorted(inputs.inputFiles()):
        at = paths.Path(name)
        status = at.getFileSystem(conf).getFileStatus(at)
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    new = new_folder(spark, kind)
    final = f"{new.rpartition('-')[0]}-{hashlib.md5(chr(10).join(seen).encode()).hexdigest()}"
    target = paths.Path(final)
    files = target.getFileSystem(conf)
    if not files.exists(target):
        build(new)
        if not files.rename(paths.Path(new), target) and not files.exists(target):
            raise OSError(f"could not rename {new}")
    return final


def spread(docs: DataFrame) -> DataFrame:
    """A table that fills fewer splits than there are cores is dealt to all of them; it is small then."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
