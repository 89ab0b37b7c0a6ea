"""Intermediate tables in the shared folder that the cluster names.

Operators cut lineage by writing Parquet below ``spark.checkpoint.dir``; every
executor sees that folder, so a lost executor costs only its running tasks.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and all of it runs on this machine.
FALLBACK = "/tmp/checkpoints/corpusloom"


def folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or FALLBACK


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders through Hadoop's file systems, whatever store they are in."""
    for path in paths:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """The tables of one operator's run.

    ``table`` writes a DataFrame and returns what was written; ``drop`` deletes
    a table once nothing reads it.  What is left goes when the process ends,
    because the lazy result may read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(remove, spark, self.base)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        remove(self.spark, *(f"{self.base}/{name}" for name in names))
