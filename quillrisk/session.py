"""Session helpers: tables by name, and tables written to the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Used only where the session names no shared folder, as in tests on one machine.
DEFAULT_SHARED = "file:///tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table in few splits dealt out to all cores, for work that costs more than moving them; a table in many splits stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a default only where it is unset and all runs in one process. Elsewhere it has to be set."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or DEFAULT_SHARED).rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors,
    and lets several later jobs read what was computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillrisk/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)
