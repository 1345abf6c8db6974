"""Tables that a long job writes between its stages.

A stage boundary is a written Parquet table in the folder that every executor
shares (``spark.checkpoint.dir``), so a lost executor costs one stage and never
the whole lineage.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is configured, a temporary one in local mode and an error on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "gneiss")


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Nulls, empty tables and duplicate rows come back as they went in. The
    schema is passed to the reader, so no inference job runs and an empty
    result keeps its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
