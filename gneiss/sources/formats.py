"""Readers and writers with declared schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gneiss.functions.columns import uniform

RUN_SCHEMA = "unit string, task string, model string, fold int, threshold double, metrics map<string,double>, history array<struct<t:int,score:double,best:double,params:map<string,string>>>"


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header; nothing is inferred, unreadable cells are null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A folder of run documents, one JSON object a line."""
    return spark.read.schema(RUN_SCHEMA).json(path)


def explode_history(runs: DataFrame) -> DataFrame:
    """One row for each evaluation of each run; runs without any are left out."""
    return runs.select("unit", "model", "fold", F.explode("history").alias("h")).select("unit", "model", "fold", "h.*")


def append_runs(df: DataFrame, path: str) -> None:
    """Add runs; Spark's commit makes each append whole or absent."""
    df.write.mode("append").json(path)


def pending(units: DataFrame, runs: DataFrame) -> DataFrame:
    """Units without a run yet, so a study resumes where it stopped."""
    return units.join(runs.select("unit").distinct(), "unit", "left_anti")


def hand_over(dev: DataFrame, test: DataFrame, path: str, target: str, categorical: list[str]) -> None:
    """Development and test tables with their column roles."""
    dev.write.mode("overwrite").parquet(f"{path}/dev")
    test.write.mode("overwrite").parquet(f"{path}/test")
    roles = {"target": target, "categorical": categorical, "numeric": [c for c in dev.columns if c not in {target, *categorical}]}
    dev.sparkSession.createDataFrame([(json.dumps(roles),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/roles")


def take_over(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    roles = json.loads(spark.read.text(f"{path}/roles").first()[0])
    return spark.read.parquet(f"{path}/dev"), spark.read.parquet(f"{path}/test"), roles


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """Rows, sum of keys and an order-free digest of all cells: equal content, equal fingerprint."""
    cells = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)))
    return df.agg(F.count("*").alias("n_rows"), F.sum(key).alias("key_sum"), F.bit_xor(cells).alias("digest")).withColumn("columns", F.lit(",".join(sorted(df.columns))))


def made_up(spark: SparkSession, n: int, measures: int, groups: int, rate: float, holes: float, seed: int) -> DataFrame:
    """Rows for trying things out: measures, a group and an outcome of mean ``rate``.

    Measures are even on [0, 1); the outcome's chance is ``rate`` times the
    sum of the first two. The k-th measure is missing in ``holes`` * k /
    ``measures`` of the rows. Every cell is a hash of its row and name, so any
    number of tasks gives the same rows.
    """
    draw = lambda name: uniform(F.lit(name), "row_id", seed=seed)
    row = spark.range(n).withColumnRenamed("id", "row_id")
    shown = [F.when(draw(f"hole{k}") >= holes * k / measures, draw(f"x{k}")).alias(f"x{k}") for k in range(1, measures + 1)]
    group = F.concat(F.lit("g"), F.floor(draw("group") * groups).cast("int").cast("string"))
    return row.select("row_id", *shown, group.alias("grp"), (draw("outcome") < rate * (draw("x1") + draw("x2"))).cast("int").alias("outcome"))
