"""Stored results: versioned datasets, profiles, insights and audit records.

Stores are plain Parquet folders partitioned by dataset, so writing one
dataset never rewrites another and readers prune to the dataset they want.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablelens.operators.profile import PROFILE_VERSION


def write_dataset(df: DataFrame, root: str, name: str, format: str = "parquet", version: str | None = None) -> str:
    """Write a table under a new versioned folder and return its path."""
    stamp = version or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%S%f")
    path = f"{root.rstrip('/')}/{name}/v={stamp}"
    writer = df.write.mode("errorifexists").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


def append_profile(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("append").partitionBy("dataset").parquet(path)  # one row per column


def latest_profiles(spark: SparkSession, path: str, version: str = PROFILE_VERSION) -> DataFrame:
    """The newest profile of every dataset, flagged stale when its version is not current."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("dataset").agg(F.max("profiled_at").alias("profiled_at"))
    return rows.join(newest, ["dataset", "profiled_at"], "left_semi").withColumn(
        "stale", F.col("profile_version") != version
    )


def replace_insights(rows: DataFrame, path: str, datasets: tuple[str, ...] = ()) -> None:
    """Replace the insights of the datasets in ``rows`` and of those named; others stay.

    A named dataset without rows in this run loses its old insights: its partition
    is overwritten by one row without a title, which readers skip.
    """
    spark = rows.sparkSession
    if datasets:
        named = spark.createDataFrame([(d,) for d in datasets], "dataset string")
        rows = rows.unionByName(named.join(rows.select("dataset").distinct(), "dataset", "left_anti"), allowMissingColumns=True)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("title").isNotNull()).orderBy("dataset", F.col("score").desc(), "title")


def latest_n(df: DataFrame, keys: list[str], order_by: list[str], n: int = 50) -> DataFrame:
    """The last n rows per key; the rank limit is applied before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order_by])
    return df.withColumn("__rank", F.row_number().over(newest)).filter(F.col("__rank") <= n).drop("__rank")
