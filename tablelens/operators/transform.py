"""User transformations of a table, with a report of its shape before and after."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def transform_hook(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(result, report); the report counts rows and columns of both sides in Spark."""
    out = fn(df)
    if not isinstance(out, DataFrame):
        raise TypeError("a transformation must return a DataFrame")

    def shape(name: str, x: DataFrame) -> DataFrame:
        return x.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("side"), "rows", F.lit(len(x.columns)).alias("columns")
        )

    return out, shape("before", df).unionByName(shape("after", out))
