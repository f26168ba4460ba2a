"""Feature columns: date parts, scaled numbers, label codes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.functions.semantics import as_time, col
from tablelens.operators.dashboard import top_counts, value_counts
from tablelens.operators.ranks import exact_quantiles
from tablelens.operators.rowindex import with_row_index

# What a missing date turns into.
MISSING_DATE = {"year": 2000, "month": 1, "day": 1, "dayofweek": 0}


def date_part_columns(moment: Column, name: str) -> dict[str, Column]:
    """Year, month, day, weekday (Monday 0) and weekend flag of a point in time."""
    parts = {"year": F.year(moment), "month": F.month(moment), "day": F.dayofmonth(moment), "dayofweek": F.weekday(moment)}
    out = {f"{name}_{k}": F.coalesce(v, F.lit(MISSING_DATE[k])).cast("double") for k, v in parts.items()}
    weekend = F.coalesce((F.weekday(moment) >= 5).cast("int"), F.lit(0))
    return out | {f"{name}_is_weekend": weekend.cast("double")}


def date_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    new: dict[str, Column] = {}
    for c in columns:
        new |= date_part_columns(as_time(df, c), c)
    return df.withColumns(new)


def _standardise(df: DataFrame, names: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    stats = df.agg(*[e for i, n in enumerate(names) for e in (F.avg(col(n)).alias(f"m{i}"), F.stddev_pop(col(n)).alias(f"s{i}"))]).first()
    return df.withColumns(
        {n: (col(n) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i, n in enumerate(names)}
    )


def cyclical_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Date parts plus sine and cosine of the month, all standardised."""
    out = date_parts(df, columns)
    names: list[str] = []
    for c in columns:
        angle = col(f"{c}_month") * F.lit(2 * math.pi / 12.0)
        out = out.withColumns({f"{c}_month_sin": F.sin(angle), f"{c}_month_cos": F.cos(angle)})
        names += [f"{c}_{k}" for k in ("year", "month", "day", "dayofweek", "is_weekend", "month_sin", "month_cos")]
    return _standardise(out, names)


def scale_numeric(df: DataFrame, columns: list[str], robust: bool = False, rows: int | None = None) -> DataFrame:
    """Nulls to the median, then standard scaling, or median and IQR when ``robust``."""
    rows = df.count() if rows is None else rows
    medians = {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in columns}, rows).items()}
    filled = df.withColumns(
        {c: F.coalesce(col(c).cast("double"), F.lit(float(medians[c]))) for c in columns if medians[c] is not None}
    )
    if not robust:
        return _standardise(filled, columns)
    quarters = exact_quantiles(filled, {c: [0.25, 0.5, 0.75] for c in columns}, rows)
    return filled.withColumns(
        {
            c: (col(c) - F.lit(float(q2))) / F.lit(float(q3 - q1) or 1.0)
            for c, (q1, q2, q3) in quarters.items()
            if q2 is not None
        }
    )


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent value per column, the smallest on ties; one row per column is collected."""
    if not columns:
        return {}
    counts = value_counts(df, columns).filter(F.col("value").isNotNull())
    return {r["column"]: r["value"] for r in top_counts(counts, 1).collect()}


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(label, code): distinct labels in sorted order, nulls counted as the most frequent label."""
    labels = df.select(col(column).cast("string").alias("label")).filter(F.col("label").isNotNull()).distinct()
    return with_row_index(labels, ["label"], "code")


def label_encode(df: DataFrame, column: str, codes: DataFrame, mode: str | None, name: str) -> DataFrame:
    """Add the code of each label; labels not in ``codes`` get the first code, 0."""
    filled = F.coalesce(col(column).cast("string"), F.lit(mode)) if mode is not None else col(column).cast("string")
    lookup = codes.select(F.col("label").alias("__label"), F.col("code").alias(name))
    joined = df.withColumn("__filled", filled).join(lookup, F.col("__filled") == F.col("__label"), "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0))).drop("__filled", "__label")
