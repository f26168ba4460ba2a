"""KPIs, breakdowns, roll-ups, trends, shares and histograms of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.functions.semantics import as_time, col, n_unique, zsum
from tablelens.operators.ranks import at_or_after, order_cutoffs, text_keys


def half_split(df: DataFrame, order_by: list[str]) -> Column:
    """True for rows of the second half (by count) in the given total order."""
    rows = df.count()
    if rows < 2:
        return F.lit(False)
    order_by = text_keys(df, order_by)
    cutoff = order_cutoffs(df, order_by, [rows // 2], rows)[0]
    return at_or_after(df, order_by, cutoff)


def _growth(first: Column, second: Column) -> Column:
    return (second - first) / first * F.lit(100.0)


def kpis(
    df: DataFrame,
    metric: str,
    order_by: list[str],
    category: str | None = None,
    geo: str | None = None,
) -> DataFrame:
    """One row of headline numbers; growth compares the two halves in order."""
    late = half_split(df, order_by)
    m = col(metric)
    cells = F.count(F.lit(1)) * F.lit(len(df.columns))
    nulls = sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0))
    parts = df.agg(
        zsum(m).cast("double").alias("total_value"),
        F.coalesce(F.avg(m), F.lit(0.0)).alias("mean_value"),
        F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias("std_dev"),
        zsum(F.when(~late, m)).cast("double").alias("__h1"),
        zsum(F.when(late, m)).cast("double").alias("__h2"),
        F.count(F.lit(1)).alias("total_records"),
        (n_unique(col(category)) if category else F.lit(0).cast("long")).alias("unique_categories"),
        (n_unique(col(geo)) if geo else F.lit(0).cast("long")).alias("unique_regions"),
        F.greatest(F.lit(50), F.floor(F.lit(100) - F.try_divide(nulls, cells) * 100).cast("int")).alias(
            "quality_score"
        ),
    )
    h1, h2 = F.col("__h1"), F.col("__h2")
    return parts.select(
        F.lit(metric).alias("metric_name"),
        "total_value",
        "mean_value",
        "std_dev",
        F.when(h1 > 0, _growth(h1, h2)).otherwise(F.lit(0.0)).alias("growth_rate"),
        "total_records",
        "unique_categories",
        "unique_regions",
        "quality_score",
    )


def dashboard_kpis(
    df: DataFrame, metric: str, order_by: list[str] | None = None, geo: str | None = None
) -> DataFrame:
    """One row for the (already filtered) dashboard; growth only with a time order."""
    m = col(metric)
    late = half_split(df, order_by) if order_by else F.lit(None).cast("boolean")
    parts = df.agg(
        zsum(m).cast("double").alias("total_value"),
        F.count(F.lit(1)).alias("total_records"),
        zsum(F.when(~late, m)).cast("double").alias("__h1"),
        zsum(F.when(late, m)).cast("double").alias("__h2"),
        (n_unique(col(geo)) if geo else F.lit(1).cast("long")).alias("__geo"),
    )
    h1, h2 = F.col("__h1"), F.col("__h2")
    enough = F.col("total_records") >= 2
    return parts.select(
        F.lit(metric).alias("metric_name"),
        "total_value",
        "total_records",
        F.when(enough & (h1 != 0), F.round(_growth(h1, h2), 1)).otherwise(F.lit(0.0)).alias("growth_rate"),
        F.when(F.col("total_records") > 0, F.col("__geo")).otherwise(F.lit(1)).alias("unique_regions"),
    )


def numeric_kpis(df: DataFrame, columns: list[str]) -> DataFrame:
    """mean, sum, min and max per numeric column, from one aggregate."""
    zero = F.lit(0.0)
    packed = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.coalesce(F.avg(col(c)).cast("double"), zero).alias("mean"),
                zsum(col(c)).cast("double").alias("sum"),
                F.coalesce(F.min(col(c)).cast("double"), zero).alias("min"),
                F.coalesce(F.max(col(c)).cast("double"), zero).alias("max"),
            )
            for c in columns
        ]
    )
    return df.agg(packed.alias("k")).select(F.inline("k"))


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows of the named columns, values as text."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(cells))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count); one shuffle of pre-aggregated pairs for all columns."""
    return long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_counts(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent values per column, ties by value."""
    from pyspark.sql import Window

    # The rank filter is applied inside each task before the shuffle.
    order = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def category_breakdown(df: DataFrame, columns: list[str], n: int = 10) -> DataFrame:
    """Top counts of the given columns, null counting as a value."""
    return top_counts(value_counts(df, columns), n)


def geo_rollup(df: DataFrame, geo: str, metric: str) -> DataFrame:
    """Sum and row count per region, largest first."""
    return (
        df.groupBy(col(geo).cast("string").alias("region"))
        .agg(zsum(col(metric)).cast("double").alias("value"), F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("value").desc(), F.col("region").asc_nulls_first())
    )


def trend(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Metric sum per point in time, ascending."""
    return (
        df.groupBy(as_time(df, date).alias("date"))
        .agg(zsum(col(metric)).cast("double").alias("value"))
        .orderBy(F.col("date").asc_nulls_first())
    )


def segment_shares(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """Total, rows and share of the grand total per segment."""
    groups = df.groupBy(col(dimension).cast("string").alias("segment")).agg(
        zsum(col(metric)).cast("double").alias("total"), F.count(F.lit(1)).alias("count")
    )
    # The grand total is the sum of the group totals: the grouped shuffle is reused, the table read once.
    # Both columns are summed so that the two plans keep the same grouped shuffle.
    total = groups.agg(F.struct(F.sum("total").alias("total"), F.sum("count").alias("count"))).scalar()["total"]
    return groups.withColumn("share", F.when(total > 0, F.col("total") / total * 100).otherwise(F.lit(0.0)))


def percent_share(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """Whole-number percentage per segment."""
    return segment_shares(df, dimension, metric).select(
        "segment", F.round(F.col("share")).cast("long").alias("percent")
    )


def histogram(df: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """Equal-width bins from min to max, last bin closed, empty bins included."""
    v = col(column).cast("double")
    low, high, n, mean = df.agg(F.min(v), F.max(v), F.count(v), F.avg(v)).first()
    spark = df.sparkSession
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if n == 0:
        return edges.select("bin", *[F.lit(None).cast("double").alias(c) for c in ("low", "high")], F.lit(0).cast("long").alias("count"), F.lit(None).cast("double").alias("mean"))
    step = (high - low) / bins or 1.0
    number = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v - F.lit(low)) / F.lit(step)))).cast("int")
    counts = df.filter(v.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return edges.join(counts, "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(step)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(step)).alias("high"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
        F.round(F.lit(mean), 1).alias("mean"),
    )


def category_shares(df: DataFrame, category: str, metric: str | None, n: int = 8) -> DataFrame:
    """Rounded sum of the metric (else row count) per non-empty category, top n."""
    c = col(category).cast("string")
    weight = F.coalesce(col(metric).cast("double"), F.lit(1.0)) if metric else F.lit(1.0)
    return (
        df.filter(c.isNotNull() & (c != ""))
        .groupBy(c.alias("category"))
        .agg(F.round(F.sum(weight)).cast("long").alias("value"))
        .orderBy(F.col("value").desc(), "category")
        .limit(n)
    )


def anomaly_counts(anomalies: DataFrame) -> DataFrame:
    """Anomalies per category (else region, else row), severe ones apart."""
    label = F.coalesce(
        F.when(F.col("category") != "General", F.col("category")),
        F.when(F.col("region") != "Global", F.col("region")),
        F.concat(F.lit("Row "), F.col("row_key").cast("string")),
    )
    severe = F.col("severity").isin("High", "Critical")
    return anomalies.groupBy(label.alias("label")).agg(
        F.count_if(severe).alias("high"), F.count_if(~severe).alias("medium")
    )


def null_stats(df: DataFrame) -> DataFrame:
    """Null count and percentage per column, plus a total row, in one scan."""
    counts = [F.count_if(col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    rows = F.col("rows")
    each = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"), rows.alias("cells"))
        for i, c in enumerate(df.columns)
    ]
    total = F.struct(
        F.lit("(all)").alias("column"),
        sum((F.col(f"n{i}") for i in range(len(df.columns))), F.lit(0).cast("long")).alias("nulls"),
        (rows * len(df.columns)).alias("cells"),
    )
    return one.select(F.inline(F.array(*each, total))).select(
        "column",
        "nulls",
        F.round(F.coalesce(F.try_divide(F.col("nulls") * 100.0, F.col("cells")), F.lit(0.0)), 2).alias("null_pct"),
    )


def row_key(df: DataFrame) -> Column:
    """A 128-bit key of the whole row; nulls take part, so (null, 1) differs from (1, null)."""
    marked: list[Column] = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, T.VariantType):
            c = c.cast("string")
        marked += [c, c.isNull()]
    return F.struct(F.xxhash64(F.lit(1), *marked).alias("a"), F.xxhash64(F.lit(2), *marked).alias("b"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows.

    Shuffles 16 bytes per distinct row instead of the row itself; copies
    collapse before the shuffle, so heavy duplication does not skew it.
    """
    return (
        df.groupBy(row_key(df).alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        )
        .select(
            "rows",
            "duplicates",
            F.round(F.coalesce(F.try_divide(F.col("duplicates") * 100.0, F.col("rows")), F.lit(0.0)), 2).alias(
                "duplicate_pct"
            ),
        )
    )
