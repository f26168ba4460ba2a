"""Event rates and latency percentiles over sliding windows, batch and streaming alike.

The state of a window is one counter per group or per bucket, so it merges
across partitions and micro-batches, and the watermark bounds how much is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.functions.semantics import col

# Window, slide and percentile of the monitoring panels.
WINDOW, SLIDE, WINDOW_SECONDS = "5 minutes", "1 minute", 300
P95 = 0.95


def late_after(df: DataFrame, time: str, delay: str | None) -> DataFrame:
    """Bound lateness on streams; batch tables are taken as they are."""
    if not (df.isStreaming and delay):
        return df
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):  # watermarks need an instant
        df = df.withColumn(time, col(time).cast("timestamp"))
    return df.withWatermark(time, delay)


def event_rate(df: DataFrame, time: str, group: str, delay: str | None = "10 minutes") -> DataFrame:
    """Events per second and group over 5 minutes, every minute."""
    counted = (
        late_after(df, time, delay)
        .groupBy(F.window(col(time), WINDOW, SLIDE).alias("w"), col(group))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    return counted.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        col(group),
        "events",
        (F.col("events") / WINDOW_SECONDS).alias("rate"),
    )


def bucket_quantile(bounds: list[float], counts: list[Column], total: Column, q: float) -> Column:
    """Quantile from cumulative bucket counts, linear inside the bucket.

    The first bucket starts at 0; beyond the last bound the answer is that bound.
    """
    rank = total * F.lit(q)
    out: Column = F.lit(float(bounds[-1]))
    for i in range(len(bounds) - 1, -1, -1):
        below = counts[i - 1] if i else F.lit(0)
        low = bounds[i - 1] if i else 0.0
        inside = counts[i] - below
        at = F.lit(low) + F.lit(bounds[i] - low) * (rank - below) / inside
        out = F.when(counts[i] >= rank, F.when(inside > 0, at).otherwise(F.lit(float(bounds[i])))).otherwise(out)
    return F.when(total > 0, out)


def latency_p95(
    df: DataFrame, time: str, value: str, bounds: list[float], delay: str | None = "10 minutes", q: float = P95
) -> DataFrame:
    """Estimated percentile of a value per 5-minute window, from bucket counts."""
    names = [f"b{i}" for i in range(len(bounds))]
    counted = (
        late_after(df, time, delay)
        .groupBy(F.window(col(time), WINDOW, SLIDE).alias("w"))
        .agg(
            F.count(col(value)).alias("total"),
            *[F.count_if(col(value) <= F.lit(float(b))).alias(n) for b, n in zip(bounds, names)],
        )
    )
    estimate = bucket_quantile(bounds, [F.col(n) for n in names], F.col("total"), q)
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", estimate.alias("p95")
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that has arrived into a Parquet folder, then stop.

    The query can be started again on the same folders and goes on where it was.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
