"""A distributed row number over a total order.

``row_number() over (order by ...)`` without a partition would pull the whole
table into one task.  Here the rows are range-partitioned and sorted, written
once to the shared checkpoint folder (so that the counting pass and the
reading pass see the same partitions), counted per partition, and shifted by
the number of rows in the partitions before.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from tablelens.functions.semantics import col
from tablelens.session import durable


def with_row_index(
    df: DataFrame, order_by: list[str], name: str = "row_index", partitions: int | None = None
) -> DataFrame:
    """Add a 0-based position; ``order_by`` must be a total order."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [col(k).asc_nulls_first() for k in order_by]
    local = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .select(
            "*",
            F.shiftright(local, 33).cast("int").alias("__part"),
            local.bitwiseAND(F.lit((1 << 33) - 1)).alias("__pos"),
        )
    )
    placed = durable(placed)
    sizes = {r[0]: r[1] for r in placed.groupBy("__part").count().collect()}
    parts = sorted(sizes)
    starts = [0, *accumulate(sizes[p] for p in parts)]
    offsets = F.create_map(*[F.lit(v) for p, s in zip(parts, starts) for v in (p, s)]) if parts else F.lit(None)
    if not parts:
        return df.withColumn(name, F.lit(0).cast("long"))
    return placed.withColumn(name, (F.element_at(offsets, F.col("__part")) + F.col("__pos")).cast("long")).drop(
        "__part", "__pos"
    )
