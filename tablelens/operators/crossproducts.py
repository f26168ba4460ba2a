"""Products of all pairs of columns in one scan.

Every task multiplies its rows as a matrix and keeps the sums as blocks of
``BLOCK`` by ``BLOCK`` columns; blocks of the same place are added up, first
within ``SHARES`` shares of the tasks and then over all, as streams of blocks, so that no
task holds more than its own sums.  One scan for any number of columns, and a
result of columns x columns numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK = 256
SHARES = 32


def gram(df: DataFrame, columns: list[Column], block: int = BLOCK) -> np.ndarray:
    """Sums over all rows of the products of every two columns (doubles without nulls); zeros for no rows."""
    n = len(columns)
    blocks = [(i, j) for i in range(0, n, block) for j in range(i, n, block)]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((n, n)), 0
        for batch in batches:
            if batch.num_rows:
                part = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                sums += part.T @ part
                rows += len(part)
        if rows:
            share = np.random.default_rng().integers(0, SHARES)  # only spreads the blocks
            made = [np.ascontiguousarray(sums[i : i + block, j : j + block]).tobytes() for i, j in blocks]
            at = [pa.array(c, pa.int64()) for c in (*zip(*blocks), [share] * len(blocks))]
            yield pa.RecordBatch.from_arrays([*at, pa.array(made, pa.binary())], names=["i", "j", "share", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["i"], r["j"], r["share"])
                part = np.frombuffer(r["sums"])
                if key != now:
                    if now is not None:
                        yield _line(now, total)
                    now, total = key, part.copy()
                else:
                    total += part
        if now is not None:
            yield _line(now, total)

    schema = "i long, j long, share long, sums binary"
    parts = df.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(multiply, schema)
    for share in ("share", "0"):
        parts = parts.selectExpr("i", "j", f"CAST({share} AS LONG) AS share", "sums").repartition("i", "j", "share").sortWithinPartitions("i", "j", "share").mapInArrow(add, schema)
    out = np.zeros((n, n))
    for r in parts.collect():  # columns x columns numbers
        i, j = r["i"], r["j"]
        high, wide = min(block, n - i), min(block, n - j)
        out[i : i + high, j : j + wide] = np.frombuffer(r["sums"]).reshape(high, wide)
        out[j : j + wide, i : i + high] = out[i : i + high, j : j + wide].T
    return out


def _line(key: tuple[int, int, int], total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in key], pa.array([total.tobytes()], pa.binary())], names=["i", "j", "share", "sums"])


def pairwise_correlations(df: DataFrame, columns: list[Column], shifts: list[float]) -> np.ndarray:
    """Pearson r of every two columns on the rows complete in both; NaN where one does not vary there.

    ``shifts`` are numbers near the means, which keep the sums small.
    """
    n = len(columns)
    there = [c.isNotNull().cast("double") for c in columns]
    moved = [F.coalesce(c.cast("double") - F.lit(float(s)), F.lit(0.0)) for c, s in zip(columns, shifts)]
    sums = gram(df, [*there, *moved, *[m * m for m in moved]])
    count, first, second, product = sums[:n, :n], sums[n : 2 * n, :n], sums[2 * n :, :n], sums[n : 2 * n, n : 2 * n]
    with np.errstate(invalid="ignore", divide="ignore"):
        # first[a, b]: the sum of a over the rows that b has too
        covariance = product - first * first.T / count
        spread = np.maximum(second - first * first / count, 0)
        return covariance / np.sqrt(spread * spread.T)
