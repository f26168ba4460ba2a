"""Helpers of the training-data operators: Arrow batches, byte tokens, stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tablelens.session import scratch_path

# Bytes of text that one round of array work takes at most (one longer text is one round).
ROUND_BYTES = 1 << 21

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it from there.

    Later passes reread files that every executor reaches, so a lost executor
    never recomputes what was written.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def extend(df: DataFrame, fields: list[StructField], work: Callable[[pa.RecordBatch], list], dropped: tuple[str, ...] = ()) -> DataFrame:
    """Append columns made batch by batch; a column of ``df`` with a new column's name is replaced, ``dropped`` ones are not returned."""
    new = {f.name for f in fields} | {*dropped}
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = StructType(kept + fields)
    kept_names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                columns = [batch.column(batch.schema.get_field_index(n)) for n in kept_names] + made
                columns = [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins; null is empty."""
    array = column.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def rounds(offsets: np.ndarray, limit: int = ROUND_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts, each of about ``limit`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def by_round(column: pa.Array, work: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Run ``work(bytes, offsets)`` over rounds of texts and join its arrays."""
    data, offsets = text_bytes(column)
    parts = [work(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in rounds(offsets)]
    return [np.concatenate(x) for x in zip(*parts)]


def runs(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero code that stay inside a text: starts, ends, text index."""
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True
    edge[0] = edge[-1] = True
    edge[1:-1] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    full = codes[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; the spans are ascending and disjoint."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    inside = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(inside, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
    values = _BYTE[data[place + np.repeat(starts, lengths)]] * powers[place]
    return mix(np.add.reduceat(values, inside) + lengths.astype(np.uint64))


def word_hash(word: str) -> int:
    """The same hash for one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by text index (ascending)."""
    return np.bincount(text, weights=values, minlength=n)
