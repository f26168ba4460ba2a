"""Order MinHash fingerprints: likeness that follows edit distance.

The k-mers of a text (``K`` code points; a shorter text is one k-mer) are
numbered by occurrence, so that repeats count.  A hash of (k-mer, number) deals
them into ``SKETCHES`` bins; each bin selects its ``TUPLE`` least ones, puts
them back into text order, and hashes the tuple of k-mers to 16 bits.  Likeness
is the share of bins with equal tuples among bins that either text fills.

The edited text of a document is its text with the last floor(n/2) code points
replaced by the first as many (or all) of the next document in the order of
ids (nulls last, ties by text); the last is followed by the first.  Texts move
once, in a range shuffle by id.  Within a partition the next document is the
next row; the first and last rows of partitions meet in a narrow join.

Null text is empty; empty texts have an empty fingerprint of zeros, and two
empty texts have likeness 1.  One document is its own next.  Equal texts have
equal fingerprints, whatever their other columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablelens.llm.common import mix, stored

K = 6
SKETCHES = 64
TUPLE = 2
_PLACE = np.uint64(21)  # bits of a position; longer texts take the slower way
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)


def _numbered(kmers: np.ndarray) -> np.ndarray:
    """Occurrence number of every k-mer hash, in text order."""
    n = len(kmers)
    if n < 1 << int(_PLACE):
        order_key = np.sort((kmers >> _PLACE << _PLACE) | np.arange(n, dtype=np.uint64))
        order = (order_key & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
        group = order_key >> _PLACE
    else:
        order = np.argsort(kmers >> _PLACE, kind="stable")
        group = (kmers >> _PLACE)[order]
    first = np.r_[True, group[1:] != group[:-1]]
    start = np.flatnonzero(first)
    number = np.empty(n, np.uint64)
    number[order] = (np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))).astype(np.uint64)
    return number


def sketch(text: str) -> np.ndarray:
    """The fingerprint: one 16-bit number per bin, 0 for an empty bin."""
    out = np.zeros(SKETCHES, np.uint16)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points)
    if not n:
        return out
    k = min(K, n)
    kmers = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        kmers = kmers * _STEP + points[i : n - k + 1 + i] + np.uint64(1)
    kmers = mix(kmers + np.uint64(k))
    value = mix(kmers * _TURN + _numbered(kmers))
    # the bin is the top of the value, so one sort lines up all bins
    m = len(value)
    if m < 1 << int(_PLACE):
        ranked = np.sort((value >> _PLACE << _PLACE) | np.arange(m, dtype=np.uint64))
        place = (ranked & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    else:
        place = np.argsort(value, kind="stable")
        ranked = value[place]
    edge = np.searchsorted(ranked >> np.uint64(64 - (SKETCHES - 1).bit_length()), np.arange(SKETCHES + 1, dtype=np.uint64))
    size = np.minimum(np.diff(edge), TUPLE)
    picked = np.full((SKETCHES, TUPLE), m)  # no position
    for i in range(TUPLE):
        full = size > i
        picked[full, i] = place[edge[:-1][full] + i]
    picked.sort(1)
    signs = np.append(kmers, np.uint64(0))[picked]
    signature = np.zeros(SKETCHES, np.uint64)
    for i in range(TUPLE):
        signature = mix(signature * _TURN + signs[:, i])
    out[:] = np.where(size > 0, np.maximum(signature >> np.uint64(48), 1), 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a > 0) | (b > 0)
    return float((a == b)[filled].mean()) if filled.any() else 1.0


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _pair(text: str, mine: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    changed = edited_text(text, following)
    other = sketch(changed)
    return len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), mine.astype(">u2").tobytes(), other.astype(">u2").tobytes(), likeness(mine, other), likeness(mine, theirs)


def _batch(ids: list, rows: list[tuple], edges: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    """Finished rows, and edge rows (kind, partition, text) that still lack a neighbour."""
    all_ids = ids + [e[0] for e in edges]
    blank = [None] * len(edges)
    columns = [pa.array(all_ids, id_type)]
    columns += [pa.array([r[i] for r in rows] + blank, kind) for i, (_, kind) in enumerate(_FIELDS)]
    done = [None] * len(rows)
    columns += [pa.array(done + [e[1] for e in edges], pa.string()), pa.array(done + [e[2] for e in edges], pa.int64()), pa.array(done + [e[3] for e in edges], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["id", *[n for n, _ in _FIELDS], "edge", "part", "text"])


_SCHEMA = "id {}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, edge string, part long, text string"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair every row of a sorted partition with the next one."""
    last = None  # id, text, sketch
    part, kind = None, None
    for batch in batches:
        ids, rows, edges = [], [], []
        kind = batch.column(0).type
        for key, text, where in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            mine = sketch(text)
            if last is None:
                part = where
                edges.append((key, "first", part, text))
            else:
                ids.append(last[0])
                rows.append(_pair(last[1], last[2], text, mine))
            last = (key, text, mine)
        yield _batch(ids, rows, edges, kind)
    if last is not None:
        yield _batch([], [], [(last[0], "last", part, last[1])], kind)


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_pair(t, sketch(t), f, sketch(f)) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_FIELDS)]], names=["id", *[n for n, _ in _FIELDS]])


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, with their likeness to it and to the next text."""
    kind = docs.schema[id_col].dataType.simpleString()
    order = [F.col("id").asc_nulls_last(), F.col("mark")]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("id", "text", F.spark_partition_id().cast("long").alias("part"))
    walked = stored(sorted_rows.mapInArrow(_walk, _SCHEMA.format(kind)), "neighbours")
    names = ["id", *[n for n, _ in _FIELDS]]
    done = walked.filter("edge IS NULL").select(*names)
    # two rows a partition: which partition follows (empty ones are skipped), and the first of all
    parts = walked.filter("edge = 'first'").select("part", F.lead("part").over(Window.orderBy("part")).alias("next_part"), F.min("part").over(Window.orderBy("part")).alias("least"))
    lasts = walked.filter("edge = 'last'").select("id", F.col("text").alias("mine"), "part")
    firsts = walked.filter("edge = 'first'").select(F.col("text").alias("following"), F.col("part").alias("next_part"))
    met = lasts.join(parts.select("part", F.coalesce("next_part", "least").alias("next_part")), "part").join(firsts, "next_part").select("id", "mine", "following")
    return done.unionByName(met.mapInArrow(_join_edges, walked.select(*names).schema)).withColumnRenamed("id", id_col)


def fingerprints_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    hexed = lambda name: F.lower(F.hex(name)).alias(name)
    found = neighbours(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_chars", hexed("edited_sha256"), hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")
