"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Tokens are runs of letters and digits, and runs of other signs.  A text is the
bag of its token n-grams (one and two tokens, and two and three token *shapes*:
letter case, digits, the sign itself; a token that repeats the one before is
one feature of its own), hashed into ``2**BITS`` slots and weighted by share.
The score is the sparse dot product of the slots with the weights, through the
logistic function.

The model is fitted on a bounded sample of labelled rows (``max_docs``, picked
by a hash of the id), dealt over a fixed number of shards.  Each shard runs the
per-coordinate update over its rows; the shard weights are averaged.  What is
collected is bounded by the number of slots.  Scoring covers every whole text.

Null and empty texts get the score of the bias alone.  Repeated labels of a
document count as their mean, 1 from one half up; null labels are left out.
Without any labelled row the score is 0.5.  Other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from tablelens.llm.common import WHITE, by_round, extend, fold, mix, runs, span_hashes, text_bytes

BITS = 18
SLOTS = 1 << BITS
SHARDS = 8
SCALE = 20.0  # a text's shares sum to this

_KIND = np.full(256, 2, np.uint8)  # 0 white or control, 1 letters and digits, 2 signs
_KIND[:0x20] = 0
_KIND[WHITE] = 0
_CASE = np.zeros(256, np.uint8)
for _chars, _bit in ((range(0x30, 0x3A), 1), (range(0x41, 0x5B), 2), (range(0x61, 0x7B), 4), (range(0x80, 0x100), 4)):
    _CASE[list(_chars)] = _bit
    _KIND[list(_chars)] = 1
_SALT = mix(np.arange(1, 7, dtype=np.uint64))
_TURN = np.uint64(0xD6E8FEB86659FD93)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text index of every feature occurrence."""
    starts, ends, text = runs(_KIND[data], offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    token = span_hashes(data, starts, ends)
    cases = np.bitwise_or.reduceat(_CASE[data], starts) if len(starts) else starts
    # reduceat runs on to the next start; the signs and blanks between add no case bits
    capital = (_CASE[data[starts]] == 2) & (cases == 6)
    shape = np.where(_KIND[data[starts]] == 1, mix(cases.astype(np.uint64) + np.uint64(8) * capital + np.uint64(1)), token)
    second = np.flatnonzero(text[1:] == text[:-1]) + 1 if len(text) > 1 else np.zeros(0, np.int64)
    third = second[1:][np.diff(second) == 1] if len(second) else second
    third = third[text[third] == text[third - 2]] if len(third) else third
    same = token[second] == token[second - 1]
    pair = np.where(same, np.uint64(7), mix(token[second - 1] * _TURN + token[second]))
    shapes2 = mix(shape[second - 1] * _TURN + shape[second])
    shapes3 = mix((shape[third - 2] * _TURN + shape[third - 1]) * _TURN + shape[third])
    keys = np.concatenate([token + _SALT[0], pair + _SALT[1], shapes2 + _SALT[2], shapes3 + _SALT[3]])
    where = np.concatenate([text, text[second], text[second], text[third]])
    return (mix(keys) >> np.uint64(64 - BITS)).astype(np.int64), where


@dataclass(frozen=True)
class QualityModel:
    bias: float
    weights: np.ndarray


def _fit_shard(alpha: float, beta: float, l1: float, l2: float, epochs: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "text", "label"])
        bags = []
        for text in rows["text"]:
            slots, _ = _features(*text_bytes(pa.array([text], pa.string())))
            kept, counts = np.unique(slots, return_counts=True)
            bags.append((kept, SCALE * counts / max(1, len(slots))))
        labels = rows["label"].to_numpy(float)
        z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)  # the last is the bias
        for _ in range(epochs):
            for (kept, value), label in zip(bags, labels):
                at, x = np.append(kept, SLOTS), np.append(value, 1.0)
                w = _weights(z[at], n[at], alpha, beta, l1, l2)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
        w = _weights(z, n, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        # the slot after the bias counts the shards that had rows
        return pd.DataFrame({"slot": np.append(at, SLOTS + 1), "weight": np.append(w[at], 1.0)})

    return fit


def _weights(z, n, alpha, beta, l1, l2):
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, max_docs: int = 20_000, epochs: int = 8, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1,
) -> QualityModel:
    """Learn from labelled rows outside fold 0, about ``max_docs`` of them at most."""
    known = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, folds) != 0))
        .groupBy(F.col(id_col).alias("key"))
        .agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    )
    n = known.count()
    order = F.xxhash64(F.col("key").cast("string"))
    if n > max_docs:
        known = known.filter(F.pmod(order, F.lit(1_000_000)) < int(1_000_000 * max_docs / n))
    picked = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    shards = (
        picked.join(F.broadcast(known), "key")  # at most about max_docs rows
        .select("text", "label", order.alias("order"), F.pmod(F.shiftright(order, 20), F.lit(SHARDS)).alias("shard"))
        .groupBy("shard")
        .applyInPandas(_fit_shard(alpha, beta, l1, l2, epochs), "slot int, weight double")
        .groupBy("slot")
        .agg(F.sum("weight").alias("weight"))
        .collect()
    )
    weights = np.zeros(SLOTS + 2)
    for row in shards:
        weights[row["slot"]] = row["weight"]
    weights /= max(1.0, weights[SLOTS + 1])
    return QualityModel(float(weights[SLOTS]), weights[:SLOTS].astype(np.float32))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """Append the score, 0 to 1, of every whole text."""
    bias, weights = model.bias, model.weights

    def one(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        slots, text = _features(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(text, weights=weights[slots], minlength=n)
        return [bias + SCALE * total / np.maximum(1, np.bincount(text, minlength=n))]

    def work(batch: pa.RecordBatch) -> list:
        (margin,) = by_round(batch.column(batch.schema.get_field_index(text_col)), one)
        return [pa.array(1 / (1 + np.exp(-np.clip(margin, -35, 35))))]

    return extend(docs, [StructField(out, DoubleType())], work)


def quality_table(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit_quality(docs, labels)
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), (fold("doc_id", 5) == 0).alias("held_out"))
    scored = score_quality(base, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    scored = score_quality(docs, fit_quality(docs, labels), out="__score")
    return scored.filter(F.col("__score") >= cut).select(*docs.columns)


def feature_counts(text: str | None) -> Iterator[tuple[int, int]]:
    """Slots and counts of one text (for tests)."""
    slots, _ = _features(*text_bytes(pa.array([text], pa.string())))
    return zip(*(a.tolist() for a in np.unique(slots, return_counts=True)))
