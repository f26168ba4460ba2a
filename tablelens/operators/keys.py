"""Which columns join two tables: candidates by name, measured on the data."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.functions.semantics import col

# Confidence by kind of name match.
SAME_NAME, ID_PATTERN = 0.95, 0.98


@dataclass(frozen=True)
class KeyPair:
    left_table: str
    left: str
    right_table: str
    right: str
    confidence: float


def candidate_pairs(tables: dict[str, list[str]]) -> list[KeyPair]:
    """Equal names holding id or key, and ``id`` against ``<table>_id``."""
    out = []
    for (t1, c1), (t2, c2) in itertools.combinations(tables.items(), 2):
        for a, b in itertools.product(c1, c2):
            x, y = a.lower(), b.lower()
            if x == y and ("id" in x or "key" in x):
                out.append(KeyPair(t1, a, t2, b, SAME_NAME))
            elif (x == "id" and f"{t1.lower()}_id" in y) or (y == "id" and f"{t2.lower()}_id" in x):
                out.append(KeyPair(t1, a, t2, b, ID_PATTERN))
    return out


def _as_text(df: DataFrame, name: str) -> Column:
    """A key value as text, written alike for every numeric type."""
    kind, value = df.schema[name].dataType, col(name)
    if isinstance(kind, T.IntegralType):
        return value.cast("string")
    if isinstance(kind, T.FractionalType):
        return F.when(value == F.floor(value), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def measure_pairs(tables: dict[str, DataFrame], pairs: list[KeyPair]) -> DataFrame:
    """One row per pair: how unique each side is, how much of it the other side holds, and the relationship.

    Each table is read once, however many pairs it is part of, and reduced to
    one row per column and key value before the sides meet, so a hot key meets
    as a single row.  The uses of a column are literals, a few per pair.
    """
    uses: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for i, p in enumerate(pairs):
        uses.setdefault((p.left_table, p.left), []).append((i, 0))
        uses.setdefault((p.right_table, p.right), []).append((i, 1))
    # whole numbers meet as they are; as soon as one key is of another type, all meet as text
    whole = all(isinstance(tables[t].schema[c].dataType, T.IntegralType) for t, c in uses)
    parts = []
    for name, df in tables.items():
        wanted = [c for c in df.columns if (name, c) in uses]
        if not wanted:
            continue
        cells = F.array(*[F.struct(F.lit(i).alias("c"), (col(c).cast("long") if whole else _as_text(df, c)).alias("k")) for i, c in enumerate(wanted)])
        counts = df.select(F.inline(cells)).filter(F.col("k").isNotNull()).groupBy("c", "k").agg(F.count(F.lit(1)).alias("n"))
        sides = F.array(*[F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(s).alias("side")) for i, s in uses[name, c]]) for c in wanted])
        parts.append(counts.select("k", "n", F.inline(F.get(sides, F.col("c")))))
    both = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("pair", "k")
        .agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    )
    l, r = F.col("l"), F.col("r")
    found = both.groupBy("pair").agg(
        F.count(l).alias("left_keys"),
        F.count(r).alias("right_keys"),
        F.count_if(l.isNotNull() & r.isNotNull()).alias("shared_keys"),
        F.max(l).alias("left_max"),
        F.max(r).alias("right_max"),
    )
    names = "pair int, left_table string, left_column string, right_table string, right_column string, confidence double"
    listed = tables[pairs[0].left_table].sparkSession.createDataFrame(
        [(i, p.left_table, p.left, p.right_table, p.right, p.confidence) for i, p in enumerate(pairs)], names
    )
    one_l, one_r = (F.coalesce(F.col(m), F.lit(0)) <= 1 for m in ("left_max", "right_max"))
    kind = (
        F.when(one_l & one_r, "one-to-one")
        .when(one_l, "one-to-many")
        .when(one_r, "many-to-one")
        .otherwise("many-to-many")
    )
    # A pair without any key value keeps its row.
    return listed.join(found, "pair", "left").select(
        "left_table",
        "left_column",
        "right_table",
        "right_column",
        "confidence",
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("left_keys", "right_keys")],
        F.coalesce(F.try_divide("shared_keys", "left_keys"), F.lit(0.0)).alias("left_contained"),
        F.coalesce(F.try_divide("shared_keys", "right_keys"), F.lit(0.0)).alias("right_contained"),
        kind.alias("relationship"),
    )


def measure(left: DataFrame, right: DataFrame, pair: KeyPair) -> DataFrame:
    """The row of a single pair."""
    return measure_pairs({pair.left_table: left, pair.right_table: right}, [pair])


def detect_keys(tables: dict[str, DataFrame]) -> DataFrame | None:
    """All candidate pairs of all tables, measured; None when no names match."""
    pairs = candidate_pairs({n: df.columns for n, df in tables.items()})
    return measure_pairs(tables, pairs) if pairs else None


def join_detected(left: DataFrame, right: DataFrame, pair: KeyPair, how: str = "inner") -> DataFrame:
    """Join by a detected pair; Spark picks the strategy and splits skewed keys at run time."""
    renamed = right.select(*[col(c).alias(f"{pair.right_table}_{c}" if c in left.columns else c) for c in right.columns])
    key = f"{pair.right_table}_{pair.right}" if pair.right in left.columns else pair.right
    return left.join(renamed, col(pair.left) == col(key), how)
