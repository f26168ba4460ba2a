"""Isolation forest on Spark: sampled trees, built in parallel, scored everywhere.

Each tree sees 256 rows picked by a hash of the row key, so the picks do not
depend on partitioning.  Trees are grown one per task; together they are a few
thousand numbers, small by construction (trees x 511 nodes), and are shipped to
the executors, where all rows are scored in Arrow batches.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.functions.semantics import as_time, col
from tablelens.operators.ranks import exact_quantiles
from tablelens.session import durable

SAMPLE_ROWS = 256
SEED = 42
TREE_SCHEMA = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>"

# Workers get these helpers with the job and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def mean_path(n: int) -> float:
    """Average search path in a random binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """Nodes of one tree; a leaf has feature -1 and carries its path length."""
    nodes: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "path": []}

    def add(feature: int, threshold: float, path: float) -> int:
        for key, value in zip(nodes, (feature, threshold, -1, -1, path)):
            nodes[key].append(value)
        return len(nodes["feature"]) - 1

    pending = [(x, 0, -1, "")]
    while pending:
        rows, depth, parent, side = pending.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            here = add(-1, 0.0, depth + mean_path(len(rows)))
        else:
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(low[feature], high[feature]))
            here = add(feature, cut, 0.0)
            goes_left = rows[:, feature] <= cut
            pending.append((rows[~goes_left], depth + 1, here, "right"))
            pending.append((rows[goes_left], depth + 1, here, "left"))
        if parent >= 0:
            nodes[side][parent] = here
    return nodes


def walk(tree: dict, x: np.ndarray) -> np.ndarray:
    """Path length of every row in one tree, level by level."""
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        feature = tree["feature"][at]
        inner = np.flatnonzero(feature >= 0)
        if len(inner) == 0:
            return tree["path"][at]
        node = at[inner]
        left = x[inner, feature[inner]] <= tree["threshold"][node]
        at[inner] = np.where(left, tree["left"][node], tree["right"][node])


def sample_rows(df: DataFrame, features: list[Column], key: list[str], trees: int, rows: int) -> DataFrame:
    """(tree, order, f0..fn): about 256 rows for every tree, by hash of the row key."""
    names = [f"f{i}" for i in range(len(features))]
    base = df.select(*[f.cast("double").alias(n) for f, n in zip(features, names)], *[col(k).alias(f"k{i}") for i, k in enumerate(key)])
    keys = [F.col(f"k{i}") for i in range(len(key))]
    # A row goes to `share` trees on average: the whole part surely, one more with the rest as its
    # chance.  Its trees lie a hashed stride apart that has no factor in common with their number.
    share = trees * min(1.0, 1.5 * SAMPLE_ROWS / max(rows, 1))
    strides = F.array(*[F.lit(s) for s in range(1, trees + 1) if math.gcd(s, trees) == 1])
    hashed = lambda n: F.xxhash64(F.lit(SEED + n), *keys)
    chance = F.shiftrightunsigned(hashed(0), 11).cast("double") / float(1 << 53)
    stride = F.element_at(strides, (F.pmod(hashed(3), F.size(strides)) + 1).cast("int"))
    kept = base.withColumn("picks", F.floor(F.lit(share) + chance).cast("int")).filter("picks > 0")
    dealt = kept.withColumn("pick", F.explode(F.sequence(F.lit(1), F.least("picks", F.lit(trees)))))
    dealt = dealt.withColumn("tree", F.pmod(hashed(1) + F.col("pick") * stride, F.lit(trees)).cast("int"))
    order = F.xxhash64(F.lit(SEED + 2), "tree", *keys)
    first = Window.partitionBy("tree").orderBy("order")
    return (
        dealt.select("tree", order.alias("order"), *names)
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= SAMPLE_ROWS)
    )


def fit(df: DataFrame, features: list[Column], key: list[str], trees: int, rows: int) -> list[dict]:
    """Grow the trees, one group of at most 256 rows each."""
    names = [f"f{i}" for i in range(len(features))]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", *names])
        number = int(pdf["tree"].iloc[0])
        x = pdf[names].to_numpy(dtype=float)
        limit = math.ceil(math.log2(max(len(x), 2)))
        tree = grow(x, np.random.default_rng([SEED, number]), limit)
        return pd.DataFrame({"tree": [number], **{k: [v] for k, v in tree.items()}})

    grown = sample_rows(df, features, key, trees, rows).groupBy("tree").applyInPandas(build, TREE_SCHEMA)
    out = []
    for r in sorted(grown.collect(), key=lambda r: r["tree"]):
        out.append(
            {
                "feature": np.array(r["feature"]),
                "threshold": np.array(r["threshold"]),
                "left": np.array(r["left"]),
                "right": np.array(r["right"]),
                "path": np.array(r["path"]),
            }
        )
    return out


def scale(rows: int) -> float:
    return mean_path(min(SAMPLE_ROWS, rows)) or 1.0


def step_scores(trees: list[dict], norm: float) -> tuple[np.ndarray, np.ndarray]:
    """A one-column forest as a step function: sorted cuts and the score of each interval.

    The score is 0.5 - 2^(-path/norm), negative for anomalies.
    """
    cuts = np.unique(np.concatenate([t["threshold"][t["feature"] >= 0] for t in trees]))
    if len(cuts) == 0:
        inner = np.array([0.0])
    else:
        inner = np.concatenate([cuts, [np.nextafter(cuts[-1], np.inf)]])
    path = np.mean([walk(t, inner.reshape(-1, 1)) for t in trees], axis=0)
    return cuts, 0.5 - np.exp2(-path / norm)


def score_multivariate(trees: list[dict], norm: float, features: list[Column], df: DataFrame) -> Column:
    shipped = df.sparkSession.sparkContext.broadcast((trees, norm))

    @F.pandas_udf("double")
    def score(values: pd.DataFrame) -> pd.Series:
        held, scale_ = shipped.value
        x = values.to_numpy(dtype=float)
        path = np.zeros(len(x))
        for t in held:
            path += walk(t, x)
        return pd.Series(0.5 - np.exp2(-path / len(held) / scale_))

    return score(F.struct(*[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)]))


def weighted_percentile(values: np.ndarray, counts: np.ndarray, p: float) -> float:
    """Linear percentile of values repeated ``counts`` times."""
    order = np.argsort(values)
    values, ends = values[order], np.cumsum(counts[order])
    at = p * (ends[-1] - 1)
    low, high = math.floor(at), math.ceil(at)
    a = values[np.searchsorted(ends, low, side="right")]
    b = values[np.searchsorted(ends, high, side="right")]
    return float(a + (b - a) * (at - low))


ANOMALY_COLUMNS = ("value", "score", "deviation_pct", "severity", "date", "category", "region", "root_cause")


def univariate_anomalies(
    df: DataFrame,
    metric: str,
    key: list[str],
    date: str | None = None,
    category: str | None = None,
    geo: str | None = None,
    drivers: list[str] | None = None,
    trees: int = 100,
) -> DataFrame:
    """Rows whose metric isolates early; the lowest 5 % of all scores are critical."""
    from tablelens.operators.signals import root_cause

    value = col(metric).cast("double")
    df = df.filter(value.isNotNull() & ~F.isnan(value))
    rows, mean = df.agg(F.count(F.lit(1)), F.avg(value)).first()
    if rows < 10:
        return df.withColumns({c: F.lit(None).cast("double" if c in ("value", "score", "deviation_pct") else "string") for c in ANOMALY_COLUMNS}).limit(0)
    cuts, scores = step_scores(fit(df, [value], key, trees, rows), scale(rows))
    shipped = df.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def interval(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shipped.value, v.to_numpy(dtype=float), side="left").astype("int32"))

    # At most one row per interval: trees x 255 + 1.
    seen = df.select(interval(value).alias("i")).groupBy("i").count().collect()
    cell = np.array([r["i"] for r in seen])
    critical = weighted_percentile(scores[cell], np.array([r["count"] for r in seen]), 0.05)
    table = df.sparkSession.sparkContext.broadcast((cuts, scores))

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        edges, held = table.value
        return pd.Series(held[np.searchsorted(edges, v.to_numpy(dtype=float), side="left")])

    scored = df.withColumn("__score", score(value)).filter(F.col("__score") < 0)
    found = scored.withColumns(
        {
            "value": value,
            "score": F.col("__score"),
            "deviation_pct": (value - F.lit(mean)) / F.lit(mean or 1.0) * 100.0,
            "severity": F.when(F.col("__score") <= F.lit(critical), "Critical").otherwise("High"),
            "date": as_time(df, date).cast("string") if date else F.lit(None).cast("string"),
            "category": F.coalesce(col(category).cast("string"), F.lit("None")) if category else F.lit("General"),
            "region": F.coalesce(col(geo).cast("string"), F.lit("None")) if geo else F.lit("Global"),
        }
    ).drop("__score")
    names = [c for c in (drivers or []) if c != metric]
    if not names:
        return found.withColumn("root_cause", F.lit("No clear secondary driver detected."))
    return root_cause(found, F.lit(True), names, stats_from=df)


def multivariate_outliers(
    df: DataFrame, columns: list[str], key: list[str], rows: int | None = None, trees: int = 50, share: float = 0.05
) -> DataFrame:
    """Score and flag the ``share`` most isolated rows over all numeric columns; nulls count as 0."""
    rows = df.count() if rows is None else rows
    features = [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in columns]
    grown = fit(df, features, key, trees, rows)
    scored = df.withColumn("score", score_multivariate(grown, scale(rows), features, df))
    scored = durable(scored)  # several passes follow: score once, keep in the shared folder
    limit = exact_quantiles(scored, {"score": [share]}, rows)["score"][0]
    return scored.withColumn("is_outlier", F.col("score") < F.lit(limit))
