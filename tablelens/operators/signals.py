"""Signals: outliers, drift, coupled columns, missing-data clusters, imbalance.

Each detector runs a few whole-table aggregates and then decides on numbers
whose count is bounded by the number of columns (or column pairs).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.functions.semantics import as_time, col, half_up, title_case
from tablelens.operators.crossproducts import gram
from tablelens.operators.profile import PAIRS_AT_ONCE, Profile, iqr_fences
from tablelens.operators.ranks import bucket_number, order_cutoffs, text_keys

# Bands and thresholds of the detectors.
OUTLIER_BAND = (0.005, 0.15)
OUTLIER_FULL = 0.05
SHIFT_Z, SHIFT_FULL = 2.0, 4.0
STRONG_R = 0.80
STRONG_MI = 0.65
CLUSTER_MIN_NULLS, CLUSTER_RATIO = 5, 0.60
DOMINANT_SHARE = 0.80
MAX_SIGNALS = 8

SIGNAL_SCHEMA = (
    "signal_type string, columns array<string>, title string, description string, severity double, "
    "significance double, relevance double, details map<string,string>"
)


@dataclass
class Signal:
    kind: str
    columns: list[str]
    title: str
    description: str
    significance: float
    relevance: float
    details: dict = field(default_factory=dict)

    @property
    def severity(self) -> float:
        return min(1.0, self.significance * self.relevance)

    def row(self) -> tuple:
        scores = (half_up(x, 3) for x in (self.severity, self.significance, self.relevance))
        details = {k: str(v) for k, v in self.details.items()}
        return (self.kind, self.columns, self.title, self.description, *scores, details)


def to_df(spark, signals: list[Signal]) -> DataFrame:
    return spark.createDataFrame([s.row() for s in signals], SIGNAL_SCHEMA)


def iqr_outliers(p: Profile) -> list[Signal]:
    """Numeric columns whose share of values beyond the IQR fences is notable but not routine."""
    out = []
    if p.rows < 10:
        return out
    for n in p.stats_columns:
        q1, _, q3 = p.quartiles[n]
        if p.facts[n].filled < 10 or q1 is None:
            continue
        share = p.outliers[n] / p.rows
        if q3 - q1 > 0 and OUTLIER_BAND[0] <= share <= OUTLIER_BAND[1]:
            low, high = iqr_fences(q1, q3)
            out.append(
                Signal(
                    "outlier",
                    [n],
                    f"Outlier Spike in {title_case(n)}",
                    f"{p.outliers[n]} values ({share:.1%} of rows) lie outside the IQR fences.",
                    min(1.0, share / OUTLIER_FULL),
                    p.relevance(n),
                    {
                        "outlier_count": p.outliers[n],
                        "outlier_ratio": half_up(share, 4),
                        "lower_bound": half_up(low, 2),
                        "upper_bound": half_up(high, 2),
                        "iqr": half_up(q3 - q1, 2),
                    },
                )
            )
    return out


def zscore_outliers(df: DataFrame, columns: list[str], order_by: list[str], n: int = 5) -> DataFrame:
    """Values more than three deviations from the mean: count per column and the first n in order.

    Needs more than three values and some spread, else the column is skipped.
    """
    exprs = [e for c in columns for e in (F.count(col(c)), F.avg(col(c)), F.stddev_samp(col(c)))]
    stats = df.agg(*[e.alias(f"s{i}") for i, e in enumerate(exprs)]).first()
    cells = []
    for i, c in enumerate(columns):
        filled, mean, std = stats[3 * i : 3 * i + 3]
        if filled > 3 and std and std > 0:
            v = col(c).cast("double")
            far = F.abs(v - F.lit(float(mean))) / F.lit(float(std)) > 3.0
            cells.append(F.when(far, F.struct(F.lit(c).alias("column"), v.alias("value"))))
    if not cells:
        return df.select(F.lit("").alias("column"), F.lit(0.0).alias("value"), *order_by).limit(0)
    hits = df.select(F.explode(F.array_compact(F.array(*cells))).alias("h"), *[col(c) for c in order_by]).select(
        "h.*", *order_by
    )
    first = Window.partitionBy("column").orderBy(*order_by)
    shown = hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
    totals = hits.groupBy("column").agg(F.count(F.lit(1)).alias("outliers"))
    return shown.join(totals, "column")


def root_cause(
    df: DataFrame, flagged: Column, columns: list[str], stats_from: DataFrame | None = None
) -> DataFrame:
    """For flagged rows, the other numeric column furthest (>1.5 deviations) from its mean.

    Means and deviations come from ``stats_from`` (the whole table) when given.
    """
    stats = (df if stats_from is None else stats_from).agg(
        *[e.alias(f"s{i}_{k}") for i, c in enumerate(columns) for k, e in (("m", F.avg(col(c))), ("s", F.stddev_samp(col(c))))]
    ).first()
    marks = []
    for i, c in enumerate(columns):
        mean, std = stats[f"s{i}_m"], stats[f"s{i}_s"]
        if not std:
            continue
        v = col(c).cast("double")
        z = F.abs(v - F.lit(float(mean))) / F.lit(float(std))
        marks.append(
            F.when(
                z > 1.5,
                # Earlier columns win ties, hence the negative position.
                F.struct(
                    z.alias("z"),
                    F.lit(-i).alias("order"),
                    F.lit(c).alias("driver"),
                    v.alias("driver_value"),
                    F.lit(float(mean)).alias("driver_mean"),
                ),
            )
        )
    rows = df.filter(flagged)
    if not marks:
        return rows.withColumns(
            {
                "driver": F.lit(None).cast("string"),
                "direction": F.lit(None).cast("string"),
                "driver_value": F.lit(None).cast("double"),
                "driver_mean": F.lit(None).cast("double"),
                "driver_z": F.lit(None).cast("double"),
                "root_cause": F.lit("No clear secondary driver detected."),
            }
        )
    best = F.array_max(F.array_compact(F.array(*marks)))
    rows = rows.withColumn("__best", best)
    b = F.col("__best")
    direction = F.when(b["driver_value"] > b["driver_mean"], "spiked").when(b.isNotNull(), "dropped")
    text = F.when(b.isNull(), F.lit("No clear secondary driver detected.")).otherwise(
        F.format_string(
            "Likely driven by %s, which %s to %.1f (avg: %.1f).", b["driver"], direction, b["driver_value"], b["driver_mean"]
        )
    )
    return rows.select(
        *[col(c) for c in df.columns],
        b["driver"].alias("driver"),
        direction.alias("direction"),
        b["driver_value"].alias("driver_value"),
        b["driver_mean"].alias("driver_mean"),
        b["z"].alias("driver_z"),
        text.alias("root_cause"),
    )


def distribution_shift(p: Profile, date: str, tie_break: list[str]) -> list[Signal]:
    """Equal-count buckets in date order whose mean leaves the overall mean by 2 deviations.

    Bucket limits are exact ranks found without sorting the table; then one
    grouped aggregate yields at most ten rows.  The first such bucket per column counts.
    """
    df = p.df.filter(as_time(p.df, date).isNotNull())
    rows = df.count()
    if rows < 30 or not p.numeric:
        return []
    buckets = max(4, min(10, rows // 15))
    size = rows // buckets
    order_by = text_keys(df, [date, *tie_break])
    cutoffs = order_cutoffs(df, order_by, [b * size for b in range(1, buckets)], rows, final_rows=p.final_rows)
    when = as_time(df, date)
    exprs = [e for i, c in enumerate(p.numeric) for e in (F.avg(col(c)).alias(f"m{i}"), F.count(col(c)).alias(f"n{i}"))]
    means = (
        df.groupBy(bucket_number(df, order_by, cutoffs).alias("b"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.date_format(F.min(when), "yyyy-MM-dd").alias("start"),
            F.date_format(F.max(when), "yyyy-MM-dd").alias("end"),
            *exprs,
        )
        .orderBy("b")
        .collect()
    )
    spread = df.agg(
        *[e for i, c in enumerate(p.numeric) for e in (F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}"))]
    ).first()
    out = []
    for i, c in enumerate(p.numeric):
        mean, std = spread[f"m{i}"], spread[f"s{i}"]
        if mean is None or not std or std <= 1e-8:
            continue
        hit = next(
            (
                (r, (r[f"m{i}"] - mean) / std)
                for r in means
                if r["rows"] >= 5 and r[f"m{i}"] is not None and abs(r[f"m{i}"] - mean) / std >= SHIFT_Z
            ),
            None,
        )
        if hit is None:
            continue
        r, z = hit
        change = (r[f"m{i}"] - mean) / abs(mean) * 100.0 if mean else 0.0
        word = "sharp increase" if z > 0 else "significant drop"
        out.append(
            Signal(
                "distribution_shift",
                [c, date],
                f"Distribution Shift in {title_case(c)}",
                f"A {word} ({change:+.1f}%, z={z:.2f}) from {r['start']} to {r['end']}.",
                min(1.0, abs(z) / SHIFT_FULL),
                p.relevance(c),
                {
                    "bucket": r["b"],
                    "period_start": r["start"],
                    "period_end": r["end"],
                    "bucket_mean": half_up(r[f"m{i}"], 2),
                    "overall_mean": half_up(mean, 2),
                    "z_score": half_up(z, 2),
                    "pct_change": half_up(change, 2),
                },
            )
        )
    return out


def correlation_signals(p: Profile) -> list[Signal]:
    """Column pairs that move together or against each other."""
    out = []
    place = {n: i for i, n in enumerate(p.numeric)}
    for a, b, r in p.correlations:
        if place[a] >= place[b] or r is None or abs(r) < STRONG_R:
            continue
        together = r > 0
        out.append(
            Signal(
                "high_correlation" if together else "inverse_relationship",
                [a, b],
                f"{'Strong Correlation' if together else 'Inverse Relationship'}: {title_case(a)} & {title_case(b)}",
                f"r={r:.2f}: {a} and {b} move {'together' if together else 'in opposite directions'}.",
                min(1.0, abs(r)),
                (p.relevance(a) + p.relevance(b)) / 2.0,
                {"r": half_up(r, 3), "relationship": "positive" if together else "negative"},
            )
        )
    return out


def information_signals(p: Profile) -> list[Signal]:
    """Columns that share much information with the primary metric."""
    return [
        Signal(
            "high_correlation",
            [c, target],
            f"High Non-Linear Relationship: {c} & {target}",
            f"Mutual information of {score:.2f} points to a non-linear link.",
            min(1.0, score),
            p.relevance(c),
            {"mi_score": half_up(score, 3), "relationship": "non_linear"},
        )
        for target, c, score, _ in p.information
        if score >= STRONG_MI
    ]


def missingness_clusters(p: Profile) -> list[Signal]:
    """Column pairs whose nulls occur together."""
    holes = [n for n, f in p.facts.items() if f.null_pct > 0.0]
    if len(holes) < 2 or p.rows < 10:
        return []
    pairs = [(a, b) for a, b in itertools.combinations(holes, 2) if p.facts[a].nulls >= CLUSTER_MIN_NULLS]
    if len(pairs) > PAIRS_AT_ONCE:
        sums, place = gram(p.df, [col(n).isNull() for n in holes]), {n: i for i, n in enumerate(holes)}
        shared = [round(sums[place[a], place[b]]) for a, b in pairs]
    else:
        shared = p.df.agg(*[F.count_if(col(a).isNull() & col(b).isNull()).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    out = []
    for (a, b), both in zip(pairs, shared):
        ratio = both / p.facts[a].nulls
        if ratio >= CLUSTER_RATIO:
            out.append(
                Signal(
                    "missingness_cluster",
                    [a, b],
                    f"Missingness Cluster: {title_case(a)} & {title_case(b)}",
                    f"'{b}' is missing in {ratio:.1%} of the rows where '{a}' is ({both} rows).",
                    min(1.0, ratio),
                    (p.relevance(a) + p.relevance(b)) / 2.0,
                    {
                        "col_a": a,
                        "col_b": b,
                        "co_occurrence_pct": half_up(ratio * 100, 1),
                        "co_occurrence_count": both,
                    },
                )
            )
    return out


def category_imbalance(p: Profile) -> list[Signal]:
    """Categories where one value holds at least 80 % of the rows."""
    out = []
    if p.rows < 10:
        return out
    for n, values in p.top_values.items():
        if p.categories[n] != "categorical" or not values:
            continue
        value, count = values[0]
        share = count / p.rows
        if share < DOMINANT_SHARE:
            continue
        listed = sum(c for _, c in values)
        gini = 1.0 - sum((c / listed) ** 2 for _, c in values)
        out.append(
            Signal(
                "category_imbalance",
                [n],
                f"Category Imbalance in {title_case(n)}",
                f"'{value}' makes up {share:.1%} of all rows (Gini impurity {gini:.2f}).",
                min(1.0, share),
                p.relevance(n),
                {
                    "dominant_value": value,
                    "dominant_share_pct": half_up(share * 100, 1),
                    "gini_impurity": half_up(gini, 3),
                    "cardinality": p.facts[n].cardinality,
                },
            )
        )
    return out


def multivariate_signal(p: Profile, key_columns: list[str]) -> list[Signal]:
    """Rows unusual across all numeric columns, by an isolation forest."""
    from tablelens.operators.forest import multivariate_outliers

    names = p.stats_columns
    if len(names) < 2 or p.rows < 20:
        return []
    count = multivariate_outliers(p.df, names, key_columns, p.rows).filter("is_outlier").count()
    share = count / p.rows
    if not OUTLIER_BAND[0] <= share <= OUTLIER_BAND[1]:
        return []
    lead = p.primary["metric"] if p.primary["metric"] in names else names[0]
    return [
        Signal(
            "multivariate_outlier",
            names[:3],
            "Multivariate Outlier Pattern Detected",
            f"{count} rows ({share:.1%}) are unusual across the numeric columns.",
            min(1.0, share / OUTLIER_FULL),
            p.relevance(lead),
            {"anomalous_rows": count, "anomalous_pct": half_up(share * 100, 2), "evaluated_columns": ", ".join(names)},
        )
    ]


def rank_signals(signals: list[Signal], n: int = MAX_SIGNALS) -> list[Signal]:
    """One signal per type and column set (the first), strongest first."""
    unique: dict[tuple, Signal] = {}
    for s in signals:
        unique.setdefault((s.kind, tuple(sorted(s.columns))), s)
    return sorted(unique.values(), key=lambda s: -half_up(s.severity, 3))[:n]


def detect(p: Profile, key_columns: list[str], n: int = MAX_SIGNALS) -> list[Signal]:
    """All detectors, deduplicated and ranked."""
    date = p.primary["date"]
    found = iqr_outliers(p) + multivariate_signal(p, key_columns)
    if date:
        found += distribution_shift(p, date, [k for k in key_columns if k != date])
    found += correlation_signals(p) + information_signals(p) + missingness_clusters(p) + category_imbalance(p)
    return rank_signals(found, n)
