"""Which charts suit a table: single columns, column pairs, missing data.

A score is significance x clarity x completeness.  All statistics come from a
few grouped aggregates shared by every candidate of a kind.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

from pyspark.sql import DataFrame, functions as F

from tablelens.functions.semantics import col, half_up, title_case
from tablelens.functions.tails import chi2_tail, f_tail
from tablelens.operators.crossproducts import pairwise_correlations
from tablelens.operators.profile import PAIRS_AT_ONCE, Profile, iqr_fences

# Weights and limits of the scoring rules.
SKEWED, SPIKY = 1.0, 0.05
SKEW_WEIGHT, OUTLIER_WEIGHT = 0.6, 0.4
RELATED = 0.3
EFFECT = 0.06
SMALL_CATEGORY = 15
HIGH_MISSING = 0.20
NEAR_UNIQUE = 0.95

CHART_SCHEMA = "kind string, chart string, columns array<string>, score double, details map<string,double>"


def _complete(p: Profile, *names: str) -> float:
    """1 minus the mean missing share."""
    if not p.rows:
        return 0.0
    return 1.0 - sum(p.facts[n].nulls / p.rows for n in names) / len(names)


def _grouping(p: Profile) -> list[str]:
    return [n for n, k in p.categories.items() if k in ("categorical", "text")]


def score_numeric(p: Profile) -> list[tuple]:
    names = [n for n in p.numeric if p.facts[n].filled and p.quartiles[n][0] is not None]
    exprs = []
    for i, n in enumerate(names):
        v = col(n).cast("double")
        low, high = iqr_fences(p.quartiles[n][0], p.quartiles[n][2])
        exprs += [F.skewness(v).alias(f"s{i}"), F.count_if((v < low) | (v > high)).alias(f"o{i}")]
    if not exprs:
        return []
    row = p.df.agg(*exprs).first()
    out = []
    for i, n in enumerate(names):
        skew = abs(row[f"s{i}"] or 0.0)
        skew = 0.0 if skew != skew else skew
        share = row[f"o{i}"] / p.facts[n].filled
        significance = SKEW_WEIGHT * (skew > SKEWED) + OUTLIER_WEIGHT * (share > SPIKY)
        chart = "histogram" if skew > SKEWED else "histogram_kde"
        out.append(("numeric", chart, [n], significance * 0.9 * _complete(p, n), {"skew": skew, "outlier_ratio": share}))
    return out


def score_categorical(p: Profile) -> list[tuple]:
    out = []
    for n in _grouping(p):
        size = p.facts[n].cardinality
        chart, clarity = next(
            (c, k) for c, k, limit in (("pie", 0.9, 8), ("bar_horizontal", 0.8, 50), ("bar_top_n", 0.6, None)) if limit is None or size <= limit
        )
        out.append(("categorical", chart, [n], 0.7 * clarity * _complete(p, n), {"cardinality": float(size)}))
    return out


def score_datetime(p: Profile) -> list[tuple]:
    return [
        ("datetime", "area_time", [n], 0.6 * 0.9 * _complete(p, n), {"missingness": 1.0 - _complete(p, n)})
        for n, k in p.categories.items()
        if k == "datetime"
    ]


def score_num_num(p: Profile) -> list[tuple]:
    """Correlation of each pair on the rows complete in that pair."""
    out = []
    pairs = list(itertools.combinations(p.numeric, 2))
    if len(pairs) > PAIRS_AT_ONCE:
        place = {n: i for i, n in enumerate(p.numeric)}
        found = pairwise_correlations(p.df, [col(n) for n in p.numeric], [p.facts[n].measures["mean"] or 0.0 for n in p.numeric])
        related_by = [float(found[place[a], place[b]]) for a, b in pairs]
    else:
        related_by = p.df.agg(*[F.corr(col(a).cast("double"), col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    for (a, b), r in zip(pairs, related_by):
        if r is None or r != r:
            continue
        related = abs(r) > RELATED
        score = min(abs(r), 1.0) * 0.7 * (0.8 if related else 0.5) * _complete(p, a, b)
        out.append(("num_num", "scatter" if related else "scatter_no_rel", [a, b], score, {"pearson_r": r}))
    return out


def anova(p: Profile) -> list[dict]:
    """One-way analysis of variance for every numeric x category pair, in one grouped pass.

    Rows are pre-aggregated per category value before the shuffle, so a value
    holding a third of the table costs no more than any other.
    """
    numbers, groups = p.numeric, _grouping(p)
    if not numbers or not groups:
        return []
    cells = F.array(
        *[
            F.struct(
                F.lit(g).alias("group"),
                # Long texts are grouped by a hash of the whole text instead of being shuffled.
                (F.xxhash64(col(g)).cast("string") if p.categories[g] == "text" else col(g)).alias("value"),
            )
            for g in groups
        ]
    )
    long = p.df.select(F.inline(cells), *[col(n).cast("double").alias(f"v{i}") for i, n in enumerate(numbers)]).filter(
        F.col("value").isNotNull()
    )
    per_value = long.groupBy("group", "value").agg(
        *[
            e
            for i in range(len(numbers))
            for e in (
                F.count(f"v{i}").alias(f"n{i}"),
                F.avg(f"v{i}").alias(f"m{i}"),
                F.var_pop(f"v{i}").alias(f"q{i}"),
            )
        ]
    )
    shifts = [p.facts[n].measures["mean"] or 0.0 for n in numbers]
    sums = []
    for i, shift in enumerate(shifts):
        n, d = F.col(f"n{i}"), F.col(f"m{i}") - F.lit(shift)
        sums += [
            F.count_if(n > 0).alias(f"k{i}"),
            F.sum(n).alias(f"n{i}"),
            F.sum(n * d).alias(f"d{i}"),
            F.sum(n * d * d).alias(f"b{i}"),
            F.sum(n * F.col(f"q{i}")).alias(f"w{i}"),
        ]
    out = []
    for r in per_value.groupBy("group").agg(*sums).collect():  # one row per category column
        for i, name in enumerate(numbers):
            k, n = r[f"k{i}"], r[f"n{i}"]
            if k < 2 or n <= k:
                continue
            between = r[f"b{i}"] - r[f"d{i}"] ** 2 / n
            within = r[f"w{i}"]
            ratio = (between / (k - 1)) / (within / (n - k)) if within else float("inf") if between else float("nan")
            total = between + within
            out.append(
                {
                    "number": name,
                    "group": r["group"],
                    "f": ratio,
                    "p": f_tail(p.df.sparkSession, ratio, k - 1, n - k),
                    "eta_squared": between / total if total else 0.0,
                }
            )
    return out


def score_num_cat(p: Profile) -> list[tuple]:
    out = []
    for a in anova(p):
        effect = max(0.0, 1.0 - a["p"])
        clarity = 0.7 if p.facts[a["group"]].cardinality <= 10 else 0.4
        out.append(
            (
                "num_cat",
                "boxplot_grouped" if effect > EFFECT else "bar_means",
                [a["number"], a["group"]],
                effect * 0.7 * clarity * _complete(p, a["number"], a["group"]),
                {"effect": effect, "f": a["f"], "eta_squared": a["eta_squared"]},
            )
        )
    return out


def contingency(p: Profile) -> list[dict]:
    """Chi-square independence tests for category pairs of at most 15 values each."""
    small = [n for n in _grouping(p) if p.facts[n].cardinality <= SMALL_CATEGORY]
    pairs = list(itertools.combinations(small, 2))
    if not pairs:
        return []
    cells = F.array(
        *[F.struct(F.lit(i).alias("pair"), col(a).alias("a"), col(b).alias("b")) for i, (a, b) in enumerate(pairs)]
    )
    counts = (
        p.df.select(F.inline(cells))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .groupBy("pair", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()  # at most 15 x 15 rows per pair
    )
    tables: dict[int, dict] = defaultdict(dict)
    for r in counts:
        tables[r["pair"]][(r["a"], r["b"])] = r["n"]
    out = []
    for i, (a, b) in enumerate(pairs):
        seen = tables[i]
        row_sum, col_sum = defaultdict(int), defaultdict(int)
        for (x, y), n in seen.items():
            row_sum[x] += n
            col_sum[y] += n
        total = sum(row_sum.values())
        dof = (len(row_sum) - 1) * (len(col_sum) - 1)
        if dof < 1:
            out.append({"a": a, "b": b, "chi2": 0.0, "p": 1.0, "dof": dof})
            continue
        chi2 = 0.0
        for x, y in itertools.product(row_sum, col_sum):
            expected = row_sum[x] * col_sum[y] / total
            gap = abs(seen.get((x, y), 0) - expected)
            if dof == 1:  # Yates continuity correction
                gap -= min(0.5, gap)
            chi2 += gap * gap / expected
        out.append({"a": a, "b": b, "chi2": chi2, "p": chi2_tail(p.df.sparkSession, chi2, dof), "dof": dof})
    return out


def score_cat_cat(p: Profile) -> list[tuple]:
    return [
        (
            "cat_cat",
            "heatmap" if t["p"] < 0.05 else "grouped_bar",
            [t["a"], t["b"]],
            (1 - t["p"]) * 0.7 * 0.8 * _complete(p, t["a"], t["b"]),
            {"chi2": t["chi2"], "p": t["p"]},
        )
        for t in contingency(p)
    ]


def missingness_map(p: Profile) -> list[tuple]:
    holes = [n for n, f in p.facts.items() if p.rows and f.nulls / p.rows > HIGH_MISSING]
    return [("missing", "missingness_heatmap", holes, 0.5, {})] if holes else []


def exclude_ids(p: Profile) -> list[tuple]:
    ids = [n for n, f in p.facts.items() if half_up(f.ratio, 4) > NEAR_UNIQUE]
    return [("exclude", "exclude_id_columns", ids, 0.0, {})] if ids else []


def candidates(p: Profile) -> list[tuple]:
    scorers = (score_numeric, score_categorical, score_datetime, score_num_num, score_num_cat, score_cat_cat, missingness_map, exclude_ids)
    return [c for s in scorers for c in s(p)]


def charts_df(p: Profile, rows: list[tuple]) -> DataFrame:
    """Candidates as a table; their number is bounded by columns and column pairs."""
    return p.df.sparkSession.createDataFrame(rows, CHART_SCHEMA)


def suggest(p: Profile, n: int = 3) -> DataFrame:
    """The n best charts with a positive score."""
    ranked = charts_df(p, candidates(p)).filter(F.col("score") > 0)
    return ranked.orderBy(F.col("score").desc(), "chart", "columns").limit(n)


def titles(suggested: DataFrame) -> DataFrame:
    """Readable title and subtitle per suggested chart."""

    def readable(c):
        return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))

    labels = F.transform("columns", readable)
    return suggested.select(
        "chart",
        "columns",
        "score",
        F.concat(readable(F.col("chart")), F.lit(": "), F.array_join(labels, " vs ")).alias("title"),
        F.format_string("Visualizing relationship across %d variables.", F.size("columns")).alias("subtitle"),
    )


def dataset_summary(p: Profile, name: str) -> str:
    """One sentence on size, and one on the leading metric."""
    text = f"Dataset '{name}' contains {p.rows:,} records across {len(p.facts)} attributes."
    metric = p.primary["metric"]
    return text if metric is None else f"{text} The primary target metric identified is '{title_case(metric)}'."


def business_names(p: Profile) -> DataFrame:
    rows = [(n, title_case(n)) for n in p.facts]
    return p.df.sparkSession.createDataFrame(rows, "column string, label string")


def relationships(p: Profile, n: int | None = None) -> DataFrame:
    """Sentences for the pairs (the first ``n``, if given) with |r| of at least 0.4."""
    place = {c: i for i, c in enumerate(p.numeric)}
    rows = []
    for a, b, r in p.correlations:
        if place[a] < place[b] and r is not None and abs(r) >= 0.4:
            word = "positive" if r > 0 else "negative"
            rows.append((a, b, r, f"Strong {word} correlation (r={r:.2f}) observed between '{a}' and '{b}'."))
    return p.df.sparkSession.createDataFrame(rows[:n], "col_a string, col_b string, r double, text string")
