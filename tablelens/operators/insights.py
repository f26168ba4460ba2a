"""Scored insights, a short narrative, and a text summary of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.functions.semantics import col
from tablelens.operators.dashboard import geo_rollup, segment_shares, top_counts, value_counts
from tablelens.operators.profile import Profile
from tablelens.operators.query import auto_model

INSIGHT_COLUMNS = ("title", "description", "recommendation", "severity", "score", "category")

# Thresholds and scores of the insight rules.
GROWTH_NOTABLE, GROWTH_STRONG = 10.0, 25.0
QUALITY_LOW, QUALITY_POOR = 80, 60
FORECAST_DROP = -5.0


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns[c].alias(c) for c in INSIGHT_COLUMNS])


def growth_insight(kpis: DataFrame) -> DataFrame:
    """A row when the second half of the table differs from the first by more than 10 %."""
    g = F.col("growth_rate")
    up = g > 0
    return _rows(
        kpis.filter(F.abs(g) > GROWTH_NOTABLE),
        title=F.when(up, "Significant Growth Acceleration Detected").otherwise("Significant Revenue Contraction Detected"),
        description=F.format_string("Values shifted by %+.1f%% between the first and the second half of the records.", g),
        recommendation=F.when(up, "Plan capacity for the higher demand.").otherwise("Look into pricing and demand to stop the decline."),
        severity=F.when(F.abs(g) > GROWTH_STRONG, "High").otherwise("Medium"),
        score=F.least(F.lit(95), F.floor(F.abs(g) * 2.5)).cast("int"),
        category=F.when(up, "Growth").otherwise("Risk"),
    )


def anomaly_insight(anomalies: DataFrame) -> DataFrame:
    """A row when the table holds anomalies, naming the most extreme one."""
    found = anomalies.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity") == "Critical").alias("critical"),
        F.max_by(F.struct("date", "value", "score"), F.struct(F.abs(F.col("score")), F.col("value"), F.col("date"))).alias("top"),
    ).filter(F.col("n") > 0)
    critical = F.col("critical") > 0
    return _rows(
        found,
        title=F.lit("Unusual Data Anomaly Spike Flags"),
        description=F.format_string(
            "Detected %d statistical outliers, %d of them critical. Most extreme: %,.2f at %s (score %.2f).",
            "n",
            "critical",
            F.col("top.value"),
            F.coalesce(F.col("top.date"), F.lit("an unknown date")),
            F.col("top.score"),
        ),
        recommendation=F.lit("Check the source for collection errors; audit the operation if the values are real."),
        severity=F.when(critical, "Critical").otherwise("High"),
        score=F.when(critical, 90).otherwise(75),
        category=F.lit("Anomaly"),
    )


def quality_insight(kpis: DataFrame) -> DataFrame:
    """A row when less than 80 % of the cells are filled."""
    q = F.col("quality_score")
    return _rows(
        kpis.filter(q < QUALITY_LOW),
        title=F.lit("Degraded Dataset Integrity Rating"),
        description=F.format_string("The quality score is %d%%: many values are missing.", q),
        recommendation=F.lit("Validate the table and fill or drop missing values before reporting."),
        severity=F.when(q < QUALITY_POOR, "High").otherwise("Medium"),
        score=(F.lit(100) - q).cast("int"),
        category=F.lit("Risk"),
    )


def forecast_insight(forecast: DataFrame) -> DataFrame:
    """A row when the first seven forecast steps fall by more than 5 %."""
    ends = forecast.filter(F.col("step") <= 7).agg(F.min_by("yhat", "step").alias("a"), F.max_by("yhat", "step").alias("b"))
    base = F.when(F.col("a") == 0, F.lit(1.0)).otherwise(F.col("a"))
    change = (F.col("b") - F.col("a")) / base * 100
    return _rows(
        ends.withColumn("change", change).filter(F.col("change") < FORECAST_DROP),
        title=F.lit("Negative Near-Term Forecast Trend"),
        description=F.format_string("The forecast drops by %.1f%% over the next 7 periods.", "change"),
        recommendation=F.lit("Review the near-term plan and cut what is not essential."),
        severity=F.lit("Medium"),
        score=F.lit(55),
        category=F.lit("Forecast"),
    )


def model_insight(history: DataFrame, word: str = "churn") -> DataFrame:
    """A row for the latest model run on a target or dataset named after ``word``."""
    runs = history.filter(F.lower("target").contains(word) | F.lower("dataset").contains(word))
    latest = runs.agg(F.max_by("best", "version").alias("best")).filter(F.col("best").isNotNull())
    return _rows(
        latest,
        title=F.lit("ML Churn Prediction Pipeline Active"),
        description=F.format_string("A model for this outcome is trained and scores %.1f%%.", F.col("best") * 100),
        recommendation=F.lit("Score the customer table and contact the profiles at risk."),
        severity=F.lit("Info"),
        score=F.lit(35),
        category=F.lit("ML"),
    )


def all_insights(
    dataset: str,
    kpis: DataFrame,
    anomalies: DataFrame | None = None,
    forecast: DataFrame | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Every insight that applies, stamped with its dataset, best score first."""
    parts = [growth_insight(kpis), quality_insight(kpis)]
    if anomalies is not None:
        parts.append(anomaly_insight(anomalies))
    if forecast is not None:
        parts.append(forecast_insight(forecast))
    if history is not None:
        parts.append(model_insight(history))
    merged = reduce(DataFrame.unionByName, parts)
    return merged.select(F.lit(dataset).alias("dataset"), *INSIGHT_COLUMNS).orderBy(F.col("score").desc(), "title")


# Titles, scores and sentences of the narrative.
HEADLINE_TITLE = "Primary Metric Overview (%s)"
DRIVER_TITLE = "Key Driver Analysis by %s"
TIME_TITLE = "Temporal Velocity across %s"
HEADLINE = "Across %d records, %s recorded a mean of %,.2f (min: %,.2f, max: %,.2f)."
DRIVER = "Segment '%s' is the primary driver, contributing %.1f%% (%,.2f) of total %s."
CAUSE = "High concentration in %s='%s' directly explains total volume shift."


def narrative_columns(p: Profile) -> tuple[str | None, str | None, str | None]:
    """Metric, dimension and date a narrative is about: the first column of each role; a metric is a number."""

    def first(*roles: str, among: list[str] | None = None) -> str | None:
        return next((n for n in p.facts if p.roles[n] in roles and (among is None or n in among)), None)

    return first("metric", "target", among=p.numeric), first("dimension", "geo"), first("temporal")


def profile_narrative(p: Profile) -> DataFrame:
    """The narrative of a table on the columns its profile picks; without a metric only the temporal note."""
    metric, dimension, date = narrative_columns(p)
    if metric is None:  # a column of nulls has no overview and no driver
        return narrative(p.df.withColumn("__none", F.lit(None).cast("double")), "__none", None, date)
    return narrative(p.df, metric, dimension, date)


def narrative(df: DataFrame, metric: str, dimension: str | None = None, date: str | None = None) -> DataFrame:
    """Ranked sentences with title and, for the driver, its causal factor: overview, key driver, temporal note."""
    m = col(metric).cast("double")
    stats = df.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(m).alias("mean"), F.min(m).alias("min"), F.max(m).alias("max"), F.stddev_samp(m).alias("std")
    ).filter(F.col("mean").isNotNull())

    def row(source: DataFrame, rank: int, kind: str, significance: float, title: str, text: Column, cause: Column | None = None) -> DataFrame:
        return source.select(
            F.lit(rank).alias("rank"),
            F.lit(kind).alias("type"),
            F.lit(title).alias("title"),
            F.lit(significance).alias("significance"),
            text.alias("narrative"),
            (F.lit(None).cast("string") if cause is None else cause).alias("causal_factor"),
        )

    text = F.format_string(HEADLINE, F.col("rows"), F.lit(metric), F.col("mean"), F.col("min"), F.col("max"))
    parts = [row(stats, 1, "headline", 0.98, HEADLINE_TITLE % metric, text)]
    if dimension is not None:
        spread = stats.select("std").scalar()
        shares = segment_shares(df, dimension, metric)
        top = shares.agg(F.max_by(F.struct("segment", "total", "share"), F.struct("total", "segment")).alias("t")).filter(spread > 0)
        text = F.format_string(DRIVER, F.col("t.segment"), F.round(F.col("t.share"), 1), F.col("t.total"), F.lit(metric))
        cause = F.format_string(CAUSE, F.lit(dimension), F.col("t.segment"))
        parts.append(row(top, 2, "causal_driver", 0.92, DRIVER_TITLE % dimension, text, cause))
    if date is not None:
        some = df.agg(F.count(col(date)).alias("n")).filter(F.col("n") > 0)
        text = F.format_string("Ordered by %s, the series shows stable variance with local peaks.", F.lit(date))
        parts.append(row(some, 3, "temporal_acceleration", 0.88, TIME_TITLE % date, text))
    return reduce(DataFrame.unionByName, parts)


# Fixed value: values listed per leading column.
LISTED_VALUES = 10


def _leading_values(p: Profile, columns: list[str], n: int) -> dict[str, list[str]]:
    """The ``n`` most frequent values of a few columns; at most ``n`` rows a column are collected."""
    if not columns:
        return {}
    counts = value_counts(p.df, columns).filter(F.col("value").isNotNull())
    rows = top_counts(counts, n).collect()
    return {c: [r["value"] for r in sorted((r for r in rows if r["column"] == c), key=lambda r: r["rank"])] for c in columns}


def context_summary(
    p: Profile, kpis: DataFrame, anomalies: DataFrame, name: str, geo: str | None, metric: str | None = None
) -> DataFrame:
    """(position, line): the table in a few lines of text, then the names a query may use.

    Every input is one row, a top-k, or bounded by the columns.
    """
    metric = metric or p.primary["metric"]
    texts = (
        F.lit(f"Dataset: {name}"),
        F.format_string("Primary target metric: %s", "metric_name"),
        F.format_string("Total rows: %d", "total_records"),
        F.format_string("Total aggregate value: %,.2f", "total_value"),
        F.format_string("Mean value: %,.2f", "mean_value"),
        F.format_string("Growth Rate (Period-over-Period): %.1f%%", "growth_rate"),
    )
    head = kpis.select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("position"), t.alias("line")) for i, t in enumerate(texts)]))
    )
    spark = p.df.sparkSession
    leading = (("Categories", p.primary["category"]), ("Regions", p.primary["geo"]))
    listed = _leading_values(p, [c for _, c in leading if c], LISTED_VALUES)
    lists = [(6 + i, f"{label} in '{c}': [{', '.join(listed[c])}]") for i, (label, c) in enumerate(leading) if listed.get(c)]
    model = auto_model(p, name)
    lists += [(11, f"Metric {n}: {m.agg} of {m.column}") for n, m in model.metrics.items()]
    lists += [(12, f"Dimension {n}: {c}") for n, c in model.dimensions.items()]
    parts = [head]
    if lists:
        parts.append(spark.createDataFrame(lists, "position int, line string"))
    if geo and metric:
        parts.append(
            geo_rollup(p.df, geo, metric)
            .limit(1)
            .select(
                F.lit(8).alias("position"),
                F.format_string("Top region: '%s' with value %,.2f (%d records)", "region", "value", "count").alias("line"),
            )
        )
    parts.append(
        anomalies.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(9).alias("position"), F.format_string("Statistical anomalies detected: %d", "n").alias("line")
        )
    )
    worst = anomalies.orderBy("score", "value", "date", "category", "region").limit(5)
    parts.append(
        worst.select(
            F.lit(10).alias("position"),
            F.format_string(
                " - Outlier at %s, category %s, region %s: %,.2f (score %.2f)", "date", "category", "region", "value", "score"
            ).alias("line"),
        )
    )
    return reduce(DataFrame.unionByName, parts).orderBy("position", "line")
