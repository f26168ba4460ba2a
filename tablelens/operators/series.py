"""Time series per key: daily series, trend lines, averages, simple forecasts, lags.

Rows are summed per (key, day) first, with map-side combining, so a key that
holds a third of the table shrinks to its days before anything is shuffled.
After that a window per key holds at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.functions.semantics import as_time, col

# Fixed values of the forecasting rules.
SMOOTHING = 0.3
BAND_Z = 1.96
BAND_GROWTH = 0.08
TREND_LIMIT = 2.0


def daily_series(df: DataFrame, date: str, metric: str, keys: list[str] | None = None, fill_above: int = 10) -> DataFrame:
    """(keys, ds, y): sum per day; series of more than ten points get every missing day, linearly filled."""
    keys = keys or []
    moment = as_time(df, date)
    day = moment.cast("date")
    sums = (
        df.filter(day.isNotNull() & col(metric).isNotNull())
        .groupBy(*[col(k) for k in keys], day.alias("ds"))
        .agg(F.sum(col(metric).cast("double")).alias("__sum"), F.count_distinct(moment).alias("__moments"))
    )
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    long = F.sum("__moments").over(w) > fill_above
    # Days holding several points in time count with the mean of their sums once a series is resampled.
    known = sums.withColumn("__long", long).withColumn(
        "y", F.when(F.col("__long"), F.col("__sum") / F.col("__moments")).otherwise(F.col("__sum"))
    )
    ordered = w.orderBy("ds")
    nxt, nxt_y = F.lead("ds").over(ordered), F.lead("y").over(ordered)
    gap = F.when(nxt.isNotNull() & F.col("__long"), F.date_diff(nxt, F.col("ds"))).otherwise(F.lit(1))
    # Each known day emits itself and the missing days up to the next known one.
    spread = known.withColumns({"__gap": gap, "__next": nxt_y})
    return spread.select(
        *[col(k) for k in keys], "ds", "y", "__gap", "__next", F.explode(F.sequence(F.lit(0), F.col("__gap") - 1)).alias("__i")
    ).select(
        *[col(k) for k in keys],
        F.date_add("ds", F.col("__i")).alias("ds"),
        F.when(F.col("__i") == 0, F.col("y"))
        .otherwise(F.col("y") + (F.col("__next") - F.col("y")) * F.col("__i") / F.col("__gap"))
        .alias("y"),
    )


def indexed(series: DataFrame, keys: list[str]) -> DataFrame:
    """Add the 0-based position ``i`` and the length ``n`` per series."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return series.withColumns(
        {"i": F.row_number().over(w.orderBy("ds")) - 1, "n": F.count(F.lit(1)).over(w).cast("int")}
    )


def trend_line(series: DataFrame, keys: list[str], alpha: float = 1.0, ahead: int = 3) -> DataFrame:
    """Ridge line of value on position, with the fitted values and the next points.

    Closed form: slope = Sxy / (Sxx + alpha).  Future points are spaced by the
    last gap.  Series shorter than five points are left out.
    """
    points = indexed(series, keys).filter(F.col("n") >= 5)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    x, y = F.col("i").cast("double"), F.col("y")
    mean_x, mean_y = F.avg(x).over(w), F.avg(y).over(w)
    centred = points.withColumns({"__mx": mean_x, "__my": mean_y})
    dx, dy = x - F.col("__mx"), F.col("y") - F.col("__my")
    slope = F.sum(dx * dy).over(w) / (F.sum(dx * dx).over(w) + F.lit(alpha))
    fitted = centred.withColumn("slope", slope).withColumn("intercept", F.col("__my") - F.col("slope") * F.col("__mx"))
    line = F.col("intercept") + F.col("slope") * x
    history = fitted.select(
        *keys, "ds", "y", line.alias("line"), F.lit(False).alias("is_forecast"), "slope", "intercept"
    )
    before = F.lag("ds").over(w.orderBy("ds"))
    last = fitted.withColumn("__step", F.date_diff("ds", before)).filter(F.col("i") == F.col("n") - 1)
    future = last.select(
        *keys, "ds", "__step", "slope", "intercept", "i", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("__k")
    ).select(
        *keys,
        F.date_add("ds", F.col("__step") * F.col("__k")).alias("ds"),
        F.lit(None).cast("double").alias("y"),
        (F.col("intercept") + F.col("slope") * (F.col("i") + F.col("__k"))).alias("line"),
        F.lit(True).alias("is_forecast"),
        "slope",
        "intercept",
    )
    return history.unionByName(future)


def moving_average(series: DataFrame, keys: list[str], size: int = 2) -> DataFrame:
    """Centred average over ``size`` points; outside the series counts as zero."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("ds")
    frame = w.rowsBetween(-(size // 2), (size - 1) // 2)
    return series.select(*keys, "ds", "y", (F.sum("y").over(frame) / size).alias("moving_average"))


def simple_forecast(series: DataFrame, keys: list[str], periods: int = 12, multiplier: float = 1.0) -> DataFrame:
    """Exponentially smoothed level, projected linearly, with a widening band.

    The recursive level has the closed form
    (1-a)^n * y1 + sum of a(1-a)^(n-k) * yk, so one aggregate per key suffices.
    """
    points = indexed(series, keys)
    keep = 1.0 - SMOOTHING
    age = F.col("n") - 1 - F.col("i")
    weight = F.lit(SMOOTHING) * F.pow(F.lit(keep), age.cast("double"))
    stats = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("y", "i").alias("first"),
        F.max_by("y", "i").alias("last"),
        F.sum(weight * F.col("y")).alias("tail"),
        F.avg("y").alias("mean"),
        F.stddev_pop("y").alias("std"),
    )
    level = F.pow(F.lit(keep), F.col("n").cast("double")) * F.col("first") + F.col("tail")
    std = F.when(F.col("n") > 1, F.col("std")).otherwise(F.col("mean") * 0.1)
    rows = stats.withColumns({"level": level, "std": std}).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(periods)))
    )
    slope = (F.col("level") - F.col("first")) / F.col("n")
    yhat = (F.col("last") + F.col("step") * slope) * F.lit(multiplier)
    margin = F.lit(BAND_Z) * F.col("std") * F.sqrt(1 + F.col("step") * BAND_GROWTH)
    return rows.select(
        *keys,
        "step",
        F.format_string("Period +%d", "step").alias("label"),
        F.round(yhat, 2).alias("yhat"),
        F.round(F.greatest(F.lit(0.0), yhat - margin), 2).alias("lower"),
        F.round(yhat + margin, 2).alias("upper"),
        "level",
    )


def direction(change_pct: Column) -> Column:
    return (
        F.when(change_pct > TREND_LIMIT, "increasing").when(change_pct < -TREND_LIMIT, "decreasing").otherwise("stable")
    )


# Closing sentence per direction.
OUTLOOK = {
    "increasing": "This suggests strong growth momentum in the dataset.",
    "decreasing": "This indicates downward pressure; operational reviews may be warranted to prevent decline.",
    "stable": "The forecast indicates highly consistent, sideways behavior.",
}


def trend_label(forecast: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First-to-last change of each forecast in percent, its direction, and a sentence."""
    ends = forecast.groupBy(*keys).agg(
        F.min_by(value, order).alias("start_value"), F.max_by(value, order).alias("end_value"), F.count(F.lit(1)).alias("steps")
    )
    base = F.when(F.col("start_value") == 0, F.lit(1.0)).otherwise(F.col("start_value"))
    change = (F.col("end_value") - F.col("start_value")) / base * 100
    named = ends.withColumn("change_pct", change).withColumn("direction", direction(F.col("change_pct")))
    tail = F.element_at(F.create_map(*[F.lit(x) for kv in OUTLOOK.items() for x in kv]), F.col("direction"))
    return named.withColumn(
        "text",
        F.concat(
            F.format_string(
                "A %s trend over the next %d days, from %,.2f to %,.2f (%+.1f%%). ",
                "direction",
                "steps",
                "start_value",
                "end_value",
                "change_pct",
            ),
            tail,
        ),
    )


def scenarios(forecast: DataFrame, keys: list[str], multiplier: float = 1.0) -> DataFrame:
    """Cumulative baseline, optimistic and pessimistic totals; what-if factor 0.5 to 1.5."""
    if not 0.5 <= multiplier <= 1.5:
        raise ValueError("the what-if factor must lie between 0.5 and 1.5")
    return forecast.groupBy(*keys).agg(
        (F.sum("yhat") * multiplier).alias("baseline"),
        (F.sum("upper") * multiplier).alias("optimistic"),
        (F.sum("lower") * multiplier).alias("pessimistic"),
    )


def lag_features(series: DataFrame, keys: list[str], lags: tuple[int, ...] = (1, 2, 3, 7), value: str = "y") -> DataFrame:
    """Earlier values as columns; rows without all of them are dropped."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("ds")
    names = {f"{value}_lag_{n}": F.lag(value, n).over(w) for n in lags}
    return series.withColumns(names).na.drop(subset=list(names))


def widening_band(points: DataFrame, step: str, value: str) -> DataFrame:
    """A band of 5 % per step around each forecast point."""
    reach = F.col(value) * 0.05 * F.col(step)
    return points.withColumns({"lower": F.col(value) - reach, "upper": F.col(value) + reach})

