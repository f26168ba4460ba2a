"""Daily series, trend lines, forecasts and lag features, many series at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import forecast, series
from tablelens.plans.registry import query, table

KEY = ["o_orderpriority"]

DAILY = """d AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS ds, sum(o_totalprice) AS y FROM orders GROUP BY ALL),
  b AS (SELECT o_orderpriority, min(ds) AS d0, max(ds) AS d1 FROM d GROUP BY 1),
  c AS (SELECT o_orderpriority, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS ds FROM b),
  j AS (SELECT c.o_orderpriority, c.ds, d.y, last_value(d.y IGNORE NULLS) OVER w AS py, last_value(CASE WHEN d.y IS NOT NULL THEN c.ds END IGNORE NULLS) OVER w AS pd,
    first_value(d.y IGNORE NULLS) OVER v AS ny, first_value(CASE WHEN d.y IS NOT NULL THEN c.ds END IGNORE NULLS) OVER v AS nd
    FROM c LEFT JOIN d USING (o_orderpriority, ds)
    WINDOW w AS (PARTITION BY c.o_orderpriority ORDER BY c.ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           v AS (PARTITION BY c.o_orderpriority ORDER BY c.ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  daily AS (SELECT o_orderpriority, ds, coalesce(y, py + (ny - py) * date_diff('day', pd, ds) / date_diff('day', pd, nd)) AS y FROM j),
  idx AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM daily)"""


def daily(spark, sf):
    return series.daily_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", KEY)


@query("daily_series", f"WITH {DAILY} SELECT o_orderpriority, ds, round(y, 7) AS y FROM daily")
def daily_series(spark, sf):
    return daily(spark, sf).withColumn("y", F.round("y", 7))


LINE = f"""WITH {DAILY}, s AS (SELECT o_orderpriority, regr_sxy(y, i) / (regr_sxx(y, i) + 1) AS slope, avg(y) AS my, avg(i) AS mx, max(ds) AS last, max(n) AS n FROM idx GROUP BY 1),
  l AS (SELECT *, my - slope * mx AS intercept FROM s)"""


@query(
    "trend_line",
    LINE
    + """ SELECT o_orderpriority, ds, round(y, 7) AS y, round(intercept + slope * i, 2) AS line, false AS is_forecast FROM idx JOIN l USING (o_orderpriority)
    UNION ALL SELECT o_orderpriority, CAST(last + k AS DATE), NULL, round(intercept + slope * (n - 1 + k), 2), true FROM l, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS k)""",
)
def trend_line(spark, sf):
    out = series.trend_line(daily(spark, sf), KEY)
    return out.select("o_orderpriority", "ds", F.round("y", 7).alias("y"), F.round("line", 2).alias("line"), "is_forecast")


@query(
    "moving_average",
    """WITH y AS (SELECT o_orderpriority, CAST(date_trunc('year', o_orderdate) AS DATE) AS ds, sum(o_totalprice) AS y FROM orders GROUP BY ALL)
    SELECT o_orderpriority, ds, round((y + coalesce(lag(y) OVER (PARTITION BY o_orderpriority ORDER BY ds), 0)) / 2, 2) AS moving_average FROM y""",
)
def moving_average(spark, sf):
    yearly = table(spark, sf, "orders").groupBy("o_orderpriority", F.trunc(F.col("o_orderdate").cast("date"), "year").alias("ds")).agg(F.sum("o_totalprice").alias("y"))
    out = series.moving_average(yearly, KEY)
    return out.select("o_orderpriority", "ds", F.round("moving_average", 2).alias("moving_average"))


SIMPLE = f"""WITH {DAILY}, s AS (SELECT o_orderpriority, count(*) AS n, arg_min(y, i) AS y1, arg_max(y, i) AS yn, stddev_pop(y) AS sd,
  pow(0.7, count(*)) * arg_min(y, i) + sum(0.3 * pow(0.7, n - 1 - i) * y) AS level FROM idx GROUP BY 1),
  f AS (SELECT *, CAST(unnest(range(1, 13)) AS INTEGER) AS step FROM s),
  g AS (SELECT *, (yn + step * (level - y1) / n) * 1.1 AS p, 1.96 * sd * sqrt(1 + step * 0.08) AS m FROM f),
  fc AS (SELECT o_orderpriority, step, p AS yhat, greatest(0, p - m) AS lower, p + m AS upper FROM g)"""


def simple(spark, sf):
    return series.simple_forecast(daily(spark, sf), KEY, 12, 1.1)


@query("simple_forecast", SIMPLE + " SELECT o_orderpriority, step, 'Period +' || step AS label, round(yhat, 2) AS yhat, round(lower, 2) AS lower, round(upper, 2) AS upper FROM fc")
def simple_forecast(spark, sf):
    return simple(spark, sf).drop("level")


@query(
    "trend_label",
    SIMPLE
    + """, r AS (SELECT o_orderpriority, step, round(yhat, 2) AS v FROM fc), e AS (SELECT o_orderpriority, arg_min(v, step) AS start_value, arg_max(v, step) AS end_value FROM r GROUP BY 1)
    SELECT *, round((end_value - start_value) / start_value * 100, 4) AS change_pct, CASE WHEN (end_value - start_value) / start_value * 100 > 2 THEN 'increasing'
      WHEN (end_value - start_value) / start_value * 100 < -2 THEN 'decreasing' ELSE 'stable' END AS direction FROM e""",
)
def trend_label(spark, sf):
    out = series.trend_label(simple(spark, sf), KEY, "step", "yhat")
    return out.select("o_orderpriority", "start_value", "end_value", F.round("change_pct", 4).alias("change_pct"), "direction")


@query(
    "scenarios",
    SIMPLE
    + """ SELECT o_orderpriority, round(sum(round(yhat, 2)) * 1.2, 1) AS baseline, round(sum(round(upper, 2)) * 1.2, 1) AS optimistic,
    round(sum(round(lower, 2)) * 1.2, 1) AS pessimistic FROM fc GROUP BY 1""",
)
def scenarios(spark, sf):
    out = series.scenarios(simple(spark, sf), KEY, 1.2)
    return out.select("o_orderpriority", *[F.round(c, 1).alias(c) for c in ("baseline", "optimistic", "pessimistic")])


@query(
    "lag_features",
    f"""WITH {DAILY}, g AS (SELECT o_orderpriority, ds, y, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2, lag(y, 3) OVER w AS l3, lag(y, 7) OVER w AS l7
      FROM daily WINDOW w AS (PARTITION BY o_orderpriority ORDER BY ds))
    SELECT o_orderpriority, ds, round(y, 7) AS y, round(l1, 7) AS y_lag_1, round(l2, 7) AS y_lag_2, round(l3, 7) AS y_lag_3, round(l7, 7) AS y_lag_7 FROM g WHERE l7 IS NOT NULL""",
)
def lag_features(spark, sf):
    out = series.lag_features(daily(spark, sf), KEY)
    return out.select("o_orderpriority", "ds", *[F.round(c, 7).alias(c) for c in ("y", "y_lag_1", "y_lag_2", "y_lag_3", "y_lag_7")])


@query(
    "widening_band",
    LINE
    + """, f AS (SELECT o_orderpriority, k AS step, intercept + slope * (n - 1 + k) AS v FROM l, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS k))
    SELECT o_orderpriority, step, round(v, 2) AS line, round(v - v * 0.05 * step, 2) AS lower, round(v + v * 0.05 * step, 2) AS upper FROM f""",
)
def widening_band(spark, sf):
    from pyspark.sql import Window

    future = series.trend_line(daily(spark, sf), KEY).filter("is_forecast")
    # Three future points per series.
    step = F.row_number().over(Window.partitionBy(*KEY).orderBy("ds"))
    out = series.widening_band(future.withColumn("step", step), "step", "line")
    return out.select("o_orderpriority", "step", *[F.round(c, 2).alias(c) for c in ("line", "lower", "upper")])


@query("forecast_tournament")
def forecast_tournament(spark, sf):
    return forecast.tournament(daily(spark, sf), KEY)


@query("forecast_bands")
def forecast_bands(spark, sf):
    return forecast.forecast(daily(spark, sf), KEY, 30)
