"""Filters, aggregations, dashboard numbers, top-k and guarded SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import dashboard as dash
from tablelens.operators.filters import (
    Filter,
    FilterState,
    apply_filters,
    filter_brush,
    filter_category,
    filter_dates,
    filter_ranges,
    filter_region,
    filter_value_sets,
)
from tablelens.operators.query import Metric, QuerySpec, SemanticModel, run_query
from tablelens.plans import inputs
from tablelens.plans.registry import query, table

ORDER_KEYS = ["o_orderdate", "o_orderkey"]


@query(
    "group_agg",
    """SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice_sum,
       round(avg(l_extendedprice), 4) AS l_extendedprice_avg, count(l_quantity) AS l_quantity_count,
       min(l_discount) AS l_discount_min, max(l_tax) AS l_tax_max
       FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_returnflag
       ORDER BY l_extendedprice_sum DESC LIMIT 100""",
)
def group_agg(spark, sf):
    spec = QuerySpec(
        dimensions=("l_returnflag",),
        metrics=(
            Metric("l_extendedprice", "sum"),
            Metric("l_extendedprice", "avg"),
            Metric("l_quantity", "count"),
            Metric("l_discount", "min"),
            Metric("l_tax", "max"),
        ),
        filters=(Filter("l_returnflag", "in", ["A", "R"]),),
        sort_by="l_extendedprice_sum",
    )
    return run_query(table(spark, sf, "lineitem"), spec).withColumns(
        {
            "l_extendedprice_sum": F.round("l_extendedprice_sum", 2),
            "l_extendedprice_avg": F.round("l_extendedprice_avg", 4),
        }
    )


@query(
    "filter_ops",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
       WHERE l_returnflag = 'R' AND l_linestatus <> 'F' AND l_quantity >= 10 AND l_quantity <= 40
       AND l_extendedprice > 1000 AND l_discount < 0.08 AND l_linenumber IN (1, 2, 3) AND l_tax BETWEEN 0.01 AND 0.05""",
)
def filter_ops(spark, sf):
    conditions = [
        Filter("l_returnflag", "==", "R"),
        Filter("l_linestatus", "!=", "F"),
        Filter("l_quantity", ">=", 10),
        Filter("l_quantity", "lte", 40),
        Filter("l_extendedprice", ">", 1000),
        Filter("l_discount", "<", 0.08),
        Filter("l_linenumber", "in", [1, 2, 3]),
        Filter("l_tax", "between", [0.01, 0.05]),
        Filter("no_such_column", "==", 1),
    ]
    return apply_filters(table(spark, sf, "lineitem"), conditions).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )


@query(
    "filter_region",
    f"WITH {inputs.CUST_GEO} SELECT c_custkey, nation, region FROM cust_geo WHERE lower(region) = 'europe'",
)
def q_filter_region(spark, sf):
    return filter_region(inputs.cust_geo(spark, sf), "Europe").select("c_custkey", "nation", "region")


@query("filter_category", "SELECT * FROM customer WHERE lower(c_mktsegment) = 'machinery'")
def q_filter_category(spark, sf):
    return filter_category(table(spark, sf, "customer"), "Machinery")


@query(
    "filter_value_sets",
    """SELECT p_partkey, p_brand, p_type FROM part
       WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_type IN ('ECONOMY', 'STANDARD')""",
)
def q_filter_value_sets(spark, sf):
    sets = {"p_brand": ["Brand#1", "Brand#2"], "p_type": ["ECONOMY", "STANDARD"], "p_name": []}
    return filter_value_sets(table(spark, sf, "part"), sets).select("p_partkey", "p_brand", "p_type")


@query(
    "filter_ranges",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_totalprice BETWEEN 10000 AND 50000 AND o_custkey BETWEEN 10 AND 900""",
)
def q_filter_ranges(spark, sf):
    ranges = {"o_totalprice": [10000, 50000], "o_custkey": [10, 900]}
    return filter_ranges(table(spark, sf, "orders"), ranges).select("o_orderkey", "o_totalprice")


@query(
    "filter_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
       WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'""",
)
def q_filter_dates(spark, sf):
    df = filter_dates(table(spark, sf, "orders"), "1996-01-01", "1996-12-31")
    return df.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("filter_brush", "SELECT event_id, event_type, value FROM events WHERE event_id BETWEEN 100 AND 2500")
def q_filter_brush(spark, sf):
    return filter_brush(table(spark, sf, "events"), 100, 2500).select("event_id", "event_type", "value")


@query(
    "filter_state",
    f"""WITH {inputs.CUST_GEO} SELECT region, c_mktsegment, count(*) AS len FROM cust_geo
        WHERE lower(region) = 'asia' AND c_mktsegment IN ('BUILDING', 'FURNITURE') AND c_acctbal BETWEEN 0 AND 8000
        GROUP BY region, c_mktsegment""",
)
def filter_state(spark, sf):
    state = (
        FilterState()
        .set("region", "ASIA")
        .set("category", "machinery")
        .set("nation", "NATION_2")
        .toggle("c_mktsegment", "BUILDING")
        .toggle("c_mktsegment", "HOUSEHOLD")
        .toggle("c_mktsegment", "FURNITURE")
        .toggle("c_mktsegment", "HOUSEHOLD")
        .set_range("c_acctbal", (0, 8000))
        .remove("category")
        .remove("nation")
    )
    df = state.apply(inputs.cust_geo(spark, sf))
    return df.groupBy("region", "c_mktsegment").agg(F.count(F.lit(1)).alias("len"))


@query(
    "raw_rows",
    "SELECT * FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 25",
)
def raw_rows(spark, sf):
    spec = QuerySpec(sort_by="c_acctbal", limit=25, tie_break=("c_custkey",))
    return run_query(table(spark, sf, "customer"), spec)


@query(
    "global_agg",
    """SELECT round(coalesce(sum(o_totalprice), 0), 2) AS o_totalprice_sum, round(avg(o_totalprice), 4) AS o_totalprice_avg,
       count(o_custkey) AS o_custkey_count, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max
       FROM orders""",
)
def global_agg(spark, sf):
    metrics = [("o_totalprice", "sum"), ("o_totalprice", "mean"), ("o_custkey", "count"), ("o_totalprice", "min"), ("o_totalprice", "max")]
    spec = QuerySpec(metrics=tuple(Metric(*m) for m in metrics))
    return run_query(table(spark, sf, "orders"), spec).withColumns(
        {"o_totalprice_sum": F.round("o_totalprice_sum", 2), "o_totalprice_avg": F.round("o_totalprice_avg", 4)}
    )


@query(
    "group_count",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS len FROM orders GROUP BY ALL",
)
def group_count(spark, sf):
    return run_query(table(spark, sf, "orders"), QuerySpec(dimensions=("o_orderstatus", "o_orderpriority")))


@query(
    "semantic_query",
    """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 4) AS o_totalprice_avg
       FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY o_totalprice_sum DESC LIMIT 3""",
)
def semantic_query(spark, sf):
    model = SemanticModel(
        "orders",
        {"total_revenue": Metric("o_totalprice", "sum"), "average_revenue": Metric("o_totalprice", "avg")},
        {"priority": "o_orderpriority"},
    )
    spec = model.resolve(
        QuerySpec(filters=(Filter("o_orderstatus", "==", "F"),), sort_by="o_totalprice_sum", limit=3),
        ["Total_Revenue", "average_revenue", "unknown_metric"],
        ["PRIORITY", "unknown_dimension"],
    )
    return run_query(table(spark, sf, "orders"), spec).withColumns(
        {"o_totalprice_sum": F.round("o_totalprice_sum", 2), "o_totalprice_avg": F.round("o_totalprice_avg", 4)}
    )


KPI_SQL = """WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
  h AS (SELECT sum(o_totalprice) FILTER (i < n // 2) AS h1, sum(o_totalprice) FILTER (i >= n // 2) AS h2 FROM r)"""


@query(
    "kpis",
    f"""{KPI_SQL} SELECT 'o_totalprice' AS metric_name, round(sum(o_totalprice), 2) AS total_value,
        round(avg(o_totalprice), 4) AS mean_value, round(stddev_samp(o_totalprice), 4) AS std_dev,
        round((SELECT (h2 - h1) / h1 * 100 FROM h), 4) AS growth_rate, count(*) AS total_records,
        count(DISTINCT o_orderpriority) AS unique_categories, count(DISTINCT o_orderstatus) AS unique_regions,
        CAST(100 AS INTEGER) AS quality_score FROM orders""",
)
def kpis(spark, sf):
    df = dash.kpis(table(spark, sf, "orders"), "o_totalprice", ORDER_KEYS, "o_orderpriority", "o_orderstatus")
    return df.withColumns(
        {
            "total_value": F.round("total_value", 2),
            "mean_value": F.round("mean_value", 4),
            "std_dev": F.round("std_dev", 4),
            "growth_rate": F.round("growth_rate", 4),
        }
    )


@query(
    "dashboard_kpis",
    f"""WITH o AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT'),
        r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM o),
        h AS (SELECT sum(o_totalprice) FILTER (i < n // 2) AS h1, sum(o_totalprice) FILTER (i >= n // 2) AS h2 FROM r)
        SELECT 'o_totalprice' AS metric_name, round(sum(o_totalprice), 2) AS total_value, count(*) AS total_records,
        round((SELECT (h2 - h1) / h1 * 100 FROM h), 1) AS growth_rate,
        count(DISTINCT o_orderstatus) AS unique_regions FROM o""",
)
def dashboard_kpis(spark, sf):
    df = apply_filters(table(spark, sf, "orders"), [Filter("o_orderpriority", "==", "1-URGENT")])
    out = dash.dashboard_kpis(df, "o_totalprice", ORDER_KEYS, "o_orderstatus")
    return out.withColumn("total_value", F.round("total_value", 2))


@query(
    "numeric_kpis",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(sum({c}), 2) AS sum,
            CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def numeric_kpis(spark, sf):
    df = dash.numeric_kpis(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return df.withColumns({"mean": F.round("mean", 4), "sum": F.round("sum", 2)})


def _top_counts_sql(source: str, columns: list[str], n: int, keep_null: bool = True) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {source}
            {'' if keep_null else f'WHERE {c} IS NOT NULL'} GROUP BY 2"""
        for c in columns
    )
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column"
        ORDER BY count DESC, value ASC NULLS FIRST) AS INTEGER) AS rank FROM ({parts})) WHERE rank <= {n}"""


@query("category_breakdown", _top_counts_sql("part", ["p_name", "p_brand", "p_type"], 10))
def category_breakdown(spark, sf):
    return dash.category_breakdown(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query(
    "geo_rollup",
    f"""WITH {inputs.CUST_GEO} SELECT region, round(sum(c_acctbal), 2) AS value, count(*) AS count
        FROM cust_geo GROUP BY region ORDER BY value DESC""",
)
def geo_rollup(spark, sf):
    return dash.geo_rollup(inputs.cust_geo(spark, sf), "region", "c_acctbal").withColumn("value", F.round("value", 2))


@query(
    "trend",
    """SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders
       GROUP BY o_orderdate ORDER BY 1""",
)
def trend(spark, sf):
    df = dash.trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return df.select(F.col("date").cast("date").alias("date"), F.round("value", 2).alias("value"))


@query(
    "driver_share",
    """SELECT c_mktsegment AS segment, round(sum(c_acctbal), 2) AS total, count(*) AS count,
       round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer) * 100, 1) AS share,
       row_number() OVER (ORDER BY sum(c_acctbal) DESC) = 1 AS is_driver
       FROM customer GROUP BY c_mktsegment""",
)
def driver_share(spark, sf):
    shares = dash.segment_shares(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal")
    top = shares.agg(F.max_by("segment", "total")).scalar()
    return shares.select(
        "segment",
        F.round("total", 2).alias("total"),
        "count",
        F.round("share", 1).alias("share"),
        (F.col("segment") == top).alias("is_driver"),
    )


@query(
    "percent_share",
    """SELECT o_orderpriority AS segment,
       CAST(round(100 * sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders)) AS BIGINT) AS percent
       FROM orders GROUP BY o_orderpriority""",
)
def percent_share(spark, sf):
    return dash.percent_share(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


@query(
    "histogram",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_extendedprice) AS m FROM lineitem),
       c AS (SELECT greatest(0, least(7, floor((l_extendedprice - lo) / ((hi - lo) / 8)))) AS b, count(*) AS n FROM lineitem, s GROUP BY 1)
       SELECT CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / 8, 4) AS low, round(lo + (i + 1) * (hi - lo) / 8, 4) AS high,
       coalesce(n, 0) AS count, round(m, 1) AS mean FROM range(8) t(i) CROSS JOIN s LEFT JOIN c ON c.b = i""",
)
def histogram(spark, sf):
    df = dash.histogram(table(spark, sf, "lineitem"), "l_extendedprice")
    return df.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@query(
    "category_shares",
    """SELECT p_brand AS category, CAST(round(sum(p_retailprice)) AS BIGINT) AS value FROM part
       GROUP BY p_brand ORDER BY value DESC, category LIMIT 8""",
)
def category_shares(spark, sf):
    return dash.category_shares(table(spark, sf, "part"), "p_brand", "p_retailprice")


LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(
    "null_stats",
    f"""WITH {inputs.LI_NULLS}, n AS ("""
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS cells FROM li_nulls"
        for c in LINE_COLUMNS
    )
    + """) SELECT "column", nulls, round(nulls * 100.0 / cells, 2) AS null_pct FROM n UNION ALL
       SELECT '(all)', CAST(sum(nulls) AS BIGINT), round(sum(nulls) * 100.0 / sum(cells), 2) FROM n""",
)
def null_stats(spark, sf):
    return dash.null_stats(inputs.li_nulls(spark, sf))


@query(
    "duplicate_rows",
    f"""WITH {inputs.LI_DUPS}, d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM li_dups)),
        a AS (SELECT count(*) AS rows FROM li_dups)
        SELECT rows, rows - n AS duplicates, round((rows - n) * 100.0 / rows, 2) AS duplicate_pct FROM a, d""",
)
def duplicate_rows(spark, sf):
    return dash.duplicate_rows(inputs.li_dups(spark, sf))


@query(
    "sort_result",
    """SELECT l_suppkey, round(sum(l_quantity), 2) AS l_quantity_sum FROM lineitem GROUP BY l_suppkey
       ORDER BY l_quantity_sum ASC NULLS FIRST, l_suppkey LIMIT 50""",
)
def sort_result(spark, sf):
    spec = QuerySpec(
        dimensions=("l_suppkey",),
        metrics=(Metric("l_quantity", "sum"),),
        sort_by="l_quantity_sum",
        sort_desc=False,
        limit=50,
        tie_break=("l_suppkey",),
    )
    return run_query(table(spark, sf, "lineitem"), spec)


@query(
    "limit_result",
    """SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders GROUP BY o_custkey
       ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 100""",
)
def limit_result(spark, sf):
    spec = QuerySpec(
        dimensions=("o_custkey",), metrics=(Metric("o_totalprice", "sum"),), sort_by="o_totalprice_sum", tie_break=("o_custkey",), limit=100
    )
    return run_query(table(spark, sf, "orders"), spec).withColumn("o_totalprice_sum", F.round("o_totalprice_sum", 2))


@query("group_many", "SELECT l_partkey, round(sum(l_quantity), 2) AS l_quantity_sum, count(l_orderkey) AS l_orderkey_count FROM lineitem GROUP BY l_partkey")
def group_many(spark, sf):
    spec = QuerySpec(dimensions=("l_partkey",), metrics=(Metric("l_quantity", "sum"), Metric("l_orderkey", "count")))
    return run_query(table(spark, sf, "lineitem"), spec).withColumn("l_quantity_sum", F.round("l_quantity_sum", 2))


@query(
    "last_n_points",
    """SELECT * FROM (SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders
       GROUP BY 1 ORDER BY 1 DESC LIMIT 30) ORDER BY date""",
)
def last_n_points(spark, sf):
    df = dash.trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")
    return (
        df.orderBy(F.col("date").desc())
        .limit(30)
        .orderBy("date")
        .select(F.col("date").cast("date").alias("date"), F.round("value", 2).alias("value"))
    )


@query(
    "top_bars",
    """SELECT l_partkey, round(sum(l_extendedprice), 2) AS l_extendedprice_sum FROM lineitem GROUP BY l_partkey
       ORDER BY sum(l_extendedprice) DESC, l_partkey LIMIT 10""",
)
def top_bars(spark, sf):
    spec = QuerySpec(
        dimensions=("l_partkey",), metrics=(Metric("l_extendedprice", "sum"),), sort_by="l_extendedprice_sum", limit=10, tie_break=("l_partkey",)
    )
    return run_query(table(spark, sf, "lineitem"), spec).withColumn("l_extendedprice_sum", F.round("l_extendedprice_sum", 2))
