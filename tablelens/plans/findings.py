"""Outliers, drift, coupled columns, missing data, imbalance, and chart scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablelens.operators import charts, dashboard, forest, signals
from tablelens.operators.profile import Profile
from tablelens.plans import inputs
from tablelens.plans.profiles import (
    CORR_COLUMNS,
    KINDS,
    PRIMARY_SQL,
    _outliers_sql,
    corr_sql,
    mi_sql,
    typed_sql,
)
from tablelens.plans.registry import query, table

LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


def ranked_sql(name: str) -> str:
    """CTEs ending in ``rel``: typed facts with the relevance of every column."""
    return f"""{typed_sql(name)}, prim AS ({PRIMARY_SQL}),
    rel AS (SELECT typed.*, least(1.0, 0.4 + CASE WHEN metric OR date OR category OR geo_flag THEN 0.3 ELSE 0 END
      + CASE WHEN role <> 'identifier' THEN 0.2 ELSE 0 END + CASE WHEN nulls / n * 100 < 30 THEN 0.1 ELSE 0 END)::DOUBLE AS relevance
      FROM typed JOIN (SELECT "column", metric, date, category, geo AS geo_flag FROM prim) USING ("column"))"""


def flat(df, *details):
    """Signal rows with chosen details as columns."""
    return df.select(
        "signal_type",
        F.array_join("columns", ",").alias("columns"),
        "severity",
        "significance",
        "relevance",
        *[F.col("details")[d].cast("double").alias(d) for d in details],
    )


@query(
    "iqr_outliers",
    f"""{ranked_sql('li_bulk')}, o AS ({_outliers_sql('li_bulk')}), s AS (SELECT rel.*, outliers, outliers / n AS share FROM rel JOIN o USING ("column"))
    SELECT 'outlier' AS signal_type, "column" AS columns, round(least(1, least(1, share / 0.05) * relevance), 3) AS severity,
    round(least(1, share / 0.05), 3) AS significance, round(relevance, 3) AS relevance, CAST(outliers AS DOUBLE) AS outlier_count,
    round(q1 - 1.5 * (q3 - q1), 2) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 2) AS upper_bound
    FROM s WHERE cat = 'numeric' AND role IN ('metric', 'target', 'dimension') AND q3 > q1 AND share BETWEEN 0.005 AND 0.15""",
)
def iqr_outliers(spark, sf):
    found = signals.iqr_outliers(Profile(inputs.li_bulk(spark, sf)))
    return flat(signals.to_df(spark, found), "outlier_count", "lower_bound", "upper_bound")


def _zscore_sql(name: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c}::DOUBLE AS value, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice
        FROM {name}, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM {name}) WHERE abs({c} - m) / s > 3"""
        for c in columns
    )
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS INTEGER) AS rank,
        count(*) OVER (PARTITION BY "column") AS outliers FROM ({parts})) WHERE rank <= 5"""


@query("zscore_outliers", f"WITH {inputs.LI_BULK} " + _zscore_sql("li_bulk", ["l_quantity", "l_extendedprice", "l_discount"]))
def zscore_outliers(spark, sf):
    return signals.zscore_outliers(inputs.li_bulk(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"], LINE_KEYS)


@query(
    "root_cause",
    """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_discount) AS md, stddev_samp(l_discount) AS sd,
      avg(l_tax) AS mt, stddev_samp(l_tax) AS st, avg(l_extendedprice) AS me, stddev_samp(l_extendedprice) AS se FROM lineitem),
    z AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax, mq, md, mt,
      abs(l_quantity - mq) / sq AS zq, abs(l_discount - md) / sd AS zd, abs(l_tax - mt) / st AS zt
      FROM lineitem, s WHERE abs(l_extendedprice - me) / se > 1.6),
    d AS (SELECT *, CASE WHEN greatest(zq, zd, zt) <= 1.5 THEN NULL WHEN zq >= zd AND zq >= zt THEN 'l_quantity' WHEN zd >= zt THEN 'l_discount' ELSE 'l_tax' END AS driver FROM z)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, driver,
    CASE driver WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount WHEN 'l_tax' THEN l_tax END AS driver_value,
    CASE driver WHEN 'l_quantity' THEN CASE WHEN l_quantity > mq THEN 'spiked' ELSE 'dropped' END
      WHEN 'l_discount' THEN CASE WHEN l_discount > md THEN 'spiked' ELSE 'dropped' END
      WHEN 'l_tax' THEN CASE WHEN l_tax > mt THEN 'spiked' ELSE 'dropped' END END AS direction FROM d""",
)
def root_cause(spark, sf):
    df = table(spark, sf, "lineitem")
    mean, std = df.agg(F.avg("l_extendedprice"), F.stddev_samp("l_extendedprice")).first()
    far = F.abs(F.col("l_extendedprice") - F.lit(mean)) / F.lit(std) > 1.6
    out = signals.root_cause(df, far, ["l_quantity", "l_discount", "l_tax"])
    return out.select(*LINE_KEYS, "driver", "driver_value", "direction")


SHIFT_SQL = f"""{ranked_sql('orders_shift')},
    r AS (SELECT o_totalprice AS v, o_orderdate AS d, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders_shift),
    k AS (SELECT *, greatest(4, least(10, n // 15)) AS nb FROM r), b AS (SELECT v, d, least(i // (n // nb), nb - 1) AS b FROM k),
    o AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM r), g AS (SELECT b, avg(v) AS bm, min(d) AS d0, max(d) AS d1 FROM b GROUP BY b),
    h AS (SELECT *, (bm - m) / s AS z FROM g, o WHERE abs(bm - m) / s >= 2 ORDER BY b LIMIT 1)
    SELECT 'distribution_shift' AS signal_type, 'o_totalprice,o_orderdate' AS columns, round(least(1, least(1, abs(z) / 4) * relevance), 3) AS severity,
    round(least(1, abs(z) / 4), 3) AS significance, round(relevance, 3) AS relevance, CAST(b AS DOUBLE) AS bucket, round(bm, 2) AS bucket_mean,
    round(m, 2) AS overall_mean, round(z, 2) AS z_score, round((bm - m) / abs(m) * 100, 2) AS pct_change,
    strftime(d0, '%Y-%m-%d') AS period_start, strftime(d1, '%Y-%m-%d') AS period_end
    FROM h, rel WHERE rel."column" = 'o_totalprice'"""


@query("distribution_shift", SHIFT_SQL)
def distribution_shift(spark, sf):
    df = signals.to_df(spark, signals.distribution_shift(Profile(inputs.orders_shift(spark, sf)), "o_orderdate", ["o_orderkey"]))
    out = flat(df, "bucket", "bucket_mean", "overall_mean", "z_score", "pct_change")
    dates = df.select(F.array_join("columns", ",").alias("columns"), *[F.col("details")[k].alias(k) for k in ("period_start", "period_end")])
    return out.join(dates, "columns")


PRICE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_gross", "l_net_loss"]
LI_COUPLED = "li_coupled AS (SELECT *, l_extendedprice * (1 + l_tax) AS l_gross, -l_extendedprice * (1 - l_discount) AS l_net_loss FROM lineitem)"
KINDS["li_coupled"] = {**KINDS["lineitem"], "l_gross": "float", "l_net_loss": "float"}


def li_coupled(spark, sf):
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").withColumns(
        {"l_gross": price * (1 + F.col("l_tax")), "l_net_loss": -price * (1 - F.col("l_discount"))}
    )


from tablelens.plans.profiles import DERIVED  # noqa: E402

DERIVED["li_coupled"] = LI_COUPLED
COUPLED_RANKED = ranked_sql("li_coupled")


@query(
    "correlation_signals",
    f"""{COUPLED_RANKED}, c AS ({corr_sql('li_coupled', PRICE_COLUMNS)}),
    x AS (SELECT c.*, a.relevance AS ra, b.relevance AS rb FROM c JOIN rel a ON a."column" = col_a JOIN rel b ON b."column" = col_b
      WHERE a.position < b.position AND abs(r) >= 0.8)
    SELECT CASE WHEN r > 0 THEN 'high_correlation' ELSE 'inverse_relationship' END AS signal_type, col_a || ',' || col_b AS columns,
    round(least(1, abs(r) * (ra + rb) / 2), 3) AS severity, round(least(1, abs(r)), 3) AS significance, round((ra + rb) / 2, 3) AS relevance, round(r, 3) AS r FROM x""",
)
def correlation_signals(spark, sf):
    return flat(signals.to_df(spark, signals.correlation_signals(Profile(li_coupled(spark, sf)))), "r")


KINDS["ship"] = {"l_orderkey": "int", "l_quantity": "float", "l_bulk": "float", "l_returnflag": "text"}
SHIP = """ship AS (SELECT l_orderkey, l_quantity * 1000 AS l_quantity, abs(l_quantity * 1000 - 25000) AS l_bulk, l_returnflag FROM lineitem)"""
DERIVED["ship"] = SHIP


@query(
    "mi_signals",
    f"""WITH m AS ({mi_sql("SELECT l_orderkey, l_quantity * 1000 AS l_quantity, abs(l_quantity * 1000 - 25000) AS l_bulk, l_returnflag FROM lineitem",
        "l_quantity", ["l_orderkey", "l_bulk"], ["l_returnflag"]).replace("4) AS mi_score", "6) AS mi_score")}),
    r AS ({ranked_sql('ship')} SELECT "column", relevance FROM rel)
    SELECT 'high_correlation' AS signal_type, "column" || ',l_quantity' AS columns, round(least(1, least(1, mi_score) * relevance), 3) AS severity,
    round(least(1, mi_score), 3) AS significance, round(relevance, 3) AS relevance, round(mi_score, 3) AS mi_score
    FROM m JOIN r USING ("column") WHERE mi_score >= 0.65""",
)
def mi_signals(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey",
        (F.col("l_quantity") * 1000).alias("l_quantity"),
        F.abs(F.col("l_quantity") * 1000 - 25000).alias("l_bulk"),
        "l_returnflag",
    )
    return flat(signals.to_df(spark, signals.information_signals(Profile(df))), "mi_score")


@query(
    "missingness_clusters",
    f"""{ranked_sql('li_nulls')}, c AS (SELECT * FROM (VALUES ('l_quantity', 'l_discount'), ('l_quantity', 'l_tax'), ('l_discount', 'l_tax')) t(col_a, col_b)),
    p AS (SELECT 'l_quantity' AS col_a, 'l_discount' AS col_b, count(*) FILTER (l_quantity IS NULL AND l_discount IS NULL) AS both_null, count(*) FILTER (l_quantity IS NULL) AS na FROM li_nulls
      UNION ALL SELECT 'l_quantity', 'l_tax', count(*) FILTER (l_quantity IS NULL AND l_tax IS NULL), count(*) FILTER (l_quantity IS NULL) FROM li_nulls
      UNION ALL SELECT 'l_discount', 'l_tax', count(*) FILTER (l_discount IS NULL AND l_tax IS NULL), count(*) FILTER (l_discount IS NULL) FROM li_nulls)
    SELECT 'missingness_cluster' AS signal_type, col_a || ',' || col_b AS columns, round(least(1, both_null / na * (a.relevance + b.relevance) / 2), 3) AS severity,
    round(both_null / na, 3) AS significance, round((a.relevance + b.relevance) / 2, 3) AS relevance, CAST(both_null AS DOUBLE) AS co_occurrence_count
    FROM p JOIN rel a ON a."column" = col_a JOIN rel b ON b."column" = col_b WHERE na >= 5 AND both_null / na >= 0.6""",
)
def missingness_clusters(spark, sf):
    found = signals.missingness_clusters(Profile(inputs.li_nulls(spark, sf)))
    return flat(signals.to_df(spark, found), "co_occurrence_count")


@query(
    "category_imbalance",
    f"""{ranked_sql('li_bulk')}, v AS (SELECT l_returnflag, count(*) AS c FROM li_bulk GROUP BY 1), g AS (SELECT max(c) AS top, 1 - sum((c / t) ** 2) AS gini
      FROM v, (SELECT sum(c) AS t FROM v))
    SELECT 'category_imbalance' AS signal_type, "column" AS columns, round(least(1, top / n * relevance), 3) AS severity, round(top / n, 3) AS significance,
    round(relevance, 3) AS relevance, round(gini, 3) AS gini_impurity, round(top / n * 100, 1) AS dominant_share_pct
    FROM rel, g WHERE "column" = 'l_returnflag' AND top / n >= 0.8""",
)
def category_imbalance(spark, sf):
    found = signals.category_imbalance(Profile(inputs.li_bulk(spark, sf)))
    return flat(signals.to_df(spark, found), "gini_impurity", "dominant_share_pct")


@query("relevance", f"""{ranked_sql('li_nulls')} SELECT "column", round(relevance, 3) AS relevance FROM rel""")
def relevance(spark, sf):
    p = Profile(inputs.li_nulls(spark, sf))
    rows = [(c, p.relevance(c)) for c in p.facts]
    return spark.createDataFrame(rows, "`column` string, relevance double").withColumn("relevance", F.round("relevance", 3))


@query("isolation_forest")
def isolation_forest(spark, sf):
    found = forest.univariate_anomalies(
        inputs.li_spikes(spark, sf),
        "l_extendedprice",
        LINE_KEYS,
        date="l_shipdate",
        category="l_returnflag",
        geo="l_linestatus",
        drivers=["l_quantity", "l_discount", "l_tax"],
    )
    return found.select(*LINE_KEYS, "date", "category", "region", "value", "score", "deviation_pct", "severity", "root_cause").orderBy("score", *LINE_KEYS)


@query("multivariate_forest")
def multivariate_forest(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    flagged = forest.multivariate_outliers(inputs.li_spikes(spark, sf), columns, LINE_KEYS)
    return flagged.filter("is_outlier").select(*LINE_KEYS, "score")


@query("anomaly_counts")
def anomaly_counts(spark, sf):
    found = forest.univariate_anomalies(table(spark, sf, "orders"), "o_totalprice", ["o_orderkey"], date="o_orderdate", category="o_orderpriority", geo="o_orderstatus")
    return dashboard.anomaly_counts(found.withColumnRenamed("o_orderkey", "row_key"))


@query("signals")
def all_signals(spark, sf):
    return signals.to_df(spark, signals.detect(Profile(inputs.li_bulk(spark, sf)), ["l_shipdate", *LINE_KEYS]))


# -- charts -----------------------------------------------------------------


def _charts(spark, p, rows, **details):
    return charts.charts_df(p, rows).select(
        "chart",
        F.array_join("columns", ",").alias("columns"),
        F.round("score", 4).alias("score"),
        *[F.round(F.col("details")[k], digits).alias(k) for k, digits in details.items()],
    )


def _score_numeric_sql(name: str) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS columns, abs((avg({c} ** 3) - 3 * avg({c}) * avg({c} ** 2) + 2 * avg({c}) ** 3) / stddev_pop({c}) ** 3) AS skew,
        count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({c}) AS share, count({c}) / count(*) AS comp
        FROM {name}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {name})"""
        for c in CORR_COLUMNS
    )
    return f"""SELECT CASE WHEN skew > 1 THEN 'histogram' ELSE 'histogram_kde' END AS chart, columns,
        round((CASE WHEN skew > 1 THEN 0.6 ELSE 0 END + CASE WHEN share > 0.05 THEN 0.4 ELSE 0 END) * 0.9 * comp, 4) AS score,
        round(skew, 3) AS skew, round(share, 4) AS outlier_ratio FROM ({parts})"""


@query("score_numeric", f"WITH {inputs.LI_BULK} " + _score_numeric_sql("li_bulk"))
def score_numeric(spark, sf):
    p = Profile(inputs.li_bulk(spark, sf))
    return _charts(spark, p, charts.score_numeric(p), skew=3, outlier_ratio=4)


@query(
    "score_categorical",
    f"""{typed_sql('cust_geo')} SELECT CASE WHEN card <= 8 THEN 'pie' WHEN card <= 50 THEN 'bar_horizontal' ELSE 'bar_top_n' END AS chart, "column" AS columns,
    round(0.7 * CASE WHEN card <= 8 THEN 0.9 WHEN card <= 50 THEN 0.8 ELSE 0.6 END * filled / n, 4) AS score, CAST(card AS DOUBLE) AS cardinality
    FROM typed WHERE cat IN ('categorical', 'text')""",
)
def score_categorical(spark, sf):
    p = Profile(inputs.cust_geo(spark, sf))
    return _charts(spark, p, charts.score_categorical(p), cardinality=0)


@query(
    "score_datetime",
    f"""{typed_sql('orders_text')} SELECT 'area_time' AS chart, "column" AS columns, round(0.54 * filled / n, 4) AS score FROM typed WHERE cat = 'datetime'""",
)
def score_datetime(spark, sf):
    from tablelens.plans.profiles import orders_text

    p = Profile(orders_text(spark, sf))
    return _charts(spark, p, charts.score_datetime(p))


def _num_num_sql(name: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{a},{b}' AS columns, corr({a}, {b}) AS r, (count({a}) + count({b})) / 2 / count(*) AS comp FROM {name}"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    )
    return f"""SELECT CASE WHEN abs(r) > 0.3 THEN 'scatter' ELSE 'scatter_no_rel' END AS chart, columns,
        round(least(abs(r), 1) * 0.7 * CASE WHEN abs(r) > 0.3 THEN 0.8 ELSE 0.5 END * comp, 4) AS score, round(r, 4) AS pearson_r FROM ({parts})"""


@query("score_num_num", f"WITH {inputs.LI_NULLS} " + _num_num_sql("li_nulls", CORR_COLUMNS))
def score_num_num(spark, sf):
    p = Profile(inputs.li_nulls(spark, sf))
    return _charts(spark, p, charts.score_num_num(p), pearson_r=4)


def _anova_sql(name: str, numbers: list[str], groups: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{v}' AS number, '{g}' AS "group", k, n, ssb, ssw FROM (
          SELECT count(*) AS k, sum(c) AS n, sum(c * (m - gm) ** 2) AS ssb, sum(c * q) AS ssw FROM
          (SELECT {g}, count({v}) AS c, avg({v}) AS m, var_pop({v}) AS q FROM {name} WHERE {g} IS NOT NULL GROUP BY {g}),
          (SELECT avg({v}) AS gm FROM {name} WHERE {g} IS NOT NULL))"""
        for v in numbers
        for g in groups
    )
    return f"""SELECT number, "group", round((ssb / (k - 1)) / (ssw / (n - k)), 4) AS f, round(ssb / (ssb + ssw), 6) AS eta_squared FROM ({parts})"""


@query("score_num_cat", f"WITH {inputs.LI_NULLS} " + _anova_sql("li_nulls", CORR_COLUMNS, ["l_returnflag", "l_linestatus"]))
def score_num_cat(spark, sf):
    p = Profile(inputs.li_nulls(spark, sf))
    rows = [(a["number"], a["group"], a["f"], a["eta_squared"]) for a in charts.anova(p)]
    df = spark.createDataFrame(rows, "number string, `group` string, f double, eta_squared double")
    return df.withColumns({"f": F.round("f", 4), "eta_squared": F.round("eta_squared", 6)})


def _chi2_sql(name: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(sum((greatest(abs(coalesce(o.n, 0) - e), 0)) ** 2 / e), 4) AS chi2,
        CAST((count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS BIGINT) AS dof FROM
        (SELECT r.{a} AS x, c.{b} AS y, r.n * c.n / t.n AS e FROM (SELECT {a}, count(*) AS n FROM {name} GROUP BY 1) r,
         (SELECT {b}, count(*) AS n FROM {name} GROUP BY 1) c, (SELECT count(*) AS n FROM {name}) t) g
        LEFT JOIN (SELECT {a}, {b}, count(*) AS n FROM {name} GROUP BY ALL) o ON o.{a} = g.x AND o.{b} = g.y"""


@query("score_cat_cat", _chi2_sql("orders", "o_orderstatus", "o_orderpriority"))
def score_cat_cat(spark, sf):
    p = Profile(table(spark, sf, "orders"))
    rows = [(t["a"], t["b"], t["chi2"], t["dof"]) for t in charts.contingency(p)]
    return spark.createDataFrame(rows, "a string, b string, chi2 double, dof long").withColumn("chi2", F.round("chi2", 4))


@query("missingness_map", "SELECT 'missingness_heatmap' AS chart, 'o_totalprice' AS columns, 0.5::DOUBLE AS score FROM (SELECT count(*) FILTER (o_orderkey % 3 = 0) / count(*) AS gone FROM orders) WHERE gone > 0.2")
def missingness_map(spark, sf):
    price = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    p = Profile(table(spark, sf, "orders").withColumn("o_totalprice", price))
    return _charts(spark, p, charts.missingness_map(p))


@query(
    "exclude_ids",
    f"""{typed_sql('cust_geo')} SELECT 'exclude_id_columns' AS chart, string_agg("column", ',' ORDER BY position) AS columns, 0.0::DOUBLE AS score FROM typed WHERE round(ratio, 4) > 0.95""",
)
def exclude_ids(spark, sf):
    p = Profile(inputs.cust_geo(spark, sf))
    return _charts(spark, p, charts.exclude_ids(p))


@query("suggest_charts")
def suggest_charts(spark, sf):
    return charts.suggest(Profile(li_coupled(spark, sf)), 5)


@query(
    "chart_texts",
    """WITH p AS (SELECT corr(l_quantity, l_quantity * 3 + l_tax) AS r, count(*) AS n FROM lineitem)
    SELECT 'summary' AS kind, format('Dataset ''lines'' contains {:,} records across 3 attributes. The primary target metric identified is ''Triple''.', n) AS text FROM p
    UNION ALL SELECT 'name', unnest(['l_quantity = L Quantity', 'triple = Triple', 'l_returnflag = L Returnflag'])
    UNION ALL SELECT 'relationship', format('Strong positive correlation (r={:.2f}) observed between ''l_quantity'' and ''triple''.', r) FROM p""",
)
def chart_texts(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_quantity") * 3 + F.col("l_tax")).alias("triple"), "l_returnflag")
    p = Profile(df)
    summary = spark.createDataFrame([("summary", charts.dataset_summary(p, "lines"))], "kind string, text string")
    names = charts.business_names(p).select(F.lit("name").alias("kind"), F.concat_ws(" = ", "column", "label").alias("text"))
    links = charts.relationships(p).select(F.lit("relationship").alias("kind"), "text")
    return summary.unionByName(names).unionByName(links)


@query(
    "chart_titles",
    f"""{typed_sql('cust_geo')}, s AS (SELECT CASE WHEN card <= 8 THEN 'pie' WHEN card <= 50 THEN 'bar_horizontal' ELSE 'bar_top_n' END AS chart, "column" FROM typed WHERE cat = 'categorical')
    SELECT chart, "column" AS columns, CASE chart WHEN 'pie' THEN 'Pie' WHEN 'bar_horizontal' THEN 'Bar Horizontal' ELSE 'Bar Top N' END || ': ' ||
    CASE "column" WHEN 'c_name' THEN 'C Name' WHEN 'c_mktsegment' THEN 'C Mktsegment' WHEN 'nation' THEN 'Nation' ELSE 'Region' END AS title,
    'Visualizing relationship across 1 variables.' AS subtitle FROM s""",
)
def chart_titles(spark, sf):
    p = Profile(inputs.cust_geo(spark, sf))
    out = charts.titles(charts.charts_df(p, charts.score_categorical(p)))
    return out.select("chart", F.array_join("columns", ",").alias("columns"), "title", "subtitle")
