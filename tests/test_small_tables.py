"""Small tables with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablelens.operators import charts, dashboard, insights, keys, models, quality, query, series, signals, sqlgate, textsearch
from tablelens.operators.filters import Filter, FilterState
from tablelens.operators.profile import Profile
from tablelens.operators.query import Metric, QuerySpec, run_query
from tablelens.operators.transform import transform_hook

REVENUE = [100, 150, 200, 250, 1000, 300, 105, 145, 210, 240, 290]
CATEGORY = ["Electronics", "Electronics", "Apparel", "Apparel", "Electronics", "Home", "Electronics", "Electronics", "Apparel", "Apparel", "Home"]
REGION = ["North", "North", "South", "South", "East", "West", "North", "North", "South", "South", "West"]
SECOND = [10, 15, 20, 25, 100, 30, 11, 14, 21, 24, 29]


@pytest.fixture(scope="module")
def sales(spark):
    rows = [(f"2024-{i + 1:02d}-01", r, c, g, o) for i, (r, c, g, o) in enumerate(zip(REVENUE, CATEGORY, REGION, SECOND))]
    return spark.createDataFrame(rows, "Date string, Revenue long, Category string, Region string, Outliers long").cache()


def test_kpis(sales):
    k = dashboard.kpis(sales, "Revenue", ["Date"], "Category", "Region").first()
    assert (k["total_value"], k["total_records"], k["unique_categories"], k["unique_regions"], k["quality_score"]) == (2990.0, 11, 3, 4, 100)
    assert k["mean_value"] == pytest.approx(271.8182, abs=1e-4)
    assert k["std_dev"] == pytest.approx(251.0206, abs=1e-4)
    assert k["growth_rate"] == pytest.approx(-24.1176, abs=1e-4)


def test_regions_and_drivers(sales):
    rows = [tuple(r) for r in dashboard.geo_rollup(sales, "Region", "Revenue").collect()]
    assert rows == [("East", 1000.0, 1), ("South", 900.0, 4), ("West", 590.0, 2), ("North", 500.0, 4)]
    shares = {r["segment"]: (r["total"], round(r["share"], 1)) for r in dashboard.segment_shares(sales, "Category", "Revenue").collect()}
    assert shares == {"Electronics": (1500.0, 50.2), "Apparel": (900.0, 30.1), "Home": (590.0, 19.7)}


def test_profile_of_sales(sales):
    p = Profile(sales)
    assert p.quartiles["Revenue"] == [147.5, 210.0, 270.0]
    assert p.numeric_stats["Revenue"]["outlier_count"] == 1.0
    assert p.numeric_stats["Revenue"]["skew"] == 0.74
    assert p.roles["Date"] == "temporal" and p.roles["Region"] == "geo"
    assert p.temporal_stats["Date"]["granularity"] == "monthly"
    r = {(a, b): r for a, b, r in p.correlations}
    assert r[("Revenue", "Outliers")] == pytest.approx(1.0, abs=1e-3)


def test_trend_line(sales):
    points = sales.select(F.to_date("Date").alias("ds"), F.col("Revenue").cast("double").alias("y"))
    rows = series.trend_line(points, []).orderBy("ds").collect()
    assert rows[0]["slope"] == pytest.approx(2.117117, abs=1e-6)
    assert rows[0]["intercept"] == pytest.approx(261.232596, abs=1e-6)
    future = [round(r["line"], 4) for r in rows if r["is_forecast"]]
    assert future == [284.5209, 286.6380, 288.7551]


def test_roles(spark):
    rows = [(f"t{i}", f"2024-01-{i + 1:02d}", v, g, s) for i, (v, g, s) in enumerate(zip(
        [100.0, 150.0, 200.0, 120.0, 300.0, 250.0, 180.0, 220.0, 190.0, 1000.0], ["APAC", "EMEA", "LATAM"] * 3 + ["APAC"], ["a", "b"] * 5))]
    p = Profile(spark.createDataFrame(rows, "transaction_id string, date string, revenue double, region string, customer_segment string"))
    assert list(p.roles.values()) == ["identifier", "temporal", "metric", "geo", "dimension"]
    assert p.quartiles["revenue"] == [157.5, 195.0, 242.5]
    assert p.outliers["revenue"] == 1
    assert p.primary == {"metric": "revenue", "date": "date", "category": "customer_segment", "geo": "region"}


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(5.0, float(i)) for i in range(1, 6)], "constant_col double, normal_col double")
    assert [r for _, _, r in Profile(df).correlations] == [None, None, None, 1.0]


def test_query(spark):
    df = spark.createDataFrame([("A", 10, 1), ("B", 20, 2), ("A", 15, 1), ("C", 5, 3)], "category string, value long, growth long")
    spec = QuerySpec(("category",), (Metric("value", "sum"),), sort_by="value_sum", limit=10)
    assert [tuple(r) for r in run_query(df, spec).collect()] == [("A", 25), ("B", 20), ("C", 5)]
    both = QuerySpec(filters=(Filter("category", "==", "A"), Filter("value", ">=", 15)))
    assert [r["value"] for r in run_query(df, both).collect()] == [15]
    with pytest.raises(ValueError):
        run_query(df, QuerySpec(("nope",)), strict=True)
    assert run_query(df.limit(0), QuerySpec(metrics=(Metric("value", "sum"),))).first()[0] == 0


def test_filter_state():
    s = FilterState().set("Region", "x").set("brush", (1, 2)).toggle("c", 1).toggle("c", 2).toggle("c", 1).set("k", "v")
    assert (s.region, s.brush, s.value_sets, s.equals) == ("x", (1, 2), {"c": (2,)}, {"k": "v"})
    assert s.remove("selectedRegion").remove("c").remove("brushedRange").remove("k") == FilterState()
    assert s.clear() == FilterState() and s.set_range("n", (0, 1)).set_range("n", None) == s


def test_signals(spark):
    a = [10, 12, 11, 10.5, 11.2, 10.8, 11.1, 10.9, 12.1, 100, 105] * 5
    rows = [(float(x), "electronics" if i < 50 else "fashion", i % 11 + 1) for i, x in enumerate(a)]
    p = Profile(spark.createDataFrame(rows, "col_a double, col_b string, col_c long"))
    assert p.quartiles["col_a"] == [10.8, 11.1, 12.1]
    assert not [s for s in signals.iqr_outliers(p) if s.columns == ["col_a"]]
    (imbalance,) = signals.category_imbalance(p)
    assert imbalance.details["dominant_share_pct"] == 90.9 and imbalance.details["gini_impurity"] == 0.165


def test_missing_together(spark):
    rows = [(None if i % 4 == 0 else 1.0, None if i % 4 == 0 else float(i), float(i)) for i in range(100)]
    (cluster,) = signals.missingness_clusters(Profile(spark.createDataFrame(rows, "a double, b double, c double")))
    assert cluster.columns == ["a", "b"] and cluster.significance == 1.0
    ranked = signals.rank_signals([cluster, cluster])
    assert len(ranked) == 1


def test_zscore_needs_room(spark):
    values = [100, 105, 110, 115, 120, 10000, 125, 130]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    assert signals.zscore_outliers(df, ["v"], ["id"]).count() == 0


def test_healing(spark):
    rows = [(10.0, "A"), (12.0, "A"), (None, None), (14.0, "B"), (1000.0, "A"), (10.0, "A")]
    healed = quality.auto_heal(spark.createDataFrame(rows, "numeric_val double, category_val string"))
    assert sorted((round(r[0], 4), r[1]) for r in healed.collect()) == [(10.0, "A"), (12.0, "A"), (14.0, "B"), (950.7, "A")]


def test_quality_score(spark):
    schema = "id long, Date string, Revenue double, Category string, Region string"
    rows = [(i, "2024-01-01", None if i == 2 else 10.0 * i, "a", "b") for i in range(4)]
    df = spark.createDataFrame(rows, schema)
    q = quality.quality_score(df, quality.SALES_RULES, ["id"]).first()
    assert (q["quality_score"], q["missing"], q["anomalies"]) == (95, 1, 0)
    empty = quality.quality_score(df.limit(0), quality.SALES_RULES, ["id"]).first()
    assert empty["quality_score"] == 0
    rules = quality.infer_rules(df.schema)
    blank = df.withColumn("Revenue", F.lit(None).cast("double"))
    assert [(r["column"], r["reason"]) for r in quality.validate(blank, rules, ["id"]).collect()] == [("Revenue", "no values")]


def test_simple_forecast(spark):
    rows = [(dt.date(2024, 1, i + 1), float(v)) for i, v in enumerate([100, 120, 140, 160, 180])]
    out = {r["step"]: r for r in series.simple_forecast(spark.createDataFrame(rows, "ds date, y double"), [], 6, 1.2).collect()}
    assert out[1]["level"] == pytest.approx(144.538, abs=1e-3)
    assert [(out[i]["yhat"], out[i]["lower"], out[i]["upper"]) for i in (1, 2, 6)] == [
        (226.69, 169.08, 284.30), (237.38, 177.67, 297.09), (280.13, 212.69, 347.58)]


@pytest.mark.parametrize("values,word", [([100, 110, 120, 150], "increasing"), ([200, 180, 160, 140], "decreasing"), ([100, 100.5, 100.2, 100.1], "stable")])
def test_trend_label(spark, values, word):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, i int, v double")
    row = series.trend_label(df, ["k"], "i", "v").first()
    assert row["direction"] == word and series.OUTLOOK[word] in row["text"]
    assert series.trend_label(df.limit(0), ["k"], "i", "v").count() == 0


def test_series_fill_and_lags(spark):
    days = [dt.date(2024, 1, d) for d in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14)]
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(days)], "d date, v double")
    rows = {r["ds"].day: r["y"] for r in series.daily_series(df, "d", "v").collect()}
    assert len(rows) == 14 and rows[12] == pytest.approx(10 + 1 / 3) and rows[13] == pytest.approx(10 + 2 / 3)
    short = series.daily_series(df.filter("v < 3 or v = 11"), "d", "v")
    assert short.count() == 4
    ten = spark.createDataFrame([(dt.date(2024, 1, i), float(i)) for i in range(1, 11)], "ds date, y double")
    assert series.lag_features(ten, []).count() == 3


def test_moving_average(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, i + 1), float(v)) for i, v in enumerate([2, 4, 6, 8])], "ds date, y double")
    assert [r["moving_average"] for r in series.moving_average(df, []).orderBy("ds").collect()] == [1.0, 3.0, 5.0, 7.0]


def test_narrative(spark):
    rows = [(100.0, "USA", "2024-01-01"), (200.0, "Europe", "2024-01-02"), (150.0, "USA", "2024-01-03"), (300.0, "APAC", "2024-01-04"), (250.0, "USA", "2024-01-05")]
    df = spark.createDataFrame(rows, "revenue double, region string, date string")
    out = {r["type"]: r["narrative"] for r in insights.narrative(df, "revenue", "region", "date").collect()}
    assert set(out) == {"headline", "causal_driver", "temporal_acceleration"}
    assert "'USA' is the primary driver, contributing 50.0% (500.00)" in out["causal_driver"]


def test_sql_gate(spark):
    spark.range(500).createOrReplaceTempView("datasets")
    spark.range(3).createOrReplaceTempView("users")
    run = lambda text, **more: sqlgate.read_only_sql(spark, text, allowed={"datasets"}, **more)
    assert run("SELECT * FROM datasets;").count() == 500 and run("SELECT * FROM datasets", limit=100).count() == 100
    assert run("/* x */ select id -- drop\n from datasets limit 7", limit=3).count() == 7
    assert run("SELECT * FROM datasets LIMIT 300 OFFSET 5", limit=100).count() == 300
    assert run("SELECT 'a--b' AS t, count(*) AS n FROM datasets").first()[0] == "a--b"
    assert run("SELECT id FROM datasets WHERE id IN (SELECT max(id) FROM datasets) UNION SELECT 1 ORDER BY id").count() == 2
    assert run("SELECT * FROM (WITH x AS (SELECT id FROM datasets) SELECT * FROM x) t WHERE id < 2").count() == 2
    nested = "SELECT * FROM (WITH users AS (SELECT id FROM datasets), y AS (SELECT id FROM users) SELECT y.id FROM y JOIN users ON y.id = users.id) t"
    assert run(nested).count() == 500  # here the name is a common table
    assert run("SELECT abs(-id), upper('x'), row_number() OVER (ORDER BY id), explode(array(1, 2)) FROM datasets").count() == 1000
    spark.udf.register("my_own", lambda x: x)
    for text in (
        "DELETE FROM datasets", "INSERT INTO datasets VALUES (1)", "DROP TABLE datasets", "ALTER TABLE datasets RENAME TO x",
        "TRUNCATE TABLE datasets", "UPDATE datasets SET id = 1", "SELECT * FROM users", "SELECT * FROM datasets JOIN refresh_tokens",
        "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT 1; DROP TABLE datasets", "SELECT * FROM (SELECT * FROM users) t",
        "SELECT TRANSFORM(id) USING 'cat' AS (x) FROM datasets", "SELECT reflect('java.lang.Math', 'abs', -1)", "SELECT try_reflect('java.lang.Math', 'abs', id) FROM datasets",
        "SELECT java_method('java.lang.Math', 'abs', -1) FROM datasets", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM range(5)", "SELECT * FROM other",
        "SELECT * FROM (WITH users AS (SELECT * FROM users) SELECT * FROM users) t", "SELECT u.* FROM users u, (WITH users AS (SELECT 1 AS a) SELECT a FROM users) t",
        "SELECT * FROM (WITH a AS (SELECT * FROM users), users AS (SELECT 1 AS x) SELECT * FROM a) t", "SELECT * FROM datasets, LATERAL (SELECT * FROM users) t",
        "SELECT * FROM (WITH x AS (WITH users AS (SELECT 1) SELECT * FROM users) SELECT * FROM x, users) t", "SELECT * FROM (WITH users AS (SELECT 1) SELECT * FROM default.users) t",
        "SELECT * FROM (WITH RECURSIVE x AS (SELECT 1 AS a UNION ALL SELECT a + 1 FROM x WHERE a < 3) SELECT * FROM x) t", "SELECT id FROM datasets WHERE id IN (WITH users AS (SELECT id FROM users) SELECT id FROM users)",
        "SELECT uuid() FROM datasets", "SELECT rand() FROM datasets", "SELECT current_user() FROM datasets", "SELECT nosuch(id) FROM datasets", "SELECT my_own(id) FROM datasets", "SELECT system.builtin.abs(id) FROM datasets",
        "SELECT id FROM datasets WHERE id = (SELECT max(id) FROM users)", "SELECT id FROM datasets WHERE EXISTS (SELECT reflect('java.lang.Math', 'abs', -1))",
    ):
        with pytest.raises(sqlgate.NotAllowed):
            run(text)


def test_queries_return_all_groups(spark):
    df = spark.range(3000).select((F.col("id") % 1000).alias("k"), F.lit(1.0).alias("v"))
    spec = query.QuerySpec(("k",), (query.Metric("v", "sum"),))
    assert query.run_query(df, spec).count() == 1000
    few = query.QuerySpec(("k",), (query.Metric("v", "sum"),), sort_by="v_sum", limit=5)
    assert [r["k"] for r in query.run_query(df, few).collect()] == [0, 1, 2, 3, 4]


def test_repair_of_nan_and_nested_columns(spark):
    df = spark.createDataFrame([(1.0, ["a"], "x"), (float("nan"), None, None), (3.0, ["b"], "x"), (None, [], "y")], "n double, tags array<string>, c string")
    assert sorted(tuple(r) for r in quality.impute(df).select("n", "c").collect()) == [(1.0, "x"), (2.0, "x"), (2.0, "y"), (3.0, "x")]
    healed = quality.auto_heal(df)
    assert healed.count() == 4 and healed.agg(F.max("n")).first()[0] < 3.0 and healed.filter("tags IS NULL").count() == 1


def test_quality_score_counts_all_failures(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("v"), F.lit(None).cast("double").alias("hollow"))
    rules = [quality.Rule("v", "number", minimum=30.0), quality.Rule("hollow", "number", some_value=True)]
    row = quality.quality_score(df, rules, ["id"]).first()
    assert row["anomalies"] == 31 and row["quality_score"] == 100 - 30 - 22


def test_overlap(spark):
    df = spark.createDataFrame([("revenue grew fast", "revenue grew fast"), ("alpha beta", "gamma delta"), ("", "word here")], "a string, b string")
    assert [r[0] for r in df.select(textsearch.overlap(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1.0]


def test_transform_hook(spark):
    df = spark.createDataFrame([("a", 100), ("b", 200), ("a", 150), ("c", 300)], "category string, revenue long")
    out, report = transform_hook(df, lambda d: d.filter("revenue > 120").withColumn("more", F.col("revenue") * 1.1))
    assert out.count() == 3
    assert [tuple(r) for r in report.orderBy("rows").collect()] == [("after", 3, 3), ("before", 4, 2)]
    with pytest.raises(TypeError):
        transform_hook(df, lambda d: 5)


def test_keyword_search_allows_typos(spark):
    docs = textsearch.search_document(
        spark.createDataFrame([(1, "revenue report"), (2, "revenu summary"), (3, "other")], "id long, t string"), "dataset", F.col("id"), F.col("t")
    )
    rows = [(r["id"], r["matched"], r["typos"]) for r in textsearch.keyword_search(docs, "revenue report").collect()]
    assert rows == [("dataset_1", 2, 0), ("dataset_2", 1, 1)]


def test_key_candidates():
    pairs = keys.candidate_pairs({"customers": ["id", "name"], "orders": ["id", "customers_id", "name"]})
    assert [(p.left, p.right, p.confidence) for p in pairs] == [("id", "id", 0.95), ("id", "customers_id", 0.98)]


def test_edge_tables(spark):
    schema = "a double, b string, c long, d date"
    for rows in ([], [(1.0, "x", 1, dt.date(2024, 1, 1))], [(None, None, None, None)] * 12, [(float("nan"), "x", 5, dt.date(2024, 1, 1))] * 20):
        df = spark.createDataFrame(rows, schema)
        p = Profile(df)
        assert p.columns_df().count() == 4 and 0 <= p.quality["health_score"] <= 100
        assert charts.suggest(p, 5).count() <= 5
        assert isinstance(signals.category_imbalance(p), list)
        assert dashboard.kpis(df, "a", ["c"]).count() == 1
        assert dashboard.histogram(df, "c").agg(F.sum("count")).first()[0] == sum(r[2] is not None for r in rows)
        assert quality.auto_heal(df).count() <= len(rows)


def test_target_rules(spark):
    rows = [(i, i % 3, float(i % 50), None if i % 2 else "a", 1) for i in range(200)]
    p = Profile(spark.createDataFrame(rows, "row_id long, cls int, num double, half string, same int"))
    assert models.task_type(p, "cls") == "classification"
    assert models.task_type(p, "num") == "regression"
    with pytest.raises(models.BadTarget):
        models.task_type(p, "same")
    assert "row_id" not in [c["column"] for c in models.target_candidates(p, 10)]
