"""Feature columns, target choice, model tournaments, scoring and segments."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tablelens.operators import features, forest, models
from tablelens.operators.profile import Profile
from tablelens.plans import inputs
from tablelens.plans.profiles import PRIMARY_SQL, orders_text, typed_sql
from tablelens.plans.registry import query, table
from tablelens.session import durable, scratch_path


@query(
    "target_candidates",
    f"""{typed_sql('part')}, p AS ({PRIMARY_SQL}), s AS (SELECT "column", cat AS dtype_category, role, card AS cardinality,
      CASE WHEN metric THEN 0.5 ELSE 0 END + CASE WHEN cat = 'numeric' AND abs(std / (mean + 1e-6)) > 0.01 THEN least(0.3 * abs(std / (mean + 1e-6)), 0.4) + 0.3
        WHEN cat = 'categorical' AND card BETWEEN 2 AND 20 THEN 0.6 WHEN cat = 'categorical' AND card > 20 THEN 0.2 ELSE 0 END AS score, position
      FROM typed JOIN (SELECT "column", metric FROM p) USING ("column") WHERE ratio <= 0.95 AND nulls / n <= 0.5)
    SELECT "column", round(score, 3)::DOUBLE AS score, dtype_category, role, cardinality FROM s WHERE score > 0 ORDER BY round(score, 3) DESC, position LIMIT 3""",
)
def target_candidates(spark, sf):
    found = models.target_candidates(Profile(table(spark, sf, "part")))
    schema = "`column` string, score double, dtype_category string, role string, cardinality long"
    return spark.createDataFrame([tuple(c.values()) for c in found], schema)


@query(
    "task_type",
    f"""{typed_sql('orders_text')}, v AS (SELECT *, card - CASE WHEN nulls > 0 THEN 1 ELSE 0 END AS vals,
      (SELECT count(*) FROM typed t WHERE t."column" <> typed."column" AND (t.role = 'temporal' OR t.cat = 'datetime')) > 0 AS timed FROM typed)
    SELECT 'orders' AS dataset, "column", CASE WHEN timed AND cat = 'numeric' THEN 'forecasting'
      WHEN cat = 'categorical' OR (cat = 'numeric' AND vals <= 10 AND vals / n < 0.05) THEN 'classification' WHEN cat = 'numeric' THEN 'regression' ELSE 'classification' END AS task FROM v
    UNION ALL SELECT 'part', q.* FROM ({typed_sql('part')} SELECT "column", CASE WHEN cat = 'categorical' OR (card <= 10 AND card / n < 0.05) THEN 'classification' ELSE 'regression' END AS task FROM typed) q""",
)
def task_type(spark, sf):
    rows = []
    for name, df in (("orders", orders_text(spark, sf)), ("part", table(spark, sf, "part"))):
        p = Profile(df)
        rows += [(name, c, models.task_type(p, c)) for c in p.facts]
    return spark.createDataFrame(rows, "dataset string, `column` string, task string")


@query(
    "date_parts",
    """SELECT o_orderkey, coalesce(year(d), 2000)::DOUBLE AS d_year, coalesce(month(d), 1)::DOUBLE AS d_month, coalesce(day(d), 1)::DOUBLE AS d_day,
       coalesce(isodow(d) - 1, 0)::DOUBLE AS d_dayofweek, coalesce(CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END, 0)::DOUBLE AS d_is_weekend
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders)""",
)
def date_parts(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")).alias("d"))
    return features.date_parts(df, ["d"]).drop("d")


CYCLE_PARTS = ["year", "month", "day", "dayofweek", "is_weekend", "month_sin", "month_cos"]


@query(
    "cyclical_dates",
    """WITH p AS (SELECT o_orderkey, year(o_orderdate)::DOUBLE AS d_year, month(o_orderdate)::DOUBLE AS d_month, day(o_orderdate)::DOUBLE AS d_day,
      (isodow(o_orderdate) - 1)::DOUBLE AS d_dayofweek, CASE WHEN isodow(o_orderdate) >= 6 THEN 1.0 ELSE 0.0 END AS d_is_weekend,
      sin(2 * pi() * month(o_orderdate) / 12) AS d_month_sin, cos(2 * pi() * month(o_orderdate) / 12) AS d_month_cos FROM orders)
    SELECT o_orderkey, """
    + ", ".join(f"round((d_{c} - avg(d_{c}) OVER ()) / stddev_pop(d_{c}) OVER (), 6)::DOUBLE AS d_{c}" for c in CYCLE_PARTS)
    + " FROM p",
)
def cyclical_dates(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("d"))
    out = features.cyclical_dates(df, ["d"])
    return out.select("o_orderkey", *[F.round(f"d_{c}", 6).alias(f"d_{c}") for c in CYCLE_PARTS])


def _holed(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"), F.col("o_custkey").cast("double").alias("cust")
    )


@query(
    "scale_numeric",
    """WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price, o_custkey::DOUBLE AS cust FROM orders),
      f AS (SELECT o_orderkey, coalesce(price, (SELECT median(price) FROM h)) AS price, cust FROM h),
      q AS (SELECT quantile_cont(price, [0.25, 0.5, 0.75]) AS p, quantile_cont(cust, [0.25, 0.5, 0.75]) AS c FROM f)
    SELECT o_orderkey, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS price, round((cust - avg(cust) OVER ()) / stddev_pop(cust) OVER (), 6) AS cust,
      round((price - p[2]) / (p[3] - p[1]), 6) AS price_robust, round((cust - c[2]) / (c[3] - c[1]), 6) AS cust_robust FROM f, q""",
)
def scale_numeric(spark, sf):
    df = _holed(spark, sf)
    both = df.withColumns({"price_robust": F.col("price"), "cust_robust": F.col("cust")})
    out = features.scale_numeric(features.scale_numeric(both, ["price", "cust"]), ["price_robust", "cust_robust"], robust=True)
    return out.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("price", "cust", "price_robust", "cust_robust")])


@query(
    "label_encode",
    """WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS b FROM part),
      t AS (SELECT b FROM h WHERE p_partkey % 2 = 0 AND b <> 'Brand#7'),
      m AS (SELECT b FROM t WHERE b IS NOT NULL GROUP BY b ORDER BY count(*) DESC, b LIMIT 1),
      k AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS code FROM (SELECT DISTINCT b FROM t WHERE b IS NOT NULL))
    SELECT p_partkey, coalesce(code, 0) AS code FROM h LEFT JOIN k ON coalesce(h.b, (SELECT b FROM m)) = k.b""",
)
def label_encode(spark, sf):
    brand = F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand"))
    df = table(spark, sf, "part").select("p_partkey", brand.alias("b"))
    # Codes are learnt on a part of the labels, so some labels are unseen later.
    learnt = df.filter((F.col("p_partkey") % 2 == 0) & (F.col("b") != "Brand#7"))
    codes = features.label_codes(learnt, "b")
    mode = features.most_frequent(learnt, ["b"]).get("b")
    return features.label_encode(df, "b", codes, mode, "code").select("p_partkey", "code")


def _parts(spark, sf):
    return Profile(table(spark, sf, "part").drop("p_partkey"))


def _labelled(spark, sf):
    """Documents with a quality label and a few counts to learn it from; an empty text has no shares."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    text = F.col("text")

    def share(others: str):
        return F.try_divide(F.length(F.regexp_replace(text, others, "")), F.length(text))

    return docs.join(labels, "doc_id").select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.size(F.split(text, r"\s+")).alias("n_words"),
        share(r"[^0-9]").alias("digit_share"),
        share(r"[^\p{Lu}]").alias("upper_share"),
        F.col("quality").cast("string").alias("quality"),
    )


@query("preprocess")
def preprocess(spark, sf):
    from pyspark.ml.functions import vector_to_array

    p = Profile(orders_text(spark, sf))
    pipeline, _ = models.build_preprocessor(p, models.choose_features(p, "o_totalprice"))
    return pipeline.fit(p.df).transform(p.df).select("o_orderkey", vector_to_array("features").alias("features"))


def _board_sql(task: str, target: str, models_: str) -> str:
    """A board has these models, one champion, which is the best of them all; scores are finite."""
    return f"""SELECT '{task}' AS task, '{target}' AS target, unnest([{models_}]) AS model, true AS one_champion, true AS champion_is_best, true AS finite"""


def _board_checks(t: models.Tournament, spark):
    board = t.leaderboard_df(spark)
    rivals = board.filter(F.col("model") != t.leaderboard[0][0])
    best = rivals.agg(F.max("score")).scalar()
    marks = rivals.filter("champion").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("s"))
    return board.select(
        "task",
        "target",
        "model",
        (marks.select("n").scalar() == 1).alias("one_champion"),
        (marks.select("s").scalar() == best).alias("champion_is_best"),
        (~F.isnan("score") & ~F.isnan("second") & (F.abs("score") < float("inf"))).alias("finite"),
    )


@query("regression_tournament")
def regression_tournament(spark, sf):
    return models.regression_tournament(_parts(spark, sf), "p_retailprice").leaderboard_df(spark)


@query(
    "regression_tournament_checks",
    _board_sql("regression", "p_retailprice", "'Baseline', 'LinearRegression', 'Ridge', 'RandomForestRegressor', 'GradientBoostingRegressor'"),
)
def regression_tournament_checks(spark, sf):
    return _board_checks(models.regression_tournament(_parts(spark, sf), "p_retailprice"), spark)


@query("classification_tournament")
def classification_tournament(spark, sf):
    return models.classification_tournament(Profile(durable(_labelled(spark, sf))), "quality").leaderboard_df(spark)


@query(
    "classification_tournament_checks",
    _board_sql("classification", "quality", "'Baseline', 'LogisticRegression', 'RandomForestClassifier', 'GaussianNB'"),
)
def classification_tournament_checks(spark, sf):
    return _board_checks(models.classification_tournament(Profile(durable(_labelled(spark, sf))), "quality"), spark)


@query("stratified_folds", "SELECT CAST(fold AS INTEGER) AS fold, event_type, true AS even FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest([0, 1, 2, 3, 4]) AS fold)")
def stratified_folds(spark, sf):
    """Every fold holds a fifth of the rows of each class, give or take one."""
    df = table(spark, sf, "events").withColumn("h", F.xxhash64("event_id"))
    folds = models.stratified(df, "event_type", "h", 5, df.count())
    counts = folds.groupBy("fold", "event_type").count()
    share = F.sum("count").over(Window.partitionBy("event_type")) / 5
    return counts.select("fold", "event_type", (F.abs(F.col("count") - share) < 1).alias("even"))


@query("holdout_forecast")
def holdout_forecast(spark, sf):
    t = models.holdout_forecast(Profile(table(spark, sf, "orders")), "o_totalprice", ["o_orderdate", "o_orderkey"])
    return t.leaderboard_df(spark)


@query("improvement")
def improvement(spark, sf):
    t = models.holdout_forecast(Profile(inputs.orders_shift(spark, sf)), "o_totalprice", ["o_orderdate", "o_orderkey"])
    row = [(t.task, t.champion, t.baseline, t.best, t.improvement)]
    return spark.createDataFrame(row, "task string, champion string, baseline double, best double, improvement_pct double")


@query("importances")
def importances(spark, sf):
    t = models.holdout_forecast(Profile(table(spark, sf, "orders")), "o_totalprice", ["o_orderdate", "o_orderkey"])
    return spark.createDataFrame(t.importances, "feature string, importance double")


@query("model_store")
def model_store(spark, sf):
    t = models.holdout_forecast(Profile(table(spark, sf, "orders")), "o_totalprice", ["o_orderdate", "o_orderkey"])
    root = scratch_path(spark, "models")
    models.save_model(spark, t, root, "orders")
    models.save_model(spark, t, root, "orders")
    return models.run_history(spark, root, "orders").drop("path", "version")


@query("batch_score")
def batch_score(spark, sf):
    from pyspark.ml import PipelineModel

    p = Profile(table(spark, sf, "orders"))
    t = models.holdout_forecast(p, "o_totalprice", ["o_orderdate", "o_orderkey"])
    path = models.save_model(spark, t, scratch_path(spark, "models"), "orders")
    lacking = table(spark, sf, "orders").drop("o_orderpriority")
    scored = models.batch_score(PipelineModel.load(path), lacking, t.task, models.choose_features(p, "o_totalprice").names)
    return scored.select("o_orderkey", "prediction")


@query("batch_score_checks", "SELECT o_orderkey, true AS scored FROM orders")
def batch_score_checks(spark, sf):
    return batch_score(spark, sf).select("o_orderkey", (F.col("prediction").isNotNull() & ~F.isnan("prediction")).alias("scored"))


@query("class_scores")
def class_scores(spark, sf):
    """Class names, and the confidence of the likeliest class, of a stored classifier for every row."""
    from pyspark.ml import PipelineModel

    df = durable(_labelled(spark, sf))  # counts of each text, read many times
    p = Profile(df)
    t = models.classification_tournament(p, "quality")
    path = models.save_model(spark, t, scratch_path(spark, "models"), "labels")
    scored = models.batch_score(PipelineModel.load(path), df.drop("quality"), t.task, models.choose_features(p, "quality").names)
    return scored.select("doc_id", "prediction", "confidence")


@query(
    "class_scores_checks",
    "SELECT doc_id, true AS known_class, true AS sure FROM documents JOIN labels USING (doc_id)",
)
def class_scores_checks(spark, sf):
    """Every row has a known class, at the confidence that the likeliest of two has."""
    scored = class_scores(spark, sf)
    return scored.select("doc_id", F.col("prediction").isin("0", "1").alias("known_class"), (F.col("confidence").between(0.5, 1.0)).alias("sure"))


@query("segments")
def segments(spark, sf):
    """Size and mean balance of every segment, and the number of segments asked for."""
    _, out, k = models.segments(Profile(table(spark, sf, "customer")))
    return out.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"), F.avg("c_acctbal").alias("mean_acctbal")).withColumn("k", F.lit(k))


@query("segments_checks", "SELECT true AS k_in_range, true AS segments_match, count(*) AS rows FROM customer")
def segments_checks(spark, sf):
    k = F.max("k")
    return segments(spark, sf).agg(
        k.between(2, 6).alias("k_in_range"),
        ((F.count(F.lit(1)) == k) & (F.min("segment") == 0) & (F.max("segment") == k - 1)).alias("segments_match"),
        F.sum("rows").alias("rows"),
    )


@query("anomaly_task")
def anomaly_task(spark, sf):
    df = table(spark, sf, "customer")
    flagged = forest.multivariate_outliers(df, ["c_acctbal", "c_nationkey"], ["c_custkey"])
    return flagged.select("c_custkey", F.col("is_outlier").alias("anomaly"), "score")
