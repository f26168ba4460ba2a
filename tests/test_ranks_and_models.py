"""Rank search, forests, forecasts and models against NumPy and planted answers."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tablelens.operators import forecast, forest, models, ranks, vectors
from tablelens.operators.dashboard import duplicate_rows, half_split
from tablelens.operators.information import mutual_information
from tablelens.operators.profile import Profile
from tablelens.operators.rowindex import with_row_index

RNG = np.random.default_rng(3)
N = 3000
SHAPES = {
    "uniform": RNG.uniform(-5, 5, N),
    "hot": np.where(RNG.random(N) < 0.35, 7.0, RNG.normal(0, 10, N)),
    "steps": RNG.integers(0, 4, N).astype(float),
    "tail": np.exp(RNG.normal(0, 12, N)),
    "wide": np.concatenate([RNG.normal(0, 1, N - 2), [1e308, -1e308]]),
}


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame(pd.DataFrame(SHAPES | {"id": np.arange(N)})).repartition(5).cache()


@pytest.mark.parametrize("final_rows", [10_000, 40])
def test_quantiles_match_numpy(shapes, final_rows):
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = ranks.exact_quantiles(shapes, {n: probs for n in SHAPES}, final_rows=final_rows)
    for n, values in SHAPES.items():
        assert found[n] == pytest.approx(list(np.quantile(values, probs)), rel=1e-9, abs=1e-9)


def test_quantiles_are_the_same_at_all_sizes(shapes):
    probs = {n: [0.01, 0.1, 1 / 3, 0.77, 0.9] for n in SHAPES}
    small, large = (ranks.exact_quantiles(shapes, probs, final_rows=n) for n in (10_000, 2999))
    assert small == large  # to the last bit


def test_cutoffs_with_hot_key(shapes):
    ordered = pd.DataFrame(SHAPES | {"id": np.arange(N)}).sort_values(["hot", "id"])
    wanted = [0, 1000, 1500, 2999]
    for buffer_rows in (10_000, 100):  # the small buffer searches inside the hot key
        found = ranks.order_cutoffs(shapes, ["hot", "id"], wanted, buffer_rows=buffer_rows, final_rows=200)
        assert found == [tuple(ordered.iloc[r][["hot", "id"]]) for r in wanted]
    late = shapes.filter(ranks.at_or_after(shapes, ["hot", "id"], found[1])).count()
    assert late == N - 1000


def test_row_index_is_a_total_order(shapes):
    indexed = with_row_index(shapes.select("hot", "id"), ["hot", "id"], partitions=6).toPandas().sort_values("row_index")
    assert list(indexed["row_index"]) == list(range(N))
    assert list(indexed["id"]) == list(indexed.sort_values(["hot", "id"])["id"])


def test_duplicates_see_nulls(spark):
    rows = [(None, 1), (1, None), (1, None), (None, None), (2, 2), (2, 2), (2, 2)]
    found = duplicate_rows(spark.createDataFrame(rows, "a int, b int")).first()
    assert (found["rows"], found["duplicates"]) == (7, 3)


def test_information_sees_nonlinear_links(spark):
    x = RNG.uniform(-1, 1, 4000)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": x**2, "z": RNG.uniform(-1, 1, 4000)}))
    scores = {c: s for _, c, s, _ in mutual_information(df, "y", ["x", "z"], ["x", "y", "z"], 4000)}
    assert scores["x"] > 1.0 and scores["z"] < 0.05


def planted(spark, parts):
    values = np.concatenate([np.random.default_rng(1).normal(100, 5, 990), [500, -300, 450, 700, -250, 650, 420, -400, 380, 900]])
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(1000), "v": values, "w": values * 2})).repartition(parts)


def test_forest_ranks_planted_outliers_first(spark):
    found = forest.univariate_anomalies(planted(spark, 2), "v", ["id"], drivers=["w"]).orderBy("score").limit(10)
    rows = found.collect()
    assert {r["id"] for r in rows} == set(range(990, 1000))
    assert all(r["severity"] == "Critical" and "w" in r["root_cause"] for r in rows)


def test_forest_ignores_partitioning(spark):
    def scores(parts):
        out = forest.multivariate_outliers(planted(spark, parts), ["v", "w"], ["id"])
        return {r["id"]: (round(r["score"], 12), r["is_outlier"]) for r in out.select("id", "score", "is_outlier").collect()}

    one, seven = scores(1), scores(7)
    assert one == seven
    assert sum(flag for _, flag in one.values()) == 50
    assert all(one[i][1] for i in range(990, 1000))


def test_large_tables_deal_rows_to_trees(spark):
    df = spark.range(60_000).select("id", F.pmod("id", F.lit(97)).cast("double").alias("v"))
    picked = forest.sample_rows(df, [F.col("v")], ["id"], 20, 60_000).groupBy("tree").count().collect()
    assert len(picked) == 20 and {r["count"] for r in picked} == {256}


def test_forecast_finds_the_season(spark):
    start = dt.date(2024, 1, 1)
    noise = np.random.default_rng(5).normal(0, 1, 140)
    rows = [("a", start + dt.timedelta(days=i), float(100 + 0.5 * i + 20 * np.sin(2 * np.pi * i / 7) + noise[i])) for i in range(140)]
    rows += [("b", start + dt.timedelta(days=i), float(v)) for i, v in enumerate([5, 6, 7, 8])]
    df = spark.createDataFrame(rows, "k string, ds date, y double")
    board = forecast.tournament(df, ["k"]).collect()
    assert {r["k"] for r in board} == {"a"} and sum(r["is_best"] for r in board) == 1
    errors = {r["model"]: r["mape"] for r in board}
    assert min(errors["SARIMA"], errors["ETS"]) < 3 < errors["ARIMA"]
    out = forecast.forecast(df, ["k"], 14).orderBy("step").collect()
    truth = [100 + 0.5 * i + 20 * np.sin(2 * np.pi * i / 7) for i in range(140, 154)]
    assert len(out) == 14 and out[0]["ds"] == start + dt.timedelta(days=140)
    assert np.abs(np.array([r["yhat"] for r in out]) - truth).max() < 8
    widths = [r["upper"] - r["lower"] for r in out]
    assert all(w > 0 for w in widths) and widths[-1] >= widths[0]


def test_regression_tournament_beats_the_mean(spark):
    rng = np.random.default_rng(2)
    x, g = rng.normal(0, 1, 400), rng.integers(0, 3, 400)
    data = pd.DataFrame({"x": x, "g": [f"g{i}" for i in g], "y": 3 * x + 2 * g + rng.normal(0, 0.1, 400)})
    t = models.regression_tournament(Profile(spark.createDataFrame(data.round(3))), "y", trees=3, depth=3, boosts=2)
    assert t.champion in ("LinearRegression", "Ridge") and t.best > 0.95 and t.baseline < 0.05
    assert dict(t.importances)["x"] > 0.2 and sum(v for _, v in t.importances) == pytest.approx(1.0, abs=0.01)


def test_forests_keep_the_nodes_of_rows(spark):
    """The forests do not walk from the roots at every level; trees and predictions are the same."""
    from pyspark.ml.linalg import Vectors

    rows = [(Vectors.dense(i % 7, i % 11 / 3, i % 13), float(i % 7 > 3) + i % 3) for i in range(600)]
    data = spark.createDataFrame(rows, ["features", "label"]).coalesce(2)
    made = models.regression_models(600, 5, 4, 2) | models.classification_models(5, 4)
    for name in ("RandomForestRegressor", "RandomForestClassifier"):
        assert made[name].getCacheNodeIds()
        plain = made[name].copy({made[name].cacheNodeIds: False})
        assert made[name].fit(data).toDebugString.split("\n", 1)[1] == plain.fit(data).toDebugString.split("\n", 1)[1]


def test_vector_search(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    found = [(r["id"], round(r["score"], 4)) for r in vectors.vector_topk(df, "v", [2.0, 0.0], 4, "id").collect()]
    assert found == [(1, 1.0), (3, 0.7071), (2, 0.0), (4, 0.0)]


def test_text_keys_order_like_text(spark):
    """Text ids (of several chunks, one null) split a table in half like numbers do."""
    ids = [None, *(f"order-number-{i:04d}" for i in range(999))]
    df = spark.createDataFrame([(k, float(i)) for i, k in enumerate(ids)], "id string, v double").repartition(7)
    late = half_split(df, ["id"])
    found = df.select(F.count_if(late), F.min(F.when(late, F.col("v"))), F.max(F.when(~late, F.col("v")))).first()
    assert tuple(found) == (500, 500.0, 499.0)
    hot = df.withColumn("day", F.lit("2024-01-01"))
    assert hot.filter(half_split(hot, ["day", "id"])).count() == 500


def test_classes_come_back_by_name(spark, tmp_path):
    """A stored classifier, with a coded column of many labels, returns classes and their confidence."""
    rows = [(f"code{i % 30:02d}", float(i % 3) * 5 + (i % 7) * 0.1, ("low", "mid", "top")[i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "code string, x double, kind string")
    t = models.classification_tournament(Profile(df), "kind", trees=5, depth=4)
    assert t.best > 0.95 > t.baseline
    path = models.save_model(spark, t, str(tmp_path), "kinds")
    unseen = df.withColumn("code", F.lit("never seen"))
    for table in (df, unseen):
        scored = models.batch_score(PipelineModel.load(path), table, t.task, ["code", "x"])
        assert scored.columns == ["code", "x", "kind", "prediction", "confidence"] and scored.count() == 600
    assert models.batch_score(PipelineModel.load(path), df, t.task, ["code", "x"]).filter("prediction = kind").count() > 580


def test_many_classes(spark):
    rows = spark.range(8_000).select(F.pmod("id", F.lit(2_000)).cast("double").alias("label"), (F.col("id") / 8_000.0).alias("draw"))
    drawn = models.draw_classes(rows, rows).groupBy("prediction").count()
    assert drawn.count() == 2_000 and drawn.filter("count = 4").count() == 2_000


def test_importances_follow_the_slots(spark):
    """A column named like the start of another keeps its own share."""
    rows = [(("b_x", "c")[i % 2], ("x", "y")[i // 2 % 2], float(i // 2 % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "a string, a_b string, y double")
    t = models.regression_tournament(Profile(df), "y", trees=3, depth=3, boosts=2)
    assert dict(t.importances)["a_b"] > 0.9


def test_batch_search_agrees_with_one_by_one(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(200, None), (201, [1.0]), (202, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    asked = df.filter("id % 20 = 0 AND id < 60")
    for block in (1, 512):  # several scans, and one
        found = vectors.vector_topk_batch(df, "v", "id", asked, "v", "id", 4, block).collect()
        for one in asked.collect():
            want = [(r["id"], round(r["score"], 6)) for r in vectors.vector_topk(df.filter("size(v) = 6"), "v", one["v"], 4, "id").collect()]
            got = sorted((r["rank"], r["key"], round(r["score"], 6)) for r in found if r["query"] == one["id"])
            assert sorted(s for _, s in want) == sorted(s for _, _, s in got) and got[0][1] == one["id"]
    assert vectors.vector_topk_batch(df.limit(0), "v", "id", asked, "v", "id").count() == 0
    assert vectors.vector_topk_batch(df, "v", "id", asked.limit(0), "v", "id").count() == 0
