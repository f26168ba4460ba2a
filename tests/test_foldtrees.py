"""Trees of all folds in shared passes: as Spark's trees, where these are fitted fold by fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablelens.operators import foldtrees, models
from tablelens.operators.profile import Profile

RNG = np.random.default_rng(1)
N = 4000
X = RNG.integers(0, 25, (N, 4)).astype(float)
Y = 50 + 3 * np.sin(X[:, 0] / 4) + 0.1 * X[:, 1] + (X[:, 2] > 12) * X[:, 3] * 0.2 + RNG.normal(0, 0.3, N)
FOLDS = RNG.integers(0, 5, N).astype("int32")


def table(spark, folds=FOLDS, x=X):
    rows = spark.createDataFrame(pd.DataFrame({"f": [r.tolist() for r in x], "label": Y, "fold": folds}))
    return rows.select(array_to_vector("f").alias("features"), "label", "fold").repartition(3).cache()


def by_fold(ready, model):
    judges = (RegressionEvaluator(metricName="r2"), RegressionEvaluator(metricName="rmse"))
    return models._cross_validate(ready, lambda train, test: model.fit(train).transform(test), judges)


@pytest.mark.parametrize("block", [65_536, 100])
def test_boosting_is_that_of_spark(spark, monkeypatch, block):
    monkeypatch.setattr(foldtrees, "BLOCK", block)
    monkeypatch.setattr(foldtrees, "CUT_EVERY", 2)
    ready = table(spark)
    blocks, boosting = foldtrees.blocks_of(ready), models.regression_models(N, 2, 3, 5)["GradientBoostingRegressor"]
    assert foldtrees.boosting_scores(blocks, 5, 3) == pytest.approx(by_fold(ready, boosting), rel=1e-9)
    ours, theirs = foldtrees.fit_boosted(blocks, 5, 3), boosting.fit(ready)
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), rel=1e-9)
    both = theirs.transform(ours.transform(ready).withColumnRenamed("prediction", "ours"))
    assert both.agg(F.max(F.abs(F.col("ours") - F.col("prediction")))).first()[0] < 1e-9


def test_forest_is_as_good_as_that_of_spark(spark):
    ready = table(spark)
    blocks, forest = foldtrees.blocks_of(ready), models.regression_models(N, 24, 6, 2)["RandomForestRegressor"]
    found, wanted = foldtrees.forest_scores(blocks, 24, 6), by_fold(ready, forest)
    assert found == pytest.approx(wanted, rel=0.05) and found[0] > 0.9
    ours, theirs = foldtrees.fit_forest(blocks, 24, 6), forest.fit(ready)
    assert ours.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.06)
    scores = [RegressionEvaluator(metricName="r2").evaluate(m.transform(ready)) for m in (ours, theirs)]
    assert scores[0] == pytest.approx(scores[1], abs=0.02)


def test_first_splits_of_a_forest_are_the_best(spark):
    """Every tree's root against all cuts of its slots, over the rows as often as they are drawn."""
    blocks = foldtrees.blocks_of(table(spark))
    found = [foldtrees.Block(*b) for b in blocks.rdd.collect()]
    x, y = np.concatenate([b.bins for b in found], axis=1), np.concatenate([b.target for b in found])
    fold = np.concatenate([np.full(len(b.target), b.fold) for b in found])
    assert len(y) == N and sorted(set(fold)) == [0, 1, 2, 3, 4]
    for (out, tree), grown in foldtrees.grow_forest(blocks, [2, foldtrees.NONE], 3, 1).items():
        w = np.concatenate([foldtrees.drawn(b, tree) for b in found]) * (fold != out)
        best = {}
        for slot in foldtrees._node_slots(out, tree, 0, 4)[0]:
            for cut in range(24):
                left = x[slot] <= cut
                best[slot, cut] = sum((w * m * y).sum() ** 2 / (w * m).sum() for m in (left, ~left))
        assert (grown.levels[0][0][0], grown.levels[0][1][0]) == max(best, key=best.get)
        left = x[grown.levels[0][0][0]] <= grown.levels[0][1][0]
        assert grown.means == pytest.approx([np.average(y[m], weights=w[m]) for m in (left, ~left)])


def test_rows_are_drawn_by_a_poisson_law():
    block = foldtrees.Block((0, 1), 0, None, np.zeros(200_000))
    times = foldtrees.drawn(block, 7)
    assert np.bincount(times)[:4] / 200_000 == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613], abs=0.005)
    assert (times == foldtrees.drawn(block, 7)).all() and (times != foldtrees.drawn(block, 8)).any()


def test_many_values_missing_numbers_and_one_fold(spark):
    x = X.copy()
    x[:, 0] += RNG.uniform(0, 1, N)  # more values than bins
    x[::50, 1] = np.nan
    blocks = foldtrees.blocks_of(table(spark, np.full(N, 3, "int32"), x))
    assert [len(e) for e in blocks.edges] == [31, 24, 24, 24] and blocks.left_out == [foldtrees.NONE]
    assert foldtrees.boosting_scores(blocks, 8, 4)[0] > 0.8 and foldtrees.forest_scores(blocks, 8, 6)[0] > 0.8


def test_large_tables_grow_the_trees_of_all_folds_together(spark, monkeypatch, tmp_path):
    """No forest or boosting is fitted fold by fold; the champion is stored and scores as before."""

    def refuse(self, dataset):
        raise AssertionError("fitted apart")

    monkeypatch.setattr(models, "SHARED_ROWS", 1000)
    for estimator in (models.RandomForestRegressor, models.GBTRegressor):
        monkeypatch.setattr(estimator, "_fit", refuse)
    df = spark.createDataFrame(pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "c": [f"c{int(v)}" for v in X[:, 2]], "y": Y.round(4)}))
    for trees, boosts, champion in ((3, 6, "GradientBoostingRegressor"), (8, 1, "RandomForestRegressor")):
        t = models.regression_tournament(Profile(df), "y", trees=trees, depth=4 if boosts > 1 else 7, boosts=boosts)
        assert [m for m, _, _ in t.leaderboard] == ["Baseline", "LinearRegression", "Ridge", "RandomForestRegressor", "GradientBoostingRegressor"]
        assert t.best > max(s for m, s, _ in t.leaderboard if m in ("Baseline", "LinearRegression", "Ridge"))
        assert t.champion == champion and t.importances[0][0] == "a" and sum(v for _, v in t.importances) == pytest.approx(1, abs=0.01)
        path = models.save_model(spark, t, str(tmp_path), champion)
        scored = models.batch_score(PipelineModel.load(path), df, t.task, ["a", "b", "c"])
        assert scored.count() == N and scored.select(F.corr("y", "prediction")).first()[0] > 0.7
