"""Registered queries return all that their operators make: against brute force on small tables."""

import functools
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tablelens.operators import models
from tablelens.operators.profile import Profile
from tablelens.plans import inputs, learning

SF = "/root/testdata/sf0.001"


def run(spark, name, sf=SF):
    return entry.queries()[name](spark, sf).toPandas()


def test_text_embed(spark, tmp_path):
    from pyspark.ml.feature import HashingTF

    texts = ["One two, TWO!", "", None, "three"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(run(spark, "text_embed", str(tmp_path)).to_numpy().tolist())
    place = HashingTF(numFeatures=384, inputCol="a", outputCol="b").indexOf
    for i, words in enumerate((["one", "two", "two"], [], [], ["three"])):
        want = np.zeros(384)
        for w, n in Counter(words).items():
            want[place(w)] += n
        assert np.allclose(got[i], want / max(np.linalg.norm(want), 1e-12), atol=1e-6)


def test_outlier_values(spark):
    got = run(spark, "outlier_values")
    df = inputs.li_spikes(spark, SF).withColumn("price", F.col("l_extendedprice"))
    p = Profile(df.unionByName(df))
    data = p.df.toPandas()
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    want = []
    for c in p.numeric_stats:
        v = data[c].astype(float)
        a, b = np.percentile(v.dropna(), [25, 75])
        found = data[(v < a - 1.5 * (b - a)) | (v > b + 1.5 * (b - a))].sort_values([*keys, c])[:5]
        want += [(c, float(r[c]), i + 1, *(r[k] for k in keys)) for i, (_, r) in enumerate(found.iterrows())]
    assert len(got.columns) == 8 and want and sorted(map(tuple, got[["column", "value", "rank", *keys]].to_numpy().tolist())) == sorted(want)


def test_context_summary(spark):
    got = run(spark, "context_summary")
    balances = [r["c_acctbal"] for r in spark.read.parquet(f"{SF}/customer.parquet").orderBy("c_custkey").collect()]
    half = len(balances) // 2
    growth = (sum(balances[half:]) - sum(balances[:half])) / abs(sum(balances[:half])) * 100
    lines = {n: got[got["position"] == n]["line"].tolist() for n in (5, 9, 10)}
    assert lines[5] == [f"Growth Rate (Period-over-Period): {growth:.1f}%"]
    assert len(lines[9]) == 1 and len(lines[10]) == min(5, int(lines[9][0].split(": ")[1]))


def test_segments(spark):
    got = run(spark, "segments").sort_values("segment")
    _, out, k = models.segments(Profile(spark.read.parquet(f"{SF}/customer.parquet")))
    rows = out.select("segment", "c_acctbal").toPandas()
    want = [(s, len(g), g["c_acctbal"].mean(), k) for s, g in rows.groupby("segment")]
    assert len(want) == k and np.allclose(got[["segment", "rows", "mean_acctbal", "k"]].to_numpy(float), want)


def test_batch_score(spark):
    got = dict(run(spark, "batch_score").to_numpy().tolist())
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    t = models.holdout_forecast(Profile(orders), "o_totalprice", ["o_orderdate", "o_orderkey"])
    rows = t.model.transform(orders.withColumn("o_orderpriority", F.lit(None).cast("string"))).select("o_orderkey", "prediction").collect()
    assert len(got) == len(rows) and all(got[r[0]] == pytest.approx(r[1]) for r in rows)


def test_boards_and_class_scores(spark, monkeypatch):
    labelled = learning._labelled(spark, SF)
    # forests differ from run to run: one small tournament for all
    t = models.classification_tournament(Profile(labelled), "quality", trees=3, depth=3)
    monkeypatch.setattr(models, "classification_tournament", lambda p, target: t)
    monkeypatch.setattr(models, "regression_tournament", functools.partial(models.regression_tournament, trees=3, depth=3, boosts=2))
    board = run(spark, "classification_tournament")
    assert sorted(board[["model", "score", "second"]].to_numpy().tolist()) == sorted([m, s, e] for m, s, e in t.leaderboard)
    assert board[board["champion"]]["model"].tolist() == [t.champion]
    board = run(spark, "regression_tournament")
    assert len(board) == 5 and board["champion"].sum() == 1 and np.isfinite(board[["score", "second"]].to_numpy()).all()
    got = run(spark, "class_scores")
    rows = t.model.transform(labelled).select("doc_id", "predicted_class", "probability").collect()
    want = sorted((r[0], r[1], round(float(max(r[2])), 6)) for r in rows)
    assert sorted((i, c, round(p, 6)) for i, c, p in got[["doc_id", "prediction", "confidence"]].to_numpy().tolist()) == want
