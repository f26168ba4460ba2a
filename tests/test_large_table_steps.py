"""Steps that large tables need: whole numbers stay numbers, likely keys are ruled out early, texts are measured once."""

import pytest
from pyspark.sql import functions as F

from tablelens.operators import dependencies, information, keys, profile
from tablelens.plans import learning

NAN, INF = float("nan"), float("inf")
ODD = [(i, i % 5, i // 5, float(i % 7), None if i == 3 else i, "same") for i in range(35)]


@pytest.mark.parametrize("slices", [1, 2, 64, 100_000])
def test_keys_are_those_of_all_rows(spark, monkeypatch, slices):
    monkeypatch.setattr(dependencies, "SLICES", slices)
    df = spark.createDataFrame(ODD, "a int, b int, c int, d double, e int, f string")
    assert dependencies.keys_of(df) == [("a",), ("b", "c"), ("b", "d"), ("c", "d")]
    assert dependencies.keys_of(df, 35, {"a": 35, "b": 5, "c": 7, "d": 7, "e": 34, "f": 1}) == [("a",), ("b", "c"), ("b", "d"), ("c", "d")]
    assert dependencies.keys_of(df.unionByName(df)) == [] == dependencies.keys_of(df.filter("false"))
    # one repeat among many rows, in whichever slice it lies
    many = spark.range(3000).select(F.when(F.col("id") == 2999, 17).otherwise(F.col("id")).alias("x"), (F.col("id") % 10).alias("y"))
    assert dependencies.keys_of(many) == [("x", "y")] and dependencies.keys_of(many.withColumn("y", F.lit(1))) == []
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (NAN,), (INF,)], "x double")
    assert dependencies.keys_of(zeros) == [] and dependencies.keys_of(zeros.filter("x <> 0 OR isnan(x)")) == [("x",)]


def test_numbers_are_counted_as_numbers(spark, monkeypatch):
    def refuse(*columns):
        raise AssertionError("a number was hashed")

    rows = [(1, 0.0, 1.5), (1 << 62, -0.0, 1.5), ((1 << 62) + 1, NAN, None), (None, NAN, INF), (1, None, -INF)]
    df = spark.createDataFrame(rows, "n long, x double, y float")
    with monkeypatch.context() as m:
        m.setattr(profile.F, "xxhash64", refuse)
        assert profile.Profile(df).distinct_counts == {"n": 3, "x": 2, "y": 3}
    mixed = df.withColumns({"t": F.lit("a"), "d": F.col("n").cast("decimal(38,2)"), "l": F.array("n"), "b": F.lit(None).cast("boolean")})
    assert profile.Profile(mixed).distinct_counts == {"n": 3, "x": 2, "y": 3, "t": 1, "d": 3, "l": 4, "b": 0}


def test_whole_keys_meet_as_numbers_and_others_as_text(spark, monkeypatch):
    left = spark.createDataFrame([(1, 7), (2, 7), (None, 8)], "id int, key long")
    right = spark.createDataFrame([(1, 7), (1, 9)], "id long, key int")
    text = spark.createDataFrame([("1", 7.0), ("x", None)], "id string, key double")

    def found(tables):
        return sorted(tuple(r)[:8] for r in keys.detect_keys(tables).collect())

    want = [("l", "id", "r", "id", 0.95, 2, 1, 0.5), ("l", "key", "r", "key", 0.95, 2, 2, 0.5)]
    with monkeypatch.context() as m:
        m.setattr(keys, "_as_text", None)
        assert found({"l": left, "r": right}) == want
    assert found({"l": left, "t": text}) == [("l", "id", "t", "id", 0.95, 2, 2, 0.5), ("l", "key", "t", "key", 0.95, 2, 1, 0.5)]


def test_bins_are_counted_as_numbers(spark, monkeypatch):
    rows = [(float(i), float(i % 4), "u" if i % 2 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "y double, x double, c string")
    seen, inline = [], F.inline

    def watched(c):
        seen.append(c)
        return inline(c)

    monkeypatch.setattr(information.F, "inline", watched)
    got = {c: (s, k) for _, c, s, k in information.mutual_information(df, "y", ["x", "c"], ["y", "x"], 400)}
    assert sum("AS x" in str(c) for c in seen) == 2  # bins apart from texts
    for name, place in (("x", 1), ("c", 2)):  # no bin of y tells x or c: entropies of counts, corrected
        cells = {(min(int(r[0] * 16 / 399), 15), r[place]) for r in rows}
        assert got[name][1] == len(cells) and got[name][0] == pytest.approx(0, abs=0.02)


def test_labelled_texts_are_measured_once(spark, monkeypatch):
    kept, write = [], learning.durable
    monkeypatch.setattr(learning, "durable", lambda df: kept.append(write(df)) or kept[-1])
    monkeypatch.setattr(learning.models, "classification_tournament", lambda p, target: (_ for _ in ()).throw(InterruptedError))
    for query in (learning.class_scores, learning.classification_tournament):
        with pytest.raises(InterruptedError):
            query(spark, "/root/testdata/sf0.001")
    assert len(kept) == 2 and "Parquet" not in kept[0]._jdf.queryExecution().executedPlan().toString()


def test_empty_labelled_texts_have_no_shares(spark, tmp_path):
    """One empty text among all must not end class_scores and classification_tournament."""
    rows = [(1, "Ab1 2", "en", "s", 5), (2, "", "en", "s", 0), (3, None, "en", "s", None), (4, " \n", "en", "s", 2), (5, "no label", "en", "s", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r["doc_id"]: tuple(r)[4:7] for r in learning._labelled(spark, str(tmp_path)).collect()}
    assert found[1] == (2, 0.4, 0.2) and found[2] == (1, None, None) and found[3][1:] == (None, None) and found[4] == (2, 0.0, 0.0)
