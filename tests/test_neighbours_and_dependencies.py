"""Nearest-neighbour information, inclusion dependencies and sketch-based ranks against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablelens.operators import charts, crossproducts, dependencies, neighbours, ranks, signals, textsearch
from tablelens.operators.profile import Profile, correlation_pairs
from tablelens.session import evenly

N = 900


def brute_information(x, y, k=3):
    n, sx, sy = len(x), np.std(x, ddof=1), np.std(y, ddof=1)
    if n <= k or not sx > 0 or not sy > 0:
        return 0.0
    dx, dy = np.abs(x[:, None] - x[None]) / sx, np.abs(y[:, None] - y[None]) / sy
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, 1)[:, k - 1 : k]
    np.fill_diagonal(d, 0)
    psi = np.concatenate([[0], -0.57721566490153286 + np.concatenate([[0], np.cumsum(1 / np.arange(1, n + 2))])])
    inside = lambda one: np.where(r > 0, one < r, one == 0).sum(1)
    near = np.where(r[:, 0] > 0, k, (d == 0).sum(1))
    return max(0.0, float(np.mean(psi[near] - psi[inside(dx)] - psi[inside(dy)])) + math.log(n))


def shapes():
    rng = np.random.default_rng(7)
    y = rng.normal(size=N)
    y[:40], y[3] = 0.0, 7.5
    frame = {
        "y": y, "noisy": y + rng.normal(size=N) * 0.1, "free": rng.normal(size=N), "whole": rng.integers(0, 7, N).astype(float),
        "hot": np.where(rng.random(N) < 0.4, 5.0, y * 2), "square": y**2, "one": np.ones(N), "cents": np.round(rng.uniform(0, 10, N), 2),
        "kind": rng.choice(["a", "b", "é"], N),
    }
    return pd.DataFrame(frame)


def test_digamma():
    harmonic = np.concatenate([[0], np.cumsum(1 / np.arange(1, 5000))])
    assert neighbours.digamma(np.arange(1, 5001)) == pytest.approx(harmonic - 0.57721566490153286, abs=1e-13)


@pytest.mark.parametrize("cell_points", [8192, 60])
def test_information_equals_brute_force(spark, cell_points):
    frame = shapes()
    columns = [c for c in frame if c != "y"]
    found = neighbours.neighbour_information(spark.createDataFrame(frame).repartition(3), "y", columns, [c for c in columns if c != "kind"], cell_points=cell_points)
    scores = {r["column"]: r["mi_score"] for r in found.collect()}
    codes = frame["kind"].map({"a": 0.0, "b": 1.0, "é": 2.0})
    for c in columns:
        x = (codes if c == "kind" else frame[c]).to_numpy()
        assert scores[c] == pytest.approx(brute_information(x, frame["y"].to_numpy()), abs=1e-9), c


def test_information_of_odd_tables(spark):
    schema = "y double, a double, k string"
    run = lambda rows: {r["column"]: r["mi_score"] for r in neighbours.neighbour_information(spark.createDataFrame(rows, schema), "y", ["a", "k"], ["a"]).collect()}
    assert run([]) == run([(1.0, 2.0, "x")]) == {"a": 0.0, "k": 0.0}
    rows = [(None, float("nan"), None), (1.0, None, "x"), (float("inf"), 3.0, None)] + [(float(i), float(i % 2), "ab"[i % 2]) for i in range(20)]
    y = np.array([0.0, 1.0, 0.0, *range(20)])
    found = run(rows)
    assert found["a"] == pytest.approx(brute_information(np.array([0.0, 0, 3, *[i % 2 for i in range(20)]]), y), abs=1e-9)
    assert found["k"] == pytest.approx(brute_information(np.array([0.0, 3, 0, *[1 + i % 2 for i in range(20)]]), y), abs=1e-9)
    assert neighbours.neighbour_information(spark.createDataFrame(rows, schema), "y", [], []).count() == 0


def test_inclusions_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    parents = [(i // 4, i % 4, f"k{i}", float(i), None) for i in range(40)]
    children = [(int(a), int(b), f"k{a * 4 + b}", int(v)) for a, b, v in zip(rng.integers(0, 10, 90), rng.integers(0, 4, 90), rng.integers(0, 60, 90))]
    children += [(None, 2, None, None)]
    tables = {
        "parent": spark.createDataFrame(parents, "p int, q long, name string, size double, empty string"),
        "child": spark.createDataFrame(children, "first long, second int, label string, other long"),
        "words": spark.createDataFrame([("1",), ("2",), ("k1",)], "w string"),
        "none": spark.createDataFrame([], "z int"),
        "nested": spark.createDataFrame([([1],)], "a array<int>"),
    }
    rows = {"parent": parents, "child": children, "words": [("1",), ("2",), ("k1",)], "none": []}
    names = {"parent": ["p", "q", "name", "size", "empty"], "child": ["first", "second", "label", "other"], "words": ["w"], "none": ["z"]}
    values = {(t, c): {r[i] for r in rows[t] if r[i] is not None} for t in names for i, c in enumerate(names[t])}
    single = {(a, b) for a, b in itertools.permutations(values, 2) if values[a] and values[a] <= values[b]}
    found = dependencies.inclusions(tables).collect()
    assert {((r["table"], r["columns"]), (r["ref_table"], r["ref_columns"])) for r in found if "," not in r["columns"]} == single
    pairs = {(r["table"], r["columns"], r["ref_table"], r["ref_columns"]): (r["values"], r["ref_values"]) for r in found if "," in r["columns"]}
    tuples = len({(a, b) for a, b, *_ in children if a is not None})
    assert pairs["child", "first,second", "parent", "p,q"] == (tuples, 40)
    keys = dependencies.keys_of(tables["parent"])
    assert set(keys) == {("name",), ("size",), ("p", "q")}
    assert dependencies.keys_of(tables["none"]) == []
    linked = {(r["columns"], r["ref_columns"]) for r in dependencies.foreign_keys(dependencies.inclusions(tables)).collect()}
    assert ("label", "name") in linked and ("first,second", "p,q") in linked


def test_foreign_keys_of_the_tables_are_found_without_names(spark):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    tables = {n: (df := read(n)).toDF(*[f"{n[0]}{i}" for i in range(len(df.columns))]) for n in ("region", "nation", "customer", "orders", "lineitem", "part", "supplier")}
    found = {(r["table"], r["columns"], r["ref_table"], r["ref_columns"]) for r in dependencies.foreign_keys(dependencies.inclusions(tables, composite=False)).collect()}
    expected = {
        ("nation", "n2", "region", "r0"), ("customer", "c2", "nation", "n0"), ("supplier", "s2", "nation", "n0"), ("orders", "o1", "customer", "c0"),
        ("lineitem", "l0", "orders", "o0"), ("lineitem", "l1", "part", "p0"), ("lineitem", "l2", "supplier", "s0"),
    }
    assert expected <= found


def test_ranks_survive_a_wrong_sketch(spark, monkeypatch):
    """Whatever the grid says, the second scan finds the exact value."""
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=4000), "b": rng.integers(0, 3, 4000).astype(float), "c": np.concatenate([np.zeros(3000), rng.normal(size=1000)])}
    df = spark.createDataFrame(pd.DataFrame(data)).repartition(3)
    probs = [0, 0.001, 0.25, 1 / 3, 0.5, 0.999, 1]
    for error, final in ((0.0015, 200_000), (-0.4, 200_000), (0.2, 30), (-0.4, 30)):
        monkeypatch.setattr(ranks, "SKETCH_ERROR", error)
        found = ranks.exact_quantiles(df, {c: probs for c in data}, final_rows=final)
        for c, v in data.items():
            assert found[c] == pytest.approx(list(np.quantile(v, probs)), rel=1e-12, abs=1e-12), (c, error, final)


def test_ranks_of_long_keys_are_exact(spark):
    """Whole numbers beyond the precision of a double."""
    values = [(1 << 60) + 3 * i for i in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "k long").repartition(4)
    assert ranks.order_cutoffs(df, ["k"], [0, 1, 2500, 4999]) == [(values[i],) for i in (0, 1, 2500, 4999)]


def test_even_copies_keep_rows_and_types(spark):
    df = spark.createDataFrame([(i, None if i % 3 else f"v{i}") for i in range(50)], "`a b` int, `c.d` string")
    same = evenly(df)
    assert same.schema == df.schema and sorted(same.collect(), key=str) == sorted(df.collect(), key=str)
    assert Profile(spark.createDataFrame([], "x int")).rows == 0
    twice = spark.createDataFrame([(1, 2)], "a int, b int").toDF("a", "A")
    assert evenly(twice) is twice


def test_wide_tables_need_one_scan_for_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 23
    base = rng.normal(5, 2, (400, 3))
    data = base @ rng.normal(size=(3, n)) + rng.normal(size=(400, n)) + 1000
    holes = rng.random((400, n)) < 0.03
    holes[:, 4] = holes[:, 9]  # missing together
    frame = pd.DataFrame(np.where(holes, np.nan, data), columns=[f"m{i}" for i in range(n)])
    df = spark.createDataFrame(frame.astype(object).where(~holes, None), ", ".join(f"m{i} double" for i in range(n))).repartition(5)
    names = list(frame)
    monkeypatch.setattr(crossproducts, "BLOCK", 7)
    assert crossproducts.gram(df.na.fill(0.0), [F.col(c) for c in names], block=7) == pytest.approx((z := np.where(holes, 0, data)).T @ z)
    assert not crossproducts.gram(df.limit(0), [F.col(c) for c in names[:2]]).any()
    complete = frame.dropna().corr()
    for a, b, r in correlation_pairs(df, names):
        assert r == pytest.approx(round(complete.loc[a, b], 4), abs=1.01e-4)
    found = crossproducts.pairwise_correlations(df, [F.col(c) for c in names], list(frame.mean()))
    assert found == pytest.approx(frame.corr().to_numpy(), abs=1e-9)
    p = Profile(df)
    scored = {tuple(c): d["pearson_r"] for _, _, c, _, d in charts.score_num_num(p)}
    assert len(scored) == n * (n - 1) // 2 and scored["m1", "m2"] == pytest.approx(frame["m1"].corr(frame["m2"]), abs=1e-9)
    together = [s.columns for s in signals.missingness_clusters(p)]
    assert ["m4", "m9"] in together


def test_words_are_counted_by_document(spark):
    rows = [(1, "Apple apple pear"), (1, "apple"), (2, None), (3, ""), (4, "pear plum the the the")]
    found = sorted(tuple(r) for r in textsearch.tfidf_top(spark.createDataFrame(rows, "k int, t string"), "k", "t", n=2).collect())
    idf = {"apple": math.log(6 / 3) + 1, "pear": math.log(6 / 3) + 1}
    norm = math.hypot(2 * idf["apple"], idf["pear"])
    expected = [(1, "apple", 2 * idf["apple"] / norm), (1, "apple", 1.0), (1, "pear", idf["pear"] / norm), (4, "pear", 1.0)]
    assert [(k, t, pytest.approx(w)) for k, t, w in sorted(expected)] == found
    assert textsearch.tfidf_top(spark.createDataFrame([], "k int, t string"), "k", "t").count() == 0
