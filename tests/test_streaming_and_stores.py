"""Streams give the batch answer; stores replace and version what they should."""

import datetime as dt

from pyspark.sql import functions as F

from tablelens.operators import increments
from tablelens.plans import CHECKS, QUERIES
from tablelens.sources import readers, stores
from tablelens.streaming import rates

SCHEMA = "ts timestamp, kind string, value double"


def event(minute, kind="a", value=1.0):
    return (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), kind, value)


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    batches = [[event(m, "ab"[m % 2], float(m)) for m in range(30)], [event(m, "a", 2.0) for m in range(30, 90)], [event(1, "late")], [event(150)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        rates.run_available(rates.event_rate(stream, "ts", "kind"), str(tmp_path / "out"), str(tmp_path / "state"))
    streamed = {(r["window_start"], r["kind"]): r["events"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    kept = spark.createDataFrame(batches[0] + batches[1], SCHEMA)
    batch = {(r["window_start"], r["kind"]): r["events"] for r in rates.event_rate(kept, "ts", "kind").collect()}
    assert streamed == batch


def test_percentile_from_buckets(spark):
    rows = [event(0, "a", v / 10) for v in range(1, 101)]
    out = rates.latency_p95(spark.createDataFrame(rows, SCHEMA), "ts", "value", [2.0, 5.0, 9.0, 12.0])
    assert {round(r["p95"], 6) for r in out.collect()} == {10.5}
    over = rates.latency_p95(spark.createDataFrame([event(0, "a", 99.0)], SCHEMA), "ts", "value", [1.0, 2.0])
    assert {r["p95"] for r in over.collect()} == {2.0}


def test_encodings_and_null_tokens(spark, tmp_path):
    (tmp_path / "l1.csv").write_bytes("Full Name,unit-price\n  caf\xe9 ,1.5\nN/A,oops\n".encode("latin-1"))
    df = readers.read_dirty_csv(spark, str(tmp_path / "l1.csv"))
    assert df.columns == ["Full_Name", "unit_price"]
    assert [r[0] for r in df.collect()] == ["café", None]
    report = [tuple(r) for r in readers.dirty_csv_report(spark, str(tmp_path / "l1.csv")).collect()]
    assert report == [("ISO-8859-1", 2, "Full Name", "Full_Name", 1, 1), ("ISO-8859-1", 2, "unit-price", "unit_price", 0, 0)]
    typed = readers.read_csv(spark, str(tmp_path / "l1.csv"), spark.createDataFrame([], "n string, p double").schema, "ISO-8859-1")
    assert [r["p"] for r in typed.collect()] == [1.5, None]


def test_jdbc_options():
    plain = readers.jdbc_options("jdbc:x", "t")
    assert plain == {"url": "jdbc:x", "dbtable": "t"}
    split = readers.jdbc_options("jdbc:x", "t", ("id", 0, 100, 8))
    assert split["numPartitions"] == "8" and split["partitionColumn"] == "id"


def test_insights_of_other_datasets_stay(spark, tmp_path):
    path = str(tmp_path / "insights")
    make = lambda d, t, s: spark.createDataFrame([(d, t, s)], "dataset string, title string, score int")
    stores.replace_insights(make("a", "old", 1).union(make("b", "kept", 2)), path)
    stores.replace_insights(make("a", "new", 3), path)
    assert [tuple(r) for r in stores.read_insights(spark, path).select("dataset", "title", "score").collect()] == [("a", "new", 3), ("b", "kept", 2)]
    # a run that finds nothing empties its dataset
    stores.replace_insights(make("a", "x", 1).limit(0), path, ("a",))
    assert [r["title"] for r in stores.read_insights(spark, path).collect()] == ["kept"]


def test_latest_n(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    assert stores.latest_n(df, ["k"], ["id"], 2).agg(F.min("id")).first()[0] == 94


def test_every_check_belongs_to_a_query():
    assert set(CHECKS) <= set(QUERIES) and len(QUERIES) > 120


def test_profiles_grow_without_reading_old_files(spark, tmp_path):
    import os

    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(int(i), float(v), None if i % 7 == 0 else "abc"[i % 3], [int(i)]) for i, v in enumerate(rng.normal(10, 3, 6000))]
    df = spark.createDataFrame(rows, "k long, `v x` double, c string, a array<int>")
    data, state = str(tmp_path / "data + x"), str(tmp_path / "state")
    df.filter("k < 4000").repartition(3).write.parquet(data)
    first = increments.refresh(spark, data, state, df.schema)
    assert len(first) == 3 and increments.refresh(spark, data, state, df.schema) == []
    for path in first:  # the same length and time, but nothing that can be read
        name = path.removeprefix("file:")
        before = os.stat(name)
        with open(name, "r+b") as held:
            held.write(b"\0" * before.st_size)
        os.utime(name, ns=(before.st_atime_ns, before.st_mtime_ns))
    df.filter("k >= 4000").repartition(2).write.mode("append").parquet(data)
    assert len(increments.refresh(spark, data, state, df.schema)) == 2
    found = {r["column"]: r for r in increments.merged_profile(spark, data, state).collect()}
    values = np.array([r[1] for r in rows])
    v = found["v x"]
    assert (v["rows"], v["nulls"], v["min"], v["max"]) == (6000, 0, values.min(), values.max())
    assert abs(v["mean"] - values.mean()) < 1e-9 and abs(v["std"] - values.std(ddof=1)) < 1e-9
    for got, p in zip(v["approx_quartiles"], (0.25, 0.5, 0.75)):
        assert abs((values <= got).mean() - p) < 0.0015 + 1 / 6000
    assert abs(found["k"]["approx_distinct"] - 6000) < 6000 * 0.05
    c = found["c"]
    assert c["nulls"] == sum(r[2] is None for r in rows) and (c["first"], c["last"]) == ("a", "c")
    assert {i["item"]: i["count"] for i in c["frequent"]} == {x: sum(r[2] == x for r in rows) for x in "abc"}
    os.remove(first[0].removeprefix("file:"))  # a removed file drops out
    left = {r["column"]: r["rows"] for r in increments.merged_profile(spark, data, state).collect()}
    assert 2000 < left["k"] < 6000 and found["a"]["rows"] == 6000
