"""Committed dataset versions: snapshots, appends, failures and conflicts."""

import threading

import pytest
from pyspark.sql import functions as F

from tablelens.sources import versions


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_versions_are_snapshots(spark, tmp_path):
    root = str(tmp_path)
    assert versions.write_version(spark.range(3), root, "t") == 1
    assert versions.write_version(spark.range(3, 5), root, "t", append=True) == 2
    held = versions.read_version(spark, root, "t")
    assert versions.write_version(spark.range(0), root, "t") == 3
    assert ids(held) == [0, 1, 2, 3, 4] == ids(versions.read_version(spark, root, "t", 2))
    assert ids(versions.read_version(spark, root, "t", 1)) == [0, 1, 2]
    assert ids(versions.read_version(spark, root, "t")) == []
    assert versions.version_numbers(spark, root, "t") == [1, 2, 3]
    parts = [versions.manifest(spark, root, "t", n)["parts"] for n in (1, 2)]
    assert parts[1][:1] == parts[0]  # nothing is copied


def test_a_failed_write_never_shows(spark, tmp_path):
    root = str(tmp_path)
    versions.write_version(spark.range(3), root, "t")
    bad = spark.range(100, numPartitions=4).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        versions.write_version(bad, root, "t", append=True)
    assert versions.version_numbers(spark, root, "t") == [1]
    assert ids(versions.read_version(spark, root, "t")) == [0, 1, 2]
    assert versions.write_version(spark.range(7, 8), root, "t", append=True) == 2
    assert ids(versions.read_version(spark, root, "t")) == [0, 1, 2, 7]


def test_the_second_writer_is_refused(spark, tmp_path):
    root = str(tmp_path)
    versions.write_version(spark.range(1), root, "t")
    assert versions.write_version(spark.range(2), root, "t", expected=1) == 2
    with pytest.raises(versions.VersionConflict):
        versions.write_version(spark.range(9), root, "t", append=True, expected=1)
    assert ids(versions.read_version(spark, root, "t")) == [0, 1]
    assert not [p for p in (tmp_path / "t" / "versions").iterdir() if p.name.startswith("_")]


def test_parallel_writers_leave_whole_versions(spark, tmp_path):
    root, done, refused = str(tmp_path), [], []

    def work(i):
        try:
            done.append((versions.write_version(spark.range(i, i + 1), root, "t", append=True), i))
        except versions.VersionConflict:
            refused.append(i)

    for round_ in range(2):
        threads = [threading.Thread(target=work, args=(10 * round_ + i,)) for i in range(3)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    known = versions.version_numbers(spark, root, "t")
    assert known == list(range(1, len(known) + 1)) and len(done) + len(refused) == 6
    assert set(ids(versions.read_version(spark, root, "t"))) <= {i for _, i in done}


def test_other_columns_and_unknown_versions(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(LookupError):
        versions.read_version(spark, root, "t")
    versions.write_version(spark.range(1), root, "t")
    with pytest.raises(ValueError, match="columns differ"):
        versions.write_version(spark.range(1).withColumn("x", F.lit(1)), root, "t", append=True)
    with pytest.raises(LookupError):
        versions.read_version(spark, root, "t", 5)
