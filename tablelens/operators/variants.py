"""Clusters of values that are spellings of one another.

Two values of a column are linked if
* their words are the same (letters and digits, any case, order, or repetition),
* the one is the initials of the other's words (two words or more), or
* their edit distance, lower-cased and with runs of other signs as one blank, is
  at most 1 (both of 5 to 64 signs) or 2 (both of 9 to 64), with equal digits:
  a different number is a different thing.

Candidates meet by signatures, never all with all.  For a distance of d a text
is cut into d + 1 parts; a text within that distance holds at least one part
unchanged, at most d places away.  Every value emits its parts, and the pieces
of itself that could be a part of a value of nearly its length; equal digits,
length, part and piece meet in a shuffle, and the edit distance decides.  A piece
that many values share is dealt over ``SALTS`` shares of its probes.  Clusters are
connected components: values take the smallest label of their neighbours, and the
label of that label, until nothing changes; every round is written to the shared folder.

Values are counted first, so copies cost nothing.  Nulls and values without
letters or digits are in no cluster.  A column's clusters are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.operators.dashboard import value_counts
from tablelens.session import durable

LONGEST = 64
ONE, TWO = 5, 9  # least lengths for a distance of one and of two
SALTS = 8


def _plain(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{Nd}]+", " "))


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, rows, and what signatures are made of; one row per distinct value."""
    counted = value_counts(df, columns).filter(F.col("value").isNotNull()).select("column", "value", F.col("count").alias("rows"), _plain(F.col("value")).alias("plain"))
    tokens = F.split("plain", " ")
    return counted.filter("plain <> ''").select(
        "column",
        "value",
        "rows",
        "plain",
        F.array_join(F.array_sort(F.array_distinct(tokens)), " ").alias("words"),
        F.when(F.size(tokens) > 1, F.array_join(F.transform(tokens, lambda t: F.left(t, F.lit(1))), "")).alias("initials"),
        F.regexp_replace("plain", r"[^\p{Nd}]+", " ").alias("digits"),
        F.length("plain").alias("size"),
    )


def _cuts(size: Column, parts: int) -> list[tuple[Column, Column]]:
    """Start (from 1) and length of each part of a text."""
    least = F.floor(size / parts)
    longer = size % parts  # the last ones are one sign longer
    out, start = [], F.lit(1)
    for i in range(parts):
        length = least + F.when(F.lit(i) >= F.lit(parts) - longer, 1).otherwise(0)
        out.append((start, length))
        start = start + length
    return out


def _near(values: DataFrame, distance: int, least: int) -> DataFrame:
    """Pairs (a < b) of values of a column within an edit distance."""
    some = values.filter(F.col("size").between(least, LONGEST)).select("column", "value", "plain", "digits", "size")
    own = [F.struct(F.lit(i).alias("part"), F.substr("plain", s.cast("int"), n.cast("int")).alias("piece")) for i, (s, n) in enumerate(_cuts(F.col("size"), distance + 1))]
    held = some.select("column", "digits", "value", "plain", "size", F.inline(F.array(*own)))
    probes = []
    for shorter in range(-distance, distance + 1):
        length = F.col("size") + shorter
        for i, (s, n) in enumerate(_cuts(length, distance + 1)):
            for shift in range(-distance, distance + 1):
                at = s + shift
                fits = (length >= least) & (at >= 1) & (at + n - 1 <= F.col("size"))
                probes.append(F.when(fits, F.struct(length.cast("int").alias("size"), F.lit(i).alias("part"), F.substr("plain", at.cast("int"), n.cast("int")).alias("piece"))))
    asked = some.select("column", "digits", F.col("value").alias("b"), F.col("plain").alias("other"), F.inline(F.array_distinct(F.array_compact(F.array(*probes)))))
    keys = ["column", "digits", "size", "part", "piece", "salt"]
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    met = held.withColumnRenamed("value", "a").join(asked, keys).filter(F.col("a") < F.col("b"))
    return met.filter(F.levenshtein("plain", "other", distance) >= 0).select("column", "a", "b")


def links(values: DataFrame) -> DataFrame:
    """Linked pairs a < b; values of equal words are linked to the first of them."""
    firsts = values.groupBy("column", "words").agg(F.min("value").alias("a"))
    same = values.join(firsts, ["column", "words"]).filter("a <> value").select("column", "a", F.col("value").alias("b"))
    short = values.select("column", F.col("plain").alias("initials"), F.col("value").alias("x"))
    named = values.filter("initials IS NOT NULL").select("column", "initials", F.col("value").alias("y"))
    initials = short.join(named, ["column", "initials"]).filter("x <> y").select("column", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(initials).unionByName(_near(values, 1, ONE)).unionByName(_near(values, 2, TWO)).distinct()


def value_clusters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, cluster, value, rows): the spellings of every cluster of two or more, named by its most frequent value (ties: the first)."""
    values = durable(_values(df, columns))
    pairs = links(values)
    both = durable(pairs.unionByName(pairs.select("column", F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = durable(both.groupBy("column", F.col("a").alias("value")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(labels.select("column", F.col("value").alias("b"), F.col("label").alias("near")), ["column", "b"]).groupBy("column", F.col("a").alias("value")).agg(F.min("near").alias("near"))
        least = labels.join(seen, ["column", "value"]).select("column", "value", "label", F.least("label", "near").alias("now"))
        of = labels.select("column", F.col("value").alias("now"), F.col("label").alias("next"))
        after = durable(least.join(of, ["column", "now"], "left").select("column", "value", F.least("now", F.coalesce("next", "now")).alias("label"), (F.least("now", F.coalesce("next", "now")) < F.col("label")).alias("moved")))
        labels = after.select("column", "value", "label")
        if not after.filter("moved").limit(1).count():
            break
    found = labels.join(values.select("column", "value", "rows"), ["column", "value"])
    most = found.groupBy("column", "label").agg(F.max("rows").alias("rows"))
    names = found.join(most, ["column", "label", "rows"]).groupBy("column", "label").agg(F.min("value").alias("cluster"))
    return found.join(names, ["column", "label"]).select("column", "cluster", "value", "rows")
