"""Keys and inclusion dependencies found in the values alone, without names.

A column's values are hashed to 128 bits with their kind (number, text, time,
truth), so that values of different kinds never meet and equal numbers of any
type do.  One shuffle brings the columns that hold a value together, once per
task and column; what remains is a set of columns per value, and there are few
distinct sets.  Counting them gives, for every two columns, how many distinct
values they share: column A is included in B if that is all of A's.

Keys: a column, or a pair of columns without a key among them, whose values
are distinct over all rows.  A column with a null is none.  Each value is hashed
once a row.  A repeat among one in 64 values, by their hash, rules most lists of
columns out; the others are compared over all rows.  Composite inclusions go level by
level: two columns can only be included in the columns of a pair if each is
included alone; the surviving candidates are hashed as tuples and meet in a
shuffle of the same form.

Nulls are no values; a tuple with a null is none.  Nested columns take no part.
A column without values is included nowhere.  Repeated rows make no key.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.functions.semantics import col, is_numeric

Names = tuple[str, tuple[str, ...]]  # a table and some of its columns
# Columns may hold so many times the distinct values that a sketch of 5 % standard error tells.
SKETCH_FACTOR = 2
# The first comparison of likely keys takes one in so many values, by their hash.
SLICES = 64


def atom(field: T.StructField) -> Column | None:
    """The kind and the text of a value, written alike for equal values; null for types that have none."""
    value, kind = col(field.name), field.dataType
    if isinstance(kind, T.IntegralType):
        return F.concat(F.lit("n"), value.cast("string"))
    if is_numeric(kind):
        # whole numbers as integers write them; other decimals without trailing zeros, as doubles write them
        plain = F.when((value == F.floor(value)) & (F.abs(value) < 1e18), value.cast("decimal(38,0)").cast("string")).otherwise(value.cast("double").cast("string"))
        return F.concat(F.lit("n"), plain)
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("s"), value)
    if isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
        return F.concat(F.lit("t"), value.cast("timestamp_ntz").cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.concat(F.lit("b"), value.cast("string"))
    return None


def _hash(parts: list[Column], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *parts)


def _atoms(df: DataFrame) -> dict[str, Column]:
    return {f.name: a for f in df.schema.fields if (a := atom(f)) is not None}


def _value_sets(tables: dict[str, DataFrame], wanted: list[Names]) -> DataFrame:
    """(members, n): the sets of columns (numbers in ``wanted``) that share a value, with how many values do."""
    parts = []
    for name, df in tables.items():
        atoms = _atoms(df)
        mine = [(i, columns) for i, (t, columns) in enumerate(wanted) if t == name]
        for start in range(0, len(mine), 50):  # slices keep generated code small
            cells = []
            for i, columns in mine[start : start + 50]:
                values = [atoms[c] for c in columns]
                full = reduce(Column.__and__, [v.isNotNull() for v in values])
                cells.append(F.when(full, F.struct(F.lit(i).alias("c"), _hash(values, 1).alias("a"), _hash(values, 2).alias("b"))))
            parts.append(df.select(F.inline(F.array_compact(F.array(*cells)))).distinct())
    met = reduce(DataFrame.unionByName, parts).groupBy("a", "b").agg(F.array_sort(F.collect_set("c")).alias("members"))  # at most one a column
    return met.groupBy("members").agg(F.count("*").alias("n"))


def _shared(sets: DataFrame) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """Distinct values of every column, and of every two columns together."""
    both = sets.select("n", F.explode("members").alias("x"), "members").select("n", "x", F.explode("members").alias("y"))
    counts = {(r["x"], r["y"]): r["n"] for r in both.groupBy("x", "y").agg(F.sum("n").alias("n")).collect()}  # one line a pair of columns
    return {x: n for (x, y), n in counts.items() if x == y}, {p: n for p, n in counts.items() if p[0] != p[1]}


def _own(field: T.StructField) -> Column | None:
    """A value in a form that is equal where its ``atom`` is, for comparisons inside one column."""
    value, kind = col(field.name), field.dataType
    if isinstance(kind, (T.IntegralType, T.FloatType, T.DoubleType, T.StringType, T.BooleanType)):
        return value
    if isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
        return value.cast("timestamp_ntz")
    return atom(field)


def keys_of(df: DataFrame, rows: int | None = None, distinct: dict[str, int] | None = None) -> list[tuple[str, ...]]:
    """Single columns, and pairs of other columns, that tell all rows apart (no nulls in them)."""
    values = {f.name: v for f in df.schema.fields if (v := _own(f)) is not None}
    names = list(values)
    rows = df.count() if rows is None else rows
    if rows == 0:
        return []
    filled, most = {}, dict(distinct or {})
    for start in range(0, len(names), 50):
        part = names[start : start + 50]
        sizes = [] if distinct is not None else [F.approx_count_distinct(_hash([values[c]], 1), 0.05) for c in part]
        seen = list(df.agg(*[e.alias(f"a{i}") for i, e in enumerate([*(F.count(values[c]) for c in part), *sizes])]).first())
        filled |= dict(zip(part, seen))
        # twenty standard errors: a bound that only spares the work of counting
        most |= {c: n * SKETCH_FACTOR for c, n in zip(part, seen[len(part) :])}
    full = [c for c in names if filled[c] == rows]
    number = {c: i for i, c in enumerate(full)}
    hashed = df.select(*[_hash([values[c]], seed).alias(f"h{i}_{seed}") for c, i in number.items() for seed in (1, 2)])
    single = _keys(hashed, number, [(c,) for c in full if most.get(c, 0) >= rows])
    rest = [c for c in full if (c,) not in single]
    return single + _keys(hashed, number, [p for p in itertools.combinations(rest, 2) if most.get(p[0], 0) * most.get(p[1], 0) >= rows])


def _keys(hashed: DataFrame, number: dict[str, int], lists: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The lists of columns of which no two rows share the values.

    A repeat among the rows of one hash in SLICES rules a list out; those left are compared over all rows.
    """
    for slices in (SLICES, 1):
        repeated: set[int] = set()
        for start in range(0, len(lists), 50):
            cells = []
            for i, columns in enumerate(lists[start : start + 50], start):
                a, b = (_hash([F.col(f"h{number[c]}_{seed}") for c in columns], seed) for seed in (1, 2))
                cell = F.struct(F.lit(i).alias("c"), a.alias("a"), b.alias("b"))
                cells.append(cell if slices == 1 else F.when(F.pmod(a, F.lit(slices)) == 0, cell))
            counted = hashed.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("c", "a", "b").count()
            repeated |= {r["c"] for r in counted.filter("count > 1").select("c").distinct().collect()}  # one a list
        lists = [columns for i, columns in enumerate(lists) if i not in repeated]
    return lists


def inclusions(tables: dict[str, DataFrame], composite: bool = True) -> DataFrame:
    """One row per inclusion: table, columns, ref_table, ref_columns, values, ref_values, ref_is_key.

    All single columns; with ``composite`` also pairs of columns included in a composite key of another table.
    """
    spark = next(iter(tables.values())).sparkSession
    schema = "table string, columns string, ref_table string, ref_columns string, values long, ref_values long, ref_is_key boolean"
    single = [(t, (c,)) for t, df in tables.items() for c in _atoms(df)]
    if not single:
        return spark.createDataFrame([], schema)
    sizes, both = _shared(_value_sets(tables, single))
    rows = {t: df.count() for t, df in tables.items()}
    found = [(single[x], single[y], sizes[x], sizes[y], sizes[y] == rows[single[y][0]]) for (x, y), n in both.items() if n == sizes[x]]
    if composite:
        found += _composite(tables, single, sizes, rows, {(a, b) for a, b, *_ in found})
    listed = [(a[0], ",".join(a[1]), b[0], ",".join(b[1]), n, m, key) for a, b, n, m, key in found]
    return spark.createDataFrame(sorted(listed), schema)


def _composite(tables, single: list[Names], sizes: dict[int, int], rows: dict[str, int], known: set[tuple[Names, Names]]) -> list[tuple]:
    """Pairs of columns included in the composite keys of other tables."""
    inside: dict[Names, list[Names]] = {}
    for a, b in known:
        inside.setdefault(b, []).append(a)
    asked: list[tuple[Names, Names]] = []
    for t, df in tables.items():
        distinct = {c: sizes.get(i, 0) for i, (name, (c,)) in enumerate(single) if name == t}
        for key in keys_of(df, rows[t], distinct):
            if len(key) == 2:
                for a, b in itertools.product(inside.get((t, key[:1]), []), inside.get((t, key[1:]), [])):
                    if a[0] == b[0] != t and a != b:
                        asked.append(((a[0], a[1] + b[1]), (t, key)))
    if not asked:
        return []
    wanted = list(dict.fromkeys(n for pair in asked for n in pair))
    counts, both = _shared(_value_sets(tables, wanted))
    number = {n: i for i, n in enumerate(wanted)}
    out = []
    for a, b in asked:
        x, y = number[a], number[b]
        if counts.get(x) and both.get((x, y), 0) == counts[x]:
            out.append((a, b, counts[x], counts[y], True))
    return out


def foreign_keys(found: DataFrame) -> DataFrame:
    """The inclusions that lead to a key of another table."""
    return found.filter("ref_is_key AND table <> ref_table")
