"""Exact order statistics, quantiles and rank cut-offs without a global sort.

The first scan keeps a KLL sketch of every column and asks it for the values at
every thousandth of the rows: a grid.  Around a wanted rank two grid values
bound a narrow band that holds it, up to the sketch's error.  The second scan
sorts each value of a column into its interval (a gap, or a band) by a few
nested comparisons, one cell a column however many ranks are wanted; gaps are
counted, and bands are counted by value.  Running sums over these counts give
the value at the rank exactly.  If the sketch was wrong, the rank lies in a gap
with known counts and ends, and the search goes on there; a band of very many
rows is searched again in the same way, a thousandth of the rows a round.
Counts combine inside each task, so nothing large is shuffled, and every
answer is exact whatever the size or skew of the table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablelens.functions.semantics import as_time, col, order_number

# Rows of one group that may be sorted in one task.
BUFFER_ROWS = 1_000_000
KEY_BYTES = 6  # bytes of a text that one number holds exactly, also as a double
LONGEST_KEY = 600
# Distinct values of a band that one task may sort.
FINAL_ROWS = 200_000
# Points of a grid, size of a sketch, and its rank error as a share of the rows (99 % of sketches err less than 0.001).
GRID = 1000
SKETCH_SIZE = 4096
SKETCH_ERROR = 0.0015


def _aggregate(df: DataFrame, exprs: list[Column]) -> list:
    """Evaluate many aggregates in few scans (in slices, to keep generated code small)."""
    out: list = []
    for start in range(0, len(exprs), 100):
        part = exprs[start : start + 100]
        row = df.agg(*[e.alias(f"a{i}") for i, e in enumerate(part)]).first()
        out.extend(row)
    return out


def value_grid(c: Column, whole: bool = False, sketch: Column | None = None) -> Column:
    """Estimated values at every thousandth of the rows of a double (or ``whole``: long) column; null without values.

    ``sketch`` may be a stored sketch of the column; otherwise this is an aggregate.
    """
    build, ask = (F.kll_sketch_agg_bigint, F.kll_sketch_get_quantile_bigint) if whole else (F.kll_sketch_agg_double, F.kll_sketch_get_quantile_double)
    points = F.split(F.lit(",".join(str(i / GRID) for i in range(GRID + 1))), ",").cast("array<double>")
    if sketch is not None:
        return F.when(sketch.isNotNull(), ask(sketch, points))
    return F.when(F.count(c) > 0, ask(build(c, F.lit(SKETCH_SIZE)), points))


@dataclass
class _Place:
    """Inclusive bounds, both actual values, that hold the values at some ranks of one column."""

    slot: int
    low: object
    high: object
    rows: int
    grid: list | None = None
    forced: bool = False  # count by value, because a round did not shrink it
    ranks: dict[int, int] = field(default_factory=dict)  # wanted rank -> rank inside

    def band(self, rank: int) -> tuple:
        """Grid values around a rank, and about how many rows lie between them."""
        first = math.floor((rank / self.rows - SKETCH_ERROR) * GRID)
        last = math.ceil(((rank + 1) / self.rows + SKETCH_ERROR) * GRID)
        low = self.low if first <= 0 else self.grid[min(first, GRID)]
        high = self.high if last >= GRID else self.grid[max(last, 0)]
        low, high = sorted((max(low, self.low), min(high, self.high)))  # a grid is never trusted
        return low, high, self.rows * abs(last - first) / GRID


@dataclass(frozen=True)
class _Edge:
    """The end of an interval: values below ``at`` (or up to it, if ``closed``) lie in it or before."""

    at: object
    closed: bool

    def holds(self, c: Column) -> Column:
        return c <= F.lit(self.at) if self.closed else c < F.lit(self.at)


def _intervals(places: list[_Place], final_rows: int) -> tuple[list[_Edge], list[int | None]]:
    """Ends of the intervals of one column, and their codes: odd if counted by value, null outside of all places."""
    edges, codes, serial = [], [], 0

    def add(edge: _Edge, code: int | None) -> None:
        edges.append(edge)
        codes.append(code)

    for place in sorted(places, key=lambda p: p.low):
        add(_Edge(place.low, False), None)
        bands: list[list] = []
        for low, high, rows in sorted(place.band(r) for r in place.ranks.values()):
            if bands and low <= bands[-1][1]:
                bands[-1][1:] = max(high, bands[-1][1]), bands[-1][2] + rows
            else:
                bands.append([low, high, rows])
        for low, high, rows in bands:
            if low > place.low:
                add(_Edge(low, False), 2 * serial)
            add(_Edge(high, True), 2 * serial + 2 + int(place.forced or rows <= final_rows))
            serial += 2
        if bands[-1][1] < place.high:
            add(_Edge(place.high, True), 2 * serial)
            serial += 1
    return edges, [*codes, None]


def _code(c: Column, edges: list[_Edge], codes: list[int | None]) -> Column:
    """The code of the interval that holds a value: nested comparisons, log2 of the intervals deep."""
    if not edges:
        return F.lit(codes[0]).cast("int")
    middle = len(edges) // 2
    return F.when(edges[middle].holds(c), _code(c, edges[:middle], codes[: middle + 1])).otherwise(_code(c, edges[middle + 1 :], codes[middle + 1 :]))


def edges_reached(c: Column, edges: list[float]) -> Column:
    """How many of the ascending ``edges`` a value has reached."""
    return _code(c, [_Edge(float(e), False) for e in edges], list(range(len(edges) + 1)))


def _inlined(df: DataFrame, cells: list[Column], sizes: list[int], most: int = 48) -> DataFrame:
    """One row a cell.  A branch of the union has about ``most`` comparisons, which the JVM still compiles, and reads its own columns only."""
    parts: list[list[Column]] = []
    room = 0
    for cell, size in zip(cells, sizes):
        if size > room:
            parts.append([])
            room = most
        parts[-1].append(cell)
        room -= size
    return reduce(DataFrame.unionByName, [df.select(F.inline(F.array(*part))) for part in parts])


def _count(df: DataFrame, columns: list[Column], places: list[_Place], final_rows: int) -> list[_Place]:
    """One scan: settles what it can, and returns the narrower places of the other ranks."""
    by_slot: dict[int, list[_Place]] = {}
    for p in places:
        by_slot.setdefault(p.slot, []).append(p)
    spark, cells, sizes_of, asked = df.sparkSession, [], [], []
    for slot, mine in by_slot.items():
        c = columns[slot]
        edges, codes = _intervals(mine, final_rows)
        cells.append(F.struct(F.lit(slot).alias("slot"), _code(c, edges, codes).alias("code"), c.alias("v")))
        sizes_of.append(len(edges))
        before = 0
        for p in sorted(mine, key=lambda p: p.low):
            asked += [(slot, rank, before + inside) for rank, inside in p.ranks.items()]
            before += p.rows
    counts = (
        _inlined(df, cells, sizes_of)
        .filter("v IS NOT NULL AND code IS NOT NULL")
        .groupBy("slot", "code", F.when(F.col("code") % 2 == 1, F.col("v")).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    # a window partition holds the gaps of a column and at most FINAL_ROWS values a band
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("slot").orderBy("code", "value")))
    wanted = F.broadcast(spark.createDataFrame(asked, "slot int, rank long, at long"))
    found = upto.join(wanted, "slot").filter((F.col("at") >= F.col("upto") - F.col("n")) & (F.col("at") < F.col("upto"))).collect()  # one row a rank
    settled: list[_Place] = []
    narrower: dict[tuple, _Place] = {}
    sizes = {(p.slot, p.low, p.high): p.rows for p in places}
    for r in found:
        low, high = (r["low"], r["high"]) if r["value"] is None else (r["value"], r["value"])
        key = (r["slot"], low, high)
        if key not in narrower:
            # an interval that is all but its whole place would come back for ever: the next round counts its values
            narrower[key] = _Place(*key, r["n"], forced=2 * r["n"] > max(n for (s, _, _), n in sizes.items() if s == r["slot"]))
        narrower[key].ranks[r["rank"]] = r["at"] - (r["upto"] - r["n"])
    settled = [p for p in narrower.values() if p.low == p.high]
    return settled + [p for p in narrower.values() if p.low != p.high]


def _add_grids(df: DataFrame, columns: list[Column], places: list[_Place], whole: bool) -> None:
    """Sketch what lies inside each place, in one scan."""
    by_slot: dict[int, list[tuple[int, _Place]]] = {}
    for number, p in enumerate(places):
        by_slot.setdefault(p.slot, []).append((number, p))
    cells, sizes_of = [], []
    for slot, mine in by_slot.items():
        edges, codes = [], []
        for number, p in sorted(mine, key=lambda x: x[1].low):
            edges += [_Edge(p.low, False), _Edge(p.high, True)]
            codes += [None, number]
        cells.append(F.struct(_code(columns[slot], edges, [*codes, None]).alias("number"), columns[slot].alias("v")))
        sizes_of.append(len(edges))
    inside = _inlined(df, cells, sizes_of).filter("v IS NOT NULL AND number IS NOT NULL")
    for r in inside.groupBy("number").agg(value_grid(F.col("v"), whole).alias("grid")).collect():
        places[r["number"]].grid = r["grid"]


def order_stats(
    df: DataFrame, wanted: list[tuple[Column, list[int]]], rows: list[int], final_rows: int = FINAL_ROWS, known: list[tuple] | None = None
) -> list[list]:
    """Exact values at 0-based ranks among the non-null values of columns of one type, double or long.

    ``rows`` counts those values per column; ``known`` holds (min, max, grid) per column from an earlier scan.
    """
    names = [f"__o{i}" for i in range(len(wanted))]
    df = df.select(*[c.alias(n) for (c, _), n in zip(wanted, names)])
    columns = [F.col(n) for n in names]
    whole = isinstance(df.schema.fields[0].dataType, T.IntegralType) if names else False
    if known is None:
        seen = _aggregate(df, [e for c in columns for e in (F.min(c), F.max(c), value_grid(c, whole))])
        known = list(zip(seen[::3], seen[1::3], seen[2::3]))
    places = [_Place(i, *known[i][:2], rows[i], known[i][2], ranks={r: r for r in set(ranks)}) for i, (_, ranks) in enumerate(wanted) if ranks]
    values: dict[tuple[int, int], object] = {}
    while True:
        for p in places:
            if p.low == p.high:
                values |= {(p.slot, r): p.low for r in p.ranks}
        places = [p for p in places if p.low != p.high]
        if not places:
            return [[values[i, r] for r in ranks] for i, (_, ranks) in enumerate(wanted)]
        if any(p.grid is None for p in places):
            _add_grids(df, columns, places, whole)
        places = _count(df, columns, places, final_rows)


def exact_quantiles(
    df: DataFrame,
    probs: dict[str, list[float]],
    rows: int | None = None,
    final_rows: int = FINAL_ROWS,
    where: dict[str, Column] | None = None,
    known: dict[str, tuple] | None = None,
) -> dict[str, list]:
    """Linear-interpolated quantiles per column; null for a column without values.

    Two scans for any number of columns and probabilities, or one if ``known`` holds
    (values, min, max, grid) of every column from an earlier scan.  ``where`` maps a
    name to the expression to measure when it is not simply that column.  NaN
    counts as missing.
    """
    if not probs:
        return {}
    exprs = {n: F.nullif((where[n] if where and n in where else col(n)).cast("double"), F.lit(math.nan)) for n in probs}
    names = list(probs)
    if known is None or any(n not in known or known[n][2] != known[n][2] for n in names):  # NaN was counted
        measured = _aggregate(df, [e for n in names for e in (F.count(exprs[n]), F.min(exprs[n]), F.max(exprs[n]), value_grid(exprs[n]))])
        known = {n: tuple(measured[4 * i : 4 * i + 4]) for i, n in enumerate(names)}
    keep = [n for n in names if known[n][0]]
    places = {n: [p * (known[n][0] - 1) for p in probs[n]] for n in keep}
    wanted = [(exprs[n], [r for at in places[n] for r in (math.floor(at), math.ceil(at))]) for n in keep]
    found = order_stats(df, wanted, [known[n][0] for n in keep], final_rows, [known[n][1:] for n in keep]) if keep else []
    result: dict[str, list] = {n: [None] * len(probs[n]) for n in names}
    for n, pairs in zip(keep, found):
        result[n] = []
        for i, at in enumerate(places[n]):
            share, lo, hi = at - math.floor(at), pairs[2 * i], pairs[2 * i + 1]
            result[n].append(lo if share == 0 else lo + (hi - lo) * share)
    return result


def order_cutoffs(
    df: DataFrame,
    order_by: list[str],
    ranks: list[int],
    rows: int | None = None,
    buffer_rows: int = BUFFER_ROWS,
    final_rows: int = FINAL_ROWS,
) -> list[tuple]:
    """The sort-key tuples standing at the given 0-based ranks of a total order.

    Works key by key: an exact order statistic of the first key, then of the
    next key among its ties, and so on.  ``order_by`` must be unique as a whole
    for the ranks to be exact.  Nulls sort first.
    """
    keys = [_sort_key(df, k) for k in order_by]
    if rows is None:
        rows = df.count()

    def settle(value, name: str):
        return value if _fractional(df, name) else int(value)

    first = [settle(v, order_by[0]) for v in order_stats(df, [(keys[0], ranks)], [rows], final_rows)[0]]
    if len(keys) == 1:
        return [(v,) for v in first]
    counts = _aggregate(
        df, [e for v in first for e in (F.count_if(keys[0] < F.lit(v)), F.count_if(keys[0] == F.lit(v)))]
    )
    found: dict[int, tuple] = {}
    small: list[tuple[int, object, int]] = []
    for i, (rank, value) in enumerate(zip(ranks, first)):
        below, ties = counts[2 * i], counts[2 * i + 1]
        if ties <= buffer_rows:
            small.append((i, value, rank - below))
        else:  # a hot key: search on inside its rows by the remaining keys
            rest = order_cutoffs(
                df.filter(keys[0] == F.lit(value)), order_by[1:], [rank - below], ties, buffer_rows, final_rows
            )
            found[i] = (value, *rest[0])
    if small:
        names = [f"__k{j}" for j in range(len(keys))]
        tied = df.select(*[k.alias(n) for k, n in zip(keys, names)]).filter(
            F.col(names[0]).isin([v for _, v, _ in small])
        )
        # At most buffer_rows rows per window partition, as counted above.
        spot = F.row_number().over(Window.partitionBy(names[0]).orderBy(*names[1:])) - 1
        want = F.lit(False)
        for _, value, left in small:
            want = want | ((F.col(names[0]) == F.lit(value)) & (F.col("__at") == F.lit(left)))
        hits = {
            (r[0], r["__at"]): tuple(r[: len(keys)])
            for r in tied.withColumn("__at", spot).filter(want).collect()
        }
        for i, value, left in small:
            found[i] = hits[(value, left)]
    return [found[i] for i in range(len(ranks))]


def text_keys(df: DataFrame, order_by: list[str]) -> list:
    """``order_by`` with every text column that is not a date replaced by numbers that sort like it.

    Such a column becomes the keys (name, 0), (name, 1) ...: its bytes, six at a time.
    """
    names = [n for n in order_by if isinstance(df.schema[n].dataType, T.StringType)]
    if not names:
        return list(order_by)
    exprs = [e for n in names for e in (F.count(col(n)), F.count(as_time(df, n)), F.coalesce(F.max(F.octet_length(col(n))), F.lit(0)))]
    seen = _aggregate(df, exprs)
    keys: list = []
    for n in order_by:
        if n not in names:
            keys.append(n)
            continue
        filled, dates, longest = seen[3 * names.index(n) : 3 * names.index(n) + 3]
        if longest > LONGEST_KEY:
            raise ValueError(f"cannot order by {n}: a text of {longest} bytes is no key")
        keys += [n] if filled == dates else [(n, i) for i in range(max(1, math.ceil(longest / KEY_BYTES)))]
    return keys


def _fractional(df: DataFrame, name: str | tuple) -> bool:
    return isinstance(name, str) and isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType, T.DecimalType))


def _sort_key(df: DataFrame, name: str | tuple) -> Column:
    """The column (or a part of a text) as a number that sorts like it, nulls first."""
    if isinstance(name, tuple):
        part = F.hex(F.substring(col(name[0]).cast("binary"), KEY_BYTES * name[1] + 1, KEY_BYTES))
        number = F.conv(F.rpad(part, 2 * KEY_BYTES, "0"), 16, 10).cast("long")
        return F.coalesce(number, F.lit(-(1 << 63)).cast("long"))
    if _fractional(df, name):
        return F.coalesce(order_number(df, name).cast("double"), F.lit(-1.7976931348623157e308))
    return F.coalesce(order_number(df, name).cast("long"), F.lit(-(1 << 63)).cast("long"))


def at_or_after(df: DataFrame, order_by: list[str], cutoff: tuple) -> Column:
    """True for rows that sort at or after ``cutoff``, as a plain predicate."""
    test: Column | None = None
    for name, value in reversed(list(zip(order_by, cutoff))):
        key = _sort_key(df, name)
        if test is None:
            test = key >= F.lit(value)
        else:
            test = (key > F.lit(value)) | ((key == F.lit(value)) & test)
    return test


def bucket_number(df: DataFrame, order_by: list[str], cutoffs: list[tuple]) -> Column:
    """How many cut-offs a row has reached: 0 .. len(cutoffs)."""
    number = F.lit(0)
    for cutoff in cutoffs:
        number = number + at_or_after(df, order_by, cutoff).cast("int")
    return number
