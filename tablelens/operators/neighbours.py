"""Mutual information by nearest neighbours, exact at any size.

The estimate for mixtures of discrete and continuous values: for every row, the
distance r to its k-th nearest other row in the larger of both scaled
differences; then the rows closer than r in either column alone are counted
(rows at distance 0 if r is 0).  The score is the mean of
psi(k) + ln N - psi(n_x) - psi(n_y), where rows count themselves, and k is the
number of equal rows where r is 0.  Scales are sample standard deviations.

Equal pairs collapse to one point with a weight first.  Neighbours: points are
dealt to the cells of a rank grid, strips of one column cut by the strip's own
quantiles of the other, so that every cell holds about as many points however
the columns depend on each other; a hot value is cut in the other direction.
Each cell is searched alone; points whose square reaches beyond their cell go to
the border cells that it meets, as a halo, and the nearest of all cells are
kept.  Counts: the ends of all rows' intervals and the values themselves are
sorted by ranges and summed up along the partitions; a row's count is the
difference of two sums.  The grid's edges only decide how evenly work is dealt,
never the result; the cells are a bounded table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablelens.functions.semantics import col
from tablelens.operators.ranks import GRID, value_grid
from tablelens.session import scratch_path

NEIGHBOURS = 3
CELL_POINTS = 8192
MOST_CELLS = 20_000
LEAF = 64


def digamma(n: np.ndarray) -> np.ndarray:
    """psi of positive whole numbers, by the recurrence up to 12 and the asymptotic series from there."""
    n = np.asarray(n, float)
    out, x = np.zeros_like(n), n.copy()
    for _ in range(12):
        low = x < 12
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


# ---- inside one cell ----


def _leaves(x: np.ndarray, y: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """Halve the points along the wider side until at most ``most`` are together."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        at = stack.pop()
        if len(at) <= most:
            out.append(at)
            continue
        side = x[at] if np.ptp(x[at]) >= np.ptp(y[at]) else y[at]
        middle = len(at) // 2
        order = np.argpartition(side, middle)
        stack += [at[order[:middle]], at[order[middle:]]]
    return out


class _Cell:
    """Points of a cell, in leaves with their bounds, in scaled units."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, scale: tuple[float, float]):
        self.x, self.y, self.weights, self.scale = x, y, weights, scale
        self.leaves = _leaves(x / scale[0], y / scale[1])
        self.bounds = np.array([[x[a].min(), x[a].max(), y[a].min(), y[a].max()] for a in self.leaves])

    def distance(self, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(self.x[at][None] - x[:, None]) / self.scale[0], np.abs(self.y[at][None] - y[:, None]) / self.scale[1])

    def nearest(self, x: np.ndarray, y: np.ndarray, own: np.ndarray, k: int, best: np.ndarray, weight: np.ndarray) -> None:
        """Merge the k nearest points of this cell into ``best`` and ``weight`` (one row a query, ascending).

        ``own`` is a query's own place in the cell, or -1; its own point is skipped.
        """
        home = np.full(len(self.x), -1)
        for number, at in enumerate(self.leaves):
            home[at] = number
        first = np.where(own >= 0, home[own], -1)
        for number, at in enumerate(self.leaves):  # the own leaf gives a first bound
            mine = np.flatnonzero(first == number)
            if len(mine):
                self._merge(mine, at, x, y, own, k, best, weight)
        for number, at in enumerate(self.leaves):
            low_x, high_x, low_y, high_y = self.bounds[number]
            gap_x = np.maximum(np.maximum(low_x - x, x - high_x), 0) / self.scale[0]
            gap_y = np.maximum(np.maximum(low_y - y, y - high_y), 0) / self.scale[1]
            mine = np.flatnonzero((np.maximum(gap_x, gap_y) <= _reach(best, weight, k)) & (first != number))
            if len(mine):
                self._merge(mine, at, x, y, own, k, best, weight)

    def _merge(self, mine, at, x, y, own, k, best, weight) -> None:
        for start in range(0, len(mine), 4096):
            part = mine[start : start + 4096]
            far = self.distance(x[part], y[part], at)
            far[own[part][:, None] == at[None]] = np.inf
            both = np.concatenate([best[part], far], 1)
            heavy = np.concatenate([weight[part], np.broadcast_to(self.weights[at], far.shape)], 1)
            order = np.argpartition(both, k - 1, axis=1)[:, :k]
            near, kept = np.take_along_axis(both, order, 1), np.take_along_axis(heavy, order, 1)
            order = np.argsort(near, axis=1, kind="stable")
            best[part], weight[part] = np.take_along_axis(near, order, 1), np.take_along_axis(kept, order, 1)


def _reach(best: np.ndarray, weight: np.ndarray, need: int | np.ndarray) -> np.ndarray:
    """Distance at which the weights of the nearest points reach ``need``; infinite if they do not."""
    total = np.cumsum(np.where(np.isfinite(best), weight, 0), 1)
    enough = total >= np.reshape(need, (-1, 1)) if np.ndim(need) else total >= need
    at = enough.argmax(1)
    return np.where(enough.any(1), best[np.arange(len(best)), at], np.inf)


# ---- the rank grid ----


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _edges(grid: list | None, parts: int) -> list[float]:
    """Distinct inner edges of about ``parts`` equal shares, from a grid of quantiles."""
    if not grid or parts < 2:
        return []
    return sorted({float(grid[min(GRID, round(i * GRID / parts))]) for i in range(1, parts)})


def _cells(points: DataFrame, sizes: dict[int, int], cell_points: int, most_cells: int) -> dict[int, tuple]:
    """Per pair: strip edges, and the inner edges of every strip in the other direction."""
    grids = {r["pair"]: r["grid"] for r in points.groupBy("pair").agg(value_grid(F.col("x")).alias("grid")).collect()}
    each = {p: max(cell_points, -(-n // most_cells)) for p, n in sizes.items()}
    strips = {p: _edges(grids[p], min(GRID, math.ceil(math.sqrt(n / each[p])))) for p, n in sizes.items()}
    strip = _strip_column(strips)
    found = points.groupBy("pair", strip.alias("strip")).agg(F.count("*").alias("n"), value_grid(F.col("y")).alias("grid")).collect()  # at most MOST_CELLS strips
    out = {p: (np.array(strips[p]), [np.zeros(0)] * (len(strips[p]) + 1)) for p in sizes}
    for r in found:
        out[r["pair"]][1][r["strip"]] = np.array(_edges(r["grid"], min(GRID, math.ceil(r["n"] / each[r["pair"]]))))
    return out


def _strip_column(strips: dict[int, list[float]]):
    """Number of a point's strip: how many of its pair's edges it has reached."""
    edges = F.create_map(*[c for p, e in strips.items() for c in (F.lit(p), F.array(*[F.lit(v) for v in e]).cast("array<double>"))])
    return F.size(F.filter(F.element_at(edges, F.col("pair")), lambda e: e <= F.col("x")))


def _place(grid: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """strip * 2^20 + part of every point."""
    edges, inner = grid
    strip = np.searchsorted(edges, x, side="right")
    part = np.zeros(len(x), np.int64)
    for s in np.unique(strip):
        mine = strip == s
        part[mine] = np.searchsorted(inner[s], y[mine], side="right")
    return strip.astype(np.int64) << 20 | part


def _met(grid: tuple, cell: int, x: float, y: float, reach: float, scale: tuple[float, float]) -> list[int]:
    """The other cells that a square around a point meets (a little more at the edges does no harm)."""
    edges, inner = grid
    if not math.isfinite(reach):
        return [s << 20 | p for s in range(len(inner)) for p in range(len(inner[s]) + 1) if s << 20 | p != cell]
    wide, high = reach * scale[0] * (1 + 1e-9), reach * scale[1] * (1 + 1e-9)
    out = []
    first, last = np.searchsorted(edges, x - wide, side="left"), np.searchsorted(edges, x + wide, side="right")
    for s in range(int(first), int(last) + 1):
        low, up = np.searchsorted(inner[s], y - high, side="left"), np.searchsorted(inner[s], y + high, side="right")
        out += [s << 20 | p for p in range(int(low), int(up) + 1) if s << 20 | p != cell]
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows with equal keys, one group after the other, from a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            key = tuple(c[a] for c in columns)
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


_NEAR = "pair int, id long, far array<double>, heavy array<long>"


def _distances(points: DataFrame, grids: dict[int, tuple], scales: dict[int, tuple[float, float]], k: int) -> DataFrame:
    """(pair, id, r): the distance to the k-th nearest other row of every point."""
    spark = points.sparkSession
    held = spark.sparkContext.broadcast((grids, scales))  # bounded: at most MOST_CELLS edges a pair

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = held.value[0]
        for batch in batches:
            pair, _, x, y, _ = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cell = np.zeros(len(pair), np.int64)
            for p in np.unique(pair):
                mine = pair == p
                cell[mine] = _place(grids[p], x[mine], y[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = _stored(points.select("pair", "id", "x", "y", "w").mapInArrow(place, "pair int, id long, x double, y double, w long, cell long"), "placed")

    def listed(columns: list[np.ndarray], far: np.ndarray, heavy: np.ndarray) -> list[pa.Array]:
        offsets = pa.array(np.arange(len(far) + 1) * k, pa.int32())
        return [*map(pa.array, columns), pa.ListArray.from_arrays(offsets, pa.array(far.ravel())), pa.ListArray.from_arrays(offsets, pa.array(heavy.ravel()))]

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ("pair", "cell")):
            pair, ids, x, y, w, cells = (c.to_numpy() for c in table.columns)
            best, weight = np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int64)
            scale = held.value[1][pair[0]]
            _Cell(x, y, w, scale).nearest(x, y, np.arange(len(x)), k, best, weight)
            yield pa.RecordBatch.from_arrays(listed([pair, ids, x, y, w, cells], best, weight), names=["pair", "id", "x", "y", "w", "cell", "far", "heavy"])

    by_cell = lambda df: df.repartition("pair", "cell").sortWithinPartitions("pair", "cell")
    schema = "pair int, id long, x double, y double, w long, cell long, far array<double>, heavy array<long>"
    near = _stored(by_cell(placed).mapInArrow(inside, schema), "near")

    def halo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids, scales = held.value
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                need = k - (r["w"] - 1)
                if need <= 0:
                    continue  # enough equal rows: nothing is nearer
                far, heavy = np.array([r["far"]]), np.array([r["heavy"]])
                reach = float(_reach(far, heavy, need)[0])
                out += [(r["pair"], r["id"], r["x"], r["y"], c, reach) for c in _met(grids[r["pair"]], r["cell"], r["x"], r["y"], reach, scales[r["pair"]])]
            if out:
                kinds = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["pair", "id", "x", "y", "cell", "reach"])

    asked = near.mapInArrow(halo, "pair int, id long, x double, y double, cell long, reach double")
    none = F.lit(None).cast("double").alias("reach")
    both = placed.select("pair", "id", "x", "y", "w", "cell", none).unionByName(asked.withColumn("w", F.lit(0).cast("long")))

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ("pair", "cell")):
            point = table.filter(pc.greater(table["w"], 0))
            query = table.filter(pc.equal(table["w"], 0))
            if not query.num_rows or not point.num_rows:
                continue
            pair, ids, x, y = (query[n].to_numpy() for n in ("pair", "id", "x", "y"))
            best, weight = np.full((len(x), k), np.inf), np.zeros((len(x), k), np.int64)
            best[:, k - 1], weight[:, k - 1] = np.nextafter(query["reach"].to_numpy(), np.inf), k  # nothing beyond the reach is wanted
            _Cell(point["x"].to_numpy(), point["y"].to_numpy(), point["w"].to_numpy(), held.value[1][pair[0]]).nearest(x, y, np.full(len(x), -1), k, best, weight)
            weight[best > query["reach"].to_numpy()[:, None]] = 0
            yield pa.RecordBatch.from_arrays(listed([pair, ids], best, weight), names=["pair", "id", "far", "heavy"])

    more = by_cell(both).mapInArrow(border, _NEAR)
    every = near.select("pair", "id", "far", "heavy").unionByName(more).groupBy("pair", "id")
    lists = every.agg(F.flatten(F.collect_list(F.arrays_zip("far", "heavy"))).alias("all"))  # k a cell that the square meets

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                need = k - (r["w"] - 1)
                distance = 0.0
                if need > 0:
                    distance = math.inf
                    for n in sorted(r["all"], key=lambda n: n["far"]):
                        need -= n["heavy"]
                        if need <= 0:
                            distance = n["far"]
                            break
                found.append(distance)
            names = ("pair", "id", "x", "y", "w")
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(found)], names=[*names, "r"])

    whole = near.select("pair", "id", "x", "y", "w").join(lists, ["pair", "id"])
    return whole.mapInArrow(reach, "pair int, id long, x double, y double, w long, r double")


# ---- counts along one column ----


def _whole(v: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order (and back, by the same rule)."""
    bits = np.ascontiguousarray(v, float).view(np.int64)
    return np.where(bits < 0, np.int64(-(1 << 63)) - bits, bits)


def _double(i: np.ndarray) -> np.ndarray:
    return np.where(i < 0, np.int64(-(1 << 63)) - i, i).view(float)


def _last(value: np.ndarray, r: np.ndarray, scale: float, sign: int) -> np.ndarray:
    """The outermost double on one side that is closer than r to each value (equal to it, where r is 0).

    The very comparison that a search over all pairs makes, found by halving: no rounding can differ.
    """

    def closer(t: np.ndarray) -> np.ndarray:
        far = np.abs(t - value) / scale
        return np.where(r > 0, far < r, far == 0)

    with np.errstate(over="ignore"):
        near, beyond = _whole(value), _whole(value + sign * np.where(r > 0, 2 * r, 1) * scale)
    for _ in range(65):  # near is closer, beyond is not
        middle = (near >> 1) + (beyond >> 1) + (near & beyond & 1)
        inside = closer(_double(middle))
        near, beyond = np.where(inside, middle, near), np.where(inside, beyond, middle)
    return _double(near)


def _counted(points: DataFrame, scales: dict[int, tuple[float, float]]) -> DataFrame:
    """(pair, id, n_x, n_y): rows within the distance along each column, the row itself included."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, ids, x, y, _, r = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for p in np.unique(pair):
                mine = pair == p
                for side, value in enumerate((x[mine], y[mine])):
                    low, high = (_last(value, r[mine], scales[p][side], s) for s in (-1, 1))
                    n = int(mine.sum())
                    made = [pair[mine], ids[mine], np.full(n, side, np.int32)]
                    # count(values <= high) - count(values < low)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, made), pa.array(low), pa.array(np.full(n, -1, np.int32))], names=["pair", "id", "side", "v", "sign"])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, made), pa.array(high), pa.array(np.full(n, 1, np.int32))], names=["pair", "id", "side", "v", "sign"])

    asked = points.select("pair", "id", "x", "y", "w", "r").mapInArrow(ends, "pair int, id long, side int, v double, sign int").withColumn("n", F.lit(0).cast("long"))
    values = reduce(
        DataFrame.unionByName,
        [points.groupBy("pair", F.col(c).alias("v")).agg(F.sum("w").alias("n")).withColumns({"side": F.lit(s), "sign": F.lit(0), "id": F.lit(-1).cast("long")}) for s, c in enumerate(("x", "y"))],
    )
    rows = _stored(asked.unionByName(values), "ends")
    order = ["pair", "side", "v", "sign", "id"]  # at one value: lower ends, the value, upper ends
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("n")).to_numpy(zero_copy_only=False)
            upto = total + np.cumsum(n)
            total = int(upto[-1]) if len(upto) else total
            names = ["pair", "id", "side", "sign", "n"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(upto)], names=[*names, "upto"])

    summed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(sums, "pair int, id long, side int, sign int, n long, upto long")
    summed = _stored(summed.withColumn("part", F.spark_partition_id()), "sums")
    before, total = {}, 0
    for r in summed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one line a partition
        before[r["part"]] = total
        total += r["n"]
    at = F.element_at(F.create_map(*[F.lit(v).cast("long") for p, b in before.items() for v in (p, b)]), F.col("part").cast("long"))
    by_side = summed.filter("sign <> 0").groupBy("pair", "id")
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("sign") * (F.col("upto") + at)))
    return by_side.agg(side(0).alias("n_x"), side(1).alias("n_y"))


# ---- scores ----


def neighbour_information(
    df: DataFrame, target: str, columns: list[str], numeric: list[str], k: int = NEIGHBOURS, cell_points: int = CELL_POINTS, most_cells: int = MOST_CELLS
) -> DataFrame:
    """(target, column, mi_score): the nearest-neighbour estimate in nats, at least 0.

    Missing numbers are 0 (NaN too), as are infinite ones; other columns are numbered in the order of their text,
    missing first.  A column that does not vary scores 0, as does a table of at most ``k`` rows.
    """
    spark = df.sparkSession
    schema = "target string, column string, mi_score double"
    if not columns:
        return spark.createDataFrame([], schema)

    def number(name: str):
        v = col(name).cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == math.inf), 0.0).otherwise(v)

    pairs = []
    for i, c in enumerate(columns):
        if c in numeric:
            pairs.append(df.select(F.lit(i).alias("pair"), number(c).alias("x"), number(target).alias("y")).groupBy("pair", "x", "y").agg(F.count("*").alias("w")))
            continue
        counted = _stored(df.groupBy(col(c).cast("string").alias("c"), number(target).alias("y")).agg(F.count("*").alias("w")), "categories")
        codes = _coded(counted.select("c").distinct())
        pairs.append(counted.join(codes, counted["c"].eqNullSafe(codes["text"])).select(F.lit(i).alias("pair"), F.col("code").alias("x"), "y", "w"))
    points = reduce(DataFrame.unionByName, pairs).select("pair", F.monotonically_increasing_id().alias("id"), "x", "y", "w")
    points = _stored(points, "points")
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    means = {r["pair"]: r for r in points.groupBy("pair").agg(F.count("*").alias("n"), F.sum("w").alias("rows"), mean("x").alias("x"), mean("y").alias("y")).collect()}
    if not means:
        return spark.createDataFrame([(target, c, 0.0) for c in columns], schema)
    middle = lambda c: F.element_at(F.create_map(*[F.lit(v) for p, r in means.items() for v in (p, float(r[c]))]), F.col("pair"))
    spread = lambda c: F.sqrt(F.sum(F.col("w") * F.pow(F.col(c) - middle(c), 2)) / (F.sum("w") - 1)).alias(c)
    rows = next(iter(means.values()))["rows"]
    scales = {r["pair"]: (r["x"], r["y"]) for r in points.groupBy("pair").agg(spread("x"), spread("y")).collect()} if rows > 1 else {}
    scales = {p: s for p, s in scales.items() if rows > k and s[0] and s[1] and s[0] > 0 and s[1] > 0}
    scores = {}
    if scales:
        live = points.filter(F.col("pair").isin(list(scales)))
        grids = _cells(live, {p: means[p]["n"] for p in scales}, cell_points, most_cells)
        reached = _stored(_distances(live, grids, scales, k), "reached")
        counts = _counted(reached, scales)

        def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pair, w, r, n_x, n_y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                near = digamma(np.where(r > 0, k, w))
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(w * (near - digamma(n_x) - digamma(n_y)))], names=["pair", "term"])

        met = reached.join(counts, ["pair", "id"]).select("pair", "w", "r", "n_x", "n_y").mapInArrow(terms, "pair int, term double")
        scores = {r["pair"]: r["term"] / rows + math.log(rows) for r in met.groupBy("pair").agg(F.sum("term").alias("term")).collect()}
    found = [(target, c, round(max(0.0, scores.get(i, 0.0)), 12)) for i, c in enumerate(columns)]
    return spark.createDataFrame(sorted(found, key=lambda t: (-t[2], t[1])), schema)


def _coded(names: DataFrame) -> DataFrame:
    """(text, code): texts numbered in order, nulls first, without a single sort."""
    from tablelens.operators.rowindex import with_row_index

    return with_row_index(names.select(F.col("c").alias("text")), ["text"], "code").withColumn("code", F.col("code").cast("double"))
