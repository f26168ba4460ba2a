"""Hard negatives by exact search in an inverted multi-index.

A vector's components become floor(256 x) as whole numbers; a score is their
inner product.  An anchor's positives are its best ``positives`` other rows of
the same label; a negative of an anchor and a positive of score p is a row of
another label whose score lies in the window [low p, high p], the best
``negatives`` of which are returned.  Higher scores come first, then smaller ids.

Index: one codebook for each half of the space, fitted on a bounded sample
(``SAMPLE`` rows expected; any codebook gives the same results).  Every row goes
to the cell of its two nearest codes; a cell is stored in blocks of about
``BLOCK`` rows, so a cell of many copies is many blocks.  A code's radius is the
largest distance of any of its rows' halves.  For an anchor the inner product
with a code, plus the half length of the anchor times the radius, bounds all scores
in the code; a heap over the two sorted lists of half bounds (multi-sequence)
yields the cells by falling sums.  A search stops when it is certified: the next
cell's bound lies below the last wanted score, or below the window.

Searches run in rounds.  In a round every open anchor takes its next cells, for
eight times as many rows as in the round before; anchors meet the blocks of
their cells in a shuffle, packs of ``PACK`` anchors against one block at a time;
only rows at or above an anchor's present cut leave a task.  A round is written to the
shared folder.  No join broadcasts a side: the files of visits repeat each vector once a
block, which they store as a dictionary, so their size on disk says little of their rows.  The number of rounds grows with the logarithm of the rows.

Rows with a null id, label or vector, or a null or non-finite component, take no
part.  Shorter vectors are filled up with zeros; components beyond 32 bits are
held at the ends of that range, scores at those of 64 bits.  Repeated rows are
rows of their own (another row with an anchor's id is one of its other rows);
ties go to the smaller id.  Anchors without positives or negatives give no rows,
nor does an empty table.  Columns other than the three named never matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.llm.common import stored

CODES = 16
SAMPLE = 20_000
BLOCK = 2048
PACK = 512
FIRST_ROWS = 2048
GROWTH = 8
EDGE = (1 << 31) - 1


# ---- arithmetic ----


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = np.sqrt((a.astype(float) ** 2).sum(1).max() * (b.astype(float) ** 2).sum(1).max()) * 1.001
    if most < 1 << 24:  # no partial sum leaves the whole numbers that the type holds
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(found: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties by the smaller id (the best k, in no order)."""
    if len(found) <= k:
        return np.arange(len(found))
    cut = np.partition(found, len(found) - k)[len(found) - k]
    at = np.flatnonzero(found >= cut)
    return at[np.lexsort((ids[at], -found[at]))[:k]]


def codebook(sample: np.ndarray, codes: int, steps: int = 8) -> np.ndarray:
    """Centres by Lloyd's steps from evenly spread distinct rows."""
    rows = np.unique(sample, axis=0).astype(float)
    centres = rows[np.linspace(0, len(rows) - 1, min(codes, len(rows))).astype(int)]
    for _ in range(steps):
        near = nearest(rows, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        sizes = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(sizes > 0, sums / np.maximum(sizes, 1), centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the distance to it."""
    rows = rows.astype(float)
    near = ((centres**2).sum(1)[None] - 2 * rows @ centres.T).argmin(1)
    return near, np.sqrt(((rows - centres[near]) ** 2).sum(1))


# ---- the index ----


@dataclass(frozen=True)
class Index:
    size: int  # components of a vector
    centres: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    cells: dict[int, tuple[int, int]]  # cell -> rows, blocks (at most codes x codes)
    points: DataFrame  # row, id, label, vec, cell
    blocks: DataFrame  # cell, part, rows, ids, labels, vecs

    @property
    def split(self) -> int:
        return (self.size + 1) // 2


def quantised(rows: DataFrame, vector: str = "vector") -> tuple[DataFrame, int]:
    """Append ``vec`` (32-bit whole numbers as bytes, all of one size); the size."""
    size = rows.agg(F.max(F.size(vector))).first()[0] or 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vector))
            lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            values = np.clip(np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(float)), -EDGE, EDGE).astype("<i4")
            full = np.zeros((batch.num_rows, size), "<i4")
            at = np.repeat(np.arange(batch.num_rows), lengths)
            full[at, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
            kept = [batch.column(batch.schema.get_field_index(n)) for n in ("row", "id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([v.tobytes() for v in full], pa.binary())], names=["row", "id", "label", "vec"])

    return rows.select("row", "id", "label", vector).mapInArrow(work, "row long, id long, label long, vec binary"), size


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), size)


def build(rows: DataFrame, codes: int = CODES) -> Index | None:
    """Index of ``rows`` (row, id, label, vector); None if there are none."""
    whole, size = quantised(rows)
    whole = stored(whole, "vectors")
    n = whole.count()
    if not n:
        return None
    some = whole.sample(min(1.0, SAMPLE / n), seed=7).select("vec") if n > SAMPLE else whole.select("vec")
    picked = [r["vec"] for r in some.toLocalIterator()]  # SAMPLE rows expected
    sample = np.frombuffer(b"".join(picked), "<i4").reshape(len(picked), size)
    half = (size + 1) // 2
    centres = (codebook(sample[:, :half], codes), codebook(sample[:, half:], codes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(3), size)
                (i, r), (j, s) = nearest(x[:, :half], centres[0]), nearest(x[:, half:], centres[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(i * codes + j), pa.array(r), pa.array(s)], names=[*batch.schema.names, "cell", "r", "s"])

    points = stored(whole.mapInArrow(place, "row long, id long, label long, vec binary, cell long, r double, s double"), "points")
    radii = (np.full(len(centres[0]), -np.inf), np.full(len(centres[1]), -np.inf))
    cells = {}
    for c in points.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max("s").alias("s")).collect():  # codes x codes at most
        i, j = divmod(c["cell"], codes)
        radii[0][i], radii[1][j] = max(radii[0][i], c["r"]), max(radii[1][j], c["s"])
        cells[c["cell"]] = (c["n"], -(-c["n"] // BLOCK))
    parts = F.element_at(F.create_map(*[F.lit(x).cast("long") for c, (_, p) in cells.items() for x in (c, p)]), F.col("cell"))
    dealt = points.select("cell", F.pmod(F.xxhash64("row"), parts).alias("part"), "row", "id", "label", "vec")
    numbers = lambda v: pa.array([v.to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary())

    def pack(table: pa.Table) -> pa.Table:
        cell, part, row, ids, labels, vecs = [c.combine_chunks() for c in table.columns]
        return pa.table([cell[:1], part[:1], numbers(row), numbers(ids), numbers(labels), pa.array([b"".join(vecs.to_pylist())], pa.binary())], names=["cell", "part", "rows", "ids", "labels", "vecs"])

    blocks = dealt.groupBy("cell", "part").applyInArrow(pack, "cell long, part long, rows binary, ids binary, labels binary, vecs binary")
    return Index(size, centres, radii, cells, points, stored(blocks, "blocks"))


# ---- the order of cells ----


def cells_by_bound(vector: np.ndarray, index_size: int, centres, radii, codes: int) -> Iterator[tuple[float, int]]:
    """(bound, cell) by falling bounds: the multi-sequence walk over both lists of half bounds."""
    half = (index_size + 1) // 2
    bounds, orders = [], []
    for part, c, r in ((vector[:half], centres[0], radii[0]), (vector[half:], centres[1], radii[1])):
        part = part.astype(float)
        length = np.sqrt(part @ part)
        with np.errstate(invalid="ignore"):
            bound = c @ part + length * r
        # rounding stays below a thousand-millionth of the lengths
        bound = np.where(np.isfinite(r), bound + 1e-9 * length * (np.sqrt((c**2).sum(1)) + np.where(np.isfinite(r), r, 0)) + 1e-6, -np.inf)
        order = np.argsort(-bound, kind="stable")
        order = order[np.isfinite(bound[order])]  # codes without rows
        bounds.append(bound[order])
        orders.append(order)
    first, second = bounds
    heap, seen = [(-(first[0] + second[0]), 0, 0)], {(0, 0)}
    while heap:
        minus, i, j = heapq.heappop(heap)
        yield -minus, int(orders[0][i]) * codes + int(orders[1][j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(first) and y < len(second) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(first[x] + second[y]), x, y))


# ---- rounds ----

_ANCHOR = "a long, label long, vec binary, low array<long>, high array<long>, cut array<long>"


def _visits(live: DataFrame, index: Index, codes: int, rows: int) -> DataFrame:
    """The next cells of every open anchor, for about ``rows`` rows, and a row with cell -1: how far it came, and the next bound (null: all cells)."""
    size, centres, radii, cells = index.size, index.centres, index.radii, index.cells

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked: list[tuple] = []
            for at, r in enumerate(batch.to_pylist()):
                # nothing below this score is wanted by any window that is still open
                floor = min(max(lo, c) for lo, c in zip(r["low"], r["cut"]))
                taken, came, ahead = 0, 0, None
                for bound, cell in cells_by_bound(np.frombuffer(r["vec"], "<i4"), size, centres, radii, codes):
                    if bound < floor:
                        break
                    if came >= r["done"] and cell in cells:
                        if taken >= rows:
                            ahead = bound
                            break
                        taken += cells[cell][0]
                        asked += [(at, cell, part, None, None) for part in range(cells[cell][1])]
                    came += 1
                asked.append((at, -1, None, came, ahead))
            if asked:
                at, cell, part, came, ahead = zip(*asked)
                kept = [batch.column(batch.schema.get_field_index(n)).take(pa.array(at)) for n in ("a", "label", "vec", "low", "high", "cut")]
                made = [pa.array(cell, pa.int64()), pa.array(part, pa.int64()), pa.array(came, pa.int64()), pa.array(ahead, pa.float64())]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=["a", "label", "vec", "low", "high", "cut", "cell", "part", "done", "ahead"])

    return stored(live.mapInArrow(work, f"{_ANCHOR}, cell long, part long, done long, ahead double"), "visits")


def _met(visits: DataFrame, index: Index, packs: int, same: bool, k: int) -> DataFrame:
    """(a, window, id, score): the best k rows of each visited block for every window, none below the cut."""
    size = index.size
    asked = visits.filter("cell >= 0").select("cell", "part", F.pmod(F.xxhash64("a"), F.lit(packs)).alias("pack"), F.struct("a", "label", "vec", "low", "high", "cut").alias("anchor"))
    asked = asked.groupBy("cell", "part", "pack").agg(F.collect_list("anchor").alias("anchors"))  # about PACK anchors
    joined = asked.join(index.blocks.hint("merge"), ["cell", "part"]).select("anchors", "rows", "ids", "labels", "vecs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = []
            for r in batch.to_pylist():
                rows, ids, labels = (np.frombuffer(r[n], "<i8") for n in ("rows", "ids", "labels"))
                mine = r["anchors"]
                vectors = np.frombuffer(b"".join(x["vec"] for x in mine), "<i4").reshape(len(mine), size)
                products = scores(vectors, np.frombuffer(r["vecs"], "<i4").reshape(len(ids), size))
                for x, found in zip(mine, products):
                    own = (labels == x["label"]) & (rows != x["a"]) if same else labels != x["label"]
                    at = np.flatnonzero(own & (found >= min(map(max, x["low"], x["cut"]))) & (found <= max(x["high"])))
                    for window, (low, high, cut) in enumerate(zip(x["low"], x["high"], x["cut"])) if len(at) else ():
                        inside = at[(found[at] >= max(low, cut)) & (found[at] <= high)]
                        if len(inside):
                            inside = inside[best(found[inside], ids[inside], k)]
                            out.append([np.full(len(inside), x["a"]), np.full(len(inside), window), ids[inside], found[inside]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "window", "id", "score"])

    return joined.mapInArrow(work, "a long, window long, id long, score long")


def search(anchors: DataFrame, index: Index, k: int, same: bool, codes: int = CODES) -> DataFrame:
    """(a, window, id, score, rank): the best k rows of every window of every anchor.

    ``anchors``: a, label, vec, low, high (arrays: the windows, ends included).  ``same``: rows of the
    anchor's label other than itself, or rows of all other labels.
    """
    none = F.transform("low", lambda x: F.lit(-(1 << 63)).cast("long"))
    anchors = stored(anchors.withColumn("cut", none), "anchors")
    live = anchors.withColumn("done", F.lit(0).cast("long"))
    n, rows = live.count(), FIRST_ROWS
    kept = None
    order = Window.partitionBy("a", "window").orderBy(F.col("score").desc(), "id")
    while n or kept is None:
        visits = _visits(live, index, codes, rows)
        found = _met(visits, index, -(-max(n, 1) // PACK), same, k)
        found = found if kept is None else found.unionByName(kept.drop("rank"))
        kept = stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "found")
        # the last of k wanted scores is a window's cut from now on
        cuts = kept.filter(F.col("rank") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("cuts"))
        came = visits.filter("cell < 0 AND ahead IS NOT NULL").select("a", "label", "vec", "low", "high", "cut", "done", "ahead")
        cut = F.transform("cut", lambda c, i: F.coalesce(F.element_at("cuts", i.cast("long")), c))
        live = came.join(cuts.hint("merge"), "a", "left").withColumn("cut", F.when(F.col("cuts").isNull(), F.col("cut")).otherwise(cut)).drop("cuts")
        # certified: the next bound lies below every window's least wanted score
        wanted = F.array_min(F.transform(F.arrays_zip("low", "cut"), lambda w: F.greatest(w.low, w.cut)))
        live = stored(live.filter(F.col("ahead") >= wanted).drop("ahead"), "live")
        n, rows = live.count(), rows * GROWTH
    return kept


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, codes: int = CODES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has id, label, vector; ``anchor`` says which rows are anchors.  A negative's score, times 100, lies
    between ``low`` and ``high`` times the positive's.
    """
    x = F.col("vector")
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("vector"))
    index = build(whole.filter(usable).withColumn("row", F.monotonically_increasing_id()), codes)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if index is None:
        return rows.sparkSession.createDataFrame([], schema)
    anchors = index.points.filter(anchor).select(F.col("row").alias("a"), F.col("id").alias("anchor_id"), "label", "vec")
    all_scores = [F.array(F.lit(v).cast("long")).alias(n) for v, n in ((-(1 << 63), "low"), ((1 << 63) - 1, "high"))]
    friends = search(anchors.select("a", "label", "vec", *all_scores), index, positives, True, codes)
    friends = stored(friends.select("a", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")), "positives")
    # score * 100 >= low * p and <= high * p, in whole numbers
    p = F.col("positive_score").cast("decimal(20,0)")
    ends = friends.select("a", "place", F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high")).filter("low <= high")
    windows = ends.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))  # `positives` a group
    windows = stored(windows.join(anchors.select("a", "label", "vec").hint("merge"), "a").select("a", "label", "vec", F.col("w.low").alias("low"), F.col("w.high").alias("high"), F.col("w.place").alias("places")), "windows")
    foes = search(windows.drop("places"), index, negatives, False, codes)
    foes = foes.join(windows.select("a", "places").hint("merge"), "a").withColumn("place", F.get("places", F.col("window").cast("int")))
    return (
        foes.join(friends.hint("merge"), ["a", "place"])
        .join(anchors.select("a", "anchor_id").hint("merge"), "a")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def negatives_table(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, F.col("id") % 100 == 0)
