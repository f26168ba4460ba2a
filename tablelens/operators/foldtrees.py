"""Cross-validated forests and boosted trees of a large table, all folds in the same passes.

Fitting every fold apart reads the table once for each fold, tree level and round.
Here a pass sums the figures of one level for the trees of all folds together: the
number of rows and the sum of their targets by (tree, node, slot, bin).  The splits
are those of Spark's trees for continuous slots: at most 32 bins, the largest fall in
variance, at least one row a side, ties to the first slot and bin.  Forests draw rows
with a Poisson mean of 1 and a third of the slots a node; boosting fits the first tree
to the targets and adds a tenth of each later one.

Rows lie in blocks of one fold as bins and targets, dealt over all cores, and are
summed in tasks; what tasks return is bounded by nodes, slots and bins, whatever the
number of rows.  Up to 32 values of a slot are told apart exactly, more are cut at 31
quantiles of all rows.  NaN lies above all values.  The trees of all rows, for a
champion, grow in the same way and lie in a small stored table.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle, keyword_only
from pyspark.ml import Model
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablelens.session import durable, scratch_path

BINS = 32
RATE = 0.1
SEED = 42
# Rows that are worked on together.
BLOCK = 65_536
# Trees of every fold whose figures are summed in one job: at depth 10 some 80 MB a task for five folds and nine slots.
FAN = 20
# Rounds after which the lineage of the boosted predictions is cut.
CUT_EVERY = 10
# A cut above all bins: every row goes left.
NO_CUT = 255
# In place of a fold that is left out: the trees see all rows.
NONE = -1

# 2^16 equally likely numbers of times that a row is drawn, by a Poisson law of mean 1.
_DRAWS = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)

# Workers get these helpers with the job and need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows x slots."""
    lists = batch.column("features")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _few_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct values of every slot as far as they are at most one more than the bins."""
    seen: list[np.ndarray] = []
    for batch in batches:
        x = _matrix(batch)
        seen = seen or [np.zeros(0)] * x.shape[1]
        for j in range(x.shape[1]):
            if len(seen[j]) <= BINS:
                column = x[:, j]
                seen[j] = np.unique(np.concatenate([seen[j], column[~np.isnan(column)]]))[: BINS + 1]
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(seen)), pa.int32()), pa.array([s.tolist() for s in seen], pa.list_(pa.float64()))], ["slot", "values"])


def bin_edges(rows: DataFrame, slots: int) -> list[np.ndarray]:
    """The cuts of every slot, from all rows: between its values if they are few, else at quantiles."""
    seen = [np.zeros(0)] * slots
    for r in rows.select("features").mapInArrow(_few_values, "slot int, values array<double>").collect():
        seen[r["slot"]] = np.unique(np.concatenate([seen[r["slot"]], r["values"]]))[: BINS + 1]
    edges = [(s[1:] + s[:-1]) / 2 for s in seen]
    many = [j for j in range(slots) if len(seen[j]) > BINS]
    if many:
        columns = rows.select(*[F.get("features", F.lit(j)).alias(f"s{j}") for j in many])
        found = columns.approxQuantile(columns.columns, [k / BINS for k in range(1, BINS)], 0.001)
        for j, cuts in zip(many, found):
            edges[j] = np.unique(cuts)
    return edges


def _packer(edges: list[np.ndarray], middle: float):
    def joined(fold: int, parts: list) -> pa.RecordBatch:
        bins = np.concatenate([b for b, _ in parts], axis=1)
        target = np.concatenate([t for _, t in parts])
        return pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([bins.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary())], ["fold", "bins", "target"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, folds = _matrix(batch), batch.column("fold").to_numpy()
            target = batch.column("label").to_numpy() - middle
            bins = np.stack([np.searchsorted(e, x[:, j]).astype(np.uint8) for j, e in enumerate(edges)])
            for fold in np.unique(folds).tolist():
                mine = folds == fold
                parts = waiting.setdefault(fold, [])
                parts.append((bins[:, mine], target[mine]))
                if sum(len(t) for _, t in parts) >= BLOCK:
                    yield joined(fold, waiting.pop(fold))
        for fold, parts in waiting.items():
            yield joined(fold, parts)

    return pack


@dataclass
class Block:
    """Rows of one fold: bins by slot, then row, and targets less their mean; ``boosted`` has a row of predictions for every fold left out."""

    place: tuple[int, int]
    fold: int
    bins: np.ndarray
    target: np.ndarray
    boosted: np.ndarray | None = None

    def with_boosted(self, boosted: np.ndarray) -> tuple:
        return self.place, self.fold, self.bins, self.target, boosted


def nodes(block: Block, levels: list[tuple], at: np.ndarray) -> np.ndarray:
    """The node below ``levels`` that each of the rows ``at`` of a block reaches."""
    flat, n = block.bins.ravel(), block.bins.shape[1]
    node = np.zeros(len(at), np.intp)
    for slots, cuts in levels:
        seen = flat.take((slots.astype(np.intp) * n).take(node) + at)
        node = 2 * node + (seen > cuts.take(node))
    return node


@dataclass
class Blocks:
    """All rows, and what is known of them; ``rdd`` holds the fields of a ``Block`` each."""

    spark: SparkSession
    rdd: RDD
    edges: list[np.ndarray]
    folds: list[int]
    middle: float

    @property
    def slots(self) -> int:
        return len(self.edges)

    @property
    def left_out(self) -> list[int]:
        """The folds that are left out in turn; where all rows are in one fold, none is."""
        return self.folds if len(self.folds) > 1 else [NONE]


def blocks_of(ready: DataFrame) -> Blocks:
    """The rows of (features, label, fold) in blocks, dealt over all cores."""
    context = ready.sparkSession.sparkContext
    rows = ready.select(vector_to_array("features").alias("features"), "label", "fold")
    slots, folds, middle = rows.agg(F.max(F.size("features")), F.sort_array(F.collect_set("fold")), F.avg("label")).first()
    edges = bin_edges(rows, slots)
    dealt = rows.repartition(max(2, context.defaultParallelism))
    packed = durable(dealt.mapInArrow(_packer(edges, middle), "fold int, bins binary, target binary"))

    def unpack(part: int, found: Iterator) -> Iterator[tuple]:
        for i, r in enumerate(found):
            yield (part, i), r["fold"], np.frombuffer(r["bins"], np.uint8).reshape(slots, -1), np.frombuffer(r["target"], np.float64)

    return Blocks(ready.sparkSession, packed.rdd.mapPartitionsWithIndex(unpack).persist(StorageLevel.MEMORY_AND_DISK), edges, folds, middle)


@dataclass
class Tree:
    """A tree of full levels: (slots, cuts) of each, means of its last nodes, and which may be split again; falls of squares by slot."""

    levels: list[tuple[np.ndarray, np.ndarray]]
    means: np.ndarray | None
    live: np.ndarray
    falls: np.ndarray

    @classmethod
    def root(cls, slots: int) -> Tree:
        return cls([], None, np.ones(1, bool), np.zeros(slots))

    def split(self, sums: np.ndarray, slots: np.ndarray) -> Tree:
        """One level more, from rows and targets by (slot of ``slots``, node, bin).  A node that is not split hands its mean to both sides."""
        n, s = sums.transpose(0, 2, 1, 3)
        left_n, left_s = n.cumsum(-1), s.cumsum(-1)
        all_n, all_s = left_n[..., -1:], left_s[..., -1:]
        left_n, left_s = left_n[..., :-1], left_s[..., :-1]
        right_n, right_s = all_n - left_n, all_s - left_s
        with np.errstate(divide="ignore", invalid="ignore"):
            fall = left_s**2 / left_n + right_s**2 / right_n - all_s**2 / all_n
            fall = np.where((left_n < 1) | (right_n < 1), -np.inf, fall).reshape(len(self.live), -1)
            best, nodes = fall.argmax(1), np.arange(len(self.live))
            good = self.live & (fall[nodes, best] > 0)
            which, cut = np.divmod(best, BINS - 1)
            sides = np.stack([left_s / left_n, right_s / right_n])[:, nodes, which, cut]
            mean = np.nan_to_num(all_s[:, 0, 0] / all_n[:, 0, 0]) if self.means is None else self.means
        slot = np.where(good, slots[nodes, which], 0)
        level = slot.astype(np.int32), np.where(good, cut, NO_CUT).astype(np.uint8)
        falls = self.falls + np.bincount(slot, np.where(good, fall[nodes, best], 0.0), len(self.falls))
        return Tree([*self.levels, level], np.where(good, sides, mean).T.ravel(), np.repeat(good, 2), falls)


def _boost_sums(found: Iterator[tuple], left_out: list[int], trees: list[Tree], first: bool) -> Iterator[np.ndarray]:
    """Rows and remainders by (fold left out, slot, node, bin) of one level."""
    out = None
    size = BINS << len(trees[0].levels)
    for b in (Block(*x) for x in found):
        slots, n = b.bins.shape
        out = np.zeros((2, len(trees), slots, size)) if out is None else out
        at, bins = np.arange(n), b.bins.astype(np.intp)
        for i, (fold, tree) in enumerate(zip(left_out, trees)):
            if fold == b.fold:
                continue
            wanted = b.target if first else 2 * (b.target - b.boosted[i])
            base = nodes(b, tree.levels, at) * BINS
            for j in range(slots):
                cell = base + bins[j]
                out[0, i, j] += np.bincount(cell, minlength=size)
                out[1, i, j] += np.bincount(cell, wanted, size)
    if out is not None:
        yield out


def _delete(spark: SparkSession, path: str | None) -> None:
    """Delete the predictions of earlier rounds once later ones are stored."""
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def grow_boosted(blocks: Blocks, left_out: list[int], rounds: int, depth: int) -> tuple[list[list[Tree]], RDD]:
    """The trees of every round by fold left out (means are steps of the prediction), and the blocks with their predictions."""
    slots, many = blocks.slots, len(left_out)

    def begin(fields: tuple) -> tuple:
        b = Block(*fields)
        return b.with_boosted(np.zeros((many, len(b.target))))

    every: list[list[Tree]] = []
    kept = None
    state = blocks.rdd.map(begin).persist(StorageLevel.MEMORY_AND_DISK)
    for turn in range(rounds):
        trees = [Tree.root(slots)] * many
        for level in range(depth):
            parts = state.mapPartitions(lambda found, now=trees, first=turn == 0: _boost_sums(found, left_out, now, first)).collect()
            sums = reduce(np.add, parts).reshape(2, many, slots, 1 << level, BINS)
            trees = [t.split(sums[:, i], np.broadcast_to(np.arange(slots), (1 << level, slots))) for i, t in enumerate(trees)]
            if not any(t.live.any() for t in trees):
                break
        for t in trees:
            t.means = t.means * (1.0 if turn == 0 else RATE)
        every.append(trees)

        def grown(fields: tuple, trees=trees) -> tuple:
            b = Block(*fields)
            at = np.arange(len(b.target))
            return b.with_boosted(np.stack([now + t.means.take(nodes(b, t.levels, at)) for now, t in zip(b.boosted, trees)]))

        after = state.map(grown).persist(StorageLevel.MEMORY_AND_DISK)
        if turn % CUT_EVERY == CUT_EVERY - 1:
            after.checkpoint()
        after.count()
        state.unpersist()
        state = after
        if turn % CUT_EVERY == CUT_EVERY - 1:
            _delete(blocks.spark, kept)
            kept = state.getCheckpointFile()
    return every, state


def _node_slots(fold: int, tree: int, level: int, slots: int) -> np.ndarray:
    """A third of the slots for every node of a level."""
    order = np.random.default_rng([SEED, fold + 1, tree, level]).random((1 << level, slots)).argsort(1)
    return np.sort(order[:, : math.ceil(slots / 3)], axis=1)


def drawn(block: Block, tree: int) -> np.ndarray:
    """How many times each row is drawn for a tree, whichever fold is left out."""
    return _DRAWS.take(np.random.default_rng([SEED, *block.place, tree]).integers(0, 1 << 16, len(block.target), dtype=np.uint16))


def _forest_sums(found: Iterator[tuple], grown: dict[tuple[int, int], Tree]) -> Iterator[tuple]:
    """((fold left out, tree), rows and targets by (slot of the node, node, bin)) of one level."""
    out: dict[tuple[int, int], np.ndarray] = {}
    picked = {k: _node_slots(*k, len(t.levels), len(t.falls)) for k, t in grown.items()}
    for b in (Block(*x) for x in found):
        flat, n = b.bins.ravel(), b.bins.shape[1]
        for tree in sorted({t for _, t in grown}):
            times = drawn(b, tree)
            at = np.flatnonzero(times)
            weight = times[at].astype(np.float64)
            target = weight * b.target[at]
            for fold in sorted({f for f, _ in grown} - {b.fold}):
                own = picked[fold, tree]
                size = BINS * len(own)
                sums = out.setdefault((fold, tree), np.zeros((2, own.shape[1], size)))
                node = nodes(b, grown[fold, tree].levels, at)
                base = node * BINS
                for j in range(own.shape[1]):
                    cell = base + flat.take((own[:, j] * n).take(node) + at)
                    sums[0, j] += np.bincount(cell, weight, size)
                    sums[1, j] += np.bincount(cell, target, size)
    yield from out.items()


def grow_forest(blocks: Blocks, left_out: list[int], trees: int, depth: int) -> dict[tuple[int, int], Tree]:
    """The trees by fold left out and number."""
    whole: dict[tuple[int, int], Tree] = {}
    for begin in range(0, trees, FAN):
        grown = {(f, t): Tree.root(blocks.slots) for f in left_out for t in range(begin, min(trees, begin + FAN))}
        for level in range(depth):

            def split(item, now=grown, level=level):
                key, sums = item
                one = now[key].split(sums.reshape(2, -1, 1 << level, BINS), _node_slots(*key, level, len(now[key].falls)))
                return key, (one.levels, one.means, one.live, one.falls)

            sums = blocks.rdd.mapPartitions(lambda found, now=grown: _forest_sums(found, now))
            made = sums.reduceByKey(np.add, blocks.rdd.getNumPartitions()).map(split).collect()
            grown = {key: Tree(*fields) for key, fields in made}
        whole |= grown
    return whole


def _scores(blocks: RDD, predicted) -> tuple[float, float]:
    """Mean R2 and RMSE over the folds; ``predicted(block)`` predicts the rows of a block."""

    def sums(found: Iterator[tuple]) -> Iterator[dict]:
        out: dict[int, np.ndarray] = {}
        for b in (Block(*x) for x in found):
            wrong = b.target - predicted(b)
            out[b.fold] = out.get(b.fold, 0) + np.array([len(wrong), b.target.sum(), b.target @ b.target, wrong @ wrong])
        yield out

    total: dict[int, np.ndarray] = {}
    for part in blocks.mapPartitions(sums).collect():
        for fold, figures in part.items():
            total[fold] = total.get(fold, 0) + figures
    with np.errstate(divide="ignore", invalid="ignore"):
        both = [(1 - wrong / (squares - s * s / n), math.sqrt(wrong / n)) for n, s, squares, wrong in (total[f] for f in sorted(total))]
    return tuple(float(sum(column) / len(both)) for column in zip(*both))


def forest_scores(blocks: Blocks, trees: int, depth: int) -> tuple[float, float]:
    """R2 and RMSE of forests; every fold is predicted by the trees that left it out."""
    left_out = blocks.left_out
    grown = grow_forest(blocks, left_out, trees, depth)
    sent = blocks.rdd.context.broadcast({key: (t.levels, t.means) for key, t in grown.items()})

    def predicted(b: Block) -> np.ndarray:
        at, total = np.arange(len(b.target)), np.zeros(len(b.target))
        for tree in range(trees):
            levels, means = sent.value[b.fold if b.fold in left_out else NONE, tree]
            total += means.take(nodes(b, levels, at))
        return total / trees

    found = _scores(blocks.rdd, predicted)
    sent.unpersist()
    return found


def boosting_scores(blocks: Blocks, rounds: int, depth: int) -> tuple[float, float]:
    """R2 and RMSE of boosted trees; every fold is predicted by the trees that left it out."""
    left_out = blocks.left_out
    _, state = grow_boosted(blocks, left_out, rounds, depth)
    found = _scores(state, lambda b: b.boosted[left_out.index(b.fold if b.fold in left_out else NONE)])
    state.unpersist()
    return found


class GrownTrees(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the ``prediction`` of ``features``: the sum of what the trees of a stored table say."""

    table = Param(Params._dummy(), "table", "folder of the table of trees", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, table=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _rows(self, spark: SparkSession) -> list:
        """One row a tree: a bounded table."""
        return spark.read.parquet(self.getOrDefault(self.table)).orderBy("tree").collect()

    @property
    def featureImportances(self) -> DenseVector:
        falls = np.sum([r["falls"] for r in self._rows(SparkSession.active())], axis=0)
        return DenseVector(falls / falls.sum() if falls.sum() else falls)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = self._rows(dataset.sparkSession)
        trees = [([(np.array(s, np.intp), np.array(c)) for s, c in zip(r["slots"], r["cuts"])], np.array(r["steps"])) for r in rows]
        slots = len(rows[0]["falls"])

        def load():
            def predict(x: np.ndarray) -> np.ndarray:
                flat, at, total = x.ravel(), np.arange(len(x)) * slots, np.zeros(len(x))
                for levels, steps in trees:
                    node = np.zeros(len(x), np.intp)
                    for slot, cut in levels:
                        node = 2 * node + ~(flat.take(slot.take(node) + at) <= cut.take(node))
                    total += steps.take(node)
                return total

            return predict

        said = predict_batch_udf(load, return_type=T.DoubleType(), batch_size=10_000, input_tensor_shapes=[[slots]])
        return dataset.withColumn("prediction", said(vector_to_array("features")))


def _model(blocks: Blocks, trees: list[Tree], steps: list[np.ndarray], falls: list[np.ndarray]) -> GrownTrees:
    spark = blocks.spark
    path = scratch_path(spark, "trees")

    def cuts(slots: np.ndarray, bins: np.ndarray) -> list[float]:
        return [math.inf if c == NO_CUT else float(blocks.edges[s][c]) for s, c in zip(slots.tolist(), bins.tolist())]

    rows = [
        (i, [s.tolist() for s, _ in t.levels], [cuts(s, c) for s, c in t.levels], step.tolist(), fall.tolist())
        for i, (t, step, fall) in enumerate(zip(trees, steps, falls))
    ]
    schema = "tree int, slots array<array<int>>, cuts array<array<double>>, steps array<double>, falls array<double>"
    spark.createDataFrame(rows, schema).write.parquet(path)
    return GrownTrees(table=path)


def fit_forest(blocks: Blocks, trees: int, depth: int) -> GrownTrees:
    """A forest of all rows; every tree has the same weight in the importances."""
    grown = grow_forest(blocks, [NONE], trees, depth)
    every = [grown[NONE, t] for t in range(trees)]
    return _model(blocks, every, [(t.means + blocks.middle) / trees for t in every], [t.falls / (t.falls.sum() or 1.0) for t in every])


def fit_boosted(blocks: Blocks, rounds: int, depth: int) -> GrownTrees:
    """Boosted trees of all rows."""
    turns, state = grow_boosted(blocks, [NONE], rounds, depth)
    state.unpersist()
    every = [one for (one,) in turns]
    return _model(blocks, every, [t.means + (blocks.middle if i == 0 else 0.0) for i, t in enumerate(every)], [t.falls for t in every])
