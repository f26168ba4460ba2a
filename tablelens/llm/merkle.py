"""Merkle manifest of a table, by time-forward processing.

Every row is a leaf: SHA-256 of its fields, each ``-`` if null, else byte count,
``:`` and value.  The leaves of a group (ascending by key) become a tree of
``ARITY`` children a node; while several nodes remain, every three consecutive
ones (the last run may be shorter, even one) become their hash.  The groups'
roots, ordered by group (null first, then by UTF-8 bytes), become the root in
the same way.

A node's label is (round, tree, chunk, level, place), and every edge of the tree
leads to a larger label.  Digests travel to parents as messages in the order of
labels: between rounds they lie in stored tables, sorted by Spark's shuffle (the
external part of the priority queue), and inside a round a task pops them from a
heap.  A round climbs ``LEVELS`` levels, so a chunk is at most 243 nodes however
large a group is, and a full chunk, like a tree that fits one chunk, ends in one
node: a node needs nothing but its children to know that it is done.  A reversed
sweep goes through the same rounds from the root down; a chunk receives the
proof of its root as one message, pops its labels in falling order and hands
every child its siblings followed by the parent's proof.

Leaves are ranked by a range-partitioned sort; the ranks of a group that spans
partitions come from one line per partition (sizes of its first and last run).
No window, tree or proof is ever held by one task beyond a chunk.

Null keys come first in their group, equal keys are ordered by leaf, repeated
rows are leaves of their own and equal rows are interchangeable.  Empty texts
are ``0:``.  Very long texts are hashed whole where they are read and never
shuffled.  An empty table has no root and returns no rows.  Columns other than
the named ones never matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tablelens.llm.common import stored

ARITY = 3
LEVELS = 5
CHUNK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


# ---- places of the leaves ----


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of the run of equal groups in a sorted partition, and the place in it."""
    run, place, last = -1, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = batch.column(batch.schema.get_field_index("group")).to_pylist()
        numbers, places = np.empty(len(groups), np.int64), np.empty(len(groups), np.int64)
        for i, g in enumerate(groups):
            if run < 0 or g != last:
                run, place, last = run + 1, 0, g
            numbers[i], places[i] = run, place
            place += 1
        names = [*batch.schema.names, "run", "place"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers), pa.array(places)], names=names)


def ranked(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Replace ``group`` by ``tree`` (its number, from 0) and append ``idx`` (the row's number in it).

    ``rows`` has ``group``, ``key``, ``leaf`` and others; it should be a stored table, for it is read twice.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("tie")]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows may lie in several partitions
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie")
    schema = StructType([*rows.schema.fields, StructField("run", LongType()), StructField("place", LongType())])
    placed = stored(rows.mapInArrow(_runs, schema).withColumn("part", F.spark_partition_id()), "leaves")
    sums = placed.groupBy("part").agg(F.max_by(F.struct("group", "run", "place"), F.struct("run", "place")).alias("last"), F.max_by("group", -F.col("run")).alias("first"))
    before, trees, carried, previous = {}, 0, 0, None
    for r in sums.orderBy("part").collect():  # one line a partition
        again = previous is not None and previous[0] == r["first"]
        trees -= again
        before[r["part"]] = (trees, carried if again else 0)
        size = r["last"]["place"] + 1
        carried = size + (carried if again and r["last"]["run"] == 0 else 0)
        trees += r["last"]["run"] + 1
        previous = (r["last"]["group"],)
    if not before:
        return placed.select(F.lit(0).cast("long").alias("tree"), F.col("place").alias("idx"), *[c for c in placed.columns if c not in ("group", "run", "place", "part")])
    at = lambda k: F.element_at(F.create_map(*[F.lit(x) for p, v in before.items() for x in (p, v[k])]), F.col("part"))
    return placed.select(
        (at(0) + F.col("run")).cast("long").alias("tree"),
        (F.col("place") + F.when(F.col("run") == 0, at(1)).otherwise(F.lit(0))).cast("long").alias("idx"),
        *[c for c in placed.columns if c not in ("group", "run", "place", "part")],
    )


# ---- one chunk ----


def levels_of(chunk: int, n: int) -> int:
    """Levels that a chunk of ``n`` nodes climbs: all, unless it is its whole tree."""
    if chunk > 0 or n == CHUNK:
        return LEVELS
    up = 0
    while n > 1:
        n, up = -(-n // ARITY), up + 1
    return up


def climb(digests: list[str], levels: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The digest at the top, and every inner node as (level, place, children) in the order of labels."""
    queue = [(1, i // ARITY, i % ARITY, d) for i, d in enumerate(digests)]  # messages, sorted by label
    nodes = []
    while queue and queue[0][0] <= levels:
        level, place = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        nodes.append((level, place, children))
        heapq.heappush(queue, (level + 1, place // ARITY, place % ARITY, digest("".join(children))))
    return queue[0][3], nodes


def descend(nodes: list[tuple[int, int, list[str]]], levels: int, above: str) -> dict[int, str]:
    """The proof of every node of the chunk's lowest level: ``left:right,`` a level, then ``above``."""
    proofs = {(levels, 0): above}
    for level, place, children in reversed(nodes):
        rest = proofs.pop((level, place))
        for i in range(len(children)):
            proofs[level - 1, place * ARITY + i] = f"{''.join(children[:i])}:{''.join(children[i + 1 :])},{rest}"
    return {place: proof for (_, place), proof in proofs.items()}


def fold(start: str, proof: str) -> str:
    """The digest at the end of a proof."""
    for step in filter(None, proof.replace("/", "").split(",")):
        left, right = step.split(":")
        start = digest(left + start + right)
    return start


def siblings(proof: str) -> str:
    return proof.translate(str.maketrans("", "", ":,/"))


# ---- rounds over all chunks ----


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one (tree, chunk) after the other, from a partition sorted by them."""
    held, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["tree"], row["chunk"])
            if key != now and held:
                yield held
                held = []
            now = key
            held.append(row)
    if held:
        yield held


def _sorted(rows: DataFrame) -> DataFrame:
    """Rows in the order of their labels, the chunks dealt over all tasks."""
    return rows.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "idx")


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_IN_CHUNKS = f"idx div {CHUNK} AS chunk"


def forward(nodes: DataFrame) -> list[DataFrame]:
    """All rounds from the leaves (tree, idx, digest) up: the last holds one node a tree."""
    schema = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("digest", pa.string())])

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tops() -> Iterator[tuple]:
            for rows in _chunks(batches):
                chunk = rows[0]["chunk"]
                top, _ = climb([r["digest"] for r in rows], levels_of(chunk, len(rows)))
                yield rows[0]["tree"], chunk, top

        return _batched(tops(), schema)

    rounds = [nodes]
    while (rounds[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        last = rounds[-1].selectExpr("tree", _IN_CHUNKS, "idx", "digest")
        rounds.append(stored(_sorted(last).mapInArrow(up, "tree long, idx long, digest string"), "nodes"))
    return rounds


def _swept(nodes: DataFrame, above: DataFrame, extra: list[str], made, schema: str, arrow: pa.Schema) -> DataFrame:
    """One round of the reversed sweep: ``made(row, proof, subroot)`` for every node of the round.

    ``above`` (tree, idx, proof, subroot) are the messages to the chunks' roots.
    """
    rows = nodes.selectExpr("tree", _IN_CHUNKS, "idx", "digest", *extra, "CAST(NULL AS STRING) AS proof", "CAST(NULL AS STRING) AS subroot")
    sent = above.select("tree", F.col("idx").alias("chunk"), F.lit(-1).cast("long").alias("idx"), "proof", "subroot")

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def proofs() -> Iterator[tuple]:
            for first, *mine in _chunks(batches):
                levels = levels_of(first["chunk"], len(mine))
                _, inner = climb([r["digest"] for r in mine], levels)
                found = descend(inner, levels, first["proof"])
                for i, row in enumerate(mine):
                    yield made(row, found[i], first["subroot"])

        return _batched(proofs(), arrow)

    return _sorted(rows.unionByName(sent, allowMissingColumns=True)).mapInArrow(down, schema)


def backward(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, idx, proof, subroot) of the nodes of the second round; ``above`` is that of the last one."""
    arrow = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("proof", pa.string()), ("subroot", pa.string())])
    made = lambda row, proof, subroot: (row["tree"], row["idx"], proof, subroot)
    for nodes in reversed(rounds[1:-1]):
        above = stored(_swept(nodes, above, [], made, "tree long, idx long, proof string, subroot string", arrow), "proofs")
    return above


def manifest(rows: DataFrame) -> DataFrame:
    """``rows``: group, key, leaf, changed (a changed leaf, or null).  Returns key, leaf, subroot, root, proof, folded_root, verified.

    ``proof`` holds the siblings as ``left:right,`` a level, from the leaf up, with ``/`` at the group's root.
    """
    leaves = ranked(stored(rows.select("group", "key", "leaf", "changed"), "rows"))
    trees = forward(leaves.select("tree", "idx", F.col("leaf").alias("digest")))
    subroots = trees[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest")
    tops = forward(subroots)
    top = tops[-1].first()
    root = top["digest"] if top else None
    none = F.lit(None).cast("string")
    if len(tops) > 1:
        above = backward(tops, tops[-1].select("tree", "idx", F.lit("").alias("proof"), none.alias("subroot")))
        arrow = pa.schema([("tree", pa.int64()), ("idx", pa.int64()), ("proof", pa.string()), ("subroot", pa.string())])
        made = lambda row, proof, _: (row["idx"], 0, "/" + proof, row["digest"])
        above = stored(_swept(tops[0], above, [], made, "tree long, idx long, proof string, subroot string", arrow), "proofs")
    else:  # one group, or none
        above = subroots.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), F.lit("/").alias("proof"), F.col("digest").alias("subroot"))
    if len(trees) == 1:  # only groups of one row: they send their proof to themselves
        trees = [trees[0], trees[0]]
    above = backward(trees, above)

    def made_leaf(row: dict, proof: str, subroot: str) -> tuple:
        folded = fold(row["changed"] or row["digest"], proof)
        return row["key"], row["digest"], subroot, root, proof, folded, folded == root

    key = rows.schema["key"].dataType.simpleString()
    names = ("leaf", "subroot", "root", "proof", "folded_root")
    arrow = pa.schema([("key", pa.int64() if key == "bigint" else pa.string()), *[(n, pa.string()) for n in names], ("verified", pa.bool_())])
    schema = f"key {key}, " + ", ".join(f"{n} string" for n in names) + ", verified boolean"
    return _swept(leaves.withColumnRenamed("leaf", "digest"), above, ["key", "changed"], made_leaf, schema, arrow)


def manifest_table(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where 2 divides crc32 of the decimal id, the leaf to be verified is that of the text without line ends; a
    null id is never tampered with.
    """
    text = F.col("text").cast("string")
    values = [F.col(c) for c in FIELDS[:-1]]
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(text, F.lit("\n"))
    rows = docs.select(
        F.col("source").cast("string").alias("group"),
        F.col("doc_id").cast("long").alias("key"),
        leaf([*values, text]).alias("leaf"),
        F.when(tampered, leaf([*values, F.replace(text, F.lit("\n"), F.lit(""))])).alias("changed"),
    )
    found = manifest(rows)
    proof = F.sha2(F.translate("proof", ":,/", "").cast("binary"), 256)
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")
