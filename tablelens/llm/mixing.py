"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, in a pseudorandom order, are one stream of words, cut
into blocks of ``BLOCK`` words (the last may be shorter).  A source's target is
its share of all words by weight; no target exceeds ``CAP`` times its source,
and what is over is shared again by weight.  A source gets
round(target x blocks / words) slots of the mix.

The slots of all sources are laid end to end and a pseudorandom permutation of
the whole range deals them into output shards: a shard's source counts are a
multinomial draw, conditional on the corpus totals (which therefore hold to
within a block).  Slot j of a source takes the block at place j of the
source's own pseudorandom permutation, starting over after the last block.
Slots and documents meet by (source, block index) in a join.

Permutations are four-round Feistel networks over the smallest square that
holds the range; values outside walk on until they are inside.  Everything is
a function of the rows and ``seed``, so reruns agree.

Null text has no words; a null source is a source of its own, the last.  Null
ids and repeated rows are rows like any other (repeated rows are told apart by
their number among equals).  Without words all targets are zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.llm.common import stored

BLOCK = 32
CAP = 3
SHARD = 4_096  # slots of an output shard
WEIGHTS = (1, 2, 3)
WALKS = 64
RANGE = 1 << 16  # slots that one row is expanded to, and rows of an order bucket
WORDS = r"[^\x20\x09-\x0D]+"


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n-1, chosen by ``key``."""
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double")))).cast("long")

    def turn(value: Column) -> Column:
        left, right = F.floor(value / side).cast("long"), F.pmod(value, side)
        for k in range(4):
            left, right = right, F.pmod(left + F.pmod(F.xxhash64(*key, F.lit(k), right), side), side)
        return left * side + right

    def walk(value: Column, _: Column) -> Column:
        return F.when(value < n, value).otherwise(turn(value))

    once = turn(x)
    # few values fall outside a square of nearly n cells; only those walk
    return F.when(once < n, once).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once, walk))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """One row per source: key, source_size, weight, target, blocks, slots, first (slot).

    The windows here run over one narrow row per source, not over documents.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = table.withColumn("weight", weight.cast("double")).withColumn("most", (cap * F.col("source_size")).cast("double"))
    # sources fill up in the order of most/weight: those before the level are capped
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    table = table.withColumn("level", level).withColumn("free", F.col("weight") * F.col("level") <= F.col("most"))
    # all sources from the first free one on are free, at its level
    height = F.first(F.when(F.col("free"), F.col("level")), True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shared = F.coalesce(F.col("weight") * height, F.col("most"))
    target = F.when(total == 0, 0.0).otherwise(F.least(F.col("most"), shared))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    table = table.withColumn("target", target).withColumn("blocks", blocks)
    slots = F.when(F.col("source_size") > 0, F.least(cap * F.col("blocks"), F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))).otherwise(0).cast("long")
    table = table.withColumn("slots", slots)
    first = F.coalesce(F.sum("slots").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return table.select("source", F.col("source_size").cast("long").alias("source_size"), "target", "blocks", "slots", first.alias("first"))


def laid_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, keep_text: bool = False) -> DataFrame:
    """row, id, source, size and the place of its first word in its source's stream."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), F.xxhash64(text).alias("mark"), *([text.alias("text")] if keep_text else []))
    # the order within a source: hash buckets of bounded size, and a hash within; equal rows are numbered apart
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("mark"))
    more = ["text"] if keep_text else []
    rows = stored(rows.select("id", "source", "size", order.alias("order"), F.monotonically_increasing_id().alias("row"), *more), "sizes")
    buckets = max(64, 4 * rows.count() // RANGE)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("order"), F.lit(buckets)))
    within = Window.partitionBy("source", "bucket").orderBy("order", "row")
    rows = rows.withColumn("place", F.sum("size").over(within) - F.col("size"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    start = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), start.alias("start"))
    met = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return met.select("row", "id", "source", "size", (F.col("start") + F.col("place")).alias("place"), *more)


def slot_table(targets: DataFrame, seed: int = 0) -> DataFrame:
    """One row per slot of the mix: shard, slot, source, block."""
    total = targets.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    chunks = targets.filter("slots > 0").select("source", "blocks", "slots", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(RANGE).cast("long"))).alias("low"))
    n = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(max(n, total // (64 * RANGE) + 1))
    slots = chunks.select("source", "blocks", "first", F.explode(F.sequence("low", F.least(F.col("low") + RANGE, F.col("slots")) - 1)).alias("j"))
    where = permuted(F.col("first") + F.col("j"), F.lit(max(1, total)).cast("long"), F.lit(seed), F.lit("slots"))
    block = permuted(F.pmod(F.col("j"), F.col("blocks")), F.col("blocks"), F.lit(seed), F.coalesce("source", F.lit("")))
    return slots.select(F.floor(where / SHARD).alias("shard"), F.pmod(where, F.lit(SHARD)).alias("slot"), "source", block.alias("block"))


def block_pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The parts of documents in each block: source, block, row, first word in the document, words."""
    place, size = F.col("place"), F.col("size")
    first, last = F.floor(place / block), F.floor((place + size - 1) / block)
    parts = placed.filter("size > 0").select("row", "source", "place", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(place, F.col("block") * block)
    high = F.least(place + size, (F.col("block") + 1) * block)
    return parts.select("source", "block", "row", (low - place).alias("first_word"), (high - low).alias("words"))


def mix(placed: DataFrame, targets: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The mix: shard, slot, source, block, row, first_word, words (a slot lists its block's parts)."""
    slots, pieces = slot_table(targets, seed), block_pieces(placed, block)
    key = lambda df: df.withColumn("key", F.xxhash64(F.col("source").isNull(), "source"))
    # both sides grow with the corpus, though the planner sees a small table before it is expanded
    met = key(slots).hint("merge").join(key(pieces).withColumnRenamed("source", "s"), ["key", "block"])
    return met.filter(F.col("source").eqNullSafe(F.col("s"))).select("shard", "slot", "source", "block", "row", "first_word", "words")


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mixed text itself: shard, slot, source, text (the block's words, joined by spaces)."""
    placed = stored(laid_out(docs, id_col, text_col, source_col, seed, keep_text=True), "placed")
    pieces = mix(placed.drop("text"), stored(source_targets(placed), "targets"), seed)
    words = F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))
    cut = F.slice(words, (F.col("first_word") + 1).cast("int"), F.col("words").cast("int"))
    parts = pieces.join(placed.select("row", "place", "text"), "row").select("shard", "slot", "source", F.struct("place", F.array_join(cut, " ").alias("text")).alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), " ")  # at most BLOCK parts
    return parts.groupBy("shard", "slot", "source").agg(joined.alias("text"))


def mix_table(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    placed = stored(laid_out(docs.select("doc_id", "text", "source"), seed=seed), "placed")
    targets = stored(source_targets(placed), "targets")
    taken = mix(placed, targets, seed).groupBy("row").agg(F.sum("words").alias("taken"))
    own = targets.select(F.col("source").alias("s"), "source_size", "target")
    met = placed.join(own, F.col("source").eqNullSafe(F.col("s")), "left").join(taken, "row", "left")
    return met.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
