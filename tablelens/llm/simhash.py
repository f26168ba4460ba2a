"""SimHash near-duplicates: fingerprints, ball hashing, connected components.

Shingles are ``size`` consecutive words (fewer words: the whole sequence),
joined by one space, A-Z lower-cased; a bit of the fingerprint is set if it is
set in over half the shingle hashes (XXH64, seed 42).  No words: zero.

Two fingerprints link at ``RADIUS`` (3) or fewer differing bits.  The radius is
odd, so balls of half the radius around whole fingerprints reach distance two
only.  The two differing sides therefore meet in a half of the fingerprint: of
three differing bits at most one lies in one of the two 32-bit halves.  Every
distinct fingerprint emits each half with all its variants within radius one,
and its plain halves; equal keys meet in a shuffle, and a popcount over all 64
bits confirms the pair.  No link is missed and no bucket is capped.

Copies collapse first: the search runs over distinct fingerprints, pairs are
pairs of distinct fingerprints, and a document finds its component through its
fingerprint.  Components come from rounds of large-star and small-star edges,
each round written to the shared folder; nothing is collected but counts.

Null text has no words.  Repeated rows keep their own result rows.  Null ids
take part; a component's id is its smallest non-null id (null if it has none).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from tablelens.llm.common import LOWER, WHITE, by_round, extend, runs, stored

RADIUS = 3
SEED = 42
_LANE = np.array([sum(((v >> b) & 1) << (16 * b) for b in range(4)) for v in range(16)], np.uint64)  # nibble -> four 16-bit counters
_PART = 65_535  # shingles that a 16-bit counter can hold


def bit_majority(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Per text, the bits set in over half of its hashes (``text`` ascends)."""
    out = np.zeros(n, np.uint64)
    if not len(hashes):
        return out
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    sizes = np.diff(np.r_[first, len(text)])
    cuts = np.concatenate([np.arange(a, a + s, _PART) for a, s in zip(first, sizes)]) if sizes.max() > _PART else first
    owner = text[cuts]
    total = np.bincount(text, minlength=n)
    for nibble in range(16):
        lanes = np.add.reduceat(_LANE[((hashes >> np.uint64(4 * nibble)) & np.uint64(15)).astype(np.int64)], cuts)
        for bit in range(4):
            counts = np.bincount(owner, weights=(lanes >> np.uint64(16 * bit)) & np.uint64(0xFFFF), minlength=n)
            out |= (2 * counts > total).astype(np.uint64) << np.uint64(4 * nibble + bit)
    return out


def _fingerprints(size: int):
    digest = xxhash.xxh64_intdigest

    def one(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(offsets) - 1
        starts, ends, text = runs((~WHITE)[data].view(np.uint8), offsets)
        if not len(starts):
            return [np.zeros(n, np.uint64)]
        # one blank between words: a shingle is then one slice
        lengths = ends - starts
        at = np.cumsum(lengths + 1) - lengths - 1
        flat = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
        inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        flat[inside + np.repeat(at, lengths)] = LOWER[data[inside + np.repeat(starts, lengths)]]
        joined, stop = flat.tobytes(), at + lengths
        words = np.bincount(text, minlength=n)
        last = np.cumsum(words)[text] - 1  # the last word of the same text
        begin = np.arange(len(text))
        end = np.minimum(begin + size - 1, last)
        full = (begin + size - 1 <= last) | (begin == last - words[text] + 1)
        begin, end, owner = begin[full], end[full], text[full]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(at[begin].tolist(), stop[end].tolist())), np.uint64, len(begin))
        return [bit_majority(hashes, owner, n)]

    return one


def add_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", size: int = 3) -> DataFrame:
    """Append the 64-bit fingerprint as a long."""
    one = _fingerprints(size)

    def work(batch: pa.RecordBatch) -> list:
        (bits,) = by_round(batch.column(batch.schema.get_field_index(text_col)), one)
        return [pa.array(bits.view(np.int64))]

    return extend(docs, [StructField(out, LongType())], work)


def _halves(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _flips(half: Column) -> Column:
    """The half and its 32 variants with one bit turned."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(32)])
    return F.transform(masks, lambda m: half.bitwiseXOR(m))


def links(fingerprints: DataFrame, col: str = "fingerprint") -> DataFrame:
    """All pairs a < b of distinct fingerprints within the radius."""
    distinct = fingerprints.select(F.col(col).alias("fp")).filter(F.col("fp").isNotNull()).distinct()
    high, low = _halves(F.col("fp"))
    plain = distinct.select(
        F.col("fp").alias("a"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), high.alias("half")), F.struct(F.lit(1).alias("side"), low.alias("half")))).alias("key"),
    ).select("a", "key.side", "key.half")
    ball = distinct.select(
        F.col("fp").alias("b"),
        F.explode(
            F.concat(
                F.transform(_flips(high), lambda h: F.struct(F.lit(0).alias("side"), h.alias("half"))),
                F.transform(_flips(low), lambda h: F.struct(F.lit(1).alias("side"), h.alias("half"))),
            )
        ).alias("key"),
    ).select("b", "key.side", "key.half")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    return plain.hint("merge").join(ball, ["side", "half"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that each linked node reaches."""
    edges = stored(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")), "edges")
    while True:
        # large star: every larger neighbour of u goes to u's smallest neighbour (or u)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        after = stored(small.filter("u <> v").distinct(), "edges")
        # done when every node has one parent and no parent has a parent
        parents = after.agg(F.count("*"), F.count_distinct("u")).first()
        chained = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        edges = after
        if parents[0] == parents[1] and not chained:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, fingerprint (long) and component id."""
    marked = stored(
        add_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), "text", "fp").select("id", "fp"),
        "fingerprints",
    )
    classes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    root = components(links(marked, "fp")).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    reach = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(reach, "root").select("fp", "component_id")
    return marked.join(found, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Keep one document of each component: the smallest id (nulls last, then the row's place)."""
    names = docs.columns
    marked = add_fingerprint(docs.withColumn("__row", F.monotonically_increasing_id()), text_col, "__fp")
    marked = stored(marked, "fingerprints")
    narrow = marked.select(F.col("__fp").alias("fp"), F.struct(F.col(id_col).isNull().alias("void"), F.col(id_col).alias("id"), F.col("__row").alias("row")).alias("rank"))
    classes = narrow.groupBy("fp").agg(F.min("rank").alias("rank"))
    root = components(links(narrow, "fp")).select(F.col("node").alias("fp"), "root")
    firsts = classes.join(root, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("rank").alias("rank"))
    return marked.join(firsts.select(F.col("rank.row").alias("__row")), "__row", "left_semi").select(*names)


def duplicates_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
