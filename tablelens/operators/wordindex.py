"""A stored inverted index for typo-tolerant keyword and phrase search.

The index is three tables below one path, written once and read by every search:

* ``postings``: term, id, attribute, version of the row, positions, and the columns
  that searches filter by.  Rows are range-partitioned by term and id, so the
  postings of a frequent term lie in many files, and folders by a hash of the term
  let a search skip those it does not need.
* ``terms``: every distinct word with its number of postings and places.
* ``keys``: hashes under which a term is found by a word with typos.

Keys.  A word with one typo and its term share a string left by at most one
deletion from each.  With two typos, the term's two halves meet two pieces of the
word of which one has at most one typo, so that half and a start (or end) of the
word share such a string; a term of L letters has L + 2 keys, not L * L / 2.  Terms
above ``LONGEST`` letters are cut into thirds, one of which has no typo.  Keys only
propose terms; the edit distance decides, so nothing is lost or added.

Search ranks like ``textsearch.keyword_search``: words matched, then fewest typos,
then best attribute, then id.  A whole set of queries is searched at once, and no
text is read.  The postings of a text are made in the task that reads it.  A phrase starts from
the places of its rarest word; only there are the postings of its other words asked.

Null ids, null and empty texts give no postings; a null or empty query finds
nothing.  Rows with one id are one document; equal rows count once.  Words may have
any length.  An empty table gives an empty index.  Columns of the documents other
than those named are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablelens.functions.semantics import col
from tablelens.operators.textsearch import ONE_TYPO_LENGTH, SEARCH_ORDER, TWO_TYPO_LENGTH, words
from tablelens.session import durable, evenly

LONGEST = 64  # letters of the longest term whose halves get deletion keys
FOLDERS = 32
BLOCKS = 64  # pieces into which the postings of a term can be dealt
BROADCAST_ROWS = 100_000
ROUND_WORDS = 1 << 18  # words of whole texts whose postings are made at once


@dataclass(frozen=True)
class WordIndex:
    postings: DataFrame  # part, term, id, attribute, version, block, n, positions, and filter columns
    terms: DataFrame  # term, postings, places
    keys: DataFrame  # key, term
    attributes: tuple[str, ...]


def _part(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit("folder"), term), F.lit(FOLDERS)).cast("int")


def _key(kind: str, text: Column, length: Column | None = None) -> Column:
    return F.xxhash64(F.lit(kind), F.lit(0) if length is None else length, text)


def _spare(text: Column) -> Column:
    """A text of one letter or more, and all texts left by taking one letter out."""
    size = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1, size)))
    return F.concat(F.array(text), cut)


def _no_keys() -> Column:
    return F.array().cast("array<long>")


def term_keys(term: Column) -> Column:
    """The keys under which a term is stored."""
    size = F.length(term)
    half, third = F.floor(size / 2).cast("int"), F.floor(size / 3).cast("int")
    whole = F.transform(_spare(term), lambda x: _key("whole", x))
    start = F.transform(_spare(F.substr(term, F.lit(1), half)), lambda x: _key("start", x, size))
    end = F.transform(_spare(F.substr(term, half + 1, size - half)), lambda x: _key("end", x, size))
    thirds = [F.substr(term, third * i + 1, third if i < 2 else size - 2 * third) for i in range(3)]
    one = size.between(ONE_TYPO_LENGTH - 1, TWO_TYPO_LENGTH)  # terms that words with one typo can mean
    two = size.between(TWO_TYPO_LENGTH - 2, LONGEST)
    return F.array_distinct(
        F.concat(
            F.array(_key("same", term)),
            F.when(one, whole).otherwise(_no_keys()),
            F.when(two, F.concat(start, end)).otherwise(_no_keys()),
            F.when(size > LONGEST, F.array(*[_key(f"third{i}", t, size) for i, t in enumerate(thirds)])).otherwise(_no_keys()),
        )
    )


def word_keys(word: Column) -> Column:
    """The keys that find every term within the typos allowed for a word."""
    size = F.length(word)

    def halves(length: Column) -> Column:
        half = F.floor(length / 2).cast("int")
        near = F.array(F.lit(-1), F.lit(0), F.lit(1))
        starts = F.transform(near, lambda d: F.transform(_spare(F.substr(word, F.lit(1), half + d)), lambda x: _key("start", x, length)))
        ends = F.transform(near, lambda d: F.transform(_spare(F.substr(word, size - (length - half + d) + 1, length - half + d)), lambda x: _key("end", x, length)))
        return F.concat(F.flatten(starts), F.flatten(ends))

    def thirds(length: Column) -> Column:
        third = F.floor(length / 3).cast("int")
        shifts = F.array(*[F.lit(d) for d in range(-2, 3)])

        def part(i: int) -> Column:
            size = third if i < 2 else length - 2 * third
            return F.transform(shifts, lambda d: _key(f"third{i}", F.substr(word, third * i + 1 + d, size), length))

        return F.concat(*[part(i) for i in range(3)])

    lengths = F.sequence(size - 2, size + 2)
    two = F.flatten(F.transform(lengths, lambda n: F.when(n <= LONGEST, halves(n)).otherwise(thirds(n))))
    one = F.transform(_spare(word), lambda x: _key("whole", x))
    near = F.when(size >= TWO_TYPO_LENGTH, two).when(size >= ONE_TYPO_LENGTH, one).otherwise(_no_keys())
    return F.array_distinct(F.concat(F.array(_key("same", word)), near))


def build(documents: DataFrame, path: str, key: str = "id", attributes: Sequence[str] = SEARCH_ORDER, keep: Sequence[str] = ("resource_type", "user_id")) -> WordIndex:
    """Write the index of ``documents`` below ``path``; ``attributes`` are searched, best first, and ``keep`` can be filtered by."""
    spark = documents.sparkSession
    kept = [f"keep_{i}" for i in range(len(keep))]
    texts = F.array(*[F.struct(F.lit(i).alias("attribute"), col(a).cast("string").alias("text")) for i, a in enumerate(attributes)])
    rows = documents.select(col(key).alias("id"), *[col(c).alias(k) for c, k in zip(keep, kept)], F.inline(texts)).filter("id IS NOT NULL AND text IS NOT NULL")
    rows = evenly(rows)
    version = F.xxhash64("text", *kept).alias("version")
    found = _placed(rows.select("id", "attribute", version, *kept, words(F.col("text")).alias("words")))
    order = ["part", "term", "id"]
    dealt = found.withColumn("part", _part("term")).repartitionByRange(*order)
    # equal rows meet in a partition; no second shuffle
    once = dealt.groupBy(*order, "attribute", "version", *kept).agg(F.first("positions").alias("positions"))
    block = F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).cast("int").alias("block")
    postings = once.select("part", "term", "id", "attribute", "version", block, F.size("positions").alias("n"), "positions", *kept)
    postings.sortWithinPartitions(*order).write.partitionBy("part").parquet(f"{path}/postings")
    stored = _read(spark, f"{path}/postings", postings)
    terms = stored.groupBy("term").agg(F.count(F.lit(1)).alias("postings"), F.sum("n").alias("places"))
    terms.write.parquet(f"{path}/terms")
    terms = _read(spark, f"{path}/terms", terms)
    keys = evenly(terms).select(F.explode(term_keys(F.col("term"))).alias("key"), "term")
    keys.write.parquet(f"{path}/keys")  # searches scan them, so no shuffle, and no hot key
    names = dict(zip(kept, keep))
    return WordIndex(stored.withColumnsRenamed(names), terms, _read(spark, f"{path}/keys", keys), tuple(attributes))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with one row for every distinct one of its ``words``: ``term`` and ``positions``, made in the task that reads the text."""
    others = [f for f in rows.schema.fields if f.name != "words"]
    schema = T.StructType([*others, T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in others]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("words"))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                done = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + ROUND_WORDS, side="right")))
                flat = lists.slice(first, last - first).flatten()
                if len(flat):
                    sizes = np.diff(ends[first:last], prepend=done)
                    row = np.repeat(np.arange(first, last), sizes)
                    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    coded = flat.dictionary_encode()
                    key = row * len(coded.dictionary) + coded.indices.to_numpy()
                    order = np.argsort(key, kind="stable")
                    starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                    terms = coded.dictionary.take(coded.indices.take(pa.array(order[starts])))
                    cuts = pa.array(np.append(starts, len(order)), pa.int32())
                    places = pa.ListArray.from_arrays(cuts, pa.array(place[order], pa.int32()))
                    at = pa.array(row[order[starts]])
                    kept = [batch.column(batch.schema.get_field_index(n)).take(at) for n in names]
                    yield pa.RecordBatch.from_arrays([*kept, terms, places], names=[*names, "term", "positions"])
                first = last

    return rows.mapInArrow(work, schema)


def _read(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path)


def _small(df: DataFrame) -> bool:
    """Whether a stored table may be sent to every task."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _meet(index: WordIndex, wanted: DataFrame, equal: dict | None) -> DataFrame:
    """The postings of the terms of ``wanted``, which is stored; beyond the size of a broadcast, dealt by term and block."""
    postings = index.postings
    for name, value in (equal or {}).items():
        postings = postings.filter(col(name) == F.lit(value))
    postings = postings.select("part", "term", "block", "id", "attribute", "version", "positions")
    wanted = wanted.withColumn("part", _part("term"))
    if _small(wanted):
        return postings.join(F.broadcast(wanted), ["part", "term"])
    dealt = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    return postings.join(dealt, ["part", "term", "block"])


def match_terms(index: WordIndex, asked: DataFrame) -> DataFrame:
    """(word, term, typos) for every distinct ``word`` of ``asked`` and the terms within its typos."""
    probes = asked.select("word").distinct().select("word", F.explode(word_keys(F.col("word"))).alias("key"))
    met = index.keys.join(probes, "key").select("word", "term").distinct()
    size = F.length("word")
    typos = F.when(F.col("word") == F.col("term"), 0)
    typos = typos.when(size >= TWO_TYPO_LENGTH, F.levenshtein("word", "term", 2)).when(size >= ONE_TYPO_LENGTH, F.levenshtein("word", "term", 1))
    return met.withColumn("typos", typos).filter("typos >= 0")


def search(index: WordIndex, queries: DataFrame, key: str = "query", text: str = "text", limit: int | None = 20, offset: int = 0, equal: dict | None = None) -> DataFrame:
    """(query, id, matched, typos, attribute, rank) of the documents that each query finds.

    ``equal`` keeps documents whose kept columns have these values; without a limit
    all documents found are returned.
    """
    split = F.split(F.lower(col(text)), r"(?U)\s+")
    asked = queries.select(col(key).alias("query"), F.explode(split).alias("word")).filter("word <> ''").distinct()
    wanted = durable(asked.join(match_terms(index, asked), "word").select("query", "word", "term", "typos"))
    hits = _meet(index, wanted, equal)
    hits = hits.select("query", "id", "word", "typos", "attribute").repartition("query", "id")  # one shuffle for both sums
    best = hits.groupBy("query", "id", "word").agg(F.min("typos").alias("typos"), F.min("attribute").alias("attribute"))
    found = best.groupBy("query", "id").agg(F.count(F.lit(1)).alias("matched"), F.sum("typos").alias("typos"), F.min("attribute").alias("attribute"))
    order = Window.partitionBy("query").orderBy(F.col("matched").desc(), "typos", "attribute", "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit)) if limit is not None else ranked.filter(F.col("rank") > offset)


def phrase_search(index: WordIndex, queries: DataFrame, key: str = "query", text: str = "text", equal: dict | None = None) -> DataFrame:
    """(query, id, attribute, places): documents in which a query's words stand one after another.

    ``places`` counts the starts, in the attribute of the row that holds them; repeated
    and overlapping ones count.  Words are those of the index, without typos.
    """
    asked = queries.select(col(key).alias("query"), words(col(text)).alias("words")).distinct()
    steps = asked.select("query", F.size("words").alias("size"), F.xxhash64("words").alias("phrase"), F.posexplode("words").alias("step", "term"))
    # every phrase starts from its rarest word; an unknown one has no places
    held = steps.join(index.terms.select("term", "places"), "term", "left").withColumn("places", F.coalesce("places", F.lit(0)))
    phrase = held.groupBy("query", "size", "phrase").agg(F.min(F.struct("places", "step", "term")).alias("rare"), F.collect_list(F.struct("step", "term")).alias("steps"))
    others = F.filter("steps", lambda s: s["step"] != F.col("rare.step"))
    rarest = durable(phrase.select("query", "size", "phrase", F.col("rare.term").alias("term"), F.col("rare.step").alias("at"), others.alias("others")))
    row = ["query", "size", "phrase", "id", "attribute", "version"]
    first = _meet(index, rarest, equal).select(*row, "others", F.transform("positions", lambda p: p - F.col("at")).alias("starts"))
    asked_of = first.select(*row, "starts", F.inline("others"))
    rest = durable(rarest.select(F.inline("others")).select("term").distinct())
    held = _meet(index, rest, equal).select("term", "id", "attribute", "version", "positions")
    met = asked_of.join(held, ["term", "id", "attribute", "version"])
    places = F.array_intersect(F.transform("starts", lambda s: s + F.col("step")), "positions")
    starts = met.select(*row, "step", F.explode(places).alias("place")).groupBy(*row, (F.col("place") - F.col("step")).alias("start")).agg(F.count(F.lit(1)).alias("met"))
    whole = starts.filter(F.col("met") == F.col("size") - 1).select("query", "id", "attribute")
    alone = first.filter("size = 1").select("query", "id", "attribute", F.explode("starts")).drop("col")
    return whole.unionByName(alone).groupBy("query", "id", "attribute").agg(F.count(F.lit(1)).alias("places"))
