"""Hidden Markov language model with exact sequence likelihoods.

Tokens: words (A-Z lower-cased, split at ASCII white space), then one end.

Base model: p(w) = (c+1)/(N+V+1) over the V known tokens and one unknown.  The
counts are exact: words are counted batch by batch, then in a shuffle, and the
words of a document meet their counts in a join.  The ``frequent`` most counted
words (a bounded table) are looked up in the scan; only the others are
shuffled, once per document and word.

Hidden Markov model: latent states emit tokens, and every training word has its
own emission probability in every state.  They are kept as ratios to the base
model, r(w) = p(w | state)/p(w).  Unknown words have ratio 1.  So p(text) = base
score times the sum over state paths of moves and ratios.  Baum-Welch trains the
states: every task runs scaled forward and backward recursions over its whole
training texts and returns expected counts by word; Spark sums them.  A long text is
cut into segments that run side by side: matrices of states x states chain them exactly.  With E(w)
the expected count of a word in a state and T that state's total, r(w) =
(E(w) N/T + 1)/(c+1): each state is smoothed like the base model, and sums to 1.
Scoring runs the scaled forward recursion over each whole document.

Where ratios live: those of the head of the vocabulary (a bounded table) are an
array; a task returns the head's expected counts packed in chunks, which are
summed chunk by chunk.  A word that training holds once stays with the one text
that has it, so nothing about it is shuffled until another text needs it for its
score.  All other words have a number, and their ratios are a stored table that is
joined to the texts by number in every round.  The texts' codes lie in buckets of
one stored table and are never shuffled again: the ratios come to them.  Tables that a later round replaces
are deleted once the later one is stored.

Null and empty texts are the end alone; texts may have any length.  Null ids fall
in fold 0; repeated rows are scored each; words with equal counts are in the head
together or not at all.  Columns other than the id and the text are not read, so
their names do not matter.  With no training documents N = V = 0, and the score is
the base score; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StringType, StructField, StructType

from tablelens.llm.common import LOWER, ROUND_BYTES, WHITE, extend, fold, mix, rounds, runs, span_hashes, text_bytes
from tablelens.session import scratch_path

STATES = 4
FREQUENT = 1 << 18
CLASSES = FREQUENT + 2  # the head, the end and the unknown: what the array of ratios holds
STEPS = 3
SEGMENT = 64  # tokens of a window where windows are asked for
SPAN = 512  # tokens of a segment of a whole text; the segments of a text run side by side
ROUND_TOKENS = 1 << 18  # tokens of one round of recursions (one longer text is one piece)
CHUNK = 1 << 12  # head words whose expected counts travel as one packed row
END, UNKNOWN = 0, 1
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Drop the shuffle files of each write in the block as soon as it is done."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def _kept(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` once below the shared folder, and read it from there."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _forget(spark: SparkSession, path: str) -> None:
    """Delete a table of this module that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@dataclass(frozen=True)
class Vocabulary:
    """Counts of the training tokens: totals, and the bounded head of the table."""

    counts: DataFrame  # word, id, c (without the end)
    path: str  # of counts
    total: int  # N
    distinct: int  # V
    ends: int
    words: pa.Array  # at most `frequent` of the most counted words, descending, ties by word
    numbers: np.ndarray
    seeds: np.ndarray  # a hash of each word of the head


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df`` below the shared folder in buckets of ``key``: joins on that key leave its rows where they are."""
    spark, path, name = df.sparkSession, scratch_path(df.sparkSession, "encoded"), f"encoded_{uuid.uuid4().hex}"
    with _cleaning(spark):
        writer = df.repartition(buckets, key).write.option("compression", "zstd").option("path", path)
        writer.bucketBy(buckets, key).saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only; the files have their own path
    return table


def _buckets(spark: SparkSession, size: int) -> int:
    """Buckets of about 32 MB of text, small tables spread over the cores, and no more than Spark's own bound."""
    spread = min(spark.sparkContext.defaultParallelism, -(-size // (4 << 20)))
    return min(max(1, spread, -(-size // (32 << 20))), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))


def _planes(codes: np.ndarray) -> np.ndarray:
    """32-bit codes, small ones of either sign first, as four planes of bytes, which compress well."""
    small = ((codes << 1) ^ (codes >> 31)).astype(np.uint32)
    return np.ascontiguousarray(small.view(np.uint8).reshape(-1, 4).T)


def _from_planes(planes: np.ndarray) -> np.ndarray:
    small = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
    return (small >> 1) ^ -(small & 1)


def _pack(codes: np.ndarray) -> bytes:
    return _planes(codes).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return _from_planes(np.frombuffer(packed, np.uint8).reshape(4, -1))


def _unpack_all(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all texts of a column end to end, and how many each has."""
    data, offsets = text_bytes(column)
    ends = offsets // 4
    planes = np.empty((4, int(ends[-1])), np.uint8)
    for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()):
        planes[:, x:y] = data[4 * x : 4 * y].reshape(4, -1)
    return _from_planes(planes), np.diff(ends)


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Words of these lengths that lie end to end in ``data``."""
    ends = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(data))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of every few rounds of texts with their counts."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for low, high in rounds(offsets, 8 * ROUND_BYTES):
            words = []
            for a, b in rounds(offsets[low : high + 1]):
                a, b = a + low, b + low
                part = LOWER[data[offsets[a] : offsets[b]]]
                inside = ~WHITE[part]
                starts, ends, _ = runs(inside.view(np.uint8), offsets[a : b + 1] - offsets[a])
                words.append(_strings(part[inside], ends - starts))
            counted = pa.chunked_array(words, pa.string()).value_counts()
            yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], names=["word", "c"])


def count_words(docs: DataFrame, text_col: str = "text", frequent: int = FREQUENT) -> Vocabulary:
    """Exact token counts of all texts of ``docs``."""
    found = docs.select(text_col).mapInArrow(_count_batches, "word string, c long")
    counts, path = _kept(found.groupBy("word").agg(F.sum("c").alias("c")).select("word", F.monotonically_increasing_id().alias("id"), "c"), "vocabulary")
    ends = docs.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the head is cut at a count: as many whole steps of counts as fit into `frequent` words
    step = F.floor(F.log2("c") * 64).cast("int")
    least = None
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # about 64 x 60 rows at most
        frequent -= row["count"]
        if frequent < 0:
            break
        least = row["step"]
    head = counts.filter(step >= least if least is not None else F.lit(False)).select("word", "c", F.xxhash64("word").alias("seed"))
    head = head.toArrow().sort_by([("c", "descending"), ("word", "ascending")]).combine_chunks()  # no Python object a word
    numbers, seeds = (head.column(k).to_numpy().astype(np.int64) for k in ("c", "seed"))
    return Vocabulary(counts, path, sums[0] + ends, sums[1] + (ends > 0), ends, pa.concat_arrays([pa.array([], pa.string()), *head.column("word").cast(pa.string()).chunks]), numbers, seeds)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Where the sorted 64-bit ``keys`` with each possible beginning start (about four beginnings a key), and the bits after it."""
    bits = max(1, len(keys).bit_length() + 1)
    after = np.uint64(64 - bits)
    return np.append(0, np.cumsum(np.bincount((keys >> after).astype(np.int64), minlength=1 << bits))).astype(np.int32), after


def _lookup(hashes: np.ndarray, keys: np.ndarray, order: np.ndarray, slots: tuple[np.ndarray, np.uint64]) -> np.ndarray:
    """Rank of every hash in the head of the vocabulary, or -1."""
    rank = np.full(len(hashes), -1)
    first, after = slots
    slot = (hashes >> after).astype(np.int64)
    at, end = first[slot], first[slot + 1]
    left = np.flatnonzero(at < end)
    at, end, sought = at[left], end[left], hashes[left]
    while len(left):  # as often as most keys begin alike
        equal = keys[at] == sought
        rank[left[equal]] = order[at[equal]]
        more = ~equal & (at + 1 < end)
        left, at, end, sought = left[more], at[more] + 1, end[more], sought[more]
    return rank


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Append what later passes need of each text, which may be left out.

    ``codes`` (packed, a number a token, the end last: place in the head plus 2, or -1
    minus the place in ``rest``), ``n_tokens``, ``n_head`` and ``head_log`` (count,
    and sum of log10(c+1), of tokens in the head), and ``rest``: the other words
    with their number in the text.
    """
    data, offsets = text_bytes(vocabulary.words)
    hashes = span_hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(hashes)
    keys = hashes[order]
    slots = _slots(keys)
    logs = np.log10(vocabulary.numbers + 1.0)

    def work(batch: pa.RecordBatch) -> list:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text_col)))
        coded, tokens, known, gain, held, rest, times = [], [], [], [], [], [], []
        for a, b in rounds(offsets):
            part, local = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
            starts, ends, text = runs((~WHITE)[part].view(np.uint8), local)
            n = b - a
            hashed = span_hashes(part, starts, ends)
            rank = _lookup(hashed, keys, order, slots)
            inside = rank >= 0
            count = np.bincount(text, minlength=n)
            first = np.cumsum(count) - count
            # one place more for the end of every text
            code = np.full(len(text) + n, END, np.int32)
            spot = np.arange(len(text)) + text
            code[spot] = rank + 2
            bounds = np.append(first + np.arange(n), len(code))
            tokens.append(count + 1)
            known.append(np.bincount(text[inside], minlength=n))
            gain.append(np.bincount(text[inside], weights=logs[rank[inside]], minlength=n))
            others = np.flatnonzero(~inside)
            first_byte, length, owner = starts[others], (ends - starts)[others], text[others]
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            words = _strings(part[place + np.repeat(first_byte, length)], length)
            number = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            _, firsts, which, n_times = np.unique(owner * (len(words) + 1) + number, return_index=True, return_inverse=True, return_counts=True)
            order_met = np.argsort(firsts)  # the words of a text are numbered as they are met
            met = np.empty(len(firsts), np.int64)
            met[order_met] = np.arange(len(firsts))
            held.append(np.bincount(owner[firsts], minlength=n))
            code[spot[others]] = -1 - (met[which] - (np.cumsum(held[-1]) - held[-1])[owner])
            rest.append(words.take(pa.array(firsts[order_met])))
            times.append(n_times[order_met])
            planes = _planes(code)
            coded += [planes[:, x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        pairs = pa.StructArray.from_arrays([pa.concat_arrays(rest), pa.array(np.concatenate(times), pa.int64())], names=["word", "n"])
        ends_held = np.append(0, np.cumsum(np.concatenate(held))).astype(np.int32)
        return [pa.array(coded, pa.binary()), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(known)), pa.array(np.concatenate(gain)), pa.ListArray.from_arrays(pa.array(ends_held), pairs)]

    pair = StructType([StructField("word", StringType()), StructField("n", LongType())])
    fields = [StructField("codes", BinaryType()), StructField("n_tokens", LongType()), StructField("n_head", LongType()), StructField("head_log", DoubleType()), StructField("rest", ArrayType(pair))]
    return extend(docs, fields, work, () if keep_text else (text_col,))


@dataclass(frozen=True)
class HiddenMarkov:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x kinds of tokens (probabilities, or ratios to the base model)


def _first_ratios(seeds: np.ndarray, states: int) -> np.ndarray:
    """Ratios between 0.5 and 1.5 for words with these hashes, words x states."""
    hashes = seeds.astype(np.int64).view(np.uint64)
    return np.stack([0.5 + (mix(hashes + np.uint64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)) / 2.0**53 for s in range(states)], 1)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _names(states: int) -> list[str]:
    return [f"r{s}" for s in range(states)]


def _floats(values: np.ndarray) -> list[pa.Array]:
    """The columns of a matrix as 32-bit columns of a table."""
    return [pa.array(v) for v in np.ascontiguousarray(values.T, np.float32)]


def _first_mass(counts: DataFrame, states: int) -> np.ndarray:
    """Sum of (c+1) times the first ratio over all words, by state."""
    names = _names(states)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(states)
        for batch in batches:
            if batch.num_rows:
                total += (_numbers(batch, "c") + 1.0) @ _first_ratios(_numbers(batch, "seed"), states)
        yield pa.RecordBatch.from_arrays([pa.array([t]) for t in total], names=names)

    sums = counts.select("c", F.xxhash64("word").alias("seed")).mapInArrow(work, ", ".join(f"{n} double" for n in names))
    return np.array(sums.agg(*[F.coalesce(F.sum(n), F.lit(0.0)) for n in names]).first())


def _first_shared(counts: DataFrame, states: int) -> DataFrame:
    """id, r0, r1, ...: first ratios, not yet scaled, of the words that several places hold."""
    names = _names(states)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = _first_ratios(_numbers(batch, "seed"), states)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(made.T))], names=["id", *names])

    return counts.filter("c > 1").select("id", F.xxhash64("word").alias("seed")).mapInArrow(work, "id long, " + ", ".join(f"{n} double" for n in names))


def _first_own(pairs: DataFrame, states: int) -> DataFrame:
    """row, spots, packed: places and first ratios of the words that training holds once, with their texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = batch.column(1)
                place, seed = (x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten())
                ends = np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))
                ratios, begin = _first_ratios(seed, states).astype(np.float32), 0
                spots, packed = [], []
                for end in ends.tolist():
                    spots.append(place[begin:end].astype(np.int32).tobytes())
                    packed.append(ratios[begin:end].tobytes())
                    begin = end
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spots, pa.binary()), pa.array(packed, pa.binary())], names=["row", "spots", "packed"])

    found = pairs.filter("training AND c = 1").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "seed"))).alias("found"))
    return found.mapInArrow(work, "row long, spots binary, packed binary")


def _cut(sizes: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, number within the owner, begin and size of the segments of sequences laid end to end."""
    count = (sizes + segment - 1) // segment
    owner = np.repeat(np.arange(len(sizes)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = (np.cumsum(sizes) - sizes)[owner] + inside * segment
    return owner, inside, begin, np.minimum(segment, sizes[owner] - inside * segment)


def _live(size: np.ndarray) -> list[int]:
    """How many of these sizes, which fall, are larger than 0, 1, ..."""
    return np.searchsorted(-size, -np.arange(int(size[0]))).tolist()


def _scaled(values: np.ndarray, t: int) -> np.ndarray:
    """Columns where only directions are used, brought back to sum 1 every eighth step."""
    return values / values.sum(0) if t % 8 == 7 else values


def _boundaries(flat: np.ndarray, inside: np.ndarray, begin: np.ndarray, size: np.ndarray, model: HiddenMarkov, back: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each segment takes from its neighbours, so that all segments of a sequence run side by side.

    Columns: the states it starts from, those at the end of the segment before (0 for a first
    one), and, where ``back``, the direction of the backward numbers at its end.  Exact: the product
    of moves and emissions over a segment is a matrix of states x states, and the matrices are
    chained.  A first segment is only left and a last one only entered: a vector does for those.
    """
    states, n = len(model.start), len(begin)
    enter, before, leave = np.repeat(model.start[:, None], n, 1), np.zeros((states, n)), np.ones((states, n))
    later, ahead = inside > 0, np.append(inside[1:], 0) > 0
    if not later.any():
        return enter, before, leave
    table = model.emit.T
    firsts, middles, lasts = np.flatnonzero(~later & ahead), np.flatnonzero(later & ahead), np.flatnonzero(later & ~ahead)
    ended, begun = np.zeros((states, n)), np.zeros((states, n))  # the end of each first segment, the beginning of each last one
    at, a = begin[firsts], enter[:, firsts]  # all segments but the last of a sequence are of one size
    for t in range(int(size[firsts[0]])):
        a = _scaled((a if t == 0 else model.move.T @ a) * table[flat[at + t]].T, t)
    ended[:, firsts] = a
    whole = np.zeros((n, states, states))
    if len(middles):
        at, product = begin[middles], np.repeat(np.eye(states)[:, None, :], len(middles), 1)  # from, segment, to
        for t in range(int(size[middles[0]])):
            if t:
                product = (product.reshape(-1, states) @ model.move).reshape(states, -1, states)
            product = product * table[flat[at + t]]
            if t % 8 == 7:
                product /= product.sum((0, 2))[:, None]  # only directions are used
        whole[middles] = product.transpose(1, 0, 2)
    if back:
        lasts = lasts[np.argsort(-size[lasts], kind="stable")]
        at, b = (begin + size)[lasts] - 1, np.ones((states, len(lasts)))
        for t, k in enumerate(_live(size[lasts])):
            b[:, :k] = _scaled((model.move @ b[:, :k] if t else b[:, :k]) * table[flat[at[:k] - t]].T, t)
        begun[:, lasts] = b
    numbered = np.flatnonzero(later)[np.argsort(inside[later], kind="stable")]
    bounds = np.searchsorted(inside[numbered], np.arange(1, int(inside.max()) + 2))
    levels = [numbered[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]  # the second ones, the third ones, ...
    for those in levels:
        end = ended[:, those - 1] + np.einsum("ik,kij->jk", enter[:, those - 1], whole[those - 1])  # one of them is 0
        before[:, those] = end / end.sum(0)
        enter[:, those] = model.move.T @ before[:, those]
    for those in levels[::-1] if back else []:
        behind = model.move @ (begun[:, those] + np.einsum("kij,jk->ik", whole[those], leave[:, those]))
        leave[:, those - 1] = behind / behind.sum(0)
    return enter, before, leave


def expected_counts(codes: list[np.ndarray], model: HiddenMarkov, segment: int | None = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions, and the log likelihood, over windows of the sequences (None: over whole sequences)."""
    states, kinds = model.emit.shape
    start, move, emit, log = np.zeros(states), np.zeros((states, states)), np.zeros((states, kinds)), 0.0
    flat, table = np.concatenate(codes).astype(np.int64), model.emit.T
    sizes = np.array([len(c) for c in codes])
    _, inside, begin, size = _cut(sizes, segment or SPAN)
    if segment:  # windows stand alone
        inside = np.zeros_like(inside)
    enter, before, leave = _boundaries(flat, inside, begin, size, model)
    order = np.argsort(-size, kind="stable")  # longest first: those still running are a prefix
    for low, high in rounds(np.concatenate([[0], np.cumsum(size[order])]), ROUND_TOKENS):
        these = order[low:high]
        live = _live(size[these])
        ends = np.cumsum(live)
        step = np.repeat(np.arange(len(live)), live)
        kind = flat[begin[these][np.arange(len(step)) - (ends - live)[step]] + step]
        e = np.ascontiguousarray(table[kind].T)
        alphas, scales = np.empty_like(e), np.empty(len(kind))
        a = enter[:, these]
        for t, (k, z) in enumerate(zip(live, ends.tolist())):
            a = (a if t == 0 else model.move.T @ a[:, :k]) * e[:, z - k : z]
            s = a.sum(0)
            a = a / s
            alphas[:, z - k : z], scales[z - k : z] = a, s
        log += float(np.log(scales).sum())
        beta, last = leave[:, these], np.append(live[1:], 0)
        for t in range(len(live) - 1, -1, -1):
            k, z, over = live[t], int(ends[t]), int(last[t])  # the windows from `over` on end here
            a = alphas[:, z - k : z]
            now = beta[:, :k]
            now[:, over:] /= (a[:, over:] * now[:, over:]).sum(0)
            back = e[:, z - k : z] * now / scales[z - k : z]
            a *= now  # from here on the expected states
            if t == 0:
                first = inside[these] == 0
                start += a[:, first].sum(1)
                move += model.move * (before[:, these] @ back.T)
            else:
                y = z - k
                move += model.move * (alphas[:, y - live[t - 1] : y][:, :k] @ back.T)
                beta[:, :k] = model.move @ back
        for i in range(states):
            emit[i] += np.bincount(kind, weights=alphas[i], minlength=kinds)
    return start, move, emit, log


@dataclass(frozen=True)
class Model:
    """All of a trained model but the ratios of the words outside its head."""

    hidden: HiddenMarkov
    share: np.ndarray  # by state: the scale of the first ratios, later N / T
    trained: bool

    def ratio(self, number, c, share):
        """A word's ratio from its first ratio, or from its expected count and the count ``c``."""
        return (number * share + 1) / (c + 1) if self.trained else number * share

    def own(self, packed: np.ndarray) -> np.ndarray:
        return self.ratio(packed.reshape(-1, len(self.share)), 1, self.share)

    def columns(self) -> list[Column]:
        return [self.ratio(F.col(n), F.col("c"), F.lit(float(z))).cast("float").alias(n) for n, z in zip(_names(len(self.share)), self.share)]


def _with_ratios(coded: DataFrame, buckets: int, pairs: DataFrame, shared: DataFrame, own: DataFrame, model: Model) -> DataFrame:
    """Append ``seen`` (place in ``rest``, number and ratios of every shared word), ``spots`` and ``packed`` (of own words).

    Only what is appended moves: to the buckets of ``coded``.  The sides that are hashed are
    the ratios of a part's words, and what is appended to a bucket.
    """
    met = pairs.select("row", "place", "id", "c").join(shared.hint("shuffle_hash"), "id").select("row", F.struct("place", "id", *model.columns()).alias("met"))
    seen = met.repartition(buckets, "row").groupBy("row").agg(F.collect_list("met").alias("seen"))
    return coded.join(seen.hint("shuffle_hash"), "row", "left").join(own.repartition(buckets, "row").hint("shuffle_hash"), "row", "left")


def _tables(batch: pa.RecordBatch, model: Model) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray | None], list[pa.Array]]:
    """The codes of a batch as rows of one table of ratios: the head's, then those of each text's other words.

    Also the rows of the shared words, those of each text's own words, and the columns of ``seen``.
    """
    get = lambda name: batch.column(batch.schema.get_field_index(name))
    head = model.hidden.emit.T
    others = _numbers(batch, "n_rest").astype(np.int64)
    base = len(head) + np.cumsum(others) - others
    table = np.concatenate([head, np.ones((int(others.sum()), head.shape[1]))])
    seen = get("seen")
    place, *columns = seen.flatten().flatten()
    lengths = seen.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    shared = np.repeat(base, lengths) + place.to_numpy(zero_copy_only=False)
    table[shared] = np.stack([r.to_numpy(zero_copy_only=False) for r in columns[1:]], 1)
    own: list[np.ndarray | None] = []
    for b, spots, packed in zip(base.tolist(), get("spots").to_pylist(), get("packed").to_pylist()):
        own.append(None if spots is None else b + np.frombuffer(spots, np.int32).astype(np.int64))
        if spots is not None:
            table[own[-1]] = model.own(np.frombuffer(packed, np.float32))
    flat, sizes = _unpack_all(get("codes"))
    flat = np.where(flat < 0, np.repeat(base, sizes) - 1 - flat, flat)
    return np.split(flat, np.cumsum(sizes)[:-1]), table, shared, own, columns


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in pieces of about ROUND_TOKENS tokens (one longer text is one piece)."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.binary_length(batch.column(batch.schema.get_field_index("codes"))).to_numpy(zero_copy_only=False) // 4
            for a, b in rounds(np.append(0, np.cumsum(sizes, dtype=np.int64)), ROUND_TOKENS):
                yield batch.slice(a, b - a)


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One packed sum per chunk of the head; what a task holds is bounded by the head."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(packed, np.float64)
            sums[at] = sums[at] + part if at in sums else part
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["at", "packed"])


def _count(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Expected counts of a task's texts: rows of shared words, of texts with own words, and of chunks of the head."""
    hidden = model.hidden
    states, size = hidden.emit.shape
    names = ["row", "at", "id", "spots", "packed", *_names(states)]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.float32()] * states]

    def rows(n: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[k] if k in given else pa.nulls(n, t) for k, t in zip(names, kinds)], names=names)

    head, rest = np.zeros((size, states)), np.zeros((states + 3, states))  # rest: starts, moves, totals, log likelihood
    for batch in _pieces(batches):
        codes, table, shared, own, columns = _tables(batch, model)
        start, move, emit, log = expected_counts(codes, HiddenMarkov(hidden.start, hidden.move, table.T), None)
        emit = emit.T
        head += emit[:size]
        rest[0] += start
        rest[1 : 1 + states] += move
        rest[-2] += emit.sum(0)
        rest[-1, 0] += log
        if len(shared):
            yield rows(len(shared), id=columns[0], **dict(zip(names[5:], _floats(emit[shared]))))
        have = [i for i, at in enumerate(own) if at is not None]
        if have:
            packed = pa.array([emit[own[i]].astype(np.float32).tobytes() for i in have], pa.binary())
            yield rows(len(have), row=batch.column(batch.schema.get_field_index("row")).take(pa.array(have)), spots=batch.column(batch.schema.get_field_index("spots")).take(pa.array(have)), packed=packed)
    at = [a for a in range(0, size, CHUNK) if head[a : a + CHUNK].any()]
    packed = [rest.tobytes(), *[head[a : a + CHUNK].tobytes() for a in at]]
    yield rows(len(packed), at=pa.array([-1, *[a // CHUNK for a in at]], pa.int32()), packed=pa.array(packed, pa.binary()))


def train(coded: DataFrame, buckets: int, pairs: DataFrame, vocabulary: Vocabulary, states: int = STATES, steps: int = STEPS) -> tuple[Model, DataFrame, DataFrame, list[float]]:
    """Baum-Welch over all rows of ``coded``, which lie in ``buckets`` buckets of ``row``.

    The model, the expected counts of shared words (id, r0, ...) and own words (row, spots,
    packed), and what the states add to the log likelihood before each step.
    """
    spark, names = coded.sparkSession, _names(states)
    head = np.concatenate([np.ones((2, states)), _first_ratios(vocabulary.seeds, states)])
    counts = np.concatenate([[vocabulary.ends, 0], vocabulary.numbers]).astype(float)
    mass = (counts[:2, None] + 1).sum(0) + _first_mass(vocabulary.counts, states)
    scale = (vocabulary.total + vocabulary.distinct + 1) / mass
    least = vocabulary.numbers.min(initial=np.iinfo(np.int64).max)
    shared = _first_shared(vocabulary.counts.filter(F.col("c") < F.lit(int(least))), states)
    own, own_path = _kept(_first_own(pairs, states), "own")
    past = [vocabulary.path, own_path]  # what the next step is the last to read
    move = np.full((states, states), 0.5 / states) + 0.5 * np.eye(states)
    model, history = Model(HiddenMarkov(np.full(states, 1 / states), move, (head * scale).T), scale, False), []
    schema = "row long, at int, id long, spots binary, packed binary, " + ", ".join(f"{n} float" for n in names)
    several = pairs.filter("training AND c > 1")
    for _ in range(steps):
        held = spark.sparkContext.broadcast(model)  # bounded by the head
        found = _with_ratios(coded.select("row", "codes", "n_rest"), buckets, several, shared, own, model)
        made, made_path = _kept(found.mapInArrow(lambda batches, held=held: _count(batches, held.value), schema), "expected")
        held.destroy()
        for path in past:
            _forget(spark, path)
        past = [made_path]
        chunks = made.filter("at IS NOT NULL").select("at", "packed").mapInArrow(_add_chunks, "at int, packed binary")
        packed = {r["at"]: np.frombuffer(r["packed"], np.float64).reshape(-1, states) for r in chunks.repartition("at").mapInArrow(_add_chunks, "at int, packed binary").collect()}
        head, rest = np.zeros((len(counts), states)), packed.pop(-1)
        for at, part in packed.items():
            head[at * CHUNK : at * CHUNK + len(part)] = part
        share = vocabulary.total / np.maximum(rest[-2], 1e-300)
        shared = made.filter("id IS NOT NULL").groupBy("id").agg(*[F.sum(n).alias(n) for n in names])
        own = made.filter("row IS NOT NULL").select("row", "spots", "packed")
        start, move = rest[0] + 1 / states, rest[1 : 1 + states] + 1 / states
        hidden = HiddenMarkov(start / start.sum(), move / move.sum(1, keepdims=True), ((head * share + 1) / (counts + 1)[:, None]).T)
        model = Model(hidden, share, True)
        history.append(float(rest[-1, 0]))
    return model, shared, own, history


def forward(codes: list[np.ndarray], model: HiddenMarkov) -> np.ndarray:
    """Natural log likelihood of whole sequences by the scaled forward recursion."""
    sizes = np.array([len(c) for c in codes])
    flat, table = np.concatenate(codes).astype(np.int64), model.emit.T
    owner, inside, begin, size = _cut(sizes, SPAN)
    order = np.argsort(-size, kind="stable")
    alpha = _boundaries(flat, inside, begin, size, model, back=False)[0][:, order]
    at, log = begin[order], np.zeros(len(order))
    for t, k in enumerate(_live(size[order])):
        alpha = (alpha if t == 0 else model.move.T @ alpha[:, :k]) * table[flat[at[:k] + t]].T
        s = alpha.sum(0)
        alpha = alpha / s
        log[:k] += np.log(s)
    return np.bincount(owner[order], weights=log, minlength=len(codes))


def _own_words(own: DataFrame, states: int) -> DataFrame:
    """row, place, r0, ...: the packed numbers that stay with the texts, one row a word."""
    names = _names(states)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                spots = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
                values = np.concatenate([np.frombuffer(x, np.float32) for x in batch.column(2).to_pylist()]).reshape(-1, states)
                row = np.repeat(_numbers(batch, "row"), [len(x) for x in spots])
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.concatenate(spots)), *_floats(values)], names=["row", "place", *names])

    return own.select("row", "spots", "packed").mapInArrow(work, "row long, place int, " + ", ".join(f"{n} float" for n in names))


def add_gain(encoded: DataFrame, model: Model, kept: list[str], out: str = "gain") -> DataFrame:
    """The columns ``kept``, and what the states add to the base score (log10)."""
    held = encoded.sparkSession.sparkContext.broadcast(model)  # bounded by the head

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hidden = held.value.hidden
        for batch in _pieces(batches):
            codes, table, *_ = _tables(batch, held.value)
            gain = forward(codes, HiddenMarkov(hidden.start, hidden.move, table.T)) / math.log(10)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(k)) for k in kept], pa.array(gain)], names=[*kept, out])

    return encoded.mapInArrow(work, StructType([encoded.schema[k] for k in kept] + [StructField(out, DoubleType())]))


def score_texts(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, frequent: int = FREQUENT, states: int = STATES, steps: int = STEPS) -> DataFrame:
    """Score all of ``docs`` with a model of the rows where ``training`` (a Column) holds.

    Returns id, training, n_tokens, n_known, train_tokens, base_score, score.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    vocabulary = count_words(texts.filter("training"), "text", min(frequent, classes - 2))
    buckets = _buckets(docs.sparkSession, texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    coded = _bucketed(encode(texts, vocabulary, keep_text=False).withColumns({"row": F.monotonically_increasing_id(), "n_rest": F.size("rest")}), "row", buckets)
    words = coded.select("row", "training", F.posexplode("rest").alias("place", "r")).select("row", "training", "place", "r.word", "r.n")
    seed = F.when(F.col("training") & (F.col("c") == 1), F.xxhash64("word")).alias("seed")
    pairs, _ = _kept(words.join(vocabulary.counts, "word").select("row", "training", "place", "n", "id", "c", seed), "pairs")
    rare = pairs.groupBy("row").agg(F.sum("n").alias("n_rare"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"))
    columns = ["row", "id", "training", "n_tokens", "n_head", "head_log"]
    gained = coded.select(columns)
    if vocabulary.ends:
        model, shared, own, _ = train(coded.filter("training"), buckets, pairs, vocabulary, states, steps)
        once = F.col("training") & (F.col("c") == 1)
        needed = pairs.filter(once).join(pairs.filter("NOT training AND c = 1").select("id").distinct(), "id", "left_semi").select("row", "place", "id")
        lent = needed.join(_own_words(own, states), ["row", "place"]).select("id", *_names(states))
        whole = _with_ratios(coded.select(*columns, "codes", "n_rest"), buckets, pairs.filter(~once), shared.unionByName(lent), own, model)
        gained = add_gain(whole.join(rare.repartition(buckets, "row"), "row", "left"), model, [*columns, "n_rare", "rare_log"])
    else:
        gained = gained.withColumn("gain", F.lit(0.0)).join(rare, "row", "left")
    end_log, bottom = math.log10(vocabulary.ends + 1), math.log10(vocabulary.total + vocabulary.distinct + 1)
    base = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(bottom)
    return gained.select(
        F.col("id").alias(id_col),
        "training",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0)) + F.lit(int(vocabulary.ends > 0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain")).alias("score"),
    )


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scored = score_texts(docs.select("doc_id", "text"), fold("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
