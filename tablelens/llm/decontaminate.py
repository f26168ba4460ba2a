"""Benchmark decontamination: Wu-Manber search for benchmark windows in documents.

The symbols are words (A-Z lower-cased; letters, digits and all non-ASCII).  A
window is 13 consecutive words of an item; an item with fewer words, but not
none, is one window.  The windows of one length form one search: a shift table
over blocks of words says how far the search may jump, so most positions are
never looked at; where the shift is zero, the bucket of windows that end in
this block is compared by the window's 64-bit hash, and a hit is confirmed by
comparing the words themselves.

The benchmark is a stated query set.  It is cut into parts of at most
``PART_WORDS`` words, whose tables have a proven size; documents stream through
all parts one after the other in one scan, without a shuffle.

Null or empty texts have no words.  A null item id counts as one item that is
written ``null``; repeated items are one.  Other columns are carried along.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from tablelens.llm.common import LOWER, extend, mix, rounds, runs, span_hashes, text_bytes

WINDOW = 13
BLOCK = 3
PART_WORDS = 500_000
_WORD = np.zeros(256, np.uint8)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_TURN = np.uint64(0xD6E8FEB86659FD93)


class Words:
    """The words of a round of texts: bytes, spans, hashes, first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = LOWER[data]
        self.starts, self.ends, text = runs(_WORD[self.data], offsets)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.first = np.searchsorted(text, np.arange(len(offsets)))
        self.raw = self.data.tobytes()

    def said(self, first: int, n: int) -> bytes:
        """``n`` words from word ``first`` on, joined by one space."""
        return b" ".join(self.raw[a:b] for a, b in zip(self.starts[first : first + n].tolist(), self.ends[first : first + n].tolist()))

    def rolled(self, n: int) -> np.ndarray:
        """Hash of the ``n`` words that end at each word (wrong before word n - 1)."""
        total = np.zeros(len(self.hashes), np.uint64)
        for back in range(n):
            total = total * _TURN
            total[n - 1 - back :] += self.hashes[: len(self.hashes) - (n - 1 - back)] if n - 1 - back else self.hashes
        return mix(total)


class Windows:
    """Shift table and suffix buckets for windows of one length."""

    def __init__(self, length: int, windows: dict[bytes, set[str]]):
        self.length, self.block = length, min(BLOCK, length)
        self.items = windows
        said = list(windows)
        texts = np.frombuffer(b"".join(said), np.uint8)
        ends = np.cumsum([len(w) for w in said])
        words = Words(texts, np.r_[0, ends])
        blocks, whole = words.rolled(self.block), words.rolled(length)
        last = words.first[1:] - 1
        shifts: dict[int, int] = {}
        for back in range(length - self.block, -1, -1):  # nearer blocks overwrite
            for key in blocks[last - back].tolist():
                shifts[key] = back
        self.keys = np.array(sorted(shifts), np.uint64)
        self.shifts = np.array([shifts[k] for k in self.keys.tolist()], np.int64)
        self.most = length - self.block + 1
        self.windows = np.sort(whole[last])

    def search(self, words: Words) -> list[tuple[int, bytes]]:
        """(first word, window) of every occurrence in a round of texts."""
        first, stop = words.first[:-1], words.first[1:]
        at = first + self.length - 1  # the word that the window in view ends with
        live = np.flatnonzero(at < stop)
        at, stop = at[live], stop[live]
        if not len(at):
            return []
        blocks, whole = words.rolled(self.block), words.rolled(self.length)
        seen = []
        while len(at):
            place = np.minimum(np.searchsorted(self.keys, blocks[at]), len(self.keys) - 1)
            shift = np.where(self.keys[place] == blocks[at], self.shifts[place], self.most)
            seen.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            left = at < stop
            at, stop = at[left], stop[left]
        zero = np.concatenate(seen)
        place = np.minimum(np.searchsorted(self.windows, whole[zero]), len(self.windows) - 1)
        found = []
        for end in zero[self.windows[place] == whole[zero]].tolist():
            said = words.said(end - self.length + 1, self.length)
            if said in self.items:
                found.append((end - self.length + 1, said))
        return found


def windows_of(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[int, dict[bytes, set[str]]]:
    """Windows by length, each with the ids of the items that hold it."""
    found: dict[int, dict[bytes, set[str]]] = {}
    for item, text in items:
        words = Words(*text_bytes(pa.array([text], pa.string())))
        n = len(words.starts)
        length = min(n, window)
        for first in range(n - length + 1 if n else 0):
            found.setdefault(length, {}).setdefault(words.said(first, length), set()).add(item)
    return found


def _part(docs: DataFrame, text_col: str, tables: list[Windows], later: bool) -> DataFrame:
    """Search one part of the benchmark; ``later`` adds to what earlier parts found."""

    def work(batch: pa.RecordBatch) -> list:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        data, offsets = text_bytes(get(text_col))
        hits: list[list[int]] = get("__hits").to_pylist() if later else [[] for _ in range(batch.num_rows)]
        items: list[list[str]] = get("__items").to_pylist() if later else [[] for _ in range(batch.num_rows)]
        counts = np.zeros(batch.num_rows, np.int64)
        for a, b in rounds(offsets):
            words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            counts[a:b] = np.diff(words.first)
            spots: dict[int, set[int]] = {}
            names: dict[int, set[str]] = {}
            for table in tables:
                for first, said in table.search(words):
                    text = int(np.searchsorted(words.first, first, side="right")) - 1
                    spots.setdefault(text, set()).update(range(first - int(words.first[text]), first - int(words.first[text]) + table.length))
                    names.setdefault(text, set()).update(table.items[said])
            for text, found in spots.items():
                hits[a + text] = sorted(found.union(hits[a + text]))
                items[a + text] = sorted(names[text].union(items[a + text]))
        return [pa.array(counts), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]

    fields = [StructField("__words", LongType()), StructField("__hits", ArrayType(LongType())), StructField("__items", ArrayType(StringType()))]
    return extend(docs, fields, work)


def find_windows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """Append ``__words`` (count), ``__hits`` (word positions hit) and ``__items`` (ids, sorted)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("string").alias("text"))
    # every word of an item has at least two bytes with its separator
    bulk = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] / 2
    parts = max(1, math.ceil(bulk / part_words))
    out = docs
    for part in range(parts):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        rows = [(r["item"], r["text"]) for r in mine.collect()]  # one part: about part_words words
        tables = [Windows(n, found) for n, found in sorted(windows_of(rows).items())]
        out = _part(out, text_col, tables, part > 0)
    return out


def _contaminated():
    return (F.size("__hits") > 0) & (20 * F.size("__hits") >= F.col("__words"))


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_windows(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    return found.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        F.size("__hits").cast("long").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        _contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    return find_windows(docs, benchmark).filter(~_contaminated()).select(*docs.columns)
