"""Secret scan: fixed patterns, and a randomness test battery over encoded runs.

Fixed kinds (leftmost, non-overlapping per kind, spans of the whole match in
code points, end exclusive): ``assign``, ``access``, ``hex``.

The battery adds spans of kind ``random``.  A candidate is a maximal run of
base64 or base64url signs with 16 or more of them (padding included).  Its
encoding is the narrowest alphabet that holds it.  Three tests ask if its signs
could be independent and uniform: chi-squared over the alphabet, runs above and
below the alphabet's middle, and serial correlation; Fisher's method combines
them, and runs that fail (p < 0.001) get p = 1.  The others are weighed against
*text*, a chain of sign pairs: the pairs of all runs of the table below 16 signs
(keys are longer, so they never count), on top of a small fixed prior.  The
likelihood ratio of uniform signs to text takes in which signs stand there and
in what order.  Under text it exceeds x with probability 1/x at most, and the
alphabet is one of ten, so p = 10 / ratio.  These p-values go through a
Benjamini-Hochberg cut at 1 % false discoveries, separately for each length
class, so that many short runs do not water down long ones.  The number of
tests, the pairs and the cut cover the whole table.  Runs of digits alone, of
letters of one case under 48 signs, and of both base64 forms mixed cannot be
told from numbers, words and paths; they are not tested and do not count.

Null and empty texts have no spans.  A ``random`` span that overlaps a fixed
span is not repeated.  Repeated rows are scanned each; other columns never matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tablelens.llm.common import extend, rounds, runs, stored, text_bytes

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{14,}={0,2}")
KINDS = {"assign": 0, "access": 1, "hex": 2, "random": 3}
LEAST, LEAST_LETTERS = 16, 48
STEPS, DEPTH = 20, 40  # p-values are binned by log10 in steps of 1/20 down to 1e-40

# A chain of signs for text: before any count, classes of signs follow each other like this.
PRIOR_WEIGHT, UNIFORM = 50, 0.1  # pairs that the prior counts for in each row, and the share of uniform signs

_LOW, _UP, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# (name, place of every sign, signs)
_ENCODINGS = [
    (name, {c: i for i, c in enumerate(signs)}, frozenset(signs))
    for name, signs in (
        ("digits", _DIGIT),
        ("hex", _DIGIT + "abcdef"),
        ("HEX", _DIGIT + "ABCDEF"),
        ("lower", _LOW),
        ("upper", _UP),
        ("base32", _UP + "234567"),
        ("base36", _LOW + _DIGIT),
        ("BASE36", _UP + _DIGIT),
        ("base62", _UP + _LOW + _DIGIT),
        ("base64", _UP + _LOW + _DIGIT + "+/"),
        ("base64url", _UP + _LOW + _DIGIT + "-_"),
    )
]
_TESTABLE = len(_ENCODINGS) - 1  # all but digits

_SIGNS = _LOW + _UP + _DIGIT + "+/-_"
_PLACE = {c: i + 1 for i, c in enumerate(_SIGNS)}  # 0 is the start of a run
_WIDTH = len(_SIGNS) + 1
_CODE = np.zeros(256, np.uint8)
_CODE[[ord(c) for c in _SIGNS]] = range(1, _WIDTH)


def _prior() -> np.ndarray:
    letters = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (12.7, 9.1, 8.2, 7.5, 7, 6.7, 6.3, 6.1, 6, 4.3, 4, 2.8, 2.8, 2.4, 2.4, 2.2, 2, 2, 1.9, 1.5, 1, 0.8, 0.2, 0.2, 0.1, 0.1)))
    kinds = np.array([0] * 26 + [1] * 26 + [2] * 10 + [3] * 4)
    inside = np.array([letters[c] for c in _LOW] * 2 + [1.0] * 14)
    for k in range(4):
        inside[kinds == k] /= inside[kinds == k].sum()
    moves = np.array([[0.93, 0.02, 0.02, 0.03], [0.5, 0.4, 0.05, 0.05], [0.04, 0.04, 0.87, 0.05], [0.6, 0.2, 0.18, 0.02], [0.6, 0.25, 0.13, 0.02]])
    return np.array([moves[k][kinds] * inside for k in (4, *kinds)])


def sign_costs(pairs: np.ndarray) -> list[list[float]]:
    """Natural log of 1 / P(sign after sign) in text, from counted pairs (rows: sign before, 0 the start)."""
    counted = pairs.reshape(_WIDTH, _WIDTH)[:, 1:]
    chance = (counted + PRIOR_WEIGHT * _prior()) / (counted.sum(1, keepdims=True) + PRIOR_WEIGHT)
    return (-np.log((1 - UNIFORM) * chance + UNIFORM / len(_SIGNS))).tolist()


PRIOR_COSTS = sign_costs(np.zeros(_WIDTH * _WIDTH))


def count_pairs(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often every sign follows every other (0: starts a run) in runs too short for a candidate."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_WIDTH * _WIDTH, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in rounds(offsets):
                part = _CODE[data[offsets[a] : offsets[b]]]
                starts, ends, _ = runs((part > 0).view(np.uint8), offsets[a : b + 1] - offsets[a])
                short = ends - starts < LEAST
                long = np.zeros(len(part) + 1, np.int8)  # marks candidates
                long[starts[~short]] = 1
                long[ends[~short]] -= 1
                before = np.concatenate([[0], part[:-1]]).astype(np.int64)
                before[starts] = 0
                kept = (part > 0) & (np.cumsum(long[:-1]) == 0)
                total += np.bincount(before[kept] * _WIDTH + part[kept], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # pairs of signs
    total = np.zeros(_WIDTH * _WIDTH)
    for r in found:
        total[r["at"]] = r["n"]
    return total


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_tail(x: float, k: int) -> float:
    """P(chi-squared > x) with k degrees of freedom (cube-root normal form)."""
    return _tail(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def noncentral_head(x: float, k: int, shift: float) -> float:
    """P(noncentral chi-squared <= x), by Sankaran's normal form."""
    h = 1 - 2 * (k + shift) * (k + 3 * shift) / (3 * (k + 2 * shift) ** 2)
    p = (k + 2 * shift) / (k + shift) ** 2
    m = (h - 1) * (1 - 3 * h)
    z = ((x / (k + shift)) ** h - (1 + h * p * (h - 1 - 0.5 * (2 - h) * m * p))) / (h * math.sqrt(2 * p) * (1 + 0.5 * m * p))
    return _tail(-z)


def encoding_of(body: str) -> tuple[str, dict[str, int] | None]:
    """The narrowest encoding of a run without padding, and its alphabet (None: cannot be tested)."""
    signs = set(body)
    found = next(((name, index) for name, index, alphabet in _ENCODINGS if signs <= alphabet), None)
    if found is None:  # both base64 forms mixed
        return "mixed", None
    name, index = found
    if name == "digits" or name in ("lower", "upper") and len(body) < LEAST_LETTERS or len(body) < LEAST - 2:
        return name, None
    return name, index


def battery(run: str, costs: list[list[float]] = PRIOR_COSTS) -> tuple[str, float]:
    """The inferred encoding, and the probability that text looks so random (1: not random)."""
    body = run.rstrip("=")
    name, index = encoding_of(body)
    if index is None:
        return name, 1.0
    n, k = len(body), len(index)
    values = [index[c] for c in body]
    counts = [0] * k
    for v in values:
        counts[v] += 1
    chi = sum(c * c for c in counts) * k / n - n
    middle = (k - 1) / 2
    high = sum(v > middle for v in values)
    low = n - high
    turns = 1 + sum((a > middle) != (b > middle) for a, b in zip(values, values[1:]))
    if not high or not low:
        return name, 1.0
    mean = 2 * high * low / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs_p = 2 * _tail(abs(turns - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    centre = sum(values) / n
    total = sum((v - centre) ** 2 for v in values)
    serial = sum((a - centre) * (b - centre) for a, b in zip(values, values[1:])) / total if total else 1.0
    serial_p = 2 * _tail(abs(serial * n + 1) / math.sqrt(n))
    x = -2 * sum(math.log(max(p, 1e-300)) for p in (chi_tail(chi, k - 1), runs_p, serial_p))
    combined = math.exp(-x / 2) * (1 + x / 2 + x * x / 8)
    if combined < 0.001:
        return name, 1.0
    places = [_PLACE[c] for c in body]
    ratio = sum(costs[a][b - 1] for a, b in zip([0, *places], places)) - n * math.log(k)
    return name, min(1.0, _TESTABLE * math.exp(-min(ratio, 600.0)) if ratio > 0 else 1.0)


def fixed_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS[s[2]]))


def written(spans: list) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_CANDIDATE = StructType(
    [StructField("start", LongType()), StructField("end", LongType()), StructField("encoding", StringType()), StructField("length_class", IntegerType()), StructField("p", DoubleType())]
)
_SPAN = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("kind", StringType())])


def _scan(text: str, costs: list[list[float]] = PRIOR_COSTS) -> tuple[list, list]:
    base = fixed_spans(text)
    candidates = []
    for m in RUN.finditer(text):
        n = m.end() - m.start()
        # pure lower-case words are letters of one case: no candidates below their own least length
        if n < LEAST or n < LEAST_LETTERS and m.group().isalpha() and m.group()[1:].islower():
            continue
        if encoding_of(m.group().rstrip("="))[1] is None:
            continue
        encoding, p = battery(m.group(), costs)
        candidates.append({"start": m.start(), "end": m.end(), "encoding": encoding, "length_class": n.bit_length() - 1, "p": p})
    return base, candidates


def _add_tests(docs: DataFrame, text_col: str) -> DataFrame:
    costs = sign_costs(count_pairs(docs, text_col))

    def work(batch: pa.RecordBatch) -> list:
        found = [_scan(t or "", costs) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        tests = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("length_class", pa.int32()), ("p", pa.float64())]))
        return [
            pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in base] for base, _ in found], spans),
            pa.array([c for _, c in found], tests),
        ]

    return extend(docs, [StructField("__spans", ArrayType(_SPAN)), StructField("__tests", ArrayType(_CANDIDATE))], work)


def _bin(p):
    return F.least(F.lit(DEPTH * STEPS), F.floor(-F.log10(p) * STEPS)).cast("int")


def discovery_cuts(tested: DataFrame, rate: float = 0.01) -> dict[int, int]:
    """For each length class, the least p-value bin that Benjamini-Hochberg accepts at ``rate``."""
    counts = (
        tested.select(F.explode("__tests").alias("t"))
        .groupBy(F.col("t.length_class").alias("c"), _bin(F.col("t.p")).alias("b"))
        .count()
        .collect()  # length classes x bins
    )
    cuts = {}
    for c in {r["c"] for r in counts}:
        bins = sorted(((r["b"], r["count"]) for r in counts if r["c"] == c), reverse=True)
        tests, rank = sum(n for _, n in bins), 0
        for b, n in bins:
            rank += n
            if 10 ** (-b / STEPS) <= rate * rank / tests:  # the bin's largest p-value
                cuts[c] = b
    return cuts


def _order(kind):
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for k, i in KINDS.items()])


def _before(a, b):
    return F.when(a["start"] != b["start"], F.sign(a["start"] - b["start"]).cast("int")).otherwise(F.sign(_order(a["kind"]) - _order(b["kind"])).cast("int"))


def choose_spans(tested: DataFrame, rate: float = 0.01) -> DataFrame:
    """Replace ``__tests`` by ``__all``: fixed spans and accepted random spans, by place."""
    cuts = discovery_cuts(tested, rate)
    fixed, never = F.col("__spans"), F.lit(DEPTH * STEPS + 1)
    cut = lambda t: F.coalesce(*[F.when(t["length_class"] == c, F.lit(b)) for c, b in cuts.items()], never)
    clear = lambda t: ~F.exists(fixed, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    kept = F.filter("__tests", lambda t: (_bin(t["p"]) >= cut(t)) & clear(t))
    more = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit("random").alias("kind")))
    return tested.withColumn("__all", F.array_sort(F.concat(fixed, more), _before)).drop("__tests")


def find_secrets(docs: DataFrame, text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """Append ``__spans`` (fixed) and ``__all`` (arrays of start, end, kind) to every row.

    The columns of ``docs`` are written once to the shared folder with the test
    results, so that the corpus-wide cut and its use see the same rows.
    """
    return choose_spans(stored(_add_tests(docs, text_col), "secrets"), rate)


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = choose_spans(stored(_add_tests(texts, "text").drop("text"), "secrets"))
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_joined("__spans").cast("binary"), 256).alias("base_sha256"),
        _joined("__all").alias("spans"),
    )


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span (overlaps together) by ``mark``; texts without spans stay as they are."""
    names, types = docs.columns, {f.name: f.dataType for f in docs.schema.fields}

    def work(batch: pa.RecordBatch) -> list:
        get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()
        return [pa.array([redacted(t, s, mark) for t, s in zip(get(text_col), get("__all"))], pa.string())]

    changed = extend(find_secrets(docs, text_col), [StructField(text_col, StringType())], work)
    if length_col in names:
        length = F.when(F.size("__all") > 0, F.length(text_col).cast(types[length_col])).otherwise(F.col(length_col))
        changed = changed.withColumn(length_col, length)
    return changed.select(*names)


def redacted(text: str | None, spans: list, mark: str) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for span in spans:
        if span["end"] <= at:
            continue
        if span["start"] >= at:
            out += [text[at : span["start"]], mark]
        at = span["end"]
    return "".join(out) + text[at:]
