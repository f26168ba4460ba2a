"""The document operators against brute force, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tablelens.llm import decontaminate, language_model, mixing, order_minhash, quality, secrets, simhash
from tablelens.llm.common import fold, read_table, rounds, span_hashes, stored, text_bytes, word_hash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(30_000))
# nulls everywhere, empty, blank and long texts, ties, repeated rows
ODD = [
    (1, None, None, None, None), (None, "alpha beta gamma", "en", None, 16), (None, "alpha beta gamma", "en", None, 16),
    (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", "a", 5), (4, LONG, "en", "b", len(LONG)), (5, "alpha beta gamma", "en", "b", 16),
    (5, "alpha beta gamma", "en", "b", 16), (6, "Übung macht den Meister — \U0001f600 ok", "de", "a", 33), (6, "other text with one id", "en", "c", 22),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, DOCS)
    clash = "score text2 fingerprint words row size place key order id fp bucket spans __spans __hits classes gain training".split()
    return df.withColumns({c: F.lit(f"mine {c}") for c in clash})


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return read_table(spark, SF, "labels")


@pytest.fixture(scope="module")
def benchmark(spark):
    return read_table(spark, SF, "benchmark")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_helpers():
    data, offsets = text_bytes(pa.array(["ab", None, "", "cde"], pa.string())[1:])
    assert bytes(data) == b"cde" and offsets.tolist() == [0, 0, 0, 3]
    assert list(rounds(np.array([0, 5, 50, 51]), 10)) == [(0, 1), (1, 2), (2, 3)]
    raw = np.frombuffer(b"one two one", np.uint8)
    h = span_hashes(raw, np.array([0, 4, 8]), np.array([3, 7, 11])).tolist()
    assert h[0] == h[2] == word_hash("one") != h[1]


# ------------------------------------------------------------ 1: secrets


def base_spans(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def planted_secrets():
    random = np.random.default_rng(5)
    signs = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    return ["".join(random.choice(signs, 44)) for _ in range(30)]


def test_secrets(spark, docs, odd, empty):
    keys = planted_secrets()
    texts = [f"\U0001f600 set {k} as it is" for k in keys] + [
        "token: token : abcdefgh", "Tokén=abcdefgh \u212aey", "api_key='short' API-KEY=abcdefgh apikey = \"abcdefgh\"", "AKIA" + "A1" * 8 + " AKIA123", "f" * 24 + " " + "a" * 23,
        "abcabcabcabcabcabcabcabcabcabcabcabcabcabc", "some-long-and-quite-plain-path/with/words_in_it", "4000038985693383", "0123456789abcdef" * 3,
    ]
    made = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(made)
    want = Counter()
    for doc_id, text in both.collect():
        spans = base_spans(text)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        n = Counter(k for k, _, _ in spans)
        want[doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest()] += 1
    got = secrets.secrets_table(both).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    found = {r["doc_id"]: r["spans"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 1000}
    hits = sum(f"random:6:{6 + 44}" in found[1000 + i] for i in range(len(keys)))
    assert hits >= 27, hits
    assert not any("random" in found[1000 + i] for i in range(len(keys), len(texts)))
    assert secrets.secrets_table(empty).collect() == []


def test_redaction(spark, odd, empty):
    df = spark.createDataFrame([(1, "x token = \"24be64439e3e49cf46b2d7c90f3602a3\" y", "en", "s", 46), (2, "clean", "en", "s", 5)], DOCS)
    assert [tuple(r) for r in secrets.redact_secrets(df).orderBy("doc_id").collect()] == [(1, 'x [SECRET]" y', "en", "s", 13), (2, "clean", "en", "s", 5)]
    kept = secrets.redact_secrets(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    assert rows_of(kept) == rows_of(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    assert secrets.redact_secrets(empty).columns == empty.columns and not secrets.redact_secrets(empty).count()


def test_battery():
    assert secrets.battery("24be64439e3e49cf46b2d7c90f3602a3d0b907ff")[0] == "hex"
    assert secrets.battery("a" * 40)[1] == 1.0 and secrets.battery("1234567890123456")[1] == 1.0
    assert abs(secrets.chi_tail(15.0, 15) - 0.4514) < 0.003
    assert abs(secrets.noncentral_head(45.0, 15, 30.0) - 0.53) < 0.03
    random, alphabet = np.random.default_rng(1), list("0123456789abcdef")
    passed = sum(secrets.battery("".join(random.choice(alphabet, 64)))[1] < 1 for _ in range(300))
    assert passed > 285


def test_short_keys_are_found(spark, docs):
    random, texts, cards = np.random.default_rng(11), {}, 335
    for name, index, _ in secrets._ENCODINGS:
        if name not in ("digits", "lower", "upper"):
            for n in (16, 20, 24, 32):
                texts |= {(name, n, i): "".join(random.choice(list(index), n)) for i in range(20)}
    plain = ["SomeQuiteLongClassName42", "a-path-of-plain-words-2024", "DE44500105175407324931", "invoice_2023_0000012345", "+49-1512-3456789-001", "INV-2023-00012345-67", "docs/readme/chapter12/page7"]
    plain += ["".join(random.choice(list("0123456789"), 16)) for _ in range(cards)]
    keys = list(texts)
    made = [(10_000 + i, f"see {t} here") for i, t in enumerate([*texts.values(), *plain])]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    found = {r["doc_id"]: r["spans"] for r in secrets.secrets_table(rows).collect() if r["doc_id"] is not None and r["doc_id"] >= 10_000}
    hits = Counter(k[:2] for i, k in enumerate(keys) if found[10_000 + i] in (f"random:4:{4 + k[1]}", f"hex:4:{4 + k[1]}"))
    assert min(hits[k[:2]] for k in keys) >= 18, hits
    assert not any(found[10_000 + i] for i in range(len(keys), len(made))), [t for i, t in enumerate(plain) if found[10_000 + len(keys) + i]]
    # a few keys among many numbers: numbers are no tests
    few = spark.createDataFrame([(i, f"card {plain[-1 - i]}") for i in range(cards)] + [(1000 + i, texts["base62", 16, i]) for i in range(10)], "doc_id long, text string")
    assert sum(bool(r["spans"]) for r in secrets.secrets_table(few).collect()) >= 9
    assert not secrets._scan("4000038985693383 " + "x" * 20 + " a-b/c_d-e/f_g-h/i_j")[1]


# ------------------------------------------------------------ 2: quality


def test_quality(spark, odd, empty, labels):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    got = quality.quality_table(docs, labels).toPandas()
    held = got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)
    assert (held == got["held_out"]).all() and len(got) == docs.count() and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    tried = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert (tried["predicted"] == tried["quality"]).mean() >= 0.93
    assert (tried[tried["quality"] == 1]["predicted"]).mean() >= 0.98


def test_training_by_hand(spark):
    """Follow-the-regularised-leader one coordinate at a time; shards without rows do not count."""
    texts = ["good words stand here", "bad $$ buy now now", "more good words", "buy cheap $$ now", "plain words here", ""]
    rows = [(i, t, float("good" in t or "plain" in t)) for i, t in enumerate(texts, 1)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality double")
    model = quality.fit_quality(docs, labels, epochs=3)
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = docs.join(labels, "doc_id").filter(fold("doc_id", 5) != 0)
    known = known.select("text", "quality", order.alias("order"), F.pmod(F.shiftright(order, 20), F.lit(quality.SHARDS)).alias("shard")).orderBy("order").collect()
    shards = {r["shard"] for r in known}
    assert 0 < len(shards) < quality.SHARDS
    alpha, beta, l1, l2, mean = 0.5, 1.0, 0.01, 0.1, {}
    for shard in shards:
        z, n = {}, {}

        def weight(s):
            have = z.get(s, 0.0)
            return 0.0 if abs(have) <= l1 else ((l1 if have > 0 else -l1) - have) / ((beta + math.sqrt(n.get(s, 0.0))) / alpha + l2)

        for _ in range(3):
            for r in (r for r in known if r["shard"] == shard):
                counts = dict(quality.feature_counts(r["text"]))
                x = {s: quality.SCALE * c / max(1, sum(counts.values())) for s, c in counts.items()} | {"bias": 1.0}
                w = {s: weight(s) for s in x}
                error = 1 / (1 + math.exp(-sum(w[s] * v for s, v in x.items()))) - r["quality"]
                for s, v in x.items():
                    g, had = error * v, n.get(s, 0.0)
                    n[s] = had + g * g
                    z[s] = z.get(s, 0.0) + g - (math.sqrt(n[s]) - math.sqrt(had)) / alpha * w[s]
        for s in z:
            mean[s] = mean.get(s, 0.0) + weight(s) / len(shards)
    assert model.bias == pytest.approx(mean.pop("bias"), abs=1e-9)
    assert all(model.weights[s] == pytest.approx(v, rel=1e-5, abs=1e-7) for s, v in mean.items())
    assert np.count_nonzero(model.weights) == sum(abs(v) > 1e-12 for v in mean.values())


def test_quality_on_odd_rows(spark, odd, empty, labels):
    none = labels.limit(0)
    assert {r["score"] for r in quality.quality_table(odd, none).collect()} == {0.5}
    some = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality.quality_table(odd, some).count() == len(ODD)
    assert quality.quality_table(empty, labels).collect() == []
    assert quality.keep_good(odd, none).columns == odd.columns
    # the score reads the text only
    changed = odd.withColumns({"source": F.lit("z"), "lang": F.lit("z"), "doc_id": F.lit(0).cast("long")})
    model = quality.QualityModel(0.2, np.random.default_rng(0).normal(size=quality.SLOTS).astype(np.float32))
    assert sorted(r["score"] for r in quality.score_quality(odd, model).collect()) == sorted(r["score"] for r in quality.score_quality(changed, model).collect())
    # sparse dot product by hand
    counts = dict(quality.feature_counts("One two two!! THREE"))
    total = sum(counts.values())
    by_hand = 0.2 + sum(quality.SCALE * n / total * float(model.weights[s]) for s, n in counts.items())
    one = spark.createDataFrame([("One two two!! THREE",)], "text string")
    assert abs(quality.score_quality(one, model).first()["score"] - 1 / (1 + math.exp(-by_hand))) < 1e-5


# ----------------------------------------------------- 4: language model


def test_language_model(spark, docs, odd, empty):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", low(t)) if w] + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    data = both.collect()
    counts = Counter(w for i, t in data if not held(i) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in data:
        words = split(t)
        want[i, held(i), len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 5)] += 1
    got = language_model.score_texts(both, ~(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2), frequent=2000, classes=300).collect()
    assert Counter((r["doc_id"], not r["training"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert sum(r["score"] for r in got if r["training"]) > sum(r["base_score"] for r in got if r["training"])
    assert sum(r["score"] for r in got if not r["training"]) > sum(r["base_score"] for r in got if not r["training"]) - 1
    assert language_model.language_table(empty).collect() == []
    alone = language_model.score_texts(odd, F.lit(False)).collect()
    assert len(alone) == len(ODD) and all(r["n_known"] == 0 and r["score"] == r["base_score"] for r in alone)


def test_forward_is_exact():
    random = np.random.default_rng(3)
    model = language_model.HiddenMarkov(random.dirichlet(np.ones(2)), random.dirichlet(np.ones(2), 2), random.dirichlet(np.ones(3), 2))
    codes = [np.array(c, np.int16) for c in ([0], [1, 2], [2, 1, 1, 0, 2], [2] * 4)]
    got = language_model.forward(codes, model)
    for code, log in zip(codes, got):
        total = 0.0
        for path in np.ndindex(*[2] * len(code)):
            p = model.start[path[0]] * model.emit[path[0], code[0]]
            for t in range(1, len(code)):
                p *= model.move[path[t - 1], path[t]] * model.emit[path[t], code[t]]
            total += p
        assert abs(math.log(total) - log) < 1e-9


def test_baum_welch_climbs():
    random = np.random.default_rng(4)
    codes = [np.where(random.random(200) < 0.5, 2, 3 + np.arange(200) % 2).astype(np.int16) for _ in range(20)]
    model = language_model.HiddenMarkov(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.4, 0.6]]), random.dirichlet(np.ones(5), 2))
    logs = []
    for _ in range(6):
        start, move, emit, log = language_model.expected_counts(codes, model)
        assert abs(emit.sum() - 4000) < 1e-6 and abs(start.sum() - 80) < 1e-6 and abs(move.sum() - (4000 - 80)) < 1e-6
        model = language_model.HiddenMarkov(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        logs.append(log)
    assert all(b >= a - 1e-9 for a, b in zip(logs, logs[1:]))


def test_every_training_word_has_its_own_emissions(spark, docs):
    # ratios from the stored table are those of the array in memory, and rare words learn
    texts, training = docs.select("doc_id", "text"), F.col("doc_id") % 7 != 2
    scores = [{r["doc_id"]: (r["score"], r["base_score"]) for r in language_model.score_texts(texts, training, classes=k).collect()} for k in (40, 1 << 18)]
    assert all(np.allclose(scores[0][i], scores[1][i], atol=1e-6) for i in scores[1])
    # two topics share no word, each word stands in few texts: only own emissions tell them apart
    random = np.random.default_rng(2)
    topic = [[f"{t}{i}" for i in range(400)] for t in "ab"]
    made = spark.createDataFrame([(i, " ".join(random.choice(topic[i % 2], 100))) for i in range(200)], "doc_id long, text string")
    rows = language_model.score_texts(made, F.lit(True), classes=12, steps=8).collect()
    assert np.mean([r["score"] - r["base_score"] for r in rows]) > 10


def test_whole_sequences_carry_the_state():
    random = np.random.default_rng(6)
    model = language_model.HiddenMarkov(random.dirichlet(np.ones(3)), random.dirichlet(np.ones(3), 3), random.dirichlet(np.ones(5), 3))
    codes = [random.integers(0, 5, n) for n in (200, 65, 3)]
    start, move, emit, log = language_model.expected_counts(codes, model, None)
    assert abs(start.sum() - 3) < 1e-9 and abs(move.sum() - 265) < 1e-6 and abs(emit.sum() - 268) < 1e-6
    assert abs(log - language_model.forward(codes, model).sum()) < 1e-6


def test_segments_of_long_texts_equal_plain_recursions(monkeypatch):
    random = np.random.default_rng(9)
    model = language_model.HiddenMarkov(random.dirichlet(np.ones(3)), random.dirichlet(np.ones(3), 3), random.random((3, 50)) * 2 + 0.001)
    span = language_model.SPAN
    codes = [random.integers(0, 50, n) for n in (4 * span + 7, 1, span, span + 1, 3, 2 * span)]
    start, move, emit, log, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 50)), 0.0, []
    for code in codes:
        alphas, scales = [], []
        for t, c in enumerate(code):
            a = (model.start if t == 0 else alphas[-1] @ model.move) * model.emit[:, c]
            alphas.append(a / a.sum()), scales.append(a.sum())
        logs.append(np.log(scales).sum())
        beta = np.ones(3)
        for t in range(len(code) - 1, -1, -1):
            gamma = alphas[t] * beta
            emit[:, code[t]] += gamma
            back = model.emit[:, code[t]] * beta / scales[t]
            if t:
                move += np.outer(alphas[t - 1], back) * model.move
            else:
                start += gamma
            beta = model.move @ back
    taken = []
    live = language_model._live
    monkeypatch.setattr(language_model, "_live", lambda size: taken.append(live(size)) or taken[-1])
    got = language_model.expected_counts(codes, model, None)
    for have, want in zip(got, (start, move, emit, sum(logs))):
        assert np.allclose(have, want, rtol=1e-9)
    assert np.allclose(language_model.forward(codes, model), logs, rtol=1e-9)
    assert max(map(len, taken)) <= span  # no recursion takes more steps, however long the text


def test_matrices_are_made_of_middle_segments_only():
    # what chains the segments of a text costs a vector a token in first and last ones; forward leaves last ones out
    random = np.random.default_rng(10)
    span, gathered = language_model.SPAN, []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            gathered.append(np.size(at))
            return np.asarray(super().__getitem__(at))

    model = language_model.HiddenMarkov(random.dirichlet(np.ones(3)), random.dirichlet(np.ones(3), 3), random.random((3, 50)).view(Counted))
    codes = [random.integers(0, 50, n) for n in (2 * span, span + 9, 4)]
    language_model.forward(codes, model)
    assert sum(gathered) == sum(map(len, codes)) + 2 * span
    plain = language_model.HiddenMarkov(model.start, model.move, np.asarray(model.emit))
    assert np.allclose(language_model.forward(codes, model), language_model.forward(codes, plain))


def test_lookup_finds_equal_hashes_only():
    random = np.random.default_rng(11)
    hashes = np.append(random.integers(0, 1 << 64, 500, dtype=np.uint64), np.uint64(7 << 60) + np.arange(40, dtype=np.uint64))  # 40 begin alike
    sought = np.concatenate([hashes[::-1], hashes + np.uint64(100), [np.uint64(0), np.uint64((1 << 64) - 1)]])
    place = {h: i for i, h in enumerate(hashes.tolist())}
    for n in (540, 1, 0):
        order = np.argsort(hashes[:n])
        keys = hashes[:n][order]
        got = language_model._lookup(sought, keys, order, language_model._slots(keys))
        assert got.tolist() == [place[h] if place.get(h, n) < n else -1 for h in sought.tolist()]


def test_codes_come_back_without_texts(spark):
    made = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, None), (4, "c d")], "doc_id long, text string")
    known = language_model.count_words(made, frequent=2)
    whole = {r["doc_id"]: r for r in language_model.encode(made, known).collect()}
    bare = language_model.encode(made, known, keep_text=False)
    assert "text" not in bare.columns
    assert {r["doc_id"]: r.asDict() for r in bare.collect()} == {i: {k: v for k, v in r.asDict().items() if k != "text"} for i, r in whole.items()}
    column = pa.array([whole[i]["codes"] for i in (1, 2, 3, 4)], pa.binary())
    flat, sizes = language_model._unpack_all(column.slice(1))
    assert sizes.tolist() == [1, 1, 3]
    assert flat.tolist() == np.concatenate([language_model._unpack(c) for c in column.slice(1).to_pylist()]).tolist()


def test_words_are_counted_and_numbered_in_batches(spark):
    texts = ["B a b\u00c4 a\tx", None, "", "x \u00e4 A  q q", "q" * 30 + "\n\u6f22 q"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    known = language_model.count_words(made, frequent=0)
    want = Counter(w for t in texts for w in re.split(r"[\x20\x09-\x0D]+", low(t)) if w)
    assert {r["word"]: r["c"] for r in known.counts.collect()} == want and known.total == sum(want.values()) + 5
    for r in language_model.encode(made, known).collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", low(r["text"])) if w]
        numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
        assert [(x["word"], x["n"]) for x in r["rest"]] == list(Counter(words).items())
        assert language_model._unpack(r["codes"]).tolist() == [-1 - numbers[w] for w in words] + [0]
    got = next(language_model._count_batches(iter([pa.RecordBatch.from_arrays([pa.array(["a b", "b"])], names=["text"])])))
    assert dict(zip(*(c.to_pylist() for c in got.columns))) == {"a": 1, "b": 2}


def test_packed_codes_pieces_and_chunks():
    random = np.random.default_rng(8)
    codes = np.concatenate([[0, -1, 1, 2**31 - 1, -(2**31)], random.integers(-5000, 300000, 1000)]).astype(np.int32)
    assert language_model._unpack(language_model._pack(codes)).tolist() == codes.tolist()
    assert language_model._unpack(language_model._pack(codes[:0])).tolist() == []
    # one text beyond a piece is a piece; all rows come once and in order
    sizes = [3, language_model.ROUND_TOKENS + 5, 2, language_model.ROUND_TOKENS, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([bytes(4 * n) for n in sizes])], names=["row", "codes"])
    pieces = [p.column(0).to_pylist() for p in language_model._pieces(iter([batch, batch.slice(0, 0)]))]
    assert sum(pieces, []) == list(range(5)) and all(len(p) == 1 or sum(sizes[i] for i in p) <= language_model.ROUND_TOKENS for p in pieces)
    parts = [(1, random.random(8)), (-1, random.random(4)), (1, random.random(8))]
    rows = pa.RecordBatch.from_arrays([pa.array([a for a, _ in parts], pa.int32()), pa.array([v.tobytes() for _, v in parts])], names=["at", "packed"])
    (got,) = language_model._add_chunks(iter([rows]))
    sums = {a: np.frombuffer(v, np.float64) for a, v in zip(got.column(0).to_pylist(), got.column(1).to_pylist())}
    assert np.allclose(sums[1], parts[0][1] + parts[2][1]) and np.allclose(sums[-1], parts[1][1])


def test_a_long_text_beside_short_ones(spark):
    # the long text is a piece of its own, holds words seen once, and its base score is exact
    words = [f"w{i % 5000}" for i in range(language_model.ROUND_TOKENS + 1000)] + ["once"]
    made = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2 once"), (3, ""), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_model.score_texts(made, F.col("doc_id") != 2, classes=1000, steps=1).collect()}
    counts = Counter(words)
    n, v = len(words) + 3, len(counts) + 1
    want = sum(math.log10((c + 1) / (n + v + 1)) * c for c in counts.values()) + math.log10(4 / (n + v + 1))
    assert math.isclose(got[1]["base_score"], want, rel_tol=1e-9) and got[1]["n_tokens"] == got[1]["n_known"] == len(words) + 1
    assert got[2]["n_known"] == 4 and got[3]["score"] == got[4]["score"] and all(math.isfinite(r["score"]) for r in got.values())


# -------------------------------------------------------------- 6: mixing


def test_mixing(spark, docs, odd, empty):
    both = docs.select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    got = mixing.mix_table(both).toPandas()
    assert len(got) == both.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    data = both.toPandas()
    sums = data.assign(size=data["text"].map(size)).groupby("source", dropna=False)["size"].sum()
    names = sorted((s for s in sums.index if isinstance(s, str)), key=lambda s: s.encode()) + [s for s in sums.index if not isinstance(s, str)]
    sizes = [int(sums[s]) if isinstance(s, str) else int(sums[[not isinstance(x, str) for x in sums.index]].iloc[0]) for s in names]
    want = fill(sizes)
    taken = got.groupby(["source_size", "target"])["taken"].sum()
    assert sorted(zip(sizes, (round(t, 6) for t in want))) == sorted((s, round(t, 6)) for s, t in {(s, t) for s, t in zip(got["source_size"], got["target"])})
    for (s, target), words in taken.items():
        assert abs(words - target) <= max(32, 0.5 * s)
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix_table(both.repartition(5)).toPandas()
    assert Counter(map(tuple, got.fillna(-1).to_numpy().tolist())) == Counter(map(tuple, again.fillna(-1).to_numpy().tolist()))
    assert mixing.mix_table(empty).collect() == []
    assert {r["target"] for r in mixing.mix_table(odd.filter("text IS NULL OR trim(text) = ''")).collect()} == {0.0}


def fill(sizes):
    """Targets by repeated resharing."""
    weights, total, capped = [1 + i % 3 for i in range(len(sizes))], sum(sizes), set()
    while True:
        left = total - sum(3 * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 3 * sizes[i]}
        if not over:
            return [3.0 * sizes[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def test_targets_by_hand(spark):
    for sizes in ([1000, 10, 10], [5, 5, 5, 5000], [7], [100, 1, 1, 1, 1, 1]):
        rows = spark.createDataFrame([(f"s{i}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = [r["target"] for r in mixing.source_targets(rows).orderBy("source").collect()]
        assert np.allclose(got, fill(sizes)), (sizes, got)


def test_permutations(spark):
    for n in (1, 2, 3, 10, 17, 1000, 4097):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1)).alias("p"))
        assert sorted(r["p"] for r in df.collect()) == list(range(n))


def test_mixed_text_holds_the_blocks(spark, odd):
    rows = odd.select("doc_id", "text", "source")
    words = Counter(w for r in mixing.mixed_texts(rows).collect() for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    taken = mixing.mix_table(rows).toPandas()["taken"].sum()
    assert sum(words.values()) == taken
    assert set(words) <= {w for r in ODD for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")}


# ------------------------------------------------------ 7: decontamination


def contamination(docs, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add("null" if item is None else str(item))
    lengths = {len(k) for k in windows}
    out = Counter()
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out[doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)] += 1
    return out


def test_decontamination(spark, docs, odd, empty, benchmark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(20))
    more = [(900, f"{passage} tail"), (901, passage.upper() + " x " + passage), (902, "solo"), (903, "a one two b"), (904, " ".join(f"p{i}" for i in range(12))), (905, "y " * 4000 + passage)]
    items = [(1000, passage), (1001, passage), (None, "solo"), (1002, None), (1003, ""), (1004, "One, two!"), (1004, "one two"), (1005, "alpha beta gamma")]
    texts = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    tests = benchmark.select("item_id", "text").unionByName(spark.createDataFrame(items, "item_id long, text string"))
    want = contamination(texts.collect(), tests.collect())
    assert Counter(map(tuple, decontaminate.contamination_table(texts, tests).collect())) == want
    # many parts of the benchmark give the same
    small = decontaminate.find_windows(texts, tests, part_words=600)
    assert Counter((r["doc_id"], len(r["__hits"])) for r in small.collect()) == Counter((d, h) for d, _, h, *_ in want.elements())
    assert decontaminate.contamination_table(empty, tests).collect() == []
    assert {r["n_items"] for r in decontaminate.contamination_table(odd, benchmark.limit(0)).collect()} == {0}
    kept = decontaminate.drop_contaminated(odd, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4


# -------------------------------------------------------------- 8: SimHash


def simhash_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low(text)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_ids(pairs):
    """Smallest id within reach of every row, by brute force."""
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return [(i, f"{f:016x}", least.get(find(f))) for i, f in pairs]


def test_simhash(spark, docs, odd, empty):
    long = [f"word{i}" for i in range(400)]
    near = [(2000 + k, " ".join(long[:k] + ["changed"] + long[k + 1 :])) for k in range(0, 400, 7)]
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    want = Counter(component_ids([(i, simhash_of(t)) for i, t in rows.collect()]))
    got = Counter(map(tuple, simhash.duplicates_table(rows).collect()))
    assert got == want
    assert max(Counter(c for _, _, c in got).values()) > 5
    assert simhash.duplicates_table(empty).collect() == []
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    # null, empty and blank texts are one group; the four equal texts another
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 6, 6])


def test_links_and_components(spark):
    random = np.random.default_rng(9)
    base = [int(x) for x in random.integers(0, 1 << 62, 40)] + [0, -1, -(1 << 63)]
    near = [b ^ sum(1 << int(k) for k in random.choice(62, random.integers(1, 5), replace=False)) for b in base]
    values = sorted(set(base + near))
    df = spark.createDataFrame([(v,) for v in values + values[:5] + [None]], "fingerprint long")
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3}
    assert {tuple(r) for r in simhash.links(df).collect()} == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (150, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 150: 100, 200: 100}


# -------------------------------------------------------- 10: Order MinHash


def test_order_minhash(spark, docs, odd, empty):
    rows = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    got = order_minhash.fingerprints_table(rows).toPandas()
    assert len(got) == rows.count()
    data = rows.toPandas().sort_values("doc_id", na_position="last", kind="stable")
    texts = [t or "" for t in data["text"]]
    edits = Counter((len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for t, n in zip(texts, texts[1:] + texts[:1]))
    # ties of ids (5, 6, null) may stand in either order; all others are fixed
    mine = Counter(zip(got["n_chars"], got["edited_sha256"]))
    assert sum((mine - edits).values()) <= 4
    assert got["near_edited"].between(0, 1).all() and got["near_next"].between(0, 1).all()
    whole = got[got["n_chars"] > 300]
    assert (whole["near_edited"] > whole["near_next"]).mean() > 0.95
    same = got[got["doc_id"] == 10_005]
    assert same["fingerprint"].nunique() == 1
    assert order_minhash.fingerprints_table(empty).collect() == []
    one = order_minhash.fingerprints_table(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1.0


def test_sketch_by_brute_force():
    def slow(text):
        n, k = len(text), min(order_minhash.K, len(text))
        kmers = [text[i : i + k] for i in range(n - k + 1)]
        seen, keyed = Counter(), []
        for i, m in enumerate(kmers):
            keyed.append((m, seen[m], i))
            seen[m] += 1
        return keyed

    random = np.random.default_rng(2)
    text = "".join(random.choice(list("abcd"), 500))
    numbers = {i: n for _, n, i in slow(text)}
    points = np.array([ord(c) for c in text], np.uint64)
    kmers = np.array([hash(text[i : i + 6]) & 0xFFFFFFFFFFFF for i in range(495)], np.uint64) << np.uint64(16)
    assert order_minhash._numbered(kmers).tolist() == [numbers[i] for i in range(495)] and len(points) == 500
    a = order_minhash.sketch(text)
    assert (a > 0).all() and (order_minhash.sketch(text) == a).all()
    # moving a part keeps the k-mers but changes their order
    moved = text[250:] + text[:250]
    assert 0.1 < order_minhash.likeness(a, order_minhash.sketch(moved)) < 0.9
    assert order_minhash.likeness(a, order_minhash.sketch(text[:-1] + "z")) > 0.9
    assert order_minhash.likeness(order_minhash.sketch(""), order_minhash.sketch("")) == 1.0


def test_stored_keeps_schema(spark, odd):
    assert stored(odd, "check").schema.simpleString() == odd.schema.simpleString()
