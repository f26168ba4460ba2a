"""Hard negatives, Merkle manifest and licence scan against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tablelens.llm import hard_negatives, licenses, merkle

# ---- op11 ----


def brute_negatives(rows):
    """(anchor, positive, rank, negative, positive score, negative score) of (id, label, vector) rows."""
    size = max((len(v) for _, _, v in rows if v is not None), default=0)
    kept = []
    for place, (i, label, v) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        whole = [int(np.clip(np.floor(256 * x), -hard_negatives.EDGE, hard_negatives.EDGE)) for x in v]
        kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, whole + [0] * (size - len(v)), place))
    out = []
    for i, label, v, place in (r for r in kept if r[0] % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w, spot in kept if spot != place)
        for minus, j, _ in [s for s in scored if s[2]][:5]:
            p = -minus
            good = [(-m, n) for m, n, same in scored if not same and 30 * p <= -100 * m <= 90 * p]
            out += [(i, j, rank, n, p, s) for rank, (s, n) in enumerate(good[:10], 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, rank string, cell int")
    return sorted(tuple(r) for r in hard_negatives.negatives_table(df).collect())


def clustered(n, size, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    rows = [(i, int(rng.integers(0, 10)), (centres[rng.integers(0, 12)] + rng.normal(size=size) * 0.3).tolist()) for i in range(n)]
    return rows + [(n + i, int(i % 3), rows[0][2]) for i in range(copies)]


@pytest.mark.parametrize("first, block, pack, codes", [(2048, 2048, 512, 16), (8, 16, 3, 4), (1, 7, 1, 2)])
def test_negatives_at_any_block_size(spark, monkeypatch, first, block, pack, codes):
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", first)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "PACK", pack)
    monkeypatch.setattr(hard_negatives, "CODES", codes)
    rows = clustered(600, 6, 3, copies=60)
    assert mined(spark, [(*r, "x", 1) for r in rows]) == brute_negatives(rows)


def test_negatives_broadcast_nothing(spark, monkeypatch):
    plans, write = [], hard_negatives.stored

    def watched(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(hard_negatives, "stored", watched)
    rows = spark.createDataFrame([(*r, "x", 1) for r in clustered(300, 4, 9)], "vec_id long, label int, embedding array<double>, rank string, cell int")
    out = hard_negatives.negatives_table(rows)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_negatives_odd_rows(spark):
    rows = clustered(120, 4, 5)
    rows += [(None, 1, [1.0] * 4), (200, None, [1.0] * 4), (300, 1, None), (400, 1, [1.0, None, 0.0, 0.0]), (500, 2, [float("nan")] * 4)]
    rows += [(600, 2, [float("inf"), 0.0, 0.0, 0.0]), (700, 3, []), (800, 3, [1.0]), (900, 3, [1e30, -1e30, 1e5, 2.0]), (1000, 3, [1e30, 1.0, 0.0, 0.0]), (0, 1, rows[0][2]), rows[0]]
    found = brute_negatives(rows)
    assert found and mined(spark, [(*r, "x", 1) for r in rows]) == found
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0], "x", 1)]) == []


def test_negatives_stop_early_when_certified(spark, monkeypatch):
    """Far clusters are never met: their cells' bounds lie below the window."""
    monkeypatch.setattr(hard_negatives, "FIRST_ROWS", 50)
    rng = np.random.default_rng(1)
    rows = [(i, i % 5, (np.eye(16)[i % 16] * 4 + rng.normal(size=16) * 0.01).tolist()) for i in range(800)]
    asked = []
    plain = hard_negatives._visits

    def counted(live, index, codes, many):
        out = plain(live, index, codes, many)
        asked.append((out.filter("cell >= 0").groupBy("a").agg({"cell": "count"}).agg({"count(cell)": "max"}).first()[0], len(index.cells)))
        return out

    monkeypatch.setattr(hard_negatives, "_visits", counted)
    assert mined(spark, [(*r, "x", 1) for r in rows]) == brute_negatives(rows)
    assert asked[0][0] < asked[0][1]


def test_bounds_fall_and_hold():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 9))
    centres = (hard_negatives.codebook(x[:, :5], 6), hard_negatives.codebook(x[:, 5:], 6))
    (i, r), (j, s) = hard_negatives.nearest(x[:, :5], centres[0]), hard_negatives.nearest(x[:, 5:], centres[1])
    radii = tuple(np.array([d[n == c].max() if (n == c).any() else -np.inf for c in range(6)]) for n, d in ((i, r), (j, s)))
    for anchor in x[:20]:
        walk = list(hard_negatives.cells_by_bound(anchor, 9, centres, radii, 6))
        assert [b for b, _ in walk] == sorted((b for b, _ in walk), reverse=True) and len({c for _, c in walk}) == len(walk)
        bound = {c: b for b, c in walk}
        assert all(bound[a * 6 + b] >= v for a, b, v in zip(i, j, x @ anchor))


@pytest.mark.parametrize("most", [100, 1 << 20, 1 << 30])
def test_scores_are_exact(most):
    rng = np.random.default_rng(4)
    a, b = rng.integers(-most, most, (5, 7)), rng.integers(-most, most, (6, 7))
    exact = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
    assert hard_negatives.scores(a, b).tolist() == exact


# ---- op12 ----


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    def said(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = {}
    for d, source, lang, n, text in rows:
        kept = text.replace("\n", "") if text is not None and d is not None and zlib.crc32(str(d).encode()) % 2 == 0 else text
        leaf, other = (sha("".join(map(said, (d, source, lang, n, t)))) for t in (text, kept))
        groups.setdefault((source is not None, (source or "").encode()), []).append(((d is not None, d or 0), leaf, other, d))

    def tree(level):
        levels = [level]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
        return levels

    def proof(levels, i):
        out = []
        for level in levels[:-1]:
            run = i // 3 * 3
            out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
            i //= 3
        return out

    order = sorted(groups)
    for g in order:
        groups[g].sort(key=lambda x: x[:2])
    trees = [tree([x[1] for x in groups[g]]) for g in order]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (g, levels) in enumerate(zip(order, trees)):
        for i, (_, leaf, folded, d) in enumerate(groups[g]):
            steps = proof(levels, i) + proof(top, k)
            for left, right in steps:
                folded = sha(left + folded + right)
            out.append((d, leaf, levels[-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def _mixed():
    rng = random.Random(1)
    rows = [(rng.choice([None, i, 5]), rng.choice(["hot", "hot", "hot", "a", "é", None, ""]), rng.choice([None, "en"]), 3, rng.choice([None, "", f"x\ny{i}"])) for i in range(1500)]
    return rows + [(7, "dup", "en", 1, "t")] * 300 + [(8, "long", "de", 9, "lange\n" * 200_000)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "a", "en", 3, "x\ny")],
        [(i, f"s{i}", "en", 3, f"x\ny{i}") for i in range(800)],
        [(i, "hot", "en", 3, f"x\ny{i}") for i in range(243)],
        [(i, "hot", "en", 3, f"x\ny{i}") for i in range(729 + 1)],
        _mixed(),
    ],
    ids=["empty", "one", "many groups", "a full chunk", "several rounds", "mixed"],
)
def test_manifest(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int")
    found = merkle.manifest_table(df)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_manifest(rows)


def test_proofs_fold_to_the_root(spark):
    rows = [(f"g{i % 4}", i, sha(str(i)), None) for i in range(1000)]
    for r in merkle.manifest(spark.createDataFrame(rows, "group string, key long, leaf string, changed string")).collect():
        group, top = r["proof"].split("/")
        assert merkle.fold(r["leaf"], group) == r["subroot"] and merkle.fold(r["subroot"], top) == r["root"] == r["folded_root"] and r["verified"]


# ---- op13 ----


def brute_labels(texts):
    """(n_words, n_base, first, last, base labels, labels, score) of each text, by trying every start of every template."""
    import re

    said = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    posts = licenses.postings()
    df = {w: sum(w in s for s in map(set, said)) for _, w, _, _ in posts}
    out = []
    for words in said:
        base = sorted((i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
        rare = sorted((w for w in df if w in words and w not in licenses.FUNCTION_WORDS), key=lambda w: (df[w], w))[: licenses.RARE]
        labels, share = {label for _, label in base}, 0.0
        for t, template in enumerate(licenses.TEMPLATES):
            mine = [(w, i, must) for n, w, i, must in posts if n == t]
            for start in range(-len(mine), len(words)):
                there = [(w, must) for w, i, must in mine if 0 <= start + i < len(words) and words[start + i] == w]
                if sum(w in rare for w, _ in there) < licenses.VOTES:
                    continue
                here = len(there) / len(mine)
                share = max(share, here)
                if here >= licenses.SHARE and sum(m for _, m in there) == sum(m for _, _, m in mine):
                    labels.add(template.label)
        out.append((len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else share))
    return out


def test_licences(spark):
    rng = random.Random(3)
    vocabulary = sorted({w for _, w, _, _ in licenses.postings()})
    texts = [None, "", " \n", "under the mit license under the MIT License", "cc by nc cc by nc", "Apache License, Version 2.0", "MIT", "mit mit mit license the under", "lizenz ÀÉ under the mit licenseé"]
    texts += ["software x x x x x software", "this software and the files the software to deal"]  # one licence word, twice at the right distance
    texts += [t.text.title() for t in licenses.TEMPLATES] + [" ".join(t.text.split()[:-2]) for t in licenses.TEMPLATES]
    for _ in range(60):
        words = [rng.choice(vocabulary) if rng.random() < 0.5 else "wort" for _ in range(rng.randrange(60))]
        for t in rng.sample(licenses.TEMPLATES, 2):
            own = t.text.split()
            own[rng.randrange(len(own))] = rng.choice(["x", own[0]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = own
        texts.append(", ".join(words))
    texts += ["wort " * 300_000 + "licensed under CC BY-NC 4.0", texts[4], texts[4]]
    rows = [(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, row int")
    found = licenses.license_table(df)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    expected = [(r[0], *b) for r, b in zip(rows, brute_labels(texts))]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    assert licenses.license_table(df.limit(0)).count() == 0


def test_licence_templates_keep_their_labels():
    assert {label for _, label in licenses.BASE} <= {t.label for t in licenses.TEMPLATES}
    with pytest.raises(ValueError):
        licenses.postings((licenses.Template("x", "a b a b", ("a b",)),))


# ---- the registered queries ----


@pytest.mark.parametrize("key", ["op11_hard_negatives", "op12_merkle_manifest", "op13_license_scan"])
def test_query_equals_sql(spark, key):
    import oracle

    from tablelens.llm import queries

    sf = "/root/testdata/sf0.001"
    problem, rows, _ = oracle.compare(spark, oracle.connect(sf), queries.QUERIES[key], queries.CHECKS[key], sf)
    assert problem is None and rows > 0, problem
