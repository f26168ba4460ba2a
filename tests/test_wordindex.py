"""Searches of the stored word index against all words of all texts."""

import functools
import random
import re

import pytest
from pyspark.sql import functions as F

from tablelens.operators import textsearch, wordindex


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def split(text):
    return re.findall(r"\w+", (text or "").lower())


@functools.lru_cache(maxsize=None)
def typos(word, term):
    allowed = 2 if len(word) >= 9 else 1 if len(word) >= 5 else 0
    if abs(len(word) - len(term)) > allowed:
        return None
    found = 0 if word == term else distance(word, term)
    return found if found <= allowed else None


def spoil(rng, word, edits):
    letters = list(word)
    for _ in range(edits):
        at = rng.randrange(len(letters) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            letters.insert(at, rng.choice("abcé"))
        elif letters:
            at = min(at, len(letters) - 1)
            letters[at : at + 1] = [rng.choice("abcé")] if kind == 1 else []
    return "".join(letters)


COLUMNS = "id string, resource_type string, user_id string, title string, description string, content string, category string, term string, part int"


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    """Words of 1 to 70 letters over a small alphabet, spoilt copies of them, and odd rows."""
    rng = random.Random(7)
    base = ["".join(rng.choice("abcé") for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 20, 62, 63, 64, 65, 66, 67, 70) for _ in range(4)]
    pool = base + [s for w in base for e in (1, 2, 2, 2, 3) if (s := spoil(rng, w, e))]
    line = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    rows = [(f"d{i}", rng.choice(["x", "y"]), str(i % 3), line(2), line(1) if i % 4 else None, line(30), "", "clash", 1) for i in range(60)]
    rows += [rows[0], ("d1", "x", "9", "again", None, base[0], "", None, None), (None, "x", "0", base[20], "", "", "", None, None), ("none", None, None, None, None, None, None, None, None), ("long", "x", "0", "", "", f"{base[30]} " * 20_000, "", None, None)]
    asked = [(i, " ".join([spoil(rng, rng.choice(base), rng.randrange(3)) or "a", rng.choice(pool)])) for i in range(60)] + [(100, None), (101, "  "), (102, base[40]), (102, base[40])]
    asked += [(200 + i, w) for i, w in enumerate(base)]
    docs = spark.createDataFrame(rows, COLUMNS)
    path = str(tmp_path_factory.mktemp("words") / "index")
    return rows, asked, wordindex.build(docs, path), spark.createDataFrame(asked, "query int, text string")


def brute(rows, asked, kind=None):
    out = {}
    for query in {q for q, _ in asked}:
        wanted = {w for q, t in asked if q == query for w in (t or "").lower().split()}
        for row in rows:
            if row[0] is None or kind is not None and row[1] != kind:
                continue
            for a, text in enumerate(row[3:7]):
                for term in set(split(text)):
                    for w in wanted:
                        t = typos(w, term)
                        if t is not None:
                            have = out.setdefault((query, row[0]), {}).setdefault(w, [t, a])
                            have[:] = min(have[0], t), min(have[1], a)
    return {k: (len(v), sum(t for t, _ in v.values()), min(a for _, a in v.values())) for k, v in out.items()}


def ranked(found):
    by_query = {}
    for (query, id_), v in found.items():
        by_query.setdefault(query, []).append((-v[0], v[1], v[2], id_))
    return {(q, r[3]): (-r[0], r[1], r[2], n) for q, rows in by_query.items() for n, r in enumerate(sorted(rows), 1)}


def as_dict(df):
    return {(r["query"], r["id"]): (r["matched"], r["typos"], r["attribute"], r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("small", [True, False])
def test_search_finds_what_all_words_give(texts, monkeypatch, small):
    rows, asked, index, queries = texts
    if not small:  # terms too many for a broadcast
        monkeypatch.setattr(wordindex, "BROADCAST_ROWS", 3)
    assert as_dict(wordindex.search(index, queries, limit=None)) == ranked(brute(rows, asked))


def test_filters_limit_and_offset(texts):
    rows, asked, index, queries = texts
    want = {k: v for k, v in ranked(brute(rows, asked, "x")).items() if 2 < v[3] <= 5}
    assert as_dict(wordindex.search(index, queries, limit=3, offset=2, equal={"resource_type": "x"})) == want


def test_same_ranking_as_the_search_without_an_index(spark, texts):
    rows, asked, index, queries = texts
    docs = spark.createDataFrame(rows, COLUMNS).filter("id IS NOT NULL")
    text = asked[0][1]
    plain = [tuple(r) for r in textsearch.keyword_search(docs, text, limit=15).collect()]
    own = wordindex.search(index, queries.filter("query = 0"), limit=15).orderBy("rank")
    assert plain and [(r["id"], r["matched"], r["typos"], r["attribute"]) for r in own.collect()] == plain


def test_phrases_against_all_places(spark, texts):
    rows, _, index, _ = texts
    asked = [(i, " ".join(split(r[5])[3 * (i % 5) :][: 1 + i % 4])) for i, r in enumerate(rows[:25])] + [(50, f"{split(rows[-1][5])[0]} " * 3), (51, ""), (52, None)]
    found = {(r["query"], r["id"], r["attribute"]): r["places"] for r in wordindex.phrase_search(index, spark.createDataFrame(asked, "query int, text string")).collect()}
    want = {}
    for query, text in asked:
        words = split(text)
        for row in dict.fromkeys(rows):
            for a, held in enumerate(row[3:7]):
                have = split(held)
                n = sum(have[i : i + len(words)] == words for i in range(len(have) - len(words) + 1)) if words and row[0] is not None else 0
                if n:
                    want[query, row[0], a] = want.get((query, row[0], a), 0) + n
    assert found == want and found[50, "long", 2] == 19_998


def test_postings_terms_and_files(texts):
    rows, _, index, _ = texts
    places = sum(len(split(t)) for r in dict.fromkeys(rows) if r[0] is not None for t in r[3:7])
    sums = index.terms.agg(F.sum("places"), F.sum("postings")).first()
    assert sums[0] == places == index.postings.agg(F.sum("n")).first()[0]
    assert sums[1] == index.postings.count()
    longest = index.keys.groupBy("term").count().orderBy(F.length("term").desc()).first()
    assert longest["count"] <= 4  # a long term has a key for itself and its thirds only


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], COLUMNS)
    index = wordindex.build(docs, str(tmp_path / "empty"))
    queries = spark.createDataFrame([(1, "some words")], "query int, text string")
    assert wordindex.search(index, queries).collect() == [] == wordindex.phrase_search(index, queries).collect()
    assert wordindex.search(index, queries.filter("false")).collect() == []


def test_phrases_start_from_their_rarest_word(spark, tmp_path, monkeypatch):
    rows = [(f"d{i}", "x", "1", "the big the red" if i == 7 else "the big the", None, None, None, None, None) for i in range(40)]
    index = wordindex.build(spark.createDataFrame(rows, COLUMNS), str(tmp_path / "index"))
    met, meet = [], wordindex._meet

    def watched(*a):
        out = meet(*a)
        met.append(out.count())
        return out

    monkeypatch.setattr(wordindex, "_meet", watched)
    found = wordindex.phrase_search(index, spark.createDataFrame([(1, "the red"), (2, "red"), (3, "red the"), (4, "the unseen")], "query int, text string"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "d7", 0, 1), (2, "d7", 0, 1)]
    assert met[0] == 3  # the places of "red" for three queries, none of the unknown word's


@pytest.mark.parametrize("most", [1, 5, 1 << 18])
def test_postings_are_made_without_a_shuffle(spark, monkeypatch, most):
    monkeypatch.setattr(wordindex, "ROUND_WORDS", most)
    texts = ["b a b", "", None, "c", "a a", "  ", "b c a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", textsearch.words(F.col("text")).alias("words"))
    placed = wordindex._placed(rows)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    want = [(i, w, [n for n, x in enumerate(split(t)) if x == w]) for i, t in enumerate(texts) for w in set(split(t))]
    assert sorted(tuple(r) for r in placed.collect()) == sorted(want)
