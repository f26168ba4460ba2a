"""Spellings of one value against all pairs of values."""

import random
import re

from tablelens.operators import variants


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def linked(a, b):
    p, q = (re.sub(r"[^\w]+|_+", " ", v.lower()).strip() for v in (a, b))
    if not p or not q:
        return False
    x, y = p.split(" "), q.split(" ")
    if set(x) == set(y) or (len(x) > 1 and "".join(t[0] for t in x) == q) or (len(y) > 1 and "".join(t[0] for t in y) == p):
        return True
    digits = lambda v: re.sub(r"\D+", " ", v)
    short, long = min(len(p), len(q)), max(len(p), len(q))
    return digits(p) == digits(q) and short >= 5 and long <= 64 and distance(p, q) <= (2 if short >= 9 else 1)


def brute(counts):
    left, out = set(counts), []
    while left:
        group, stack = set(), [min(left)]
        while stack:
            v = stack.pop()
            if v not in group:
                group.add(v)
                stack += [w for w in counts if w != v and linked(v, w)]
        left -= group
        if len(group) > 1:
            name = min(group, key=lambda v: (-counts[v], v))
            out += [("c", name, v, counts[v]) for v in group]
    return sorted(out)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(8)
    names = ["North Holland", "Building", "Saint-Étienne", "Machinery 2000", "Furniture", "United States of America", "New York", "item 17", "Baden Württemberg"]
    values = [*names, "ny", "USOA", "item 18", "!!", "", "holland north", "x" * 70, "x" * 71, "abcd", "abce"]
    for _ in range(150):
        v = list(rng.choice(names))
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(v))
            kind = rng.random()
            if kind < 0.3:
                del v[at]
            elif kind < 0.6:
                v.insert(at, rng.choice("aeinr "))
            else:
                v[at] = rng.choice("AEINR-")
        values.append("".join(v))
    rows = [(v, "k") for v in values for _ in range(rng.randint(1, 4))] + [(None, "k")]
    counts = {v: sum(r[0] == v for r in rows) for v in set(values)}
    found = variants.value_clusters(spark.createDataFrame(rows, "c string, other string"), ["c", "other"])
    assert sorted(tuple(r) for r in found.collect()) == brute(counts)
    assert variants.value_clusters(spark.createDataFrame([], "c string"), ["c"]).count() == 0
