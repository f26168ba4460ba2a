"""License scan with a positional rare-token index, with DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.  A template is a
licence text of some words, of which those in its key phrases are mandatory.
The index holds the postings (word, template, place) of all template words but
the function words; templates are fixed, so it is a bounded table.

A first pass counts in how many rows each of these words stands: its inverse
document frequency.  The second pass works inside each row.  A file looks up
its ``RARE`` highest-IDF licence words (ties by the word); the difference of a
word's place in the file and its place in a posting says where the template
would begin.  Differences met at ``VOTES`` places or more are candidates.  For
these the words of the whole template are compared with the file's: a candidate
gives its label if all its key phrases stand there and at least ``SHARE`` of its
words do.  The score is the largest share found in candidates, and 1 with a
base phrase.

Texts stay in the tasks that read them: nothing but the word counts (one line a
licence word and task) is shuffled, and nothing is stored.  Work in a row grows
with its words and candidates, for a place is looked up, not searched.

Null and empty texts have no words.  Very long texts are one array of words in
one task.  Repeated rows and null ids keep their rows; an empty table gives none.
Base phrases that occur repeatedly count each time.  Equal shares are equal
scores; labels are distinct and sorted.  Other columns never matter, whatever
their names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

RARE = 16
VOTES = 2
SHARE = 0.75
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Words that no posting is kept for.
FUNCTION_WORDS = ("a", "above", "all", "an", "and", "any", "at", "be", "by", "for", "from", "in", "is", "it", "may", "no", "not", "of", "on", "or", "that", "the", "this", "to", "with", "without", "work", "you")


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # mandatory phrases, each once in the text


# Sentences of public licences.
TEMPLATES = (
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses license 2 0")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial", "license")),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3", "either version 3 of the license or at your option any later version you should have received a copy of the gnu general public license", ("either version 3 of the license", "gnu general public license")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-2", "either version 2 of the license or at your option any later version you should have received a copy of the gnu general public license", ("either version 2 of the license", "gnu general public license")),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "hereby granted")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)


def words(text: Column) -> Column:
    """All words of a text, in order."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def postings(templates=TEMPLATES) -> list[tuple[int, str, int, bool]]:
    """(template, word, place, mandatory) of all words of all templates."""
    out = []
    for number, template in enumerate(templates):
        said = template.text.split()
        must: set[int] = set()
        for key in template.keys:
            k = key.split()
            starts = [i for i in range(len(said)) if said[i : i + len(k)] == k]
            if len(starts) != 1:
                raise ValueError(f"key phrase {key!r} must occur once in its template")
            must.update(range(starts[0], starts[0] + len(k)))
        out += [(number, w, i, i in must) for i, w in enumerate(said)]
    return out


def _base_place(word: Column, place: Column, all_words: Column, phrase: str) -> Column:
    """The start of a phrase whose second word stands here, or null."""
    first, second, *rest = phrase.split()
    near = lambda step, said: F.get(all_words, place + step) == said
    # `get` gives null outside the array, and a null test is no match
    return F.when((word == second) & reduce(Column.__and__, [near(-1, first)] + [near(i + 1, w) for i, w in enumerate(rest)]), place - 1)


def _literal(df_rows: list, kind: str) -> Column:
    """A constant array from JSON, folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps(df_rows)), kind)


def rarest_first(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> list[str]:
    """The indexed licence words, by the number of rows that have them, then by the word."""
    vocabulary = sorted({w for _, w, _, _ in postings(templates)} - set(FUNCTION_WORDS))
    own = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), words(F.col(text_col)))).alias("word"))
    have = {r["word"]: r["count"] for r in own.groupBy("word").count().collect()}  # at most the words of the templates
    return sorted(vocabulary, key=lambda w: (have.get(w, 0), w))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base=BASE) -> DataFrame:
    """One row a document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    by_idf = rarest_first(docs, text_col, templates)
    table = postings(templates)
    entries = [[{"template": t, "at": i} for t, x, i, _ in table if x == w] for w in by_idf]
    index = F.map_from_arrays(F.array(*map(F.lit, by_idf)), _literal(entries, "array<array<struct<template:int,at:int>>>"))
    whole = [[{"word": w, "at": i, "must": m} for n, w, i, m in table if n == t] for t in range(len(templates))]
    whole = _literal(whole, "array<array<struct<word:string,at:int,must:boolean>>>")
    labels = _literal([t.label for t in templates], "array<string>")

    rows = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    # in the order of the first array: the file's licence words, rarest first
    rows = rows.select("id", "words", F.slice(F.array_intersect(F.array(*map(F.lit, by_idf)), "words"), 1, RARE).alias("rare"))
    starts = F.transform("words", lambda w, i: F.coalesce(*[F.when(_base_place(w, i, F.col("words"), p).isNotNull(), F.struct((i - 1).alias("place"), F.lit(label).alias("label"))) for p, label in base]))
    looked = F.transform("words", lambda w, i: F.when(w.isin(by_idf) & F.array_contains("rare", w), F.struct(i.alias("place"), w.alias("word"))))
    rows = rows.select(
        "id",
        "words",
        F.array_compact(starts).alias("base"),
        F.array_compact(looked).alias("looked"),
    )
    # where a template would begin, once for every looked-up word that stands where it should
    votes = F.flatten(F.transform("looked", lambda h: F.transform(F.element_at(index, h.word), lambda p: F.struct(p.template.alias("template"), (h.place - p["at"]).alias("start")))))
    rows = rows.select("id", "words", "base", F.sort_array(votes).alias("votes"))
    agreed = F.filter("votes", lambda v, i: v == F.get("votes", i - (VOTES - 1)))
    rows = rows.select("id", "words", "base", F.array_distinct(agreed).alias("candidates"))
    stands = lambda c: F.filter(F.get(whole, c.template), lambda p: F.get("words", c.start + p["at"]) == p.word)
    rows = rows.select("id", "words", "base", F.transform("candidates", lambda c: F.struct(c.template.alias("template"), stands(c).alias("stands"))).alias("met"))
    keys = lambda said: F.size(F.filter(said, lambda p: p.must))
    tested = F.transform(
        "met",
        lambda m: F.struct(
            F.get(labels, m.template).alias("label"),
            (F.size(m.stands) / F.size(F.get(whole, m.template))).alias("share"),
            (keys(m.stands) == keys(F.get(whole, m.template))).alias("whole"),
        ),
    )
    rows = rows.select("id", F.size("words").cast("long").alias("n_words"), "base", tested.alias("tested"))
    place, base_labels = F.transform("base", lambda b: b.place.cast("long")), F.transform("base", lambda b: b.label)
    own = F.transform(F.filter("tested", lambda t: t.whole & (t.share >= SHARE)), lambda t: t.label)
    listed = lambda said: F.array_join(F.array_sort(F.array_distinct(said)), ",")
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(place).alias("first_word"),
        F.array_max(place).alias("last_word"),
        listed(base_labels).alias("base_labels"),
        listed(F.concat(base_labels, own)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("tested", lambda t: t.share)), F.lit(0.0))).alias("score"),
    )


def license_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return scan(docs.select("doc_id", "text"))
