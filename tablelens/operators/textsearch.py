"""Words, overlap, term weights, and typo-tolerant keyword search over text columns.

Words stay in the task that reads them; only term totals and the hits of a search
are shuffled, and nothing gathers the documents of a frequent term in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablelens.functions.semantics import col
from tablelens.session import durable, evenly

# Words ignored when comparing two texts.
OVERLAP_STOP_WORDS = ("the", "and", "for", "with", "this", "that", "from", "then", "have", "been")
# Attributes searched, best first.
SEARCH_ORDER = ("title", "description", "content", "category")
# Typos allowed by word length.
ONE_TYPO_LENGTH, TWO_TYPO_LENGTH = 5, 9

# A frequent-word list for term weights; general English function words.
FUNCTION_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers him his how "
    "i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own "
    "same she should so some such than that the their theirs them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would you your yours".split()
)


def words(c: Column, shortest: int = 1) -> Column:
    """Lower-cased words of a text, in order."""
    pattern = rf"(?U)\w{{{shortest},}}"
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))


def word_set(c: Column) -> Column:
    """Distinct words of at least three letters without stop words."""
    stop = F.array(*[F.lit(w) for w in OVERLAP_STOP_WORDS])
    return F.array_except(words(c, 3), stop)


def overlap(a: Column, b: Column) -> Column:
    """Shared words over the smaller word set; 1 when either side has none."""
    x, y = word_set(a), word_set(b)
    smaller = F.least(F.size(x), F.size(y))
    return F.when(smaller == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / smaller)


def tfidf_top(df: DataFrame, key: str, text: str, n: int = 5, stop_words: tuple[str, ...] = FUNCTION_WORDS) -> DataFrame:
    """(key, term, weight) of the n most frequent terms, each document scaled to unit length.

    weight = tf * (ln((1 + documents) / (1 + df)) + 1) / norm.  Every row is a
    document; its words have at least two letters and are not stop words.  Words
    are exploded and counted in the task that reads them; what is shuffled are
    term totals, and in a second pass the counts of the n terms by document.
    """
    rows = evenly(df.select(col(key).alias("key"), col(text).alias("text")))
    totals = rows.select(F.explode(words(F.col("text"), 2)).alias("term")).filter(~F.col("term").isin(*stop_words)).groupBy("term").count()
    top = [t["term"] for t in totals.orderBy(F.col("count").desc(), "term").limit(n).collect()]
    if not top:
        return df.select(col(key).alias("key"), F.lit("").alias("term"), F.lit(0.0).alias("weight")).filter(F.lit(False))
    tokens = rows.withColumn("row", F.monotonically_increasing_id()).select("key", "row", F.explode(words(F.col("text"), 2)).alias("term"))
    found = durable(tokens.filter(F.col("term").isin(*top)).groupBy("row", "key", "term").agg(F.count("*").alias("tf")))
    texts = {r["term"]: r["count"] for r in found.groupBy("term").count().collect()}
    documents = rows.count()
    rarity = F.create_map(*[c for t in top for c in (F.lit(t), F.log(F.lit((1 + documents) / (1 + texts[t]))) + 1)])
    weighted = found.withColumn("w", F.col("tf") * F.element_at(rarity, F.col("term")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row")))  # at most n rows
    return weighted.select("key", "term", (F.col("w") / norm).alias("weight"))


def search_document(
    df: DataFrame,
    resource_type: str,
    id_: Column,
    title: Column,
    description: Column | None = None,
    content: Column | None = None,
    category: Column | None = None,
    owner: Column | None = None,
    created_at: Column | None = None,
) -> DataFrame:
    """Rows of any table in the shared search shape."""

    def text(c: Column | None) -> Column:
        return F.lit("") if c is None else F.coalesce(c.cast("string"), F.lit(""))

    return df.select(
        F.concat(F.lit(resource_type + "_"), id_.cast("string")).alias("id"),
        id_.cast("string").alias("resource_id"),
        F.lit(resource_type).alias("resource_type"),
        (F.lit(None) if owner is None else owner).cast("string").alias("user_id"),
        text(title).alias("title"),
        text(description).alias("description"),
        text(content).alias("content"),
        text(category).alias("category"),
        (F.lit(None) if created_at is None else created_at).cast("string").alias("created_at"),
    )


def keyword_search(
    documents: DataFrame,
    query: str,
    user_id: str | None = None,
    resource_type: str | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    """Documents ranked by query words matched, then fewest typos, then best attribute.

    Words of five letters or more may differ by one edit, of nine by two.  The
    words of the table are compared with the few query words as plain
    expressions, so no join of words with words takes place.
    """
    if user_id is not None:
        documents = documents.filter(F.col("user_id") == user_id)
    if resource_type is not None:
        documents = documents.filter(F.col("resource_type") == resource_type)
    asked = list(dict.fromkeys(w for w in query.lower().split() if w))

    def typos(word: Column, wanted: str) -> Column:
        allowed = 2 if len(wanted) >= TWO_TYPO_LENGTH else 1 if len(wanted) >= ONE_TYPO_LENGTH else 0
        if allowed == 0:
            return F.when(word == wanted, 0)
        # The length test keeps the edit distance off most words.
        near = F.abs(F.length(word) - len(wanted)) <= allowed
        distance = F.when(near, F.levenshtein(word, F.lit(wanted), allowed))
        return F.when(distance >= 0, distance)

    # Words are exploded and tested in the task that reads them; only hits go on.
    rows = evenly(documents.select("id", *SEARCH_ORDER))
    read = rows.select("id", F.inline(F.array(*[F.struct(F.lit(i).alias("a"), words(F.col(a)).alias("words")) for i, a in enumerate(SEARCH_ORDER)])))
    near = [typos(F.col("word"), w) for w in asked]
    some = reduce(Column.__or__, [t.isNotNull() for t in near], F.lit(False))
    tests = F.array(*[F.struct(F.lit(i).alias("q"), t.alias("t")) for i, t in enumerate(near)]) if near else F.array().cast("array<struct<q:int,t:int>>")
    hits = read.select("id", "a", F.explode("words").alias("word")).filter(some).select("id", "a", F.inline(tests)).filter(F.col("t").isNotNull())
    # At most one narrow row per query word of a matching document; rows with one id count once.
    best = hits.groupBy("id", "q").agg(F.min("t").alias("t"), F.min("a").alias("a"))
    ranked = (
        best.groupBy("id")
        .agg(F.count(F.lit(1)).alias("matched"), F.sum("t").alias("typos"), F.min("a").alias("attribute"))
        .orderBy(F.col("matched").desc(), "typos", "attribute", "id")
        .offset(offset)
        .limit(limit)
    )
    return ranked
