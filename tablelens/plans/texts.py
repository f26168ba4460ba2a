"""Text, vectors, keys, guarded SQL, insights, the ingest run, and event windows."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, functions as F

from tablelens.operators import dashboard, dependencies, forecast, forest, insights, keys, models, quality, series, textsearch, vectors, wordindex
from tablelens.operators.profile import Profile
from tablelens.operators.sqlgate import read_only_sql
from tablelens.operators.transform import transform_hook
from tablelens.plans import inputs
from tablelens.plans.profiles import typed_sql
from tablelens.plans.registry import query, table
from tablelens.plans.tables import KPI_SQL, ORDER_KEYS
from tablelens.session import scratch_path
from tablelens.sources import stores
from tablelens.streaming import rates

log = logging.getLogger(__name__)

# Word characters as the Spark side counts them, for the SQL side.
LETTERS = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(
    "vector_topk",
    """WITH t AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, t
    WHERE label = 2 ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 5""",
)
def vector_topk(spark, sf):
    df = table(spark, sf, "embeddings")
    target = df.filter("vec_id = 0").first()["embedding"]
    out = vectors.vector_topk(df, "embedding", target, 5, "vec_id", {"label": 2})
    return out.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(
    "vector_topk_batch",
    """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS t FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query, vec_id AS key, list_cosine_similarity(embedding::DOUBLE[], t) AS score FROM embeddings, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, key) AS rank FROM s)
    SELECT query, key, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def vector_topk_batch(spark, sf):
    df = table(spark, sf, "embeddings")
    out = vectors.vector_topk_batch(df, "embedding", "vec_id", df.filter("vec_id % 20 = 0"), "embedding", "vec_id")
    return out.withColumn("score", F.round("score", 6))


@query("text_embed")
def text_embed(spark, sf):
    return vectors.text_embed(table(spark, sf, "documents"), "text").select("doc_id", "embedding")


@query(
    "text_embed_checks",
    "SELECT doc_id, CAST(384 AS INTEGER) AS dimensions, true AS unit_length FROM documents",
)
def text_embed_checks(spark, sf):
    """The size of every vector, and whether its length is one (zero where a text has no word)."""
    found = vectors.text_embed(table(spark, sf, "documents"), "text")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    length = F.when(F.size(textsearch.words(F.col("text"))) > 0, 1.0).otherwise(0.0)
    return found.select("doc_id", F.size("embedding").alias("dimensions"), (F.abs(square - length) < 1e-6).alias("unit_length"))


SEARCH_SQL = """docs AS (
  SELECT 'dataset_' || doc_id AS id, CAST(doc_id AS VARCHAR) AS resource_id, 'dataset' AS resource_type, CAST(NULL AS VARCHAR) AS user_id, source AS title,
    '' AS description, text AS content, lang AS category, CAST(NULL AS VARCHAR) AS created_at FROM documents
  UNION ALL SELECT 'dashboard_' || page_id, CAST(page_id AS VARCHAR), 'dashboard', CAST(page_id % 10 AS VARCHAR), url, coalesce(html, ''), 'Query history: ' || url, '', NULL FROM pages
  UNION ALL SELECT 'insight_' || item_id, CAST(item_id AS VARCHAR), 'insight', NULL, 'item ' || item_id, text, '', 'Info', NULL FROM benchmark)"""


def search_docs_df(spark, sf) -> DataFrame:
    d, g, b = (table(spark, sf, n) for n in ("documents", "pages", "benchmark"))
    page = F.col("page_id")
    parts = [
        textsearch.search_document(d, "dataset", F.col("doc_id"), F.col("source"), content=F.col("text"), category=F.col("lang")),
        textsearch.search_document(
            g, "dashboard", page, F.col("url"), F.col("html"), content=F.concat(F.lit("Query history: "), "url"), owner=page % 10
        ),
        textsearch.search_document(
            b, "insight", F.col("item_id"), F.concat(F.lit("item "), F.col("item_id").cast("string")), F.col("text"), category=F.lit("Info")
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("search_docs", f"WITH {SEARCH_SQL} SELECT * FROM docs")
def search_docs(spark, sf):
    return search_docs_df(spark, sf)


@query(
    "keyword_search",
    f"""WITH {SEARCH_SQL}, w AS (
      SELECT id, a, unnest(list_distinct(regexp_extract_all(lower(t), '{LETTERS}'))) AS word FROM (
        SELECT id, unnest([0, 1, 2, 3]) AS a, unnest([title, description, content, category]) AS t FROM docs WHERE resource_type = 'dataset')),
    q AS (SELECT * FROM (VALUES (0, 'src1', 0), (1, 'license', 1), (2, 'permission', 2)) v(q, wanted, allowed)),
    h AS (SELECT id, q, min(CASE WHEN word = wanted THEN 0 ELSE levenshtein(word, wanted) END) AS t, min(a) AS a FROM w JOIN q
      ON word = wanted OR (allowed > 0 AND abs(length(word) - length(wanted)) <= allowed AND levenshtein(word, wanted) <= allowed) GROUP BY id, q)
    SELECT id, count(*) AS matched, CAST(sum(t) AS BIGINT) AS typos, CAST(min(a) AS INTEGER) AS attribute FROM h GROUP BY id ORDER BY matched DESC, typos, attribute, id LIMIT 20 OFFSET 2""",
)
def keyword_search(spark, sf):
    return textsearch.keyword_search(search_docs_df(spark, sf), "src1 license permission", resource_type="dataset", limit=20, offset=2)


# The SQL side's edit distance counts bytes, so letters beyond ASCII get one free byte each (words are lower-cased).
FREE_BYTES = "".join(map(chr, [*range(65, 91), *range(1, 32), *range(58, 65), 33, *range(35, 39), *range(40, 48)]))

# Three neighbouring words of every benchmark item are a query: the last three, as the index splits words.
ASKED_SQL = f"""asked AS (SELECT item_id AS query, list_slice(regexp_extract_all(lower(text), '{LETTERS}'), -3, -1) AS words FROM benchmark),
    all_words AS (SELECT id, a, regexp_extract_all(lower(t), '{LETTERS}') AS words FROM (
        SELECT id, unnest([0, 1, 2, 3]) AS a, unnest([title, description, content, category]) AS t FROM docs))"""


def indexed(spark, sf) -> tuple[wordindex.WordIndex, DataFrame]:
    """The index of all search documents, and the queries asked of it."""
    all_words = textsearch.words(F.col("text"))
    last = F.slice(all_words, F.greatest(F.size(all_words) - 2, F.lit(1)), 3)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.array_join(last, " ").alias("text"))
    return wordindex.build(search_docs_df(spark, sf), scratch_path(spark, "words")), asked


@query(
    "keyword_index",
    f"""WITH {SEARCH_SQL}, {ASKED_SQL},
    q AS (SELECT query, unnest(list_distinct(words)) AS wanted FROM asked),
    p AS (SELECT wanted, CASE WHEN length(wanted) >= 9 THEN 2 WHEN length(wanted) >= 5 THEN 1 ELSE 0 END AS allowed FROM (SELECT DISTINCT wanted FROM q)),
    w AS (SELECT DISTINCT id, a, unnest(words) AS word FROM all_words),
    l AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS letters FROM (SELECT DISTINCT unnest(regexp_extract_all(word, '[^\\x00-\\x7F]')) AS c
      FROM (SELECT word FROM w UNION ALL SELECT wanted FROM p))),
    v AS (SELECT word, translate(word, letters, '{FREE_BYTES}') AS x FROM (SELECT DISTINCT word FROM w), l),
    y AS (SELECT wanted, allowed, translate(wanted, letters, '{FREE_BYTES}') AS z FROM p, l),
    m AS (SELECT wanted, word, CASE WHEN word = wanted THEN 0 ELSE levenshtein(x, z) END AS t FROM v JOIN y
      ON word = wanted OR (allowed > 0 AND abs(length(x) - length(z)) <= allowed AND levenshtein(x, z) <= allowed)),
    h AS (SELECT query, id, wanted, min(t) AS t, min(a) AS a FROM q JOIN m USING (wanted) JOIN w USING (word) GROUP BY ALL),
    f AS (SELECT query, id, count(*) AS matched, CAST(sum(t) AS BIGINT) AS typos, CAST(min(a) AS INTEGER) AS attribute FROM h GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY matched DESC, typos, attribute, id) AS INTEGER) AS rank FROM f)
    SELECT query, id, matched, typos, attribute, rank FROM r WHERE rank <= 20""",
)
def keyword_index(spark, sf):
    """The first 20 documents of every query, found in a stored index."""
    index, asked = indexed(spark, sf)
    return wordindex.search(index, asked, limit=20).select("query", "id", "matched", "typos", "attribute", "rank")


@query(
    "phrase_index",
    f"""WITH {SEARCH_SQL}, {ASKED_SQL},
    w AS (SELECT id, a, unnest(words) AS word, unnest(range(len(words))) AS position FROM all_words),
    q AS (SELECT query, len(words) AS size, unnest(words) AS word, unnest(range(len(words))) AS step FROM asked),
    s AS (SELECT query, size, id, a, position - step AS start, count(*) AS met FROM q JOIN w USING (word) GROUP BY ALL)
    SELECT query, id, CAST(a AS INTEGER) AS attribute, count(*) AS places FROM s WHERE met = size GROUP BY ALL""",
)
def phrase_index(spark, sf):
    """Every document that holds the words of a query one after another."""
    index, asked = indexed(spark, sf)
    return wordindex.phrase_search(index, asked).select("query", "id", "attribute", "places")


@query(
    "overlap",
    f"""WITH s AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_extract_all(lower(text), '{LETTERS}'), lambda x: length(x) >= 3
        AND NOT list_contains({sql_list(textsearch.OVERLAP_STOP_WORDS)}, x))) AS w FROM conversations),
      p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn, role) AS v, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role) AS before FROM s)
    SELECT conv_id, turn, round(CASE WHEN len(w) = 0 OR len(v) = 0 THEN 1.0 ELSE len(list_intersect(w, v)) / least(len(w), len(v)) END, 6)::DOUBLE AS overlap
    FROM p WHERE role = 'assistant' AND before = 'user'""",
)
def overlap(spark, sf):
    from pyspark.sql import Window

    turns = Window.partitionBy("conv_id").orderBy("turn", "role")
    df = table(spark, sf, "conversations").withColumns({"before": F.lag("text").over(turns), "before_role": F.lag("role").over(turns)})
    pairs = df.filter((F.col("role") == "assistant") & (F.col("before_role") == "user"))
    return pairs.select("conv_id", "turn", F.round(textsearch.overlap(F.col("text"), F.col("before")), 6).alias("overlap"))


@query(
    "tfidf_top",
    f"""WITH w AS (SELECT doc_id AS key, unnest(list_filter(regexp_extract_all(lower(text), '{LETTERS}'), lambda x: length(x) >= 2)) AS term FROM documents),
      c AS (SELECT key, term, count(*) AS tf FROM w WHERE NOT list_contains({sql_list(textsearch.FUNCTION_WORDS)}, term) GROUP BY ALL),
      t AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY term ORDER BY total DESC, term LIMIT 5),
      x AS (SELECT key, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN t USING (term))
    SELECT key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS weight FROM x""",
)
def tfidf_top(spark, sf):
    return textsearch.tfidf_top(table(spark, sf, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


# -- keys ---------------------------------------------------------------------


# Every table, with the prefix that its column names carry.
PREFIXES = {
    "region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_", "events": "",
    "documents": "", "embeddings": "", "pages": "", "benchmark": "", "labels": "", "conversations": "",
}


def _plain_tables(spark, sf):
    out = {}
    for n, prefix in PREFIXES.items():
        df = table(spark, sf, n)
        out[n] = df.toDF(*[c.removeprefix(prefix) for c in df.columns])
    return out


KEY_PAIRS = [
    (a, name, PREFIXES[a] + name, b, name, PREFIXES[b] + name, 0.95)
    for a, b, name in (
        ("region", "nation", "regionkey"),
        ("nation", "customer", "nationkey"),
        ("nation", "supplier", "nationkey"),
        ("customer", "supplier", "nationkey"),
        ("customer", "orders", "custkey"),
        ("supplier", "lineitem", "suppkey"),
        ("part", "lineitem", "partkey"),
        ("orders", "lineitem", "orderkey"),
        ("documents", "labels", "doc_id"),
    )
]


def _measure_sql(t1, n1, c1, t2, n2, c2, conf) -> str:
    return f"""SELECT '{t1}' AS left_table, '{n1}' AS left_column, '{t2}' AS right_table, '{n2}' AS right_column, {conf}::DOUBLE AS confidence,
      count(l.k) AS left_keys, count(r.k) AS right_keys, round(count(CASE WHEN l.k = r.k THEN 1 END) / count(l.k), 6) AS left_contained,
      round(count(CASE WHEN l.k = r.k THEN 1 END) / count(r.k), 6) AS right_contained,
      CASE WHEN max(l.n) = 1 AND max(r.n) = 1 THEN 'one-to-one' WHEN max(l.n) = 1 THEN 'one-to-many' WHEN max(r.n) = 1 THEN 'many-to-one' ELSE 'many-to-many' END AS relationship
      FROM (SELECT {c1} AS k, count(*) AS n FROM {t1} GROUP BY 1) l FULL JOIN (SELECT {c2} AS k, count(*) AS n FROM {t2} GROUP BY 1) r ON l.k = r.k"""


@query("detect_keys", " UNION ALL ".join(_measure_sql(*p) for p in KEY_PAIRS))
def detect_keys(spark, sf):
    out = keys.detect_keys(_plain_tables(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("left_contained", "right_contained")})


@query(
    "join_detected",
    "SELECT quality, lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
)
def join_detected(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    pair = keys.candidate_pairs({"documents": docs.columns, "labels": labels.columns})[0]
    joined = keys.join_detected(docs, labels, pair)
    return joined.groupBy("quality", "lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


# Columns with values that can be compared, for the SQL side only: n numbers, s texts, t times.
ATOMS = {
    "region": "n r_regionkey s r_name",
    "nation": "n n_nationkey s n_name n n_regionkey",
    "customer": "n c_custkey s c_name n c_nationkey n c_acctbal s c_mktsegment",
    "supplier": "n s_suppkey s s_name n s_nationkey n s_acctbal",
    "part": "n p_partkey s p_name s p_brand s p_type n p_size n p_retailprice",
    "orders": "n o_orderkey n o_custkey s o_orderstatus n o_totalprice t o_orderdate s o_orderpriority",
    "lineitem": "n l_orderkey n l_partkey n l_suppkey n l_linenumber n l_quantity n l_extendedprice n l_discount n l_tax s l_returnflag s l_linestatus t l_shipdate",
    "events": "n event_id t ts n user_id s event_type n value s props",
    "documents": "n doc_id s text s lang s source n n_chars",
    "embeddings": "n vec_id n label",
    "pages": "n page_id s url s html",
    "benchmark": "n item_id s text",
    "labels": "n doc_id n quality n toxic",
    "conversations": "n conv_id n turn s role s text",
}


def _atom_sql(kind: str, name: str) -> str:
    if kind == "n":
        plain = f"CASE WHEN {name} = floor({name}) AND abs({name}) < 1e18 THEN CAST(CAST({name} AS DECIMAL(38, 0)) AS VARCHAR) ELSE CAST(CAST({name} AS DOUBLE) AS VARCHAR) END"
        return f"'n' || {plain}"
    return f"'{kind}' || CAST({name} AS VARCHAR)"


def _atoms_of(name: str) -> list[tuple[str, str]]:
    said = ATOMS[name].split()
    return list(zip(said[::2], said[1::2]))


_EVERY_VALUE = " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, {_atom_sql(k, c)} AS v FROM {t} WHERE {c} IS NOT NULL" for t in ATOMS for k, c in _atoms_of(t))
_EVERY_SIZE = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in ATOMS)


def _pairs_sql(name: str) -> str:
    atoms = [(c, _atom_sql(k, c)) for k, c in _atoms_of(name)]
    singles = " UNION ALL ".join(f"SELECT '{c}' AS c, count(DISTINCT {a}) AS n FROM {name}" for c, a in atoms)
    pairs = " UNION ALL ".join(
        f"SELECT '{c}' AS c, '{d}' AS d, count(DISTINCT ({a}, {b})) FILTER ({c} IS NOT NULL AND {d} IS NOT NULL) AS n FROM {name}"
        for i, (c, a) in enumerate(atoms)
        for d, b in atoms[i + 1 :]
    )
    return f"""SELECT '{name}' AS "table", c AS columns FROM ({singles}) WHERE n = (SELECT count(*) FROM {name})
      UNION ALL SELECT '{name}', c || ',' || d FROM ({pairs}) WHERE n = (SELECT count(*) FROM {name})
        AND c NOT IN (SELECT c FROM ({singles}) WHERE n = (SELECT count(*) FROM {name})) AND d NOT IN (SELECT c FROM ({singles}) WHERE n = (SELECT count(*) FROM {name}))"""


@query(
    "inclusion_dependencies",
    f"""WITH v AS MATERIALIZED ({_EVERY_VALUE}), s AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL), sizes AS ({_EVERY_SIZE}),
    j AS (SELECT a.t, a.c, b.t AS u, b.c AS d, count(*) AS n FROM v a JOIN v b ON a.v = b.v AND (a.t, a.c) <> (b.t, b.c) GROUP BY ALL)
    SELECT j.t AS "table", j.c AS columns, j.u AS ref_table, j.d AS ref_columns, x.n AS values, y.n AS ref_values, y.n = sizes.n AS ref_is_key
    FROM j JOIN s x ON x.t = j.t AND x.c = j.c AND x.n = j.n JOIN s y ON y.t = j.u AND y.c = j.d JOIN sizes ON sizes.t = j.u""",
)
def inclusion_dependencies(spark, sf):
    """Which column's values all occur in which other column, over all tables, names unseen."""
    return dependencies.inclusions({n: table(spark, sf, n) for n in ATOMS}, composite=False)


@query("column_keys", " UNION ALL ".join(_pairs_sql(t) for t in ATOMS))
def column_keys(spark, sf):
    """Columns and pairs of columns that tell all rows of their table apart."""
    found = [(n, ",".join(k)) for n in ATOMS for k in dependencies.keys_of(table(spark, sf, n))]
    return spark.createDataFrame(found, "table string, columns string")


# -- SQL and user code ----------------------------------------------------------


@query(
    "read_only_sql",
    """SELECT o_orderpriority AS schema, round(sum(o_totalprice), 2) AS total FROM orders
       WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY total DESC""",
)
def q_read_only_sql(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    text = """SELECT o_orderpriority AS schema, round(sum(o_totalprice), 2) AS total -- drop table orders
      FROM orders /* delete from orders */ WHERE o_orderstatus = 'F' GROUP BY o_orderpriority ORDER BY total DESC;"""
    return read_only_sql(spark, text, allowed={"orders"})


@query(
    "transform_hook",
    """SELECT 'before' AS side, count(*) AS rows, CAST(6 AS INTEGER) AS columns FROM orders
       UNION ALL SELECT 'after', count(*), CAST(7 AS INTEGER) FROM orders WHERE o_totalprice > 120000""",
)
def q_transform_hook(spark, sf):
    def keep_large(df: DataFrame) -> DataFrame:
        return df.filter(F.col("o_totalprice") > 120000).withColumn("raised", F.col("o_totalprice") * 1.1)

    return transform_hook(table(spark, sf, "orders"), keep_large)[1]


# -- insights -------------------------------------------------------------------


def _kpis(spark, sf, df=None):
    df = inputs.orders_shift(spark, sf) if df is None else df
    return dashboard.kpis(df, "o_totalprice", ORDER_KEYS, "o_orderpriority", "o_orderstatus")




@query(
    "insight_growth",
    f"""WITH {inputs.ORDERS_SHIFT}, r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders_shift),
    h AS (SELECT sum(o_totalprice) FILTER (i < n // 2) AS h1, sum(o_totalprice) FILTER (i >= n // 2) AS h2 FROM r), g AS (SELECT (h2 - h1) / h1 * 100 AS g FROM h)
    SELECT CASE WHEN g > 0 THEN 'Significant Growth Acceleration Detected' ELSE 'Significant Revenue Contraction Detected' END AS title,
    CASE WHEN abs(g) > 25 THEN 'High' ELSE 'Medium' END AS severity, CAST(least(95, floor(abs(g) * 2.5)) AS INTEGER) AS score,
    CASE WHEN g > 0 THEN 'Growth' ELSE 'Risk' END AS category FROM g WHERE abs(g) > 10""",
)
def insight_growth(spark, sf):
    return insights.growth_insight(_kpis(spark, sf)).select("title", "severity", "score", "category")


@query("insight_anomaly")
def insight_anomaly(spark, sf):
    found = forest.univariate_anomalies(inputs.orders_shift(spark, sf), "o_totalprice", ["o_orderkey"], date="o_orderdate")
    return insights.anomaly_insight(found)


def _gappy(spark, sf):
    """Orders with half of three columns missing."""
    odd = F.col("o_orderkey") % 4 == 0
    return table(spark, sf, "orders").withColumns(
        {c: F.when(odd, F.col(c)) for c in ("o_orderpriority", "o_orderstatus", "o_custkey")}
    )


@query(
    "insight_quality",
    """WITH q AS (SELECT CAST(greatest(50, floor(100 - 3 * count(*) FILTER (o_orderkey % 4 <> 0) / (6 * count(*)) * 100)) AS INTEGER) AS q FROM orders)
    SELECT 'Degraded Dataset Integrity Rating' AS title, CASE WHEN q < 60 THEN 'High' ELSE 'Medium' END AS severity, CAST(100 - q AS INTEGER) AS score, 'Risk' AS category FROM q WHERE q < 80""",
)
def insight_quality(spark, sf):
    return insights.quality_insight(_kpis(spark, sf, _gappy(spark, sf))).select("title", "severity", "score", "category")


def _falling(spark, sf):
    """Revenue that shrinks with every day."""
    age = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf, "orders").withColumn("o_totalprice", F.col("o_totalprice") * F.exp(-age / 400.0))


@query("insight_forecast")
def insight_forecast(spark, sf):
    daily = series.daily_series(_falling(spark, sf), "o_orderdate", "o_totalprice")
    return insights.forecast_insight(forecast.forecast(daily, [], 7))


@query("insight_model")
def insight_model(spark, sf):
    df = table(spark, sf, "customer").withColumn("churned", (F.col("c_acctbal") < 0).cast("string"))
    t = models.classification_tournament(Profile(df), "churned")
    root = scratch_path(spark, "models")
    models.save_model(spark, t, root, "customer")
    return insights.model_insight(models.run_history(spark, root))


@query("insights")
def all_insights(spark, sf):
    df = inputs.orders_shift(spark, sf)
    anomalies = forest.univariate_anomalies(df, "o_totalprice", ["o_orderkey"], date="o_orderdate")
    daily = series.daily_series(df, "o_orderdate", "o_totalprice")
    root = scratch_path(spark, "insights")
    models.save_model(spark, models.train(Profile(df), ORDER_KEYS), f"{root}/models", "orders_churn")
    history = models.run_history(spark, f"{root}/models", "orders_churn")
    found = insights.all_insights("orders_churn", _kpis(spark, sf), anomalies, forecast.forecast(daily, [], 7), history)
    stores.replace_insights(found, f"{root}/found", ("orders_churn",))
    return stores.read_insights(spark, f"{root}/found")


@query(
    "narrative",
    """WITH s AS (SELECT c_mktsegment AS seg, sum(c_acctbal) AS t FROM customer GROUP BY 1 ORDER BY 2 DESC LIMIT 1), a AS (SELECT avg(c_acctbal) AS m, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS n, sum(c_acctbal) AS total FROM customer)
    SELECT CAST(1 AS INTEGER) AS rank, 'headline' AS type, 'Primary Metric Overview (c_acctbal)' AS title, 0.98::DOUBLE AS significance, format('Across {} records, c_acctbal recorded a mean of {:,.2f} (min: {:,.2f}, max: {:,.2f}).', n, m, lo, hi) AS narrative, CAST(NULL AS VARCHAR) AS causal_factor FROM a
    UNION ALL SELECT 2, 'causal_driver', 'Key Driver Analysis by c_mktsegment', 0.92, format('Segment ''{}'' is the primary driver, contributing {:.1f}% ({:,.2f}) of total c_acctbal.', seg, round(t / total * 100, 1), t), format('High concentration in c_mktsegment=''{}'' directly explains total volume shift.', seg) FROM s, a""",
)
def narrative(spark, sf):
    return insights.narrative(table(spark, sf, "customer"), "c_acctbal", "c_mktsegment")


@query(
    "profile_narrative",
    """WITH s AS (SELECT l_returnflag AS seg, sum(l_quantity) AS t FROM lineitem GROUP BY 1 ORDER BY 2 DESC LIMIT 1), a AS (SELECT avg(l_quantity) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n, sum(l_quantity) AS total FROM lineitem)
    SELECT CAST(1 AS INTEGER) AS rank, 'Primary Metric Overview (l_quantity)' AS title, format('Across {} records, l_quantity recorded a mean of {:,.2f} (min: {:,.2f}, max: {:,.2f}).', n, m, lo, hi) AS narrative, CAST(NULL AS VARCHAR) AS causal_factor FROM a
    UNION ALL SELECT 2, 'Key Driver Analysis by l_returnflag', format('Segment ''{}'' is the primary driver, contributing {:.1f}% ({:,.2f}) of total l_quantity.', seg, round(t / total * 100, 1), t), format('High concentration in l_returnflag=''{}'' directly explains total volume shift.', seg) FROM s, a
    UNION ALL SELECT 3, 'Temporal Velocity across l_shipdate', 'Ordered by l_shipdate, the series shows stable variance with local peaks.', NULL""",
)
def profile_narrative(spark, sf):
    """Metric, dimension and date chosen by the profile of the table without its keys."""
    p = Profile(table(spark, sf, "lineitem").drop("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    return insights.profile_narrative(p).select("rank", "title", "narrative", "causal_factor")


@query("context_summary")
def context_summary(spark, sf):
    df = inputs.cust_geo(spark, sf)
    p = Profile(df)
    k = dashboard.kpis(df, "c_acctbal", ["c_custkey"], "c_mktsegment", "region")
    found = forest.univariate_anomalies(df, "c_acctbal", ["c_custkey"], category="c_mktsegment", geo="region")
    return insights.context_summary(p, k, found, "customers", "region", "c_acctbal")


@query(
    "context_summary_checks",
    f"""{typed_sql('cust_geo')}, a AS (SELECT count(*) AS n, sum(c_acctbal) AS t, avg(c_acctbal) AS m FROM customer),
    d AS (SELECT *, cat IN ('categorical', 'datetime') OR role IN ('geo', 'temporal') AS dim FROM typed),
    v AS (SELECT nation AS x, count(*) AS n FROM cust_geo GROUP BY 1 ORDER BY n DESC, x LIMIT 10),
    r AS (SELECT region AS x, count(*) AS n FROM cust_geo GROUP BY 1 ORDER BY n DESC, x LIMIT 10),
    g AS (SELECT region, round(sum(c_acctbal), 2) AS s, count(*) AS n FROM cust_geo GROUP BY 1 ORDER BY s DESC, region LIMIT 1)
    SELECT CAST(0 AS INTEGER) AS position, 'Dataset: customers' AS line UNION ALL SELECT 1, 'Primary target metric: c_acctbal'
    UNION ALL SELECT 2, format('Total rows: {{}}', n) FROM a UNION ALL SELECT 3, format('Total aggregate value: {{:,.2f}}', t) FROM a
    UNION ALL SELECT 4, format('Mean value: {{:,.2f}}', m) FROM a
    UNION ALL SELECT 6, 'Categories in ''nation'': [' || (SELECT string_agg(x, ', ' ORDER BY n DESC, x) FROM v) || ']'
    UNION ALL SELECT 7, 'Regions in ''region'': [' || (SELECT string_agg(x, ', ' ORDER BY n DESC, x) FROM r) || ']'
    UNION ALL SELECT 8, format('Top region: ''{{}}'' with value {{:,.2f}} ({{}} records)', region, s, n) FROM g
    UNION ALL SELECT 11, 'Metric total_' || "column" || ': sum of ' || "column" FROM d WHERE NOT dim AND cat = 'numeric'
    UNION ALL SELECT 11, 'Metric average_' || "column" || ': avg of ' || "column" FROM d WHERE NOT dim AND cat = 'numeric'
    UNION ALL SELECT 12, 'Dimension ' || "column" || ': ' || "column" FROM d WHERE dim""",
)
def context_summary_checks(spark, sf):
    """The lines that plain SQL can state: all but growth (5) and the anomalies of a forest (9, 10)."""
    return context_summary(spark, sf).filter(~F.col("position").isin(5, 9, 10))


# Name words of the metric that is forecast first.
METRIC_WORDS = ("revenue", "sales", "price", "amount")


@query(
    "ingest_run",
    """SELECT CAST(position AS INTEGER) AS position, stage, 'done' AS status, CASE kept WHEN 'all' THEN (SELECT count(*) FROM orders) WHEN 'one' THEN 1 WHEN 'month' THEN 30 END AS rows
    FROM (VALUES (0, 'read', 'all'), (1, 'validate', 'one'), (2, 'clean', 'all'), (3, 'index', 'one'), (4, 'forecast', 'month'),
      (5, 'models', 'one'), (6, 'segments', 'all'), (7, 'anomalies', 'all'), (8, 'insights', 'some')) v(position, stage, kept)""",
)
def ingest_run(spark, sf):
    """All stages over one table, with the rows each one stored (null for the insights, whose number depends on models).

    A failing model stage is reported and does not stop the run.
    """
    df = inputs.orders_shift(spark, sf)
    root = scratch_path(spark, "run")
    report: list[tuple] = []
    state: dict = {}

    def stage(name: str, work, optional: bool = False) -> None:
        try:
            rows, status = work(), "done"
        except Exception as error:  # noqa: BLE001 - optional stages may fail
            if not optional:
                raise
            log.warning("stage %s skipped: %s", name, error)
            rows, status = None, "skipped"
        report.append((len(report), name, status, rows))

    def kept(found: DataFrame, place: str) -> int:
        found.write.parquet(f"{root}/{place}")
        return spark.read.parquet(f"{root}/{place}").count()

    def read():
        path = stores.write_dataset(df, root, "orders")
        state["df"] = spark.read.parquet(path)
        state["profile"] = Profile(state["df"])
        return state["profile"].rows

    def validate():
        rules = quality.infer_rules(state["df"].schema)
        return kept(quality.quality_score(state["df"], rules, ["o_orderkey"]), "quality")

    def clean():
        healed = quality.auto_heal(state["df"], state["profile"].rows)
        return spark.read.parquet(stores.write_dataset(healed, root, "orders_healed")).count()

    def index():
        one = state["df"].agg(F.count(F.lit(1)).alias("rows"))
        columns = ", ".join(state["df"].columns)
        doc = textsearch.search_document(one, "dataset", F.lit("orders"), F.lit("orders"), F.format_string("%d rows", "rows"), F.lit(f"File columns: {columns}"))
        return kept(doc, "search")

    def predict():
        names = state["profile"].numeric
        metric = next((n for n in names if any(w in n.lower() for w in METRIC_WORDS)), names[0])
        state["metric"] = metric
        daily = series.daily_series(state["df"], state["profile"].primary["date"], metric)
        return kept(forecast.forecast(daily, [], 30), "forecast")

    def learn():
        models.save_model(spark, models.train(state["profile"], ORDER_KEYS), f"{root}/models", "orders")
        return models.run_history(spark, f"{root}/models", "orders").count()

    def cluster():
        model, found, _ = models.segments(state["profile"])
        model.write().save(f"{root}/segment_model")
        return kept(found.drop("features"), "segments")

    def isolate():
        return kept(forest.multivariate_outliers(state["df"], state["profile"].numeric, ["o_orderkey"]), "anomalies")

    def conclude():
        odd = forest.univariate_anomalies(state["df"], state["metric"], ["o_orderkey"], date=state["profile"].primary["date"])
        ahead, history = spark.read.parquet(f"{root}/forecast"), models.run_history(spark, f"{root}/models", "orders")
        found = insights.all_insights("orders", _kpis(spark, sf, state["df"]), odd, ahead, history)
        stores.replace_insights(found, f"{root}/insights", ("orders",))
        return None

    stage("read", read)
    stage("validate", validate)
    stage("clean", clean)
    stage("index", index)
    stage("forecast", predict, optional=True)
    stage("models", learn, optional=True)
    stage("segments", cluster, optional=True)
    stage("anomalies", isolate, optional=True)
    stage("insights", conclude, optional=True)
    return spark.createDataFrame(report, "position int, stage string, status string, rows long")


# -- event windows ----------------------------------------------------------------

WINDOWS_SQL = """w AS (SELECT *, date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS window_start FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS k))"""
BOUNDS = [1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


@query(
    "event_rate",
    f"""WITH {WINDOWS_SQL} SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(count(*) / 300, 6) AS rate FROM w GROUP BY ALL""",
)
def event_rate(spark, sf):
    out = rates.event_rate(table(spark, sf, "events"), "ts", "event_type")
    return _shown(out).select("window_start", "event_type", "events", F.round("rate", 6).alias("rate"))


def _shown(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "event_rate_stream",
    f"""WITH {WINDOWS_SQL} SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(count(*) / 300, 6) AS rate FROM w
    WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def event_rate_stream(spark, sf):
    """The same rates from a stream over the files: windows the watermark has closed."""
    whole = table(spark, sf, "events")
    stream = spark.readStream.schema(whole.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = scratch_path(spark, "rates")
    rates.run_available(rates.event_rate(stream, "ts", "event_type"), f"{out}/data", f"{out}/state")
    done = spark.read.parquet(f"{out}/data")
    return _shown(done).select("window_start", "event_type", "events", F.round("rate", 6).alias("rate"))


def _p95_sql(closed: str = "") -> str:
    counts = ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(BOUNDS))
    cases = " ".join(
        f"WHEN b{i} >= 0.95 * total THEN {BOUNDS[i - 1] if i else 0.0} + {b - (BOUNDS[i - 1] if i else 0.0)} * (0.95 * total - {f'b{i - 1}' if i else 0}) / (b{i} - {f'b{i - 1}' if i else 0})"
        for i, b in enumerate(BOUNDS)
    )
    return f"""WITH {WINDOWS_SQL}, c AS (SELECT window_start, count(value) AS total, {counts} FROM w {closed} GROUP BY 1)
      SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, total, round(CASE {cases} ELSE {BOUNDS[-1]} END, 6)::DOUBLE AS p95 FROM c"""


@query("latency_p95", _p95_sql())
def latency_p95(spark, sf):
    out = rates.latency_p95(table(spark, sf, "events"), "ts", "value", BOUNDS)
    return _shown(out).select("window_start", "total", F.round("p95", 6).alias("p95"))


@query(
    "latency_p95_stream",
    _p95_sql("WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"),
)
def latency_p95_stream(spark, sf):
    """The same percentiles from a stream over the files: windows the watermark has closed."""
    whole = table(spark, sf, "events")
    stream = spark.readStream.schema(whole.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = scratch_path(spark, "latency")
    rates.run_available(rates.latency_p95(stream, "ts", "value", BOUNDS), f"{out}/data", f"{out}/state")
    return _shown(spark.read.parquet(f"{out}/data")).select("window_start", "total", F.round("p95", 6).alias("p95"))
