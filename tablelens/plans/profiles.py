"""Column profiles, quality, correlation and information."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tablelens.operators import increments, information, neighbours, profile as prof, variants
from tablelens.operators.profile import Profile
from tablelens.plans import inputs
from tablelens.plans.registry import query, table
from tablelens.session import evenly, scratch_path

# Column kinds of the profiled tables, for the SQL side only.
INT, FLOAT, TEXT, TIME = "int", "float", "text", "time"
KINDS = {
    "documents": {"doc_id": INT, "text": TEXT, "lang": TEXT, "source": TEXT, "n_chars": INT},
    "pages": {"page_id": INT, "url": TEXT, "html": TEXT},
    "events": {"event_id": INT, "ts": TIME, "user_id": INT, "event_type": TEXT, "value": FLOAT, "props": TEXT},
    "orders_text": {"o_orderkey": INT, "o_custkey": INT, "o_orderstatus": TEXT, "o_totalprice": FLOAT, "order_date": TEXT},
    "cust_geo": {"c_custkey": INT, "c_name": TEXT, "c_nationkey": INT, "c_acctbal": FLOAT, "c_mktsegment": TEXT, "nation": TEXT, "region": TEXT},
    "part": {"p_partkey": INT, "p_name": TEXT, "p_brand": TEXT, "p_type": TEXT, "p_size": INT, "p_retailprice": FLOAT},
    "li_nulls": {
        "l_orderkey": INT, "l_partkey": INT, "l_suppkey": INT, "l_linenumber": INT, "l_quantity": FLOAT,
        "l_extendedprice": FLOAT, "l_discount": FLOAT, "l_tax": FLOAT, "l_returnflag": TEXT, "l_linestatus": TEXT, "l_shipdate": TIME,
    },
}
KINDS["li_spikes"] = KINDS["li_nulls"]
KINDS["li_bulk"] = KINDS["li_nulls"]
KINDS["li_dups"] = KINDS["li_nulls"]
KINDS["orders_shift"] = {"o_orderkey": INT, "o_custkey": INT, "o_orderstatus": TEXT, "o_totalprice": FLOAT, "o_orderdate": TIME, "o_orderpriority": TEXT}
KINDS["lineitem"] = KINDS["li_nulls"]

ORDERS_TEXT = """orders_text AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders)"""

DERIVED = {
    "orders_text": ORDERS_TEXT,
    "cust_geo": inputs.CUST_GEO,
    "li_nulls": inputs.LI_NULLS,
    "li_spikes": inputs.LI_SPIKES,
    "li_dups": inputs.LI_DUPS,
    "li_bulk": inputs.LI_BULK,
    "orders_shift": inputs.ORDERS_SHIFT,
}


def orders_text(spark, sf):
    df = table(spark, sf, "orders")
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))


def source(spark, sf, name):
    made = {
        "orders_text": orders_text,
        "cust_geo": inputs.cust_geo,
        "li_nulls": inputs.li_nulls,
        "li_spikes": inputs.li_spikes,
        "li_dups": inputs.li_dups,
        "li_bulk": inputs.li_bulk,
        "orders_shift": inputs.orders_shift,
    }
    return made[name](spark, sf) if name in made else table(spark, sf, name)


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def facts_sql(name: str) -> str:
    """One row of raw measures per column of a table."""
    rows = []
    for i, (c, kind) in enumerate(KINDS[name].items()):
        number, text = kind in (INT, FLOAT), kind == TEXT
        patterns = ", ".join(
            f"count(*) FILTER (regexp_matches(trim({c}), '{p}')) AS {k}" if text else f"0 AS {k}"
            for k, p in prof.TEXT_PATTERNS.items()
        )
        words = c.lower().split("_")
        has = lambda group: any(w in c.lower() for w in group)
        rows.append(
            f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS kind, count(*) AS n,
            count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) + coalesce(max(CAST({c} IS NULL AS INT)), 0) AS card,
            {f'avg(length({c}))' if text else 'NULL'} AS len,
            {f"count(*) FILTER (try_strptime({c}, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S']) IS NOT NULL)" if text else '0'} AS dates,
            {f"coalesce(bool_or(lower({c}) IN ({_quoted(prof.GEO_VALUES)})), false)" if text else 'false'} AS geo, {patterns},
            {f'CAST(min({c}) AS DOUBLE)' if number else 'NULL'} AS lo, {f'CAST(max({c}) AS DOUBLE)' if number else 'NULL'} AS hi,
            {f'avg({c})' if number else 'NULL'} AS mean, {f'stddev_samp({c})' if number else 'NULL'} AS std,
            {f'quantile_cont({c}::DOUBLE, 0.25)' if number else 'NULL'} AS q1, {f'quantile_cont({c}::DOUBLE, 0.5)' if number else 'NULL'} AS q2,
            {f'quantile_cont({c}::DOUBLE, 0.75)' if number else 'NULL'} AS q3,
            {f'count(*) FILTER ({c} >= 0 AND round({c}, 4) = {c})' if number else '0'} AS money,
            {words[0] in prof.ID_WORDS or words[-1] in prof.ID_WORDS} AS id_named, {words[-1] in prof.TARGET_WORDS} AS target_named,
            {has(prof.TIME_WORDS)} AS time_named, {has(('year', 'date'))} AS year_named, {has(prof.GEO_WORDS)} AS geo_named,
            {'lat' in c.lower()} AS lat_named, {has(('lon', 'lng'))} AS lng_named FROM {name}"""
        )
    return " UNION ALL ".join(rows)


def typed_sql(name: str) -> str:
    """CTEs ending in ``typed``: measures plus class, role, meaning and ratio."""
    given = DERIVED[name] + "," if name in DERIVED else ""
    return f"""WITH {given} facts AS ({facts_sql(name)}),
    classed AS (SELECT *, n - nulls AS filled, card / n AS ratio, CASE WHEN kind IN ('int', 'float') THEN 'numeric' WHEN kind = 'time' THEN 'datetime'
      WHEN nulls < n AND len > 60 THEN 'text' WHEN nulls < n AND dates > 0.5 * (n - nulls) THEN 'datetime' ELSE 'categorical' END AS cat FROM facts),
    typed AS (SELECT *, CASE
      WHEN n > 5 AND ratio >= 0.95 AND (id_named OR card > greatest(100, n * 0.98)) THEN 'identifier'
      WHEN target_named THEN 'target' WHEN cat = 'datetime' THEN 'temporal'
      WHEN cat = 'numeric' AND year_named THEN 'temporal' WHEN geo_named OR (cat = 'categorical' AND geo) THEN 'geo'
      WHEN cat = 'numeric' AND kind = 'int' AND card <= 5 THEN 'dimension' WHEN cat = 'numeric' THEN 'metric'
      WHEN cat = 'text' THEN 'text' WHEN n > 5 AND ratio >= 0.95 THEN 'identifier' ELSE 'dimension' END AS role,
      greatest(1, floor((n - nulls) * 0.6)) AS enough FROM classed),
    meant AS (SELECT *, CASE WHEN cat = 'datetime' THEN 'date_string' WHEN filled = 0 THEN 'generic'
      WHEN cat <> 'numeric' AND email >= enough THEN 'email' WHEN cat <> 'numeric' AND url >= enough THEN 'url'
      WHEN cat <> 'numeric' AND phone >= enough THEN 'phone' WHEN cat <> 'numeric' AND postal >= enough THEN 'postal'
      WHEN cat <> 'numeric' THEN 'generic' WHEN lo >= -90 AND hi <= 90 AND lat_named THEN 'lat'
      WHEN lo >= -180 AND hi <= 180 AND lng_named THEN 'lng' WHEN money >= enough THEN 'currency' ELSE 'generic' END AS meaning FROM typed)"""


def over(names, select: str) -> str:
    """The same selection over several tables, labelled."""
    return " UNION ALL ".join(f"SELECT '{n}' AS dataset, q.* FROM ({typed_sql(n)} {select}) q" for n in names)


def stacked(spark, sf, names, columns):
    out = None
    for n in names:
        p = Profile(source(spark, sf, n))
        schema = "dataset string, `column` string, " + ", ".join(f"{c} {t}" for c, (t, _) in columns.items())
        rows = [(n, c, *[get(p, c) for _, get in columns.values()]) for c in p.facts]
        part = spark.createDataFrame(rows, schema)
        out = part if out is None else out.unionByName(part)
    return out


@query("dtype_category", over(["documents", "pages", "events", "orders_text"], 'SELECT "column", cat AS dtype_category FROM typed'))
def dtype_category(spark, sf):
    names = ["documents", "pages", "events", "orders_text"]
    return stacked(spark, sf, names, {"dtype_category": ("string", lambda p, c: p.categories[c])})


@query("role", over(["cust_geo", "orders_text", "events", "part"], 'SELECT "column", role FROM typed'))
def role(spark, sf):
    return stacked(spark, sf, ["cust_geo", "orders_text", "events", "part"], {"role": ("string", lambda p, c: p.roles[c])})


@query("semantic_type", over(["pages", "documents", "orders_text"], 'SELECT "column", meaning AS semantic_type FROM meant'))
def semantic_type(spark, sf):
    return stacked(spark, sf, ["pages", "documents", "orders_text"], {"semantic_type": ("string", lambda p, c: p.semantic_types[c])})


PRIMARY_SQL = """SELECT "column",
  coalesce("column" = (SELECT arg_max("column", (std, -position)) FROM typed WHERE role IN ('metric', 'target') AND cat = 'numeric'), false) AS metric,
  coalesce("column" = (SELECT arg_min("column", position) FROM typed WHERE role = 'temporal'), false) AS date,
  coalesce("column" = coalesce((SELECT arg_max("column", (card, -position)) FROM typed WHERE role IN ('dimension', 'target') AND cat = 'categorical' AND round(ratio, 4) < 0.5),
    (SELECT arg_min("column", position) FROM typed WHERE role IN ('dimension', 'target') AND cat = 'categorical')), false) AS category,
  coalesce("column" = (SELECT arg_min("column", position) FROM typed WHERE role = 'geo'), false) AS geo FROM typed"""


@query("primary_flags", over(["cust_geo", "orders_text", "part"], PRIMARY_SQL))
def primary_flags(spark, sf):
    flag = {k: ("boolean", lambda p, c, k=k: p.primary[k] == c) for k in ("metric", "date", "category", "geo")}
    return stacked(spark, sf, ["cust_geo", "orders_text", "part"], flag)


def _outliers_sql(name: str) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", count(*) FILTER (q3 > q1 AND ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))) AS outliers
            FROM {name}, typed WHERE typed."column" = '{c}'"""
        for c, k in KINDS[name].items()
        if k in (INT, FLOAT)
    ]
    return " UNION ALL ".join(parts)


def numeric_stats_sql(name: str) -> str:
    return f"""{typed_sql(name)}, o AS ({_outliers_sql(name)})
    SELECT "column", round(lo, 4) AS min, round(hi, 4) AS max, round(mean, 4) AS mean, round(std, 4) AS std,
    CASE WHEN filled >= 3 AND std > 0 THEN round(3 * (mean - q2) / std, 2) END AS skew, CAST(outliers AS DOUBLE) AS outlier_count
    FROM typed JOIN o USING ("column") WHERE cat = 'numeric' AND role IN ('metric', 'target', 'dimension')"""


@query("numeric_stats", numeric_stats_sql("li_spikes"))
def numeric_stats(spark, sf):
    p = Profile(inputs.li_spikes(spark, sf))
    keys = ("min", "max", "mean", "std", "skew", "outlier_count")
    rows = [(c, *[s[k] for k in keys]) for c, s in p.numeric_stats.items()]
    return spark.createDataFrame(rows, "`column` string, " + ", ".join(f"{k} double" for k in keys))


def _top_sql(name: str, columns: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {name} WHERE {c} IS NOT NULL GROUP BY 2"""
        for c in columns
    )
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank
        FROM ({parts})) WHERE rank <= 5"""


@query("top_values", f"WITH {inputs.CUST_GEO} " + _top_sql("cust_geo", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment", "nation", "region"]))
def top_values(spark, sf):
    return Profile(inputs.cust_geo(spark, sf)).top_values_df()


@query(
    "temporal_stats",
    f"""WITH {ORDERS_TEXT}, days AS (SELECT DISTINCT CAST(order_date AS DATE) AS d FROM orders_text),
        gaps AS (SELECT date_diff('day', lag(d) OVER (ORDER BY d), d) AS g FROM days),
        g AS (SELECT quantile_cont(g, 0.5) AS m FROM gaps)
        SELECT 'order_date' AS "column", strftime(min(d), '%Y-%m-%d %H:%M:%S') AS min_date, strftime(max(d), '%Y-%m-%d %H:%M:%S') AS max_date,
        (SELECT CASE WHEN m <= 1 THEN 'daily' WHEN m <= 8 THEN 'weekly' WHEN m <= 31 THEN 'monthly' WHEN m <= 92 THEN 'quarterly' ELSE 'yearly' END FROM g) AS granularity
        FROM days""",
)
def temporal_stats(spark, sf):
    p = Profile(orders_text(spark, sf))
    rows = [(c, s["min_date"], s["max_date"], s["granularity"]) for c, s in p.temporal_stats.items()]
    return spark.createDataFrame(rows, "`column` string, min_date string, max_date string, granularity string")


@query(
    "column_profile",
    f"""{typed_sql('li_nulls').replace('meant AS', f"o AS ({_outliers_sql('li_nulls')}), meant AS")}
    SELECT CAST(position AS INTEGER) AS position, "column", cat AS dtype_category, role, meaning AS semantic_type, round(nulls / n * 100, 2) AS null_pct,
    card AS cardinality, round(ratio, 4) AS cardinality_ratio,
    CASE WHEN cat = 'numeric' AND role IN ('metric', 'target', 'dimension') THEN round(mean, 4) END AS mean,
    CASE WHEN cat = 'numeric' AND role IN ('metric', 'target', 'dimension') THEN CAST(outliers AS DOUBLE) END AS outlier_count,
    CASE WHEN "column" = 'l_returnflag' THEN (SELECT arg_max(l_returnflag, n) FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1))
         WHEN role = 'identifier' THEN (SELECT CAST(l_extendedprice AS VARCHAR) FROM lineitem GROUP BY l_extendedprice ORDER BY count(*) DESC, CAST(l_extendedprice AS VARCHAR) LIMIT 1)
         WHEN "column" = 'l_linestatus' THEN (SELECT arg_max(l_linestatus, n) FROM (SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1)) END AS top_value,
    CASE WHEN "column" = 'l_shipdate' THEN (SELECT strftime(min(l_shipdate), '%Y-%m-%d %H:%M:%S') FROM lineitem) END AS min_date
    FROM meant LEFT JOIN o USING ("column")""",
)
def column_profile(spark, sf):
    df = Profile(inputs.li_nulls(spark, sf)).columns_df()
    return df.select(
        "position", "column", "dtype_category", "role", "semantic_type", "null_pct", "cardinality", "cardinality_ratio",
        F.try_element_at("numeric_stats", F.lit("mean")).alias("mean"),
        F.try_element_at("numeric_stats", F.lit("outlier_count")).alias("outlier_count"),
        F.try_element_at("top_values", F.lit(1))["value"].alias("top_value"),
        F.try_element_at("temporal_stats", F.lit("min_date")).alias("min_date"),
    )


@query(
    "quality_report",
    f"""{typed_sql('li_dups')}, o AS ({_outliers_sql('li_dups')}),
    d AS (SELECT (SELECT count(*) FROM li_dups) AS rows, (SELECT count(*) FROM li_dups) - (SELECT count(*) FROM (SELECT DISTINCT * FROM li_dups)) AS dup),
    s AS (SELECT CAST(count(*) FILTER (outliers > 0 AND role IN ('metric', 'target', 'dimension')) AS INTEGER) AS spiky FROM typed JOIN o USING ("column")),
    x AS (SELECT dup AS duplicate_rows, round(dup * 100.0 / rows, 2) AS duplicate_pct, CAST((SELECT sum(nulls) FROM typed) AS BIGINT) AS null_cells,
      round((SELECT sum(nulls) / sum(n) * 100 FROM typed), 2) AS null_pct, spiky AS outlier_columns FROM d, s)
    SELECT greatest(45.0, round(100 - 0.5 * duplicate_pct - 0.8 * null_pct - 3.0 * outlier_columns, 1)) AS health_score, *,
      duplicate_rows || ' duplicate rows detected (' || duplicate_pct || '%)' AS issue FROM x""",
)
def quality_report(spark, sf):
    df = Profile(inputs.li_dups(spark, sf)).quality_df()
    return df.withColumn("issue", F.element_at("issues", 1)).drop("issues")


CORR_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def corr_sql(name: str, columns: list[str]) -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 4) AS r FROM {name} WHERE {complete}"
        for a in columns
        for b in columns
    )


@query("correlation", f"WITH {inputs.LI_NULLS} " + corr_sql("li_nulls", CORR_COLUMNS))
def correlation(spark, sf):
    return Profile(inputs.li_nulls(spark, sf)).correlation_df()


@query(
    "corr_extremes",
    f"""WITH c AS ({corr_sql('lineitem', CORR_COLUMNS)}), u AS (SELECT * FROM c WHERE col_a < col_b),
    e AS (SELECT 'positive' AS side, * FROM (SELECT * FROM u ORDER BY r DESC, col_a DESC, col_b DESC LIMIT 1)
      UNION ALL SELECT 'negative', * FROM (SELECT * FROM u ORDER BY r, col_a, col_b LIMIT 1))
    SELECT *, CASE WHEN r = 1 THEN 'Perfect Direct' WHEN r >= 0.7 THEN 'Strong Positive' WHEN r >= 0.3 THEN 'Moderate Positive'
      WHEN abs(r) < 0.1 THEN 'No Linear Correlation' WHEN r <= -0.7 THEN 'Strong Negative' WHEN r <= -0.3 THEN 'Moderate Negative'
      ELSE 'Weak Relationship' END AS label FROM e""",
)
def corr_extremes(spark, sf):
    return prof.corr_extremes(Profile(table(spark, sf, "lineitem")).correlation_df())


def mi_sql(source_sql: str, target: str, numeric: list[str], categorical: list[str]) -> str:
    probs = "[" + ", ".join(f"{i}/16.0" for i in range(1, 16)) + "]"
    edges = ", ".join(f"quantile_cont({c}::DOUBLE, {probs}) AS e_{c}" for c in [target, *numeric])
    cells = ", ".join(
        [f"len(list_filter(list_distinct(e_{c}), lambda e: e <= {c}::DOUBLE))::VARCHAR AS {c}" for c in [target, *numeric]] + categorical
    )
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS x, {target} AS y, count(*) AS n FROM b GROUP BY 2, 3""" for c in [*numeric, *categorical]
    )
    return f"""WITH src AS ({source_sql}), e AS (SELECT {edges} FROM src), b AS (SELECT {cells} FROM src, e), j AS ({parts}),
    xy AS (SELECT "column", sum(n * ln(n)) AS w, count(*) AS k, sum(n) AS total FROM j GROUP BY 1),
    xx AS (SELECT "column", sum(n * ln(n)) AS w, count(*) AS k FROM (SELECT "column", x, sum(n) AS n FROM j GROUP BY ALL) GROUP BY 1),
    yy AS (SELECT "column", sum(n * ln(n)) AS w, count(*) AS k FROM (SELECT "column", y, sum(n) AS n FROM j GROUP BY ALL) GROUP BY 1)
    SELECT '{target}' AS target, "column", round(greatest(0, (xy.w - xx.w - yy.w) / total + ln(total)
      - (xy.k - xx.k - yy.k + 1) / (2 * total)), 4) AS mi_score, xy.k AS cells
    FROM xy JOIN xx USING ("column") JOIN yy USING ("column")"""


@query(
    "mutual_information",
    mi_sql("SELECT * FROM lineitem", "l_extendedprice", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"]),
)
def mutual_information(spark, sf):
    df = evenly(table(spark, sf, "lineitem"))
    numbers = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]
    scores = information.mutual_information(
        df, "l_extendedprice", [*numbers, "l_returnflag", "l_linestatus"], numbers, df.count()
    )
    out = spark.createDataFrame(scores, "target string, `column` string, mi_score double, cells long")
    return out.withColumn("mi_score", F.round("mi_score", 4))


def neighbours_sql(name: str, target: str, numeric: list[str], categorical: list[str]) -> str:
    """Brute force over all pairs of rows."""
    codes = {c: f"CAST({c} AS DOUBLE)" for c in numeric} | {c: f"CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS DOUBLE)" for c in categorical}
    rows = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", row_number() OVER () AS i, {code} AS x, CAST({target} AS DOUBLE) AS y FROM {name}""" for c, code in codes.items()
    )
    return f"""WITH p AS MATERIALIZED ({rows}), s AS (SELECT "column", stddev_samp(x) AS sx, stddev_samp(y) AS sy, count(*) AS n FROM p GROUP BY 1),
    d AS (SELECT a."column", a.i, a.i = b.i AS self, abs(b.x - a.x) / sx AS dx, abs(b.y - a.y) / sy AS dy FROM p a JOIN p b USING ("column") JOIN s USING ("column")),
    k AS (SELECT "column", i, list_sort(list(greatest(dx, dy)) FILTER (NOT self))[3] AS r FROM d GROUP BY ALL),
    c AS (SELECT "column", i, any_value(r) AS r, count(*) FILTER (greatest(dx, dy) = 0) AS same, count(*) FILTER (CASE WHEN r > 0 THEN dx < r ELSE dx = 0 END) AS nx,
      count(*) FILTER (CASE WHEN r > 0 THEN dy < r ELSE dy = 0 END) AS ny FROM d JOIN k USING ("column", i) GROUP BY ALL),
    psi AS (SELECT m + 1 AS m, -0.57721566490153286 + sum(CASE WHEN m = 0 THEN 0 ELSE 1.0::DOUBLE / m END) OVER (ORDER BY m) AS v
      FROM (SELECT unnest(range(0, (SELECT max(n) FROM s) + 1)) AS m))
    SELECT '{target}' AS target, "column", round(greatest(0, avg(a.v - x.v - y.v) + ln(any_value(n))), 6) AS mi_score
    FROM c JOIN s USING ("column") JOIN psi a ON a.m = CASE WHEN r > 0 THEN 3 ELSE same END JOIN psi x ON x.m = nx JOIN psi y ON y.m = ny GROUP BY "column" """


@query("neighbour_information", neighbours_sql("customer", "c_acctbal", ["c_custkey", "c_nationkey"], ["c_mktsegment"]))
def neighbour_information(spark, sf):
    out = neighbours.neighbour_information(
        table(spark, sf, "customer"), "c_acctbal", ["c_custkey", "c_nationkey", "c_mktsegment"], ["c_custkey", "c_nationkey"]
    )
    return out.withColumn("mi_score", F.round("mi_score", 6))


@query("profile_full")
def profile_full(spark, sf):
    """Every part of the profile of one table in one row per column."""
    p = Profile(table(spark, sf, "orders"))
    strongest = (
        p.correlation_df()
        .filter("col_a <> col_b")
        .groupBy(F.col("col_a").alias("column"))
        .agg(F.max(F.abs("r")).alias("strongest_r"))
    )
    shared = p.information_df().select("column", "mi_score")
    return (
        p.columns_df()
        .join(strongest, "column", "left")
        .join(shared, "column", "left")
        .withColumn("health_score", F.lit(p.quality["health_score"]))
    )


@query(
    "category_variants",
    f"""WITH {inputs.GEO_VARIANTS}, v AS (SELECT lower(country) AS v, count(*) AS n FROM geo_variants GROUP BY 1),
    a AS (SELECT * FROM (VALUES ('usa', 'united states'), ('us', 'usa'), ('ny', 'new york'), ('ca', 'california')) t(value_a, value_b))
    SELECT 'country' AS "column", value_a, value_b, x.n AS rows_a, y.n AS rows_b FROM a JOIN v x ON x.v = value_a JOIN v y ON y.v = value_b""",
)
def category_variants(spark, sf):
    return prof.category_variants(inputs.geo_variants(spark, sf), ["country", "c_mktsegment"])


# Customers with misspelt segments and countries, for both sides.
SPELLINGS = """spelt AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'usa' WHEN 1 THEN 'United States' WHEN 2 THEN 'US' WHEN 3 THEN 'New York' ELSE 'ny' END AS country,
  CASE WHEN c_custkey % 40 = 1 THEN replace(c_mktsegment, 'IL', 'L') WHEN c_custkey % 40 = 2 THEN lower(c_mktsegment) || '!' WHEN c_custkey % 40 = 3 THEN substring(c_mktsegment, 2) ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'client ' || c_mktsegment END AS name FROM customer)"""


@query(
    "value_clusters",
    f"""WITH RECURSIVE {SPELLINGS}, c AS (SELECT 'country' AS col, country AS v FROM spelt UNION ALL SELECT 'segment', segment FROM spelt UNION ALL SELECT 'name', name FROM spelt),
    n AS (SELECT col, v, count(*) AS rows, trim(regexp_replace(lower(v), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')) AS p FROM c GROUP BY ALL),
    s AS (SELECT *, list_sort(list_distinct(string_split(p, ' '))) AS w, regexp_replace(p, '[^\\p{{Nd}}]+', ' ', 'g') AS d, length(p) AS l,
      CASE WHEN contains(p, ' ') THEN list_aggregate(list_transform(string_split(p, ' '), lambda t: t[1]), 'string_agg', '') END AS i FROM n),
    e AS (SELECT a.col, a.v AS a, b.v AS b FROM s a JOIN s b ON a.col = b.col AND a.v <> b.v AND (a.w = b.w OR a.i = b.p OR b.i = a.p OR (a.d = b.d AND a.l BETWEEN 5 AND 64 AND b.l BETWEEN 5 AND 64
      AND abs(a.l - b.l) <= 2 AND levenshtein(a.p, b.p) <= CASE WHEN a.l >= 9 AND b.l >= 9 THEN 2 ELSE 1 END))),
    reach AS (SELECT col, a, b FROM e UNION SELECT r.col, r.a, e.b FROM reach r JOIN e ON e.col = r.col AND e.a = r.b),
    root AS (SELECT col, a AS v, least(a, min(b)) AS root FROM reach GROUP BY col, a)
    SELECT col AS "column", first_value(v) OVER (PARTITION BY col, root ORDER BY rows DESC, v) AS cluster, v AS value, rows FROM root JOIN n USING (col, v)""",
)
def value_clusters(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("spelt_customer")
    df = spark.sql("WITH " + SPELLINGS.replace("FROM customer", "FROM spelt_customer") + " SELECT * FROM spelt")
    return variants.value_clusters(df, ["country", "segment", "name"])


@query(
    "dataset_overview",
    f"""{typed_sql('orders_text')}, p AS ({PRIMARY_SQL})
    SELECT (SELECT count(*) FROM orders) AS row_count, CAST((SELECT count(*) FROM typed) AS INTEGER) AS column_count,
    (SELECT strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders) AS "start", (SELECT strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders) AS "end",
    (SELECT "column" FROM p WHERE metric) AS primary_metric, (SELECT "column" FROM p WHERE date) AS primary_date,
    (SELECT "column" FROM p WHERE category) AS primary_category, (SELECT "column" FROM p WHERE geo) AS primary_geo""",
)
def dataset_overview(spark, sf):
    return prof.overview(Profile(orders_text(spark, sf)))


@query(
    "overview_columns",
    f"""{typed_sql('li_nulls')} SELECT CAST(position AS INTEGER) AS position, "column", CAST(nulls AS BIGINT) AS null_count, role, cat AS dtype_category, CAST(card AS BIGINT) AS cardinality, round(ratio, 4) AS cardinality_ratio FROM typed""",
)
def overview_columns(spark, sf):
    out = prof.overview_columns(Profile(inputs.li_nulls(spark, sf)))
    return out.select("position", "column", "null_count", "role", "dtype_category", "cardinality", "cardinality_ratio")


@query("outlier_values")
def outlier_values(spark, sf):
    """The first values outside the fences of every column, with their row keys."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    # One measure with few distinct values besides the keys, so that it is no identifier.
    df = inputs.li_spikes(spark, sf).withColumn("price", F.col("l_extendedprice"))
    return prof.outlier_values(Profile(df.unionByName(df)), keys)


@query(
    "outlier_values_checks",
    f"""WITH {inputs.LI_SPIKES}, q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM li_spikes),
    r AS (SELECT l_extendedprice, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rank FROM (FROM li_spikes UNION ALL FROM li_spikes), q
      WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a))
    SELECT 'price' AS "column", l_extendedprice AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def outlier_values_checks(spark, sf):
    found = outlier_values(spark, sf).filter(F.col("column") == "price")
    return found.select("column", "value", "rank")


@query(
    "profile_store",
    f"""SELECT 'part' AS dataset, q.*, '2.0' AS profile_version, '2024-02-01T00:00:00' AS profiled_at, false AS stale
        FROM ({typed_sql('part')} SELECT "column", role, card AS cardinality FROM typed) q
        UNION ALL SELECT 'customer', q.*, '1.0', '2024-01-01T00:00:00', true
        FROM ({typed_sql('cust_geo')} SELECT "column", role, card AS cardinality FROM typed) q""",
)
def profile_store(spark, sf):
    from tablelens.session import scratch_path
    from tablelens.sources.stores import append_profile, latest_profiles

    path = scratch_path(spark, "profiles")
    old, new = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    part, customer = Profile(table(spark, sf, "part")), Profile(inputs.cust_geo(spark, sf))
    append_profile(prof.stored_rows(part, "part", old, "1.0"), path)
    append_profile(prof.stored_rows(customer, "customer", old, "1.0"), path)
    append_profile(prof.stored_rows(part, "part", new), path)
    latest = latest_profiles(spark, path)
    return latest.select("dataset", "column", "role", "cardinality", "profile_version", "profiled_at", "stale")


ORDERS_STATE = {"o_orderkey": INT, "o_custkey": INT, "o_orderstatus": TEXT, "o_totalprice": FLOAT, "o_orderpriority": TEXT}


@query(
    "profile_increments",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, """
        + (f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std" if k != TEXT else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std")
        + f", min(CAST({c} AS VARCHAR)) AS first, max(CAST({c} AS VARCHAR)) AS last FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS o_totalprice) FROM orders)"
        for c, k in ORDERS_STATE.items()
        if c != "o_totalprice"
    )
    + """ UNION ALL SELECT 'o_totalprice', count(*), count(*) - count(p), min(p), max(p), round(avg(p), 4), round(stddev_samp(p), 4), NULL, NULL
          FROM (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS p FROM orders)""",
)
def profile_increments(spark, sf):
    """The profile of a dataset after two appends; each append reads its own files only."""
    df = table(spark, sf, "orders").select(*ORDERS_STATE).withColumn("o_totalprice", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")))
    data, state = scratch_path(spark, "grown"), scratch_path(spark, "states")
    for part in (F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3 == 0):
        df.filter(part).write.mode("append").parquet(data)
        increments.refresh(spark, data, state, df.schema)
    found = increments.merged_profile(spark, data, state)
    text = lambda c: F.when(F.col("column") != "o_totalprice", F.col(c)).alias(c)  # noqa: E731  doubles are written differently by SQL engines
    return found.select("column", "rows", "nulls", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), text("first"), text("last"))


@query(
    "semantic_model",
    f"""{typed_sql('orders_text')}, d AS (SELECT *, cat IN ('categorical', 'datetime') OR role IN ('geo', 'temporal') AS dim FROM typed)
    SELECT 'dimension' AS kind, "column" AS name, "column", CAST(NULL AS VARCHAR) AS agg FROM d WHERE dim
    UNION ALL SELECT 'metric', 'total_' || "column", "column", 'sum' FROM d WHERE NOT dim AND cat = 'numeric'
    UNION ALL SELECT 'metric', 'average_' || "column", "column", 'avg' FROM d WHERE NOT dim AND cat = 'numeric'""",
)
def semantic_model(spark, sf):
    from tablelens.operators.query import auto_model, model_terms

    return model_terms(spark, auto_model(Profile(orders_text(spark, sf)), "orders"))
