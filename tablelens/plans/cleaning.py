"""Readers, cleaning, validation, repair and stores."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablelens.operators import quality
from tablelens.operators.profile import Profile
from tablelens.operators.quality import Rule
from tablelens.plans import inputs
from tablelens.plans.findings import LINE_KEYS
from tablelens.plans.registry import query, table
from tablelens.session import scratch_path
from tablelens.sources import readers, stores, versions


@query("read_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_csv(spark, sf):
    df = table(spark, sf, "customer")
    path = scratch_path(spark, "csv")
    df.write.option("header", True).csv(path)
    return readers.read_csv(spark, path, df.schema)


@query(
    "sanitize",
    f"""WITH {inputs.CUST_DIRTY} SELECT c_custkey, trim(c_name) AS c_name, c_nationkey, c_acctbal,
        CASE WHEN trim(c_mktsegment) IN ('', 'N/A', 'null', 'NaN') THEN NULL ELSE trim(c_mktsegment) END AS mkt_segment FROM cust_dirty""",
)
def sanitize(spark, sf):
    df = inputs.cust_dirty(spark, sf).withColumnRenamed("c_mktsegment", " mkt segment ")
    path = scratch_path(spark, "dirty")
    # Padding and empty text must survive the file, so nothing is trimmed on the way out.
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_dirty_csv(spark, path, df.schema)


@query(
    "sanitize_report",
    f"""WITH {inputs.CUST_DIRTY} SELECT 'UTF-8' AS used_encoding, CAST(5 AS INTEGER) AS original_columns, original_name, "column", null_tokens, padded_cells FROM (
      SELECT 'c_custkey' AS original_name, 'c_custkey' AS "column", 0::BIGINT AS null_tokens, 0::BIGINT AS padded_cells
      UNION ALL SELECT 'c_name', 'c_name', 0, (SELECT count(*) FROM cust_dirty WHERE trim(c_name) <> c_name)
      UNION ALL SELECT 'c_nationkey', 'c_nationkey', 0, 0 UNION ALL SELECT 'c_acctbal', 'c_acctbal', 0, 0
      UNION ALL SELECT ' mkt segment ', 'mkt_segment', count(*) FILTER (trim(c_mktsegment) IN ('', 'N/A', 'null', 'NaN')),
        count(*) FILTER (trim(c_mktsegment) NOT IN ('', 'N/A', 'null', 'NaN') AND trim(c_mktsegment) <> c_mktsegment) FROM cust_dirty)""",
)
def sanitize_report(spark, sf):
    df = inputs.cust_dirty(spark, sf).withColumnRenamed("c_mktsegment", " mkt segment ")
    return quality.sanitize_report(df, readers.ENCODINGS[0])


@query(
    "write_dataset",
    """SELECT f.format, o_orderstatus, count(*) AS rows, round(sum(o_totalprice), 2) AS total
       FROM orders, (SELECT unnest(['csv', 'parquet']) AS format) f GROUP BY ALL""",
)
def write_dataset(spark, sf):
    root = scratch_path(spark, "datasets")
    df = table(spark, sf, "orders")
    paths = [stores.write_dataset(df, root, "orders", kind) for kind in ("csv", "parquet")]
    assert paths[0] != paths[1]
    back = readers.read_csv(spark, paths[0], df.schema).withColumn("format", F.lit("csv"))
    back = back.unionByName(spark.read.parquet(paths[1]).withColumn("format", F.lit("parquet")))
    return back.groupBy("format", "o_orderstatus").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "dataset_versions",
    """SELECT v AS version, count(*) AS rows, round(sum(o_totalprice), 2) AS total FROM orders, (SELECT unnest([1, 2, 3]) AS v)
       WHERE v = 1 AND o_orderstatus = 'O' OR v = 2 AND o_orderstatus IN ('O', 'F') OR v = 3 AND o_orderstatus = 'P' GROUP BY v""",
)
def dataset_versions(spark, sf):
    """Each version of a dataset that was written, appended to, and replaced."""
    root, df = scratch_path(spark, "versions"), table(spark, sf, "orders")
    for status, append in (("O", False), ("F", True), ("P", False)):
        versions.write_version(df.filter(F.col("o_orderstatus") == status), root, "orders", append)
    held = [versions.read_version(spark, root, "orders", v).withColumn("version", F.lit(v)) for v in versions.version_numbers(spark, root, "orders")]
    rows = reduce(DataFrame.unionByName, held)
    return rows.groupBy("version").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "latest_n",
    """SELECT * EXCLUDE (r) FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5""",
)
def latest_n(spark, sf):
    return stores.latest_n(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 5).select("user_id", "event_id", "event_type")


@query(
    "insight_store",
    """WITH s AS (SELECT o_orderpriority AS dataset, o_orderstatus AS title, CAST(count(*) % 100 AS INTEGER) AS score FROM orders GROUP BY ALL)
       SELECT dataset, title, CASE WHEN dataset = '5-LOW' THEN CAST(99 AS INTEGER) ELSE score END AS score FROM s WHERE dataset NOT IN ('5-LOW', '1-URGENT') OR dataset = '5-LOW' AND title = 'F'""",
)
def insight_store(spark, sf):
    path = scratch_path(spark, "insights")
    rows = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("title"))
        .agg((F.count(F.lit(1)) % 100).cast("int").alias("score"))
    )
    stores.replace_insights(rows, path)
    # A second run of one dataset replaces only its own rows.
    again = rows.filter((F.col("dataset") == "5-LOW") & (F.col("title") == "F")).withColumn("score", F.lit(99))
    stores.replace_insights(again, path)
    # A run that finds nothing leaves its dataset empty.
    stores.replace_insights(rows.limit(0), path, ("1-URGENT",))
    return stores.read_insights(spark, path).select("dataset", "title", "score")


@query(
    "infer_rules",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{kind}' AS kind, true AS nullable, {kind == 'number'} AS some_value, count(*) AS rows, count({c}) AS filled,
        {f'count({c}) > 0' if kind == 'number' else 'true'} AS holds FROM orders"""
        for c, kind in (("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"), ("o_totalprice", "number"), ("o_orderdate", "time"), ("o_orderpriority", "text"))
    ),
)
def infer_rules(spark, sf):
    """The rules of every column, and whether a column that needs some value has one."""
    df = table(spark, sf, "orders")
    rows = [(r.column, r.kind, r.nullable, r.some_value) for r in quality.infer_rules(df.schema)]
    rules = spark.createDataFrame(rows, "column string, kind string, nullable boolean, some_value boolean")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(c).alias("filled")) for c in df.columns])
    counts = df.agg(cells.alias("c")).select(F.inline("c"))
    return rules.join(counts, "column").withColumn("holds", ~F.col("some_value") | (F.col("filled") > 0))


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

SALES = """sales AS (SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "Date",
  CASE WHEN o_orderkey % 211 = 0 THEN '-5000000' WHEN o_orderkey % 223 = 0 THEN 'much' ELSE CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS "Revenue",
  o_orderpriority AS "Category", o_orderstatus AS "Region" FROM orders)"""


def sales(spark, sf):
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 101 == 0, F.lit(None)).when(key % 103 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("Date"),
        F.when(key % 211 == 0, "-5000000").when(key % 223 == 0, "much").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("Revenue"),
        F.col("o_orderpriority").alias("Category"),
        F.col("o_orderstatus").alias("Region"),
    )


FAILURES = f"""WITH {SALES}, f AS (
  SELECT o_orderkey, 'Date' AS "column", 'missing' AS reason, CAST(NULL AS VARCHAR) AS value FROM sales WHERE "Date" IS NULL
  UNION ALL SELECT o_orderkey, 'Date', 'not a time', "Date" FROM sales WHERE "Date" IS NOT NULL AND try_strptime("Date", '%Y-%m-%d') IS NULL
  UNION ALL SELECT o_orderkey, 'Revenue', 'not a number', "Revenue" FROM sales WHERE "Revenue" IS NOT NULL AND try_cast("Revenue" AS DOUBLE) IS NULL
  UNION ALL SELECT o_orderkey, 'Revenue', 'below minimum', "Revenue" FROM sales WHERE try_cast("Revenue" AS DOUBLE) < -1000000)"""


@query("fixed_rules", FAILURES + " SELECT * FROM f")
def fixed_rules(spark, sf):
    return quality.failures(sales(spark, sf), quality.SALES_RULES, ["o_orderkey"])


@query(
    "validate",
    FAILURES + """ SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column", reason ORDER BY o_orderkey) AS INTEGER) AS rank FROM f) WHERE rank <= 10""",
)
def validate(spark, sf):
    return quality.validate(sales(spark, sf), quality.SALES_RULES, ["o_orderkey"])


@query(
    "quality_score",
    f"""WITH {inputs.LI_NULLS}, f AS (SELECT count(*) FILTER (l_tax < 0.03) AS anomalies, count(*) AS rows,
      count(*) FILTER (l_quantity IS NULL) + count(*) FILTER (l_discount IS NULL) + count(*) FILTER (l_tax IS NULL) AS missing FROM li_nulls)
    SELECT CAST(greatest(10, 100 - least(30, floor(missing / (rows * 11) * 100)) - least(40, least(10, anomalies) * 2)) AS INTEGER) AS quality_score, rows, missing,
    round(missing / (rows * 11) * 100, 4) AS missing_pct, anomalies FROM f""",
)
def quality_score(spark, sf):
    rules = [Rule("l_tax", "number", minimum=0.03), Rule("l_quantity", "number", some_value=True)]
    df = quality.quality_score(inputs.li_nulls(spark, sf), rules, LINE_KEYS)
    return df.withColumn("missing_pct", F.round("missing_pct", 4))


HOLES = """holes AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag FROM lineitem)"""


def holes(spark, sf):
    key = F.col("l_orderkey")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
        F.when(key % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        F.when(key % 9 != 0, F.col("l_returnflag")).alias("l_returnflag"),
    )


IMPUTED = f"""WITH {HOLES}, s AS (SELECT quantile_cont(l_quantity, 0.5) AS q FROM holes),
  m AS (SELECT l_returnflag AS f FROM holes WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  imputed AS (SELECT l_orderkey::DOUBLE AS l_orderkey, l_partkey::DOUBLE AS l_partkey, l_suppkey::DOUBLE AS l_suppkey, l_linenumber::DOUBLE AS l_linenumber,
    l_extendedprice, coalesce(l_quantity, q) AS l_quantity, coalesce(l_returnflag, f) AS l_returnflag FROM holes, s, m)"""


@query("heal_impute", IMPUTED + " SELECT * FROM imputed")
def heal_impute(spark, sf):
    return quality.impute(holes(spark, sf))


@query(
    "heal_winsorize",
    f"WITH {inputs.LI_BULK}, q AS (SELECT "
    + ", ".join(f"quantile_cont({c}, [0.01, 0.99]) AS q_{c}" for c in LINE_NUMBERS)
    + " FROM li_bulk) SELECT l_returnflag, l_linestatus, l_shipdate::DATE AS l_shipdate, "
    + ", ".join(f"round(least(greatest({c}::DOUBLE, q_{c}[1]::DOUBLE), q_{c}[2]::DOUBLE), 4) AS {c}" for c in LINE_NUMBERS)
    + " FROM li_bulk, q",
)
def heal_winsorize(spark, sf):
    df = quality.winsorize(inputs.li_bulk(spark, sf))
    return df.withColumns({c: F.round(c, 4) for c in LINE_NUMBERS}).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query("heal_dedupe", f"WITH {inputs.LI_DUPS} SELECT DISTINCT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM li_dups")
def heal_dedupe(spark, sf):
    return quality.dedupe(inputs.li_dups(spark, sf)).withColumn("l_shipdate", F.col("l_shipdate").cast("date"))


@query("auto_heal")
def auto_heal(spark, sf):
    """Repair, store under a new version, and profile what was stored."""
    df = holes(spark, sf)
    root = scratch_path(spark, "healed")
    path = stores.write_dataset(quality.auto_heal(df), root, "lines")
    healed = spark.read.parquet(path)
    rows = Profile(healed)
    stores.append_profile(
        _stamped(rows), f"{root}/profiles"
    )
    return stores.latest_profiles(spark, f"{root}/profiles").select("dataset", "column", "null_pct", "cardinality", "stale")


def _stamped(p: Profile):
    from tablelens.operators.profile import stored_rows

    return stored_rows(p, "lines", dt.datetime.now(dt.timezone.utc))
