"""Dirty variants of the provided tables, as Spark frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelens.plans.registry import table

# A total order over lineitem: these columns together are unique.
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]

LI_NULLS = """li_nulls AS (SELECT * REPLACE (
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
  CASE WHEN l_orderkey % 14 = 0 THEN NULL ELSE l_tax END AS l_tax) FROM lineitem)"""

LI_DUPS = """li_dups AS (SELECT * FROM lineitem
  UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 50 = 0)"""

LI_SPIKES = """li_spikes AS (SELECT * REPLACE (
  CASE WHEN l_orderkey % 97 = 0 THEN l_extendedprice * 10 ELSE l_extendedprice END AS l_extendedprice)
  FROM lineitem)"""

LI_BULK = """li_bulk AS (SELECT * REPLACE (
  CASE WHEN l_orderkey % 97 = 0 THEN l_quantity * 20 ELSE l_quantity END AS l_quantity,
  CASE WHEN l_orderkey % 20 = 0 THEN l_returnflag ELSE 'Z' END AS l_returnflag) FROM lineitem)"""

CUST_DIRTY = """cust_dirty AS (SELECT * REPLACE ('  ' || c_name || ' ' AS c_name,
  CASE c_custkey % 10 WHEN 1 THEN 'N/A' WHEN 2 THEN '' WHEN 3 THEN ' null ' WHEN 4 THEN 'NaN'
  ELSE c_mktsegment END AS c_mktsegment) FROM customer)"""

ORDERS_SHIFT = """orders_shift AS (SELECT * REPLACE (
  CASE WHEN o_orderdate >= TIMESTAMP '2000-12-01' THEN o_totalprice * 8 ELSE o_totalprice END AS o_totalprice)
  FROM orders)"""

GEO_VARIANTS = """geo_variants AS (SELECT c_custkey, c_acctbal,
  CASE c_custkey % 5 WHEN 0 THEN 'usa' WHEN 1 THEN 'United States' WHEN 2 THEN 'US' WHEN 3 THEN 'New York' ELSE 'ny' END
  AS country, c_mktsegment FROM customer)"""

CUST_GEO = """cust_geo AS (SELECT c.*, n_name AS nation, r_name AS region
  FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def li_nulls(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    seventh, fourteenth = F.col("l_orderkey") % 7 == 0, F.col("l_orderkey") % 14 == 0
    return df.withColumns(
        {
            "l_quantity": F.when(~seventh, F.col("l_quantity")),
            "l_discount": F.when(~seventh, F.col("l_discount")),
            "l_tax": F.when(~fourteenth, F.col("l_tax")),
        }
    )


def li_dups(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem")
    return df.union(df.filter(F.col("l_orderkey") % 50 == 0))


def li_spikes(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf, "lineitem").withColumn(
        "l_extendedprice", F.when(F.col("l_orderkey") % 97 == 0, price * 10).otherwise(price)
    )


def li_bulk(spark: SparkSession, sf: str) -> DataFrame:
    quantity, order = F.col("l_quantity"), F.col("l_orderkey")
    return table(spark, sf, "lineitem").withColumns(
        {
            "l_quantity": F.when(order % 97 == 0, quantity * 20).otherwise(quantity),
            "l_returnflag": F.when(order % 20 == 0, F.col("l_returnflag")).otherwise("Z"),
        }
    )


def cust_dirty(spark: SparkSession, sf: str) -> DataFrame:
    k, seg = F.col("c_custkey") % 10, F.col("c_mktsegment")
    return table(spark, sf, "customer").withColumns(
        {
            "c_name": F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")),
            "c_mktsegment": F.when(k == 1, "N/A").when(k == 2, "").when(k == 3, " null ").when(k == 4, "NaN").otherwise(seg),
        }
    )


def orders_shift(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    late = F.col("o_orderdate") >= F.lit("2000-12-01").cast("timestamp_ntz")
    return table(spark, sf, "orders").withColumn("o_totalprice", F.when(late, price * 8).otherwise(price))


def geo_variants(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    country = F.when(k == 0, "usa").when(k == 1, "United States").when(k == 2, "US").when(k == 3, "New York").otherwise("ny")
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", country.alias("country"), "c_mktsegment")


def cust_geo(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        table(spark, sf, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    )
