"""Reading tables: CSV with pinned types, dirty CSV bytes, and SQL databases."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablelens.operators.quality import sanitize, sanitize_report

# Encodings tried for text files, in this order.
ENCODINGS = ("UTF-8", "ISO-8859-1", "windows-1252")


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    """Header CSV; malformed cells become null.  Types are inferred once unless given.

    Inference reads the file an extra time: pass the schema for large inputs.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", encoding)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def pick_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that decodes the whole input.

    Lines are read as raw bytes and tested for valid UTF-8; the next encoding
    in the list accepts any byte, so it is the one used otherwise.
    """
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return ENCODINGS[1] if bad.limit(1).count() else ENCODINGS[0]


def read_dirty_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read CSV of unknown encoding and clean names, padding and null tokens."""
    return sanitize(read_csv(spark, path, schema, pick_encoding(spark, path)))


def dirty_csv_report(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The encoding that ``read_dirty_csv`` uses, and what it cleans in every column."""
    encoding = pick_encoding(spark, path)
    return sanitize_report(read_csv(spark, path, schema, encoding), encoding)


def jdbc_options(url: str, table: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> dict:
    """Reader options; ``partition`` is (column, lower, upper, tasks) for parallel reads."""
    out = {"url": url, "dbtable": table, **options}
    if partition:
        column, lower, upper, tasks = partition
        out |= {
            "partitionColumn": column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(tasks),
        }
    return out


def read_jdbc(spark: SparkSession, url: str, table: str, partition=None, **options: str) -> DataFrame:
    """A whole database table; filters and column choices are pushed to the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, partition, **options)).load()


def list_tables(spark: SparkSession, url: str, schema: str = "public", **options: str) -> DataFrame:
    """Names of the tables of a schema, from the database's own catalog view."""
    catalog = f"(SELECT table_name FROM information_schema.tables WHERE table_schema = '{_safe(schema)}') t"
    return read_jdbc(spark, url, catalog, **options).orderBy("table_name")


def _safe(name: str) -> str:
    if not name.replace("_", "").isalnum():
        raise ValueError(f"not a plain schema name: {name}")
    return name


def can_connect(spark: SparkSession, url: str, **options: str) -> bool:
    """True when the catalog of the database can be read."""
    try:
        list_tables(spark, url, **options).limit(1).count()
        return True
    except (AnalysisException, Exception):  # noqa: BLE001 - any driver error means no
        return False
