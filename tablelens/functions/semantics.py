"""Column expressions that fix the meaning of an operation once.

Nulls count as a value in ``n_unique``, an empty sum is zero, sorting puts
nulls first in both directions, and lenient parsing never raises.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Date layouts accepted for text columns, tried in this order.
DATE_LAYOUTS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "dd-MM-yyyy",
    "dd/MM/yyyy",
)

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
FLOAT_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
TIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)


def col(name: str) -> Column:
    """A column by its literal name, even when it holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def zsum(c: Column) -> Column:
    """Sum that is 0, not null, when there is nothing to add."""
    return F.coalesce(F.sum(c), F.lit(0))


def n_unique(c: Column) -> Column:
    """Distinct values, null counting as one of them."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def sort_key(name: str, descending: bool) -> Column:
    """Sort expression with nulls first in both directions."""
    c = col(name)
    return c.desc_nulls_first() if descending else c.asc_nulls_first()


def parse_time(c: Column) -> Column:
    """Text to timestamp by the fixed layouts; null where none fits."""
    short = F.length(c).between(8, 26)
    looks_like_date = short & c.rlike(r"^\d{2,4}[-/]\d{2}[-/]\d{2,4}")
    parsed = F.coalesce(*[F.try_to_timestamp(c, F.lit(layout)) for layout in DATE_LAYOUTS])
    return F.when(looks_like_date, parsed)


def as_time(df: DataFrame, name: str) -> Column:
    """The column as a point in time, parsing it first when it is text."""
    dtype = df.schema[name].dataType
    return parse_time(col(name)) if isinstance(dtype, T.StringType) else col(name)


def order_number(df: DataFrame, name: str) -> Column:
    """A number that sorts like the column: numerics as they are, times as microseconds."""
    dtype = df.schema[name].dataType
    c = as_time(df, name)
    if is_numeric(dtype):
        return c
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(86_400_000_000)
    if isinstance(dtype, T.TimestampNTZType):
        second = F.extract(F.lit("SECOND"), c).cast("decimal(10,6)")
        return (
            F.unix_date(c.cast("date")).cast("long") * F.lit(86_400_000_000)
            + F.hour(c).cast("long") * F.lit(3_600_000_000)
            + F.minute(c).cast("long") * F.lit(60_000_000)
            + (second * F.lit(1_000_000)).cast("long")
        )
    if isinstance(dtype, (T.TimestampType, T.StringType)):
        return F.unix_micros(c)
    raise TypeError(f"cannot order by {name} of type {dtype.simpleString()}")


def pearson_skew(mean: Column, median: Column, std: Column) -> Column:
    """Pearson's second skewness coefficient, 3(mean - median)/std."""
    return F.when(std > 0, F.lit(3.0) * (mean - median) / std)


def title_case(name: str) -> str:
    """Readable label for a column name."""
    return name.replace("_", " ").title()


def half_up(x: float | None, digits: int) -> float | None:
    """Round half away from zero on the decimal form, as SQL engines do."""
    if x is None or x != x or x in (float("inf"), float("-inf")):
        return x
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))
