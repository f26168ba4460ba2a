"""What each column of a table is: class, role, meaning, statistics, quality.

The heavy part is a handful of whole-table aggregates shared by all columns.
Column classes and meanings are decided on every value of a column rather than
on its first few, so they do not depend on row order.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablelens.functions.semantics import (
    FLOAT_TYPES,
    TIME_TYPES,
    as_time,
    col,
    half_up,
    is_numeric,
    parse_time,
)
from tablelens.operators.crossproducts import gram
from tablelens.operators.dashboard import duplicate_rows, top_counts, value_counts
from tablelens.operators.ranks import FINAL_ROWS, exact_quantiles, value_grid
from tablelens.session import evenly

PROFILE_VERSION = "2.0"

# Patterns of the semantic types, tested in this order.
EMAIL = r"^[\w._%+\-]+@[\w.\-]+\.[a-zA-Z]{2,}$"
URL = r"^https?://\S+$"
PHONE = r"^\+?[\d\s\-().]{7,}$"
POSTAL = r"^\d{4,6}(-\d{4})?$"
TEXT_PATTERNS = {"email": EMAIL, "url": URL, "phone": PHONE, "postal": POSTAL}

# Name words that hint at a role.
ID_WORDS = ("id", "uuid", "key", "code", "index", "hash", "ssn", "guid")
TARGET_WORDS = (
    "target", "label", "class", "outcome", "y", "species", "purchased", "churn",
    "status", "survival", "survived", "disease",
)
TIME_WORDS = ("date", "time", "timestamp", "year", "month", "day", "created_at", "updated_at", "period")
GEO_WORDS = (
    "country", "region", "city", "state", "lat", "latitude", "lon", "lng", "longitude",
    "zip", "postal", "geo", "location", "county", "province",
)
# Cell values that mark a column as geographic.
GEO_VALUES = (
    "us", "usa", "uk", "gb", "ca", "de", "fr", "in", "cn", "jp", "au", "br",
    "apac", "emea", "latam", "europe", "asia",
)

# Thresholds of the rules below.
LONG_TEXT_LENGTH = 60
NEAR_UNIQUE = 0.95
SURE_UNIQUE = 0.98
PATTERN_SHARE = 0.6
HEALTH_FLOOR = 45.0

# Pairs of columns whose products fit one compiled scan; more are multiplied as matrices.
PAIRS_AT_ONCE = 100

PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("dtype_category", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("semantic_type", T.StringType()),
        T.StructField("null_pct", T.DoubleType()),
        T.StructField("cardinality", T.LongType()),
        T.StructField("cardinality_ratio", T.DoubleType()),
        T.StructField("is_primary_metric", T.BooleanType()),
        T.StructField("is_primary_date", T.BooleanType()),
        T.StructField("is_primary_category", T.BooleanType()),
        T.StructField("is_primary_geo", T.BooleanType()),
        T.StructField("numeric_stats", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "top_values",
            T.ArrayType(
                T.StructType([T.StructField("value", T.StringType()), T.StructField("count", T.LongType())])
            ),
        ),
        T.StructField("temporal_stats", T.MapType(T.StringType(), T.StringType())),
    ]
)


@dataclass
class ColumnFacts:
    """What the shared aggregates say about one column."""

    name: str
    dtype: T.DataType
    rows: int
    nulls: int
    measures: dict
    distinct: Callable[[], dict]  # counted for all columns at once, when first needed

    @property
    def cardinality(self) -> int:
        """Distinct values, null counting as one."""
        return self.distinct()[self.name] + (1 if self.nulls else 0)

    @property
    def filled(self) -> int:
        return self.rows - self.nulls

    @property
    def ratio(self) -> float:
        return self.cardinality / self.rows if self.rows else 0.0

    @property
    def null_pct(self) -> float:
        return half_up(self.nulls / self.rows * 100.0, 2) if self.rows else 0.0


def _measures(df: DataFrame, field: T.StructField) -> dict[str, Column]:
    """Aggregates needed to classify a column, by its type."""
    c = col(field.name)
    out = {"nulls": F.count_if(c.isNull())}
    if is_numeric(field.dataType):
        v = c.cast("double")
        out |= {"min": F.min(v), "max": F.max(v), "mean": F.avg(v), "std": F.stddev_samp(v)}
        # At most four decimals: scaling to whole numbers and back gives the same double.
        plain = v >= 0
        if isinstance(field.dataType, FLOAT_TYPES):
            plain = plain & (F.rint(v * 10000) / 10000 == v)
        out["money"] = F.count_if(plain)
    elif isinstance(field.dataType, T.StringType):
        trimmed = F.trim(c)
        out |= {
            "length": F.avg(F.length(c)),
            "dates": F.count_if(parse_time(c).isNotNull()),
            "geo": F.coalesce(F.bool_or(F.lower(c).isin(*GEO_VALUES)), F.lit(False)),
        }
        out |= {k: F.count_if(_cheap_test(k, trimmed) & trimmed.rlike(p)) for k, p in TEXT_PATTERNS.items()}
    return out


def _cheap_test(kind: str, text: Column) -> Column:
    """What every match of a pattern satisfies; keeps the pattern off most values."""
    if kind == "email":
        return text.contains("@")
    if kind == "url":
        return text.startswith("http")
    if kind == "phone":
        return (F.length(text) >= 7) & F.left(text, F.lit(1)).isin(*"+0123456789-(). \t\n")
    return F.length(text).between(4, 11)


def _countable(field: T.StructField) -> Column:
    """The column in a form whose distinct values can be counted."""
    c = col(field.name)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return c.cast("string")
    return c


class Profile:
    """Lazy profile of a table; each part runs its aggregate once when first read."""

    def __init__(self, df: DataFrame, exact_distinct: bool = True, final_rows: int = FINAL_ROWS):
        self.df = evenly(df)
        self.exact_distinct = exact_distinct
        self.final_rows = final_rows

    # -- shared aggregates ---------------------------------------------------

    @cached_property
    def facts(self) -> dict[str, ColumnFacts]:
        fields = self.df.schema.fields
        found: dict[str, ColumnFacts] = {}
        for start in range(0, len(fields), 25):  # slices keep generated code small
            part = fields[start : start + 25]
            exprs, slots = [F.count(F.lit(1)).alias("rows")], []
            for i, f in enumerate(part):
                for key, e in _measures(self.df, f).items():
                    slots.append((f.name, key))
                    exprs.append(e.alias(f"m{i}_{key}"))
            row = self.df.agg(*exprs).first()
            for f in part:
                got = {key: row[1 + j] for j, (name, key) in enumerate(slots) if name == f.name}
                found[f.name] = ColumnFacts(
                    f.name, f.dataType, row["rows"], got.pop("nulls"), got, lambda: self.distinct_counts
                )
        return found

    @cached_property
    def distinct_counts(self) -> dict[str, int]:
        fields = self.df.schema.fields
        found = dict.fromkeys((f.name for f in fields), 0)
        if not self.exact_distinct:
            for start in range(0, len(fields), 25):
                part = fields[start : start + 25]
                row = self.df.agg(*[F.approx_count_distinct(_countable(f)).alias(f"d{i}") for i, f in enumerate(part)]).first()
                found |= {f.name: row[i] for i, f in enumerate(part)}
            return found
        # Once per task and distinct value, a number is shuffled as it is, any other value as its 128-bit hash.
        kinds: dict[str, list[Column]] = {"long": [], "double": [], "hash": []}
        for i, (f, c) in enumerate(zip(fields, map(_countable, fields))):
            kind = "long" if isinstance(f.dataType, T.IntegralType) else "double" if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else "hash"
            value = [F.xxhash64(c).alias("a"), F.xxhash64(F.lit(1), c).alias("b")] if kind == "hash" else [c.cast(kind).alias("a")]
            kinds[kind].append(F.when(c.isNotNull(), F.struct(F.lit(i).alias("i"), *value)))
        for cells in kinds.values():
            for start in range(0, len(cells), 100):
                part = self.df.select(F.inline(F.array_compact(F.array(*cells[start : start + 100])))).distinct()
                found |= {fields[r["i"]].name: r["count"] for r in part.groupBy("i").count().collect()}
        return found

    @cached_property
    def rows(self) -> int:
        return next(iter(self.facts.values())).rows if self.facts else self.df.count()

    @cached_property
    def categories(self) -> dict[str, str]:
        return {n: dtype_category(f) for n, f in self.facts.items()}

    @cached_property
    def roles(self) -> dict[str, str]:
        return {n: column_role(f, self.categories[n]) for n, f in self.facts.items()}

    @cached_property
    def semantic_types(self) -> dict[str, str]:
        return {n: semantic_type(f, self.categories[n]) for n, f in self.facts.items()}

    @property
    def numeric(self) -> list[str]:
        types = {f.name: f.dataType for f in self.df.schema.fields}
        if not any(isinstance(t, T.ByteType) for t in types.values()):
            return [n for n, t in types.items() if is_numeric(t)]  # no scan needed
        return [n for n, c in self.categories.items() if c == "numeric"]

    # -- statistics ------------------------------------------------------------

    @cached_property
    def grids(self) -> dict[str, list | None]:
        """Estimated values at every thousandth of the rows; a scan of its own, for sketches keep other sums from being compiled."""
        exprs = [value_grid(F.nullif(col(n).cast("double"), F.lit(math.nan))) for n in self.numeric]
        return dict(zip(self.numeric, self.df.agg(*[e.alias(f"g{i}") for i, e in enumerate(exprs)]).first())) if exprs else {}

    @cached_property
    def quartiles(self) -> dict[str, list]:
        known = {n: (self.facts[n].filled, self.facts[n].measures["min"], self.facts[n].measures["max"], self.grids[n]) for n in self.numeric}
        wanted = {n: [0.25, 0.5, 0.75] for n in self.numeric}
        return exact_quantiles(self.df, wanted, self.rows, self.final_rows, known=known)

    @cached_property
    def outliers(self) -> dict[str, int]:
        """Values beyond 1.5 IQR per numeric column; 0 where the IQR is 0."""
        tests = {}
        for n, (q1, _, q3) in self.quartiles.items():
            if q1 is not None and q3 - q1 > 0:
                low, high = iqr_fences(q1, q3)
                tests[n] = (col(n) < F.lit(low)) | (col(n) > F.lit(high))
        found = dict.fromkeys(self.quartiles, 0)
        names = list(tests)
        for start in range(0, len(names), 100):
            part = names[start : start + 100]
            row = self.df.agg(*[F.count_if(tests[n]).alias(f"o{i}") for i, n in enumerate(part)]).first()
            found |= dict(zip(part, row))
        return found

    @property
    def stats_columns(self) -> list[str]:
        return [n for n in self.numeric if self.roles[n] in ("metric", "target", "dimension")]

    @cached_property
    def numeric_stats(self) -> dict[str, dict]:
        out = {}
        for n in self.stats_columns:
            m = self.facts[n].measures
            if self.facts[n].filled == 0:
                out[n] = dict.fromkeys(("min", "max", "mean", "std", "skew")) | {"outlier_count": 0.0}
                continue
            median, std = self.quartiles[n][1], m["std"]
            usable = self.facts[n].filled >= 3 and median is not None and std and std > 0
            out[n] = {
                "min": half_up(m["min"], 4),
                "max": half_up(m["max"], 4),
                "mean": half_up(m["mean"], 4),
                "std": None if std is None else half_up(std, 4),
                "skew": half_up(3.0 * (m["mean"] - median) / std, 2) if usable else None,
                "outlier_count": float(self.outliers[n]),
            }
        return out

    @property
    def top_columns(self) -> list[str]:
        counted = ("dimension", "target", "geo", "identifier")
        return [
            n
            for n in self.facts
            if self.roles[n] in counted or (self.categories[n] != "numeric" and self.roles[n] != "temporal")
        ]

    def top_values_df(self, n: int = 5) -> DataFrame:
        """(column, value, count, rank) of the most frequent non-null values."""
        counts = value_counts(self.df, self.top_columns).filter(F.col("value").isNotNull())
        return top_counts(counts, n)

    @cached_property
    def top_values(self) -> dict[str, list[tuple[str, int]]]:
        if not self.top_columns:
            return {}
        out: dict[str, list] = {n: [] for n in self.top_columns}
        # At most five rows per column.
        for r in sorted(self.top_values_df().collect(), key=lambda r: r["rank"]):
            out[r["column"]].append((r["value"], r["count"]))
        return out

    @cached_property
    def temporal_stats(self) -> dict[str, dict[str, str]]:
        names = [n for n, r in self.roles.items() if r == "temporal"]
        if not names:
            return {}
        exprs = []
        for i, n in enumerate(names):
            t = as_time(self.df, n)
            exprs += [F.min(t).cast("string").alias(f"lo{i}"), F.max(t).cast("string").alias(f"hi{i}")]
        row = self.df.agg(*exprs).first()
        out = {}
        for i, n in enumerate(names):
            if row[f"lo{i}"] is None:
                out[n] = {"min_date": "N/A", "max_date": "N/A", "granularity": "unknown"}
            else:
                out[n] = {
                    "min_date": row[f"lo{i}"],
                    "max_date": row[f"hi{i}"],
                    "granularity": granularity(self.df, n),
                }
        return out

    # -- choices ---------------------------------------------------------------

    @cached_property
    def primary(self) -> dict[str, str | None]:
        """The leading metric, date, category and geo column."""
        kinds = self.categories
        metrics = [n for n, r in self.roles.items() if r in ("metric", "target") and kinds[n] == "numeric"]
        groups = [n for n, r in self.roles.items() if r in ("dimension", "target") and kinds[n] == "categorical"]
        repeated = [n for n in groups if half_up(self.facts[n].ratio, 4) < 0.5]
        return {
            "metric": max(metrics, key=lambda n: self.facts[n].measures["std"] or 0.0, default=None),
            "date": next((n for n, r in self.roles.items() if r == "temporal"), None),
            "category": max(repeated, key=lambda n: self.facts[n].cardinality, default=None)
            or next(iter(groups), None),
            "geo": next((n for n, r in self.roles.items() if r == "geo"), None),
        }

    def relevance(self, name: str) -> float:
        """How much a column matters: base, primary, not an identifier, mostly filled."""
        f = self.facts[name]
        score = 0.4
        score += 0.3 if name in self.primary.values() else 0.0
        score += 0.2 if self.roles[name] != "identifier" else 0.0
        score += 0.1 if f.null_pct < 30.0 else 0.0
        return min(1.0, score)

    # -- tables ----------------------------------------------------------------

    def columns_df(self) -> DataFrame:
        """One row per column."""
        rows = []
        for i, (n, f) in enumerate(self.facts.items()):
            rows.append(
                (
                    i,
                    n,
                    f.dtype.simpleString(),
                    self.categories[n],
                    self.roles[n],
                    self.semantic_types[n],
                    f.null_pct,
                    f.cardinality,
                    half_up(f.ratio, 4),
                    *[self.primary[k] == n for k in ("metric", "date", "category", "geo")],
                    self.numeric_stats.get(n),
                    self.top_values.get(n),
                    self.temporal_stats.get(n),
                )
            )
        return self.df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)

    @cached_property
    def quality(self) -> dict:
        dup = duplicate_rows(self.df).first()
        nulls = sum(f.nulls for f in self.facts.values())
        cells = self.rows * len(self.facts)
        null_pct = half_up(nulls / cells * 100.0, 2) if cells else 0.0
        spiky = sum(1 for s in self.numeric_stats.values() if s["outlier_count"] > 0)
        issues = []
        if dup["duplicates"]:
            issues.append(f"{dup['duplicates']} duplicate rows detected ({dup['duplicate_pct']}%)")
        if null_pct > 5.0:
            issues.append(f"High null density: {null_pct}% of total cells missing")
        if spiky:
            issues.append(f"{spiky} numeric columns contain statistical outliers")
        penalty = 0.5 * dup["duplicate_pct"] + 0.8 * null_pct + 3.0 * spiky
        return {
            "health_score": max(HEALTH_FLOOR, half_up(100.0 - penalty, 1)),
            "duplicate_rows": dup["duplicates"],
            "duplicate_pct": dup["duplicate_pct"],
            "null_cells": nulls,
            "null_pct": null_pct,
            "outlier_columns": spiky,
            "issues": issues,
        }

    def quality_df(self) -> DataFrame:
        q = self.quality
        schema = (
            "health_score double, duplicate_rows long, duplicate_pct double, null_cells long, "
            "null_pct double, outlier_columns int, issues array<string>"
        )
        return self.df.sparkSession.createDataFrame([tuple(q.values())], schema)

    @cached_property
    def correlations(self) -> list[tuple[str, str, float | None]]:
        return correlation_pairs(self.df, self.numeric)

    def correlation_df(self) -> DataFrame:
        schema = "col_a string, col_b string, r double"
        return self.df.sparkSession.createDataFrame(self.correlations, schema)

    @cached_property
    def information(self) -> list[tuple[str, str, float, int]]:
        """Mutual information of the primary metric with every candidate, widest first."""
        from tablelens.operators.information import mutual_information

        target = self.primary["metric"]
        if target is None:
            return []
        wanted = [
            n
            for n, k in self.categories.items()
            if k in ("numeric", "categorical") and n != target and self.roles[n] != "identifier"
        ]

        def weight(n: str) -> float:
            if n in self.stats_columns:
                return self.facts[n].measures["std"] or 0.0
            return float(self.facts[n].cardinality)

        wanted.sort(key=weight, reverse=True)
        return mutual_information(self.df, target, wanted, self.numeric, self.rows)

    def information_df(self) -> DataFrame:
        schema = "target string, column string, mi_score double, cells long"
        return self.df.sparkSession.createDataFrame(self.information, schema)


def iqr_fences(q1: float, q3: float) -> tuple[float, float]:
    reach = 1.5 * (q3 - q1)
    return q1 - reach, q3 + reach


def dtype_category(f: ColumnFacts) -> str:
    """numeric, boolean, datetime, text, categorical or unknown."""
    if is_numeric(f.dtype):
        flag_like = isinstance(f.dtype, T.ByteType) and f.cardinality <= 2
        return "boolean" if flag_like else "numeric"
    if isinstance(f.dtype, TIME_TYPES):
        return "datetime"
    if isinstance(f.dtype, T.BooleanType):
        return "boolean"
    if not isinstance(f.dtype, T.StringType):
        return "unknown"
    if f.filled and f.measures["length"] > LONG_TEXT_LENGTH:
        return "text"
    return "datetime" if f.filled and f.measures["dates"] > f.filled * 0.5 else "categorical"


def column_role(f: ColumnFacts, category: str) -> str:
    """First matching rule of: identifier, target, temporal, geo, then by class."""
    name = f.name.lower()
    unique = f.rows > 5 and f.ratio >= NEAR_UNIQUE
    words = name.split("_")
    id_named = words[0] in ID_WORDS or words[-1] in ID_WORDS
    is_text = isinstance(f.dtype, T.StringType)
    rules = (
        ("identifier", unique and (id_named or f.cardinality > max(100, f.rows * SURE_UNIQUE))),
        ("target", words[-1] in TARGET_WORDS),
        ("temporal", category == "datetime"),
        (
            "temporal",
            is_text
            and any(w in name for w in TIME_WORDS)
            and f.filled > 0
            and f.measures["dates"] > f.filled * 0.5,
        ),
        ("temporal", category == "numeric" and ("year" in name or "date" in name)),
        ("geo", any(w in name for w in GEO_WORDS)),
        ("geo", category == "categorical" and f.measures.get("geo", False)),
        ("dimension", category == "boolean"),
        (
            "dimension",
            category == "numeric" and not isinstance(f.dtype, FLOAT_TYPES) and f.cardinality <= 5,
        ),
        ("metric", category == "numeric"),
        ("text", category == "text"),
        ("identifier", unique),
    )
    return next((role for role, holds in rules if holds), "dimension")


def semantic_type(f: ColumnFacts, category: str) -> str:
    """What the values mean, from the share of values matching a pattern or a range."""
    if category == "boolean":
        return "boolean_flag"
    if category == "datetime":
        return "date_string"
    if f.filled == 0:
        return "generic"
    enough = max(1, int(f.filled * PATTERN_SHARE))
    m, name = f.measures, f.name.lower()
    if category in ("categorical", "text"):
        return next((k for k in TEXT_PATTERNS if m[k] >= enough), "generic")
    if category == "numeric":
        if m["min"] >= -90 and m["max"] <= 90 and "lat" in name:
            return "lat"
        if m["min"] >= -180 and m["max"] <= 180 and any(w in name for w in ("lon", "lng")):
            return "lng"
        return "currency" if m["money"] >= enough else "generic"
    return "generic"


def granularity(df: DataFrame, name: str) -> str:
    """Label of the median gap between distinct days (their number is bounded by the calendar)."""
    days = df.select(as_time(df, name).cast("date").alias("d")).filter(F.col("d").isNotNull()).distinct()
    gap = F.date_diff(F.col("d"), F.lag("d").over(Window.orderBy("d")))
    middle = days.select(gap.alias("g")).agg(F.percentile("g", F.lit(0.5))).first()[0]
    for label, limit in (("daily", 1), ("weekly", 8), ("monthly", 31), ("quarterly", 92)):
        if middle is None or middle <= limit:
            return label
    return "yearly"


def correlation_pairs(df: DataFrame, columns: list[str]) -> list[tuple[str, str, float | None]]:
    """Pearson r for all ordered pairs, on rows complete in every column.

    Null where a column does not vary; nothing for fewer than two columns or
    three complete rows.
    """
    if len(columns) < 2:
        return []
    values = [col(c).cast("double") for c in columns]
    complete = df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)]).na.drop()
    n = len(columns)
    names = [f"c{i}" for i in range(n)]
    # First the means, then sums of products around them: plain sums, one scan each.
    first = complete.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names]).first().asDict()
    if first["n"] < 3:
        return []
    around = complete.select(*[(F.col(c) - F.lit(first[c])).alias(c) for c in names])
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    if len(pairs) > PAIRS_AT_ONCE:  # one scan for any number of columns
        sums = gram(around, [F.col(c) for c in names])
        product = {(i, j): float(sums[i, j]) for i, j in pairs}
    else:
        row = around.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"p{i}_{j}") for i, j in pairs]).first()
        product = dict(zip(pairs, row))
    varies = [product[(i, i)] > 0 for i in range(n)]

    def value(i: int, j: int) -> float | None:
        if not (varies[i] and varies[j]):
            return None
        if i == j:
            return 1.0
        found = product[(min(i, j), max(i, j))] / math.sqrt(product[(i, i)] * product[(j, j)])
        return None if found != found else half_up(max(-1.0, min(1.0, found)), 4)

    return [(columns[i], columns[j], value(i, j)) for i in range(n) for j in range(n)]


# Relationship labels by correlation, first match wins.
def correlation_label(r: Column) -> Column:
    return (
        F.when(r.isNull(), "Undefined (Zero Variance)")
        .when(r == 1, "Perfect Direct")
        .when(r >= 0.7, "Strong Positive")
        .when(r >= 0.3, "Moderate Positive")
        .when((r > -0.1) & (r < 0.1), "No Linear Correlation")
        .when(r <= -0.7, "Strong Negative")
        .when(r <= -0.3, "Moderate Negative")
        .otherwise("Weak Relationship")
    )


def corr_extremes(pairs: DataFrame) -> DataFrame:
    """The strongest positive and the strongest negative pair, each once."""
    one_way = pairs.filter((F.col("col_a") < F.col("col_b")) & F.col("r").isNotNull())
    packed = one_way.agg(
        F.max_by(F.struct("col_a", "col_b", "r"), F.struct(F.col("r"), F.col("col_a"), F.col("col_b"))).alias("p"),
        F.min_by(F.struct("col_a", "col_b", "r"), F.struct(F.col("r"), F.col("col_a"), F.col("col_b"))).alias("n"),
    )
    both = F.array(
        F.struct(F.lit("positive").alias("side"), F.col("p").alias("x")),
        F.struct(F.lit("negative").alias("side"), F.col("n").alias("x")),
    )
    return (
        packed.select(F.inline(both))
        .filter(F.col("x").isNotNull())
        .select("side", "x.*", correlation_label(F.col("x.r")).alias("label"))
    )


# Spellings that mean the same place.
ALIASES = (("usa", "united states"), ("us", "usa"), ("ny", "new york"), ("ca", "california"))


def category_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that hold two spellings of one place, with the rows of each."""
    spellings = sorted({s for pair in ALIASES for s in pair})
    lowered = F.lower(F.col("value"))
    # Only the few known spellings survive the filter, before any shuffle.
    seen = (
        value_counts(df, columns)
        .withColumn("value", lowered)
        .filter(F.col("value").isin(*spellings))
        .groupBy("column")
        .agg(*[F.sum(F.when(F.col("value") == s, F.col("count"))).alias(s) for s in spellings])
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(a).alias("value_a"), F.lit(b).alias("value_b"), col(a).alias("rows_a"), col(b).alias("rows_b")
            )
            for a, b in ALIASES
        ]
    )
    return seen.select("column", F.inline(pairs)).filter(F.col("rows_a").isNotNull() & F.col("rows_b").isNotNull())


def overview(profile: Profile) -> DataFrame:
    """One row: rows, columns, date range and the leading columns."""
    p = profile.primary
    date = profile.temporal_stats.get(p["date"], {}) if p["date"] else {}
    row = (
        profile.rows,
        len(profile.facts),
        date.get("min_date"),
        date.get("max_date"),
        p["metric"],
        p["date"],
        p["category"],
        p["geo"],
    )
    schema = (
        "row_count long, column_count int, start string, end string, primary_metric string, "
        "primary_date string, primary_category string, primary_geo string"
    )
    return profile.df.sparkSession.createDataFrame([row], schema)


def overview_columns(profile: Profile) -> DataFrame:
    """One row per column: class, role, nulls, distinct values, leading flags, frequent values and main measures."""
    stat = lambda name: F.try_element_at("numeric_stats", F.lit(name)).alias(name)
    nulls = profile.df.sparkSession.createDataFrame([(n, f.nulls) for n, f in profile.facts.items()], "column string, null_count long")
    return profile.columns_df().join(nulls, "column").select(
        "position",
        "column",
        "null_count",
        "null_pct",
        "role",
        "dtype_category",
        "semantic_type",
        "cardinality",
        "cardinality_ratio",
        "is_primary_metric",
        "is_primary_date",
        "is_primary_category",
        "is_primary_geo",
        F.transform("top_values", lambda v: v["value"]).alias("unique_values"),
        *[stat(n) for n in ("min", "max", "mean", "skew")],
        "temporal_stats",
    )


def outlier_values(profile: Profile, key: list[str], n: int = 5) -> DataFrame:
    """(column, value, rank, key): the first ``n`` values outside the fences of each column, in key order.

    The rows outside any fence are few cells of a wide table; the rank limit is applied before the shuffle.
    """
    names = [c for c in profile.numeric_stats if profile.outliers[c] > 0]
    keys = [col(k) for k in key]
    if not names:
        return profile.df.select(F.lit("").alias("column"), F.lit(0.0).alias("value"), F.lit(0).alias("rank"), *keys).limit(0)
    cells = []
    for c in names:
        low, high = iqr_fences(profile.quartiles[c][0], profile.quartiles[c][2])
        v = col(c).cast("double")
        cells.append(F.when((v < low) | (v > high), F.struct(F.lit(c).alias("column"), v.alias("value"))))
    found = profile.df.select(*keys, F.explode(F.array_compact(F.array(*cells))).alias("o")).select("o.*", *keys)
    order = Window.partitionBy("column").orderBy(*keys, "value")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def stored_rows(profile: Profile, dataset: str, at: dt.datetime, version: str = PROFILE_VERSION) -> DataFrame:
    """Profile rows stamped for the profile store."""
    return profile.columns_df().select(
        F.lit(dataset).alias("dataset"),
        F.lit(version).alias("profile_version"),
        F.lit(at.isoformat()).alias("profiled_at"),
        "*",
    )
