"""Cleaning, validation, scoring and repair of a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablelens.functions.semantics import (
    TIME_TYPES,
    as_time,
    col,
    is_numeric,
    numeric_columns,
    parse_time,
    string_columns,
)
from tablelens.operators.dashboard import top_counts, value_counts
from tablelens.operators.ranks import FINAL_ROWS, exact_quantiles

# Cell texts that stand for a missing value.
NULL_TOKENS = ("", "N/A", "null", "NaN")


def sanitize(df: DataFrame) -> DataFrame:
    """Tidy column names, trim text cells, and turn null tokens into nulls."""
    df = df.toDF(*[c.strip().replace(" ", "_").replace("-", "_") for c in df.columns])
    texts = set(string_columns(df))

    def cell(name: str) -> Column:
        if name not in texts:
            return col(name)
        trimmed = F.trim(col(name))
        return F.when(~trimmed.isin(*NULL_TOKENS), trimmed).alias(name)

    return df.select(*[cell(c) for c in df.columns])


def sanitize_report(df: DataFrame, encoding: str) -> DataFrame:
    """What ``sanitize`` does to a table, one row a column: names, null tokens turned into nulls, cells that lost padding.

    ``encoding`` is the one that the table was read with; ``original_columns`` counts the table's columns.
    """
    texts = set(string_columns(df))
    clean = sanitize(df.limit(0)).columns
    counts: list[Column] = []
    for name in df.columns:
        trimmed = F.trim(col(name))
        token = trimmed.isin(*NULL_TOKENS) if name in texts else F.lit(False)
        padded = ~token & (trimmed != col(name)) if name in texts else F.lit(False)
        counts += [F.count_if(token), F.count_if(padded)]
    found = df.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)]).first()
    rows = [(encoding, len(clean), old, new, found[2 * i], found[2 * i + 1]) for i, (old, new) in enumerate(zip(df.columns, clean))]
    return df.sparkSession.createDataFrame(rows, "used_encoding string, original_columns int, original_name string, column string, null_tokens long, padded_cells long")


@dataclass(frozen=True)
class Rule:
    """What a column must hold: a kind, optionally no nulls, a minimum, any value at all."""

    column: str
    kind: str  # number, time or text
    nullable: bool = True
    minimum: float | None = None
    some_value: bool = False


# The sales transaction schema.
SALES_RULES = [
    Rule("Date", "time", nullable=False),
    Rule("Revenue", "number", minimum=-1_000_000.0),
    Rule("Category", "text"),
    Rule("Region", "text"),
]


def infer_rules(schema: T.StructType) -> list[Rule]:
    """Rules from column types: numbers need some value, times and texts are nullable."""
    rules = []
    for f in schema.fields:
        if is_numeric(f.dataType):
            rules.append(Rule(f.name, "number", some_value=True))
        elif isinstance(f.dataType, TIME_TYPES):
            rules.append(Rule(f.name, "time"))
        else:
            rules.append(Rule(f.name, "text"))
    return rules


def _as_kind(df: DataFrame, rule: Rule) -> Column:
    c, dtype = col(rule.column), df.schema[rule.column].dataType
    if rule.kind == "number":
        return c.try_cast("double")
    if rule.kind == "time":
        return parse_time(c) if isinstance(dtype, T.StringType) else as_time(df, rule.column)
    return c.cast("string")


def failures(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """(keys, column, reason, value) for every failing cell, found in one scan."""
    checks = []
    for rule in rules:
        if rule.column not in df.columns:
            continue
        c, typed = col(rule.column), _as_kind(df, rule)

        def mark(test: Column, reason: str, c=c, name=rule.column) -> Column:
            return F.when(
                test,
                F.struct(F.lit(name).alias("column"), F.lit(reason).alias("reason"), c.cast("string").alias("value")),
            )

        if rule.kind != "text":
            checks.append(mark(c.isNotNull() & typed.isNull(), f"not a {rule.kind}"))
        if not rule.nullable:
            checks.append(mark(c.isNull(), "missing"))
        if rule.minimum is not None:
            checks.append(mark(typed < F.lit(rule.minimum), "below minimum"))
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<struct<column:string,reason:string,value:string>>")
    return df.select(*[col(k) for k in keys], F.explode(found).alias("f")).select(*keys, "f.*")


def validate(df: DataFrame, rules: list[Rule], keys: list[str], per_rule: int = 10) -> DataFrame:
    """The first failures of every rule in key order, plus columns without any value.

    The rank limit is applied inside each task before the shuffle, so a rule
    that every row breaks does not gather the table in one place.
    """
    first = Window.partitionBy("column", "reason").orderBy(*keys)
    shown = (
        failures(df, rules, keys).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= per_rule)
    )
    needed = [r.column for r in rules if r.some_value and r.column in df.columns]
    if not needed:
        return shown
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n")) for i, c in enumerate(needed)])
    empty = (
        df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(needed)])
        .filter(F.col("rows") > 0)
        .select(F.inline(cells))
        .filter(F.col("n") == 0)
    )
    blank = [F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]
    empty = empty.select(
        *blank, "column", F.lit("no values").alias("reason"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("rank")
    )
    return shown.unionByName(empty)


def quality_score(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """One row: score, rows, missing cells and all failures of the rules (at most ten per rule lower the score)."""
    per_rule = failures(df, rules, keys).groupBy("column", "reason").agg(F.count(F.lit(1)).alias("n"))
    sums = per_rule.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.least(F.col("n"), F.lit(10))), F.lit(0)).alias("counted"))).scalar()
    needed = [r.column for r in rules if r.some_value and r.column in df.columns]
    empty = sum(((F.count(col(c)) == 0).cast("long") for c in needed), F.lit(0))
    repeated = len(df.columns) - len(set(df.columns))
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        sum((F.count_if(col(c).isNull()) for c in df.columns), F.lit(0)).cast("long").alias("missing"),
        F.when(F.count(F.lit(1)) > 0, empty).otherwise(0).cast("long").alias("empty"),
    ).withColumn("found", sums)
    share = F.coalesce(F.try_divide(F.col("missing"), F.col("rows") * len(df.columns)), F.lit(0.0))
    deductions = (
        F.least(F.lit(30), F.floor(share * 100))
        + F.least(F.lit(40), (F.col("found.counted") + F.col("empty")) * 2)
        + F.lit(min(10, 5 * repeated))
    )
    return counted.withColumn("anomalies", F.col("found.n") + F.col("empty")).select(
        F.when(F.col("rows") == 0, F.lit(0)).otherwise(F.greatest(F.lit(10), F.lit(100) - deductions)).cast("int").alias("quality_score"),
        "rows",
        "missing",
        (share * 100).alias("missing_pct"),
        "anomalies",
    )


def _medians(df: DataFrame, rows: int, final_rows: int) -> dict:
    found = exact_quantiles(df, {c: [0.5] for c in numeric_columns(df)}, rows, final_rows)
    return {c: v[0] for c, v in found.items()}


def _categories(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if not is_numeric(f.dataType) and not isinstance(f.dataType, (*TIME_TYPES, T.ArrayType, T.MapType, T.StructType))
    ]


def _without_nan(df: DataFrame) -> DataFrame:
    """NaN is a missing number."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def impute(df: DataFrame, rows: int | None = None, final_rows: int = FINAL_ROWS) -> DataFrame:
    """Numeric nulls and NaN become the median (columns turn double), others the most frequent value.

    Nested columns stay as they are.
    """
    df = _without_nan(df)
    rows = df.count() if rows is None else rows
    medians = _medians(df, rows, final_rows)
    names = _categories(df)
    modes: dict[str, str] = {}
    if names:
        counts = value_counts(df, names).filter(F.col("value").isNotNull())
        modes = {r["column"]: r["value"] for r in top_counts(counts, 1).collect()}  # one row per column

    def cell(f: T.StructField) -> Column:
        c = col(f.name)
        if f.name in medians:
            c = c.cast("double")
            if medians[f.name] is not None:
                c = F.coalesce(c, F.lit(float(medians[f.name])))
        elif f.name in modes:
            c = F.coalesce(c, F.lit(modes[f.name]).cast(f.dataType))
        return c.alias(f.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def winsorize(
    df: DataFrame, rows: int | None = None, low: float = 0.01, high: float = 0.99, final_rows: int = FINAL_ROWS
) -> DataFrame:
    """Clip numeric columns to their low and high quantiles; NaN becomes null."""
    df = _without_nan(df)
    limits = exact_quantiles(df, {c: [low, high] for c in numeric_columns(df)}, rows, final_rows)

    def cell(name: str) -> Column:
        c = col(name)
        if name not in limits or limits[name][0] is None:
            return c
        lo, hi = (F.lit(float(v)) for v in limits[name])
        return F.when(c.isNotNull(), F.least(F.greatest(c.cast("double"), lo), hi)).alias(name)

    return df.select(*[cell(c) for c in df.columns])


def dedupe(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def auto_heal(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Impute, clip to the 1st and 99th percentile, drop duplicate rows."""
    rows = df.count() if rows is None else rows
    return dedupe(winsorize(impute(df, rows), rows))
