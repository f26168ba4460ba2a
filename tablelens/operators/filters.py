"""Filters: single conditions, value sets, ranges, dates, and their editable state.

Every filter compiles to one Catalyst predicate, so it reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablelens.functions.semantics import as_time, col, string_columns

# Name parts that mark a column as geographic on dashboards.
GEO_NAME_PARTS = ("region", "country", "geo", "location", "zone", "state")
# Name parts that mark a column as temporal on dashboards.
TIME_NAME_PARTS = ("date", "time")


@dataclass(frozen=True)
class Filter:
    """One condition ``column op value``."""

    column: str
    op: str
    value: Any

    def predicate(self) -> Column | None:
        """The condition as a predicate; None when op or value make no sense."""
        c, v = col(self.column), self.value
        if self.op in ("==", "eq"):
            return c == F.lit(v)
        if self.op == "!=":
            return c != F.lit(v)
        if self.op in (">=", "gte"):
            return c >= F.lit(v)
        if self.op in ("<=", "lte"):
            return c <= F.lit(v)
        if self.op == ">":
            return c > F.lit(v)
        if self.op == "<":
            return c < F.lit(v)
        if self.op == "in" and isinstance(v, list):
            return c.isin(v)
        if self.op == "between" and isinstance(v, (list, tuple)) and len(v) == 2:
            return c.between(F.lit(v[0]), F.lit(v[1]))
        return None


def apply_filters(df: DataFrame, filters: list[Filter], strict: bool = False) -> DataFrame:
    """AND all conditions; unknown columns and operators are skipped unless ``strict``."""
    for f in filters:
        predicate = f.predicate() if f.column in df.columns else None
        if predicate is not None:
            df = df.filter(predicate)
        elif strict:
            raise ValueError(f"cannot apply filter {f}")
    return df


def first_named(df: DataFrame, parts: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if any(p in c.lower() for p in parts)]


def _first_holding(df: DataFrame, candidates: list[str], value: str) -> str | None:
    """First candidate column that contains the value, found in one scan."""
    if not candidates:
        return None
    wanted = value.lower()
    row = df.agg(
        *[F.bool_or(F.lower(col(c).cast("string")) == F.lit(wanted)).alias(f"h{i}") for i, c in enumerate(candidates)]
    ).first()
    return next((c for c, hit in zip(candidates, row) if hit), None)


def filter_equal_anywhere(df: DataFrame, candidates: list[str], value: str) -> DataFrame:
    """Case-insensitive equality on the first candidate holding the value; else unchanged."""
    name = _first_holding(df, candidates, value)
    if name is None:
        return df
    return df.filter(F.lower(col(name).cast("string")) == F.lit(value.lower()))


def filter_region(df: DataFrame, value: str) -> DataFrame:
    return filter_equal_anywhere(df, first_named(df, GEO_NAME_PARTS) or string_columns(df), value)


def filter_category(df: DataFrame, value: str) -> DataFrame:
    return filter_equal_anywhere(df, string_columns(df), value)


def filter_value_sets(df: DataFrame, sets: dict[str, list]) -> DataFrame:
    return apply_filters(df, [Filter(c, "in", list(v)) for c, v in sets.items() if v])


def filter_ranges(df: DataFrame, ranges: dict[str, list]) -> DataFrame:
    return apply_filters(df, [Filter(c, "between", list(r)) for c, r in ranges.items()])


def filter_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    """Keep rows inside [start, end] on the first date- or time-named column."""
    names = first_named(df, TIME_NAME_PARTS)
    if not names or not start or not end:
        return df
    c = as_time(df, names[0])
    ntz = isinstance(df.schema[names[0]].dataType, T.TimestampNTZType)
    kind = "timestamp_ntz" if ntz else "timestamp"
    return df.filter(c.between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def filter_brush(df: DataFrame, low: float, high: float) -> DataFrame:
    """Keep rows inside [low, high] on the first float or integer column."""
    kinds = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType)
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
    return filter_ranges(df, {names[0]: [low, high]}) if names else df


@dataclass(frozen=True)
class FilterState:
    """Immutable filter selection; every edit returns a new state."""

    region: str | None = None
    category: str | None = None
    dates: tuple[str, str] | None = None
    brush: tuple[float, float] | None = None
    equals: dict[str, Any] = field(default_factory=dict)
    value_sets: dict[str, tuple] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)

    def set(self, key: str, value: Any) -> FilterState:
        name = _slot(key)
        if name:
            return replace(self, **{name: value})
        equals = {k: v for k, v in self.equals.items() if k != key}
        if value is not None:
            equals[key] = value
        return replace(self, equals=equals)

    def set_range(self, column: str, bounds: tuple[float, float] | None) -> FilterState:
        ranges = {k: v for k, v in self.ranges.items() if k != column}
        if bounds is not None:
            ranges[column] = tuple(bounds)
        return replace(self, ranges=ranges)

    def toggle(self, column: str, value: Any) -> FilterState:
        chosen = self.value_sets.get(column, ())
        chosen = tuple(v for v in chosen if v != value) if value in chosen else (*chosen, value)
        sets = {k: v for k, v in self.value_sets.items() if k != column}
        if chosen:
            sets[column] = chosen
        return replace(self, value_sets=sets)

    def remove(self, key: str) -> FilterState:
        state = replace(
            self,
            equals={k: v for k, v in self.equals.items() if k != key},
            value_sets={k: v for k, v in self.value_sets.items() if k != key},
            ranges={k: v for k, v in self.ranges.items() if k != key},
        )
        name = _slot(key)
        return replace(state, **{name: None}) if name else state

    def clear(self) -> FilterState:
        return FilterState()

    def apply(self, df: DataFrame) -> DataFrame:
        if self.region:
            df = filter_region(df, self.region)
        if self.category:
            df = filter_category(df, self.category)
        df = apply_filters(df, [Filter(c, "==", v) for c, v in self.equals.items()])
        df = filter_value_sets(df, {c: list(v) for c, v in self.value_sets.items()})
        df = filter_ranges(df, {c: list(v) for c, v in self.ranges.items()})
        if self.dates:
            df = filter_dates(df, *self.dates)
        if self.brush:
            df = filter_brush(df, *self.brush)
        return df


def _slot(key: str) -> str | None:
    """The named slot a key stands for, if any."""
    lowered = key.lower()
    if lowered in ("region", "selectedregion"):
        return "region"
    if lowered in ("category", "selectedcategory"):
        return "category"
    if lowered in ("date", "daterange"):
        return "dates"
    if lowered in ("brush", "brushedrange"):
        return "brush"
    return None
