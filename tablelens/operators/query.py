"""Declarative table queries: dimensions, metrics, filters, sort and limit."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tablelens.functions.semantics import col, sort_key, zsum
from tablelens.operators.filters import Filter, apply_filters

log = logging.getLogger(__name__)

AGGREGATES: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "sum": ("sum", zsum),
    "avg": ("avg", F.avg),
    "mean": ("avg", F.avg),
    "count": ("count", F.count),
    "min": ("min", F.min),
    "max": ("max", F.max),
}


@dataclass(frozen=True)
class Metric:
    column: str
    agg: str


@dataclass(frozen=True)
class QuerySpec:
    dimensions: tuple[str, ...] = ()
    metrics: tuple[Metric, ...] = ()
    filters: tuple[Filter, ...] = ()
    sort_by: str | None = None
    sort_desc: bool = True
    limit: int | None = None  # None: all rows
    tie_break: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class SemanticModel:
    """Business names for metrics (column, aggregate) and dimensions (column)."""

    name: str
    metrics: dict[str, Metric]
    dimensions: dict[str, str]

    def resolve(self, spec: QuerySpec, metrics: list[str], dimensions: list[str]) -> QuerySpec:
        """Add the named metrics and dimensions to a query; unknown names are skipped."""
        found_m = {k.lower(): v for k, v in self.metrics.items()}
        found_d = {k.lower(): v for k, v in self.dimensions.items()}
        more_m, more_d = [], []
        for n in metrics:
            if n.lower() in found_m:
                more_m.append(found_m[n.lower()])
            else:
                log.warning("no metric %s in model %s", n, self.name)
        for n in dimensions:
            if n.lower() in found_d:
                more_d.append(found_d[n.lower()])
            else:
                log.warning("no dimension %s in model %s", n, self.name)
        return QuerySpec(
            dimensions=(*spec.dimensions, *more_d),
            metrics=(*spec.metrics, *more_m),
            filters=spec.filters,
            sort_by=spec.sort_by,
            sort_desc=spec.sort_desc,
            limit=spec.limit,
            tie_break=spec.tie_break,
        )


def run_query(df: DataFrame, spec: QuerySpec, strict: bool = False) -> DataFrame:
    """Run a query lazily; unknown columns and aggregates are skipped unless ``strict``."""
    if strict:
        unknown = [m for m in spec.metrics if m.column not in df.columns or m.agg not in AGGREGATES]
        missing = [d for d in spec.dimensions if d not in df.columns]
        if unknown or missing:
            raise ValueError(f"unknown metrics {unknown} or dimensions {missing}")
    df = apply_filters(df, list(spec.filters), strict)
    aggregates = []
    for m in spec.metrics:
        if m.column in df.columns and m.agg in AGGREGATES:
            suffix, fn = AGGREGATES[m.agg]
            aggregates.append(fn(col(m.column)).alias(f"{m.column}_{suffix}"))
    dims = [col(d) for d in dict.fromkeys(spec.dimensions) if d in df.columns]
    if dims and aggregates:
        df = df.groupBy(*dims).agg(*aggregates)
    elif dims:
        df = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("len"))
    elif aggregates:
        df = df.agg(*aggregates)
    keys = []
    if spec.sort_by and spec.sort_by in df.columns:
        keys.append(sort_key(spec.sort_by, spec.sort_desc))
    keys += [sort_key(c, False) for c in spec.tie_break if c in df.columns]
    if spec.limit is None:
        return df.orderBy(*keys) if keys else df
    # The group columns break ties, so that a limit always picks the same rows.
    grouped = [d for d in dict.fromkeys(spec.dimensions) if d in df.columns]
    keys += [sort_key(d, False) for d in grouped if d not in (spec.sort_by, *spec.tie_break)]
    # A sort directly under a limit becomes one top-k per task, not a full sort.
    return (df.orderBy(*keys) if keys else df).limit(spec.limit)


def auto_model(profile, name: str) -> SemanticModel:
    """A model from the column profile: groupable columns as dimensions, total and average per number."""
    metrics: dict[str, Metric] = {}
    dimensions: dict[str, str] = {}
    for column, kind in profile.categories.items():
        label = column.replace(" ", "_").lower()
        if kind in ("categorical", "datetime") or profile.roles[column] in ("geo", "temporal"):
            dimensions[label] = column
        elif kind == "numeric":
            metrics[f"total_{label}"] = Metric(column, "sum")
            metrics[f"average_{label}"] = Metric(column, "avg")
    return SemanticModel(name, metrics, dimensions)


def model_terms(spark, model: SemanticModel) -> DataFrame:
    """(kind, name, column, agg) of every term; bounded by the number of columns."""
    rows = [("dimension", n, c, None) for n, c in model.dimensions.items()]
    rows += [("metric", n, m.column, m.agg) for n, m in model.metrics.items()]
    return spark.createDataFrame(rows, "kind string, name string, `column` string, agg string")
