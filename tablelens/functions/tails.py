"""Upper-tail probabilities from the statistics library that ships with Spark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def f_tail(spark: SparkSession, f: float, between: float, within: float) -> float:
    """P(F > f) for the given degrees of freedom."""
    if f != f:
        return 1.0
    if f == float("inf"):
        return 0.0
    dist = spark._jvm.org.apache.commons.math3.distribution.FDistribution(float(between), float(within))
    return 1.0 - dist.cumulativeProbability(float(f))


def chi2_tail(spark: SparkSession, x: float, dof: float) -> float:
    """P(chi-square > x)."""
    dist = spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(dof))
    return 1.0 - dist.cumulativeProbability(float(x))
