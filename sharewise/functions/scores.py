"""Expressions on classifier scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def two_class_proba(p: str | Column) -> Column:
    """``[1 - p, p]`` for a model with one output."""
    p = _col(p)
    return F.array(F.lit(1.0) - p, p)


def logit(p: str | Column) -> Column:
    """ln(p / (1 - p)); -inf at 0 and +inf at 1."""
    p = _col(p)
    return (
        F.when(p <= 0, F.lit(float("-inf")))
        .when(p >= 1, F.lit(float("inf")))
        .otherwise(F.ln(F.try_divide(p, F.lit(1.0) - p)))
    )


def sigmoid(z: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z)))


def chi2_cdf(x: str | Column, dof: int, terms: int = 3000) -> Column:
    """Chi-square distribution function by the series of the lower incomplete gamma function.

    P(a, h) = h^a e^-h / Gamma(a+1) * (1 + h/(a+1) + h^2/((a+1)(a+2)) + ...) with a = dof/2,
    h = x/2.  Beyond h = 700 the function is 1 in double precision for the few degrees of
    freedom a score histogram has.
    """
    a = dof / 2.0
    if a > 300:
        raise ValueError("at most 600 degrees of freedom")
    h = _col(x) / F.lit(2.0)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, k: F.struct(
            (s["term"] * h / (F.lit(a) + k)).alias("term"),
            (s["total"] + s["term"] * h / (F.lit(a) + k)).alias("total"),
        ),
        lambda s: s["total"],
    )
    front = F.exp(F.lit(a) * F.ln(h) - h - F.lit(math.lgamma(a + 1)))
    return F.when(h <= 0, F.lit(0.0)).when(h > 700, F.lit(1.0)).otherwise(F.least(front * series, F.lit(1.0)))


def present(df, *columns: str):
    """The one rule for missing values: rows with a null (or NaN) score or label take no part."""
    kept = df
    for c in columns:
        kept = kept.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return kept
