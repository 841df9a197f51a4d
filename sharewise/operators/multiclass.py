"""Correlation of multiclass scores with the classes, from per-class moments.

The rows are reduced once to (true class, score column): count, mean and sum of squared
deviations.  Class pairs are formed on that K x K table, never on rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_moments(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``long`` has (keys, true_cls, cls, score): one row per row and score column."""
    return long.groupBy(*keys, "true_cls", "cls").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("score").alias("mean"),
        (F.var_pop("score") * F.count(F.lit(1))).alias("ss"),
    )


def _rho(np: Column, mp: Column, sp: Column, nn: Column, mn: Column, sn: Column) -> Column:
    weight = F.try_divide(np * nn, np + nn)
    total = sp + sn + weight * (mp - mn) * (mp - mn)
    return F.coalesce(F.try_divide(F.sqrt(weight) * (mp - mn), F.sqrt(total)), F.lit(0.0))


def rho_ovo_pairs(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, j, rho) for every ordered pair of classes: score i on the rows of i and j."""
    keys = list(keys)
    m = class_moments(long, keys)
    own = m.where(F.col("true_cls") == F.col("cls")).select(
        *keys, "cls", F.col("n").alias("np"), F.col("mean").alias("mp"), F.col("ss").alias("sp")
    )
    other = m.where(F.col("true_cls") != F.col("cls"))
    rho = _rho(F.col("np"), F.col("mp"), F.col("sp"), F.col("n"), F.col("mean"), F.col("ss"))
    return own.join(other, [*keys, "cls"]).select(
        *keys, F.col("cls").alias("i"), F.col("true_cls").alias("j"), rho.alias("rho")
    )


def rho_ovr_classes(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, i, rho) for every class: score i on class i against all the rest."""
    keys = list(keys)
    m = long.groupBy(*keys, "cls").agg(
        *[
            a
            for side, cond in (("p", F.col("true_cls") == F.col("cls")), ("n", F.col("true_cls") != F.col("cls")))
            for a in (
                F.count_if(cond).cast("double").alias(f"n{side}"),
                F.avg(F.when(cond, F.col("score"))).alias(f"m{side}"),
                (F.var_pop(F.when(cond, F.col("score"))) * F.count_if(cond)).alias(f"s{side}"),
            )
        ]
    )
    rho = _rho(F.col("np"), F.col("mp"), F.col("sp"), F.col("nn"), F.col("mn"), F.col("sn"))
    return m.select(*keys, F.col("cls").alias("i"), rho.alias("rho"))


def combine_rho(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """tanh of the mean of atanh(rho)."""
    return pairs.groupBy(*keys).agg(F.tanh(F.avg(F.atanh("rho"))).alias("rho"))


def rho_ovo(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return combine_rho(rho_ovo_pairs(long, keys), keys)


def rho_ovr(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return combine_rho(rho_ovr_classes(long, keys), keys)
