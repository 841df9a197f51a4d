"""How far the scores of a new batch are from the mixture the training scores predict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharewise.functions.scores import chi2_cdf, present
from sharewise.operators.density import hist_bin
from sharewise.plans import attach


def mixture_histogram(
    batch: DataFrame, hist_pair: DataFrame, shares: DataFrame, keys: Sequence[str] = (), bins: int = 3, p: str = "p"
) -> DataFrame:
    """(keys, bin, h0, h1, m): expected and observed share per bin, and the batch size.

    ``hist_pair`` is the class pair of the histogram density of the training scores.
    """
    keys = list(keys)
    counts = present(batch, p).groupBy(*keys, hist_bin(p, bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    every = counts.select(*keys).distinct() if keys else counts.agg(F.count(F.lit(1)).alias("_a"))
    grid = every.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).cast("long").alias("c"))
    full = counts.unionByName(grid).groupBy(*keys, "bin").agg(F.sum("c").alias("c"))
    # From here on there are ``bins`` rows per key.
    on = [*[k for k in keys if k in hist_pair.columns], "bin"]
    mixed = attach(full.join(hist_pair, on), shares, keys, ["pi"])
    m = F.sum("c").over(Window.partitionBy(*keys))
    return mixed.select(
        *keys,
        "bin",
        (F.col("pi") * F.col("dt") + (F.lit(1.0) - F.col("pi")) * F.col("df")).alias("h0"),
        (F.col("c") / m).alias("h1"),
        m.alias("m"),
    )


def _per_bin(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    positive = F.least(
        F.min(F.when(F.col("h0") > 0, F.col("h0"))).over(whole),
        F.min(F.when(F.col("h1") > 0, F.col("h1"))).over(whole),
    )
    count0, count1 = F.col("h0") * F.col("m") + 0.0001, F.col("h1") * F.col("m") + 0.0001
    eps = F.col("_eps")
    return (
        hist.withColumn("_eps", positive / 1000.0)
        .withColumn("_gap", F.abs(F.sum("h0").over(upto) - F.sum("h1").over(upto)))
        .withColumn("_kl01", F.col("h1") * F.ln((F.col("h1") + eps) / (F.col("h0") + eps)))
        .withColumn("_kl10", F.col("h0") * F.ln((F.col("h0") + eps) / (F.col("h1") + eps)))
        .withColumn("_chi", (count1 - count0) * (count1 - count0) / count0)
    )


def ks_statistic(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Largest gap between the cumulative histograms."""
    return _per_bin(hist, keys).groupBy(*keys).agg(F.max("_gap").alias("ks"))


def kl_divergence(hist: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Divergence in both directions and their mean, with a small-mass guard."""
    return _per_bin(hist, keys).groupBy(*keys).agg(
        F.sum("_kl01").alias("dkl_observed_expected"),
        F.sum("_kl10").alias("dkl_expected_observed"),
        ((F.sum("_kl01") + F.sum("_kl10")) / 2).alias("dkl"),
    )


def chi2_fit(hist: DataFrame, keys: Sequence[str] = (), bins: int = 3) -> DataFrame:
    """Chi-square statistic and its distribution function with ``bins`` degrees of freedom."""
    stat = _per_bin(hist, keys).groupBy(*keys).agg(F.sum("_chi").alias("chi2"))
    return stat.withColumn("chi2_sig", chi2_cdf("chi2", bins))


def compare_distributions(hist: DataFrame, keys: Sequence[str] = (), bins: int = 3) -> DataFrame:
    """K-S, divergence, chi-square and its distribution function in one row (per key)."""
    row = _per_bin(hist, keys).groupBy(*keys).agg(
        F.max("_gap").alias("ks"),
        ((F.sum("_kl01") + F.sum("_kl10")) / 2).alias("dkl"),
        F.sum("_chi").alias("chi2"),
    )
    return row.withColumn("chi2_sig", chi2_cdf("chi2", bins))
