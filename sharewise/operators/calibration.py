"""Prevalence by maximum likelihood, calibrated thresholds and posteriors.

The likelihood sees a batch only through its counts per density cell, so estimating the
share of positives is one count over the rows (combined before its shuffle) and a bisection
over at most 1,000 cells that runs inside a Spark expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharewise.functions.scores import present, two_class_proba
from sharewise.operators.density import CELLS, density_lookup, sliding_bin
from sharewise.plans import attach, lookup, materialize, running_before

#: Bisection steps: the share is found to 2^-40.
STEPS = 40


def require_columns(df: DataFrame, y: str | None = "y", p: str = "p") -> DataFrame:
    """Reject, while planning, a frame that cannot be calibrated."""
    for name, kinds in ((p, (T.DoubleType, T.FloatType)), (y, (T.NumericType,))):
        if name is None:
            continue
        if name not in df.columns:
            raise ValueError(f"column {name!r} is missing")
        if not isinstance(df.schema[name].dataType, kinds):
            raise ValueError(f"column {name!r} has type {df.schema[name].dataType.simpleString()}")
    return df


def likelihood_cells(
    batch: DataFrame, pair: DataFrame, keys: Sequence[str] = (), p: str = "p", bin_: Column | None = None
) -> DataFrame:
    """Sufficient statistic: (keys, bin, c, dt, df), rows counted per density cell."""
    bin_ = sliding_bin(p) if bin_ is None else bin_
    counts = present(batch, p).groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return density_lookup(counts.withColumnRenamed("bin", "_b"), pair, F.col("_b"), keys).withColumnRenamed("_b", "bin")


def _slope(cells: Column, pi: Column) -> Column:
    """Derivative of the log-likelihood at ``pi``; cells with no mass in either class say nothing."""
    return F.aggregate(
        cells,
        F.lit(0.0),
        lambda acc, x: acc
        + F.coalesce(
            F.try_divide(x["c"] * (x["dt"] - x["df"]), x["dt"] * pi + x["df"] * (F.lit(1.0) - pi)),
            F.lit(0.0),
        ),
    )


def prevalence_ml(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, pi, n): the share in [0, 1] that maximises sum c * ln(dt * pi + df * (1 - pi)).

    The log-likelihood is concave, so its slope is bisected.  ``cells`` holds one row per
    density cell, at most 1,000 per key.
    """
    gathered = cells.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.collect_list(F.struct(F.col("c").cast("double").alias("c"), "dt", "df")).alias("_cells"),
    )
    halves = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda k: F.pow(F.lit(0.5), k))
    low = F.aggregate(
        halves,
        F.lit(0.0),
        lambda lo, h: lo + F.when(_slope(F.col("_cells"), lo + h) > 0, h).otherwise(F.lit(0.0)),
    )
    edge = F.lit(0.5**STEPS)
    pi = F.when(F.col("_lo") == 0.0, F.lit(0.0)).when(F.col("_lo") >= 1 - edge, F.lit(1.0)).otherwise(F.col("_lo"))
    return gathered.withColumn("_lo", low).select(*keys, pi.alias("pi"), "n")


def loglik_profile(cells: DataFrame, keys: Sequence[str] = (), samples: int = 1001) -> DataFrame:
    """(keys, pi, loglik) on an even grid of shares; a share that rules out a row gets -inf."""
    gathered = cells.groupBy(*keys).agg(
        F.collect_list(F.struct("c", "dt", "df")).alias("_cells")
    )
    grid = gathered.select(
        *keys, "_cells",
        F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_g"),
    ).withColumn("pi", F.col("_g") / F.lit(float(samples - 1)))
    mix = lambda x: x["dt"] * F.col("pi") + x["df"] * (F.lit(1.0) - F.col("pi"))
    loglik = F.aggregate(
        "_cells",
        F.lit(0.0),
        lambda acc, x: acc
        + F.when((x["dt"] == 0) & (x["df"] == 0), F.lit(0.0))
        .when(mix(x) <= 0, F.lit(float("-inf")))
        .otherwise(x["c"] * F.ln(mix(x))),
    )
    return grid.select(*keys, "pi", loglik.alias("loglik"))


def prevalence_grid(cells: DataFrame, keys: Sequence[str] = (), samples: int = 1001) -> DataFrame:
    """(keys, pi, loglik): the best share of the grid; the smallest one wins a tie."""
    best = loglik_profile(cells, keys, samples).groupBy(*keys).agg(
        F.max(F.struct(F.col("loglik"), (-F.col("pi")).alias("neg"))).alias("_m")
    )
    return best.select(*keys, (F.lit(0.0) - F.col("_m.neg")).alias("pi"), F.col("_m.loglik").alias("loglik"))


def prevalence_points(
    points: DataFrame, keys: Sequence[str] = (), tolerance: float = 1e-10, passes: int = 100
) -> DataFrame:
    """``prevalence_ml`` for densities without cells: any number of rows (keys, c, dt, df).

    Newton's method on the concave log-likelihood, kept inside a shrinking interval.  A pass
    is one aggregation of two sums over the rows of the keys that are still open; the intervals are a
    table too, one row per key, and the driver sees the number of open keys alone.  ``points``
    should be materialised.
    """
    keys = list(keys)
    c, dt, df = (F.col(x).cast("double") for x in ("c", "dt", "df"))
    gap = dt - df

    def slope(x: Column) -> Column:
        return F.coalesce(F.sum(F.try_divide(c * gap, dt * x + df * (F.lit(1.0) - x))), F.lit(0.0))

    def curve(x: Column) -> Column:
        ratio = F.try_divide(gap, dt * x + df * (F.lit(1.0) - x))
        return F.coalesce(F.sum(c * ratio * ratio), F.lit(0.0))

    half = F.lit(0.5)
    start = points.groupBy(*keys).agg(
        F.sum("c").cast("long").alias("n"),
        # A row that an end of the interval rules out pushes the share inwards.
        F.coalesce(F.bool_or((df <= 0) & (dt > 0)), F.lit(False)).alias("_not0"),
        F.coalesce(F.bool_or((dt <= 0) & (df > 0)), F.lit(False)).alias("_not1"),
        slope(F.lit(0.0)).alias("_g0"),
        slope(F.lit(1.0)).alias("_g1"),
        slope(half).alias("_g"),
        curve(half).alias("_h"),
    )
    end = F.when(~F.col("_not0") & (F.col("_g0") <= 0), F.lit(0.0)).when(~F.col("_not1") & (F.col("_g1") >= 0), F.lit(1.0))
    state = start.select(
        *keys, "n", "_g", "_h", F.lit(0.0).alias("_lo"), F.lit(1.0).alias("_hi"), half.alias("_x"), end.alias("pi")
    )
    done = []
    for step in range(passes):
        state = materialize(_newton_step(state, keys, tolerance, bisect=step % 4 == 3 or step == passes - 1))
        done.append(state.where(F.col("pi").isNotNull()).select(*keys, "pi", "n"))
        state = state.where(F.col("pi").isNull())
        if step == passes - 1:
            done.append(state.select(*keys, F.col("_x").alias("pi"), "n"))
        if state.isEmpty():
            break
        if keys:
            # A struct of the keys also matches where a key is null.
            here = state.select(F.struct(*keys).alias("_key"), "_x", "n", "_lo", "_hi")
            met = lookup(points.withColumn("_key", F.struct(*keys)), here, ["_key"])
        else:
            met = attach(points, state, (), ["_x", "n", "_lo", "_hi"])
        x = F.col("_x")
        state = met.groupBy(*keys, "n", "_lo", "_hi", "_x").agg(slope(x).alias("_g"), curve(x).alias("_h")).withColumn(
            "pi", F.lit(None).cast("double")
        )
    return reduce(DataFrame.unionByName, done)


def _newton_step(state: DataFrame, keys: Sequence[str], tolerance: float, bisect: bool) -> DataFrame:
    """The next ``_x`` of every open key inside its halved or shortened interval; ``pi`` where that is near enough."""
    x, g, h = F.col("_x"), F.col("_g"), F.col("_h")
    open_ = F.col("pi").isNull()
    lo, hi = F.when(g > 0, x).otherwise(F.col("_lo")), F.when(g > 0, F.col("_hi")).otherwise(x)
    moved = state.select(*keys, "n", "_g", x.alias("_from"), lo.alias("_lo"), hi.alias("_hi"), "pi", (x + F.try_divide(g, h)).alias("_to"))
    middle = (F.col("_lo") + F.col("_hi")) / 2
    to = F.col("_to")
    inside = (F.col("_lo") < to) & (to < F.col("_hi"))
    nxt = middle if bisect else F.when(inside, to).otherwise(middle)
    near = (F.abs(F.col("_x") - F.col("_from")) < tolerance) | (F.col("_g") == 0)
    best = F.when(F.col("_g") == 0, F.col("_from")).otherwise(F.col("_x"))
    return moved.withColumn("_x", nxt).select(
        *keys, "n", "_lo", "_hi", "_x", F.when(open_, F.when(near, best)).otherwise(F.col("pi")).alias("pi")
    )


def calibrated_threshold(
    batch: DataFrame, shares: DataFrame, keys: Sequence[str] = (), p: str = "p"
) -> DataFrame:
    """(keys, threshold): the score at index ``int((1 - pi) * n)`` of the ascending scores.

    Counts on 1,000 cells find the cell that holds the index; only its rows are ordered.
    """
    keys = list(keys)
    cell = F.greatest(F.lit(0), F.least(F.floor(F.col(p) * CELLS), F.lit(CELLS - 1))).cast("int")
    placed = present(batch, p).select(*keys, F.col(p).alias("_p"), cell.alias("_cell"))
    counts = attach(placed.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_c")), shares, keys, ["pi", "n"])
    goal = F.least(F.floor((F.lit(1.0) - F.col("pi")) * F.col("n")), F.col("n") - 1)
    hit = materialize(
        counts.groupBy(*keys)
        .agg(F.first(goal).alias("_goal"), F.array_sort(F.collect_list(F.struct("_cell", "_c"))).alias("_cells"))
        .select(
            *keys,
            "_goal",
            F.aggregate(
                "_cells",
                F.struct(F.lit(0).cast("long").alias("run"), F.lit(-1).alias("cell"), F.lit(0).cast("long").alias("before")),
                lambda s, x: F.struct(
                    (s["run"] + x["_c"]).alias("run"),
                    F.when((s["run"] <= F.col("_goal")) & (F.col("_goal") < s["run"] + x["_c"]), x["_cell"])
                    .otherwise(s["cell"]).alias("cell"),
                    F.when((s["run"] <= F.col("_goal")) & (F.col("_goal") < s["run"] + x["_c"]), s["run"])
                    .otherwise(s["before"]).alias("before"),
                ),
            ).alias("_hit"),
        )
        .select(*keys, "_goal", F.col("_hit.cell").alias("_cell"), F.col("_hit.before").alias("_before"))
    )
    inside = lookup(placed, hit, [*keys, "_cell"])
    scores = inside.groupBy(*keys, "_p", "_goal", "_before").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_before(scores, keys, ["_p"], {"_below": "_c"})
    return ranked.where(
        F.col("_before") + F.col("_below") + F.col("_c") > F.col("_goal")
    ).groupBy(*keys).agg(F.min("_p").alias("threshold"))


def calibrate(
    batch: DataFrame, pair: DataFrame, keys: Sequence[str] = (), p: str = "p", bin_: Column | None = None
) -> DataFrame:
    """(keys, pi, n, threshold), materialised: the calibration state of each presented batch."""
    shares = materialize(prevalence_ml(likelihood_cells(batch, pair, keys, p, bin_), keys))
    thresholds = calibrated_threshold(batch, shares, keys, p)
    if keys:
        return materialize(shares.join(thresholds, list(keys)))
    return materialize(attach(shares, thresholds, (), ["threshold"]))


def predict_raw(rows: DataFrame, p: str = "p", out: str = "raw_label") -> DataFrame:
    """The classifier's own label: p > 0.5."""
    return rows.withColumn(out, F.col(p) > 0.5)


def predict_calibrated(
    rows: DataFrame, state: DataFrame, keys: Sequence[str] = (), p: str = "p", out: str = "cal_label"
) -> DataFrame:
    """``p >= threshold``, with the threshold of this batch or a stored one."""
    return attach(rows, state, keys, ["threshold"]).withColumn(
        out, F.col(p) >= F.col("threshold")
    ).drop("threshold")


def posterior_calibrated(
    rows: DataFrame,
    pair: DataFrame,
    shares: DataFrame,
    keys: Sequence[str] = (),
    p: str = "p",
    bin_: Column | None = None,
    out: str = "cal_proba",
) -> DataFrame:
    """pi * dt / (pi * dt + (1 - pi) * df), through the density cell of the score."""
    bin_ = sliding_bin(p) if bin_ is None else bin_
    here = attach(density_lookup(rows, pair, bin_, keys), shares, keys, ["pi"])
    return with_posterior(here, out)


def with_posterior(rows: DataFrame, out: str = "cal_proba") -> DataFrame:
    """Turn the columns ``pi, dt, df`` into the posterior probability."""
    mass = F.col("pi") * F.col("dt")
    value = F.try_divide(mass, mass + (F.lit(1.0) - F.col("pi")) * F.col("df"))
    return rows.withColumn(out, value).drop("dt", "df", "pi")


def calibrate_scores(rows: DataFrame, pair: DataFrame, keys: Sequence[str] = (), p: str = "p") -> DataFrame:
    """Posterior of a bare score column: the share comes from the same rows, no classifier needed."""
    shares = materialize(prevalence_ml(likelihood_cells(rows, pair, keys, p), keys))
    return posterior_calibrated(rows, pair, shares, keys, p)


def proba_raw(rows: DataFrame, p: str = "p", out: str = "proba") -> DataFrame:
    """The classifier's own ``[1 - p, p]``."""
    return rows.withColumn(out, two_class_proba(p))
