"""Evaluation of binary predictions, hard or soft, for any number of groups in one job.

Everything but the area under the curve is one aggregation.  The area needs the scores in
order: rows are first collapsed to counts per distinct score, then ordered in range pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharewise.functions.scores import logit as logit_of, present
from sharewise.plans import attach, materialize, running_before
from sharewise.plans.ordering import range_pieces

_DOUBLE = "double"


def _positive(y: str) -> Column:
    return F.col(y).cast("int") == 1


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def _soft(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))


def _threshold(threshold: float | Column) -> Column:
    return threshold if isinstance(threshold, Column) else F.lit(float(threshold))


def _hard_aggs(y: str, pred: str, threshold: float | Column) -> list[Column]:
    hit = F.col(pred).cast(_DOUBLE) >= _threshold(threshold)
    pos = _positive(y)
    return [
        _count(~pos & ~hit).alias("tn"),
        _count(~pos & hit).alias("fp"),
        _count(pos & ~hit).alias("fn"),
        _count(pos & hit).alias("tp"),
    ]


def confusion_hard(
    df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "p", threshold: float | Column = 0.5
) -> DataFrame:
    """(keys, tn, fp, fn, tp), a row counted positive when ``pred >= threshold``."""
    return present(df, y, pred).groupBy(*keys).agg(*_hard_aggs(y, pred, threshold))


def confusion_soft(
    df: DataFrame,
    keys: Sequence[str] = (),
    y: str = "y",
    pred: str = "p",
    normalize: bool = False,
    decimals: int | None = None,
) -> DataFrame:
    """Expected confusion matrix: each row adds its probability to two cells."""
    pos, p = _positive(y), F.col(pred).cast(_DOUBLE)
    cells = {
        "tn": _soft(~pos, 1 - p),
        "fp": _soft(~pos, p),
        "fn": _soft(pos, 1 - p),
        "tp": _soft(pos, p),
    }
    out = []
    for name, value in cells.items():
        value = value / F.count(F.lit(1)) if normalize else value
        out.append((F.round(value, decimals) if decimals is not None else value).alias(name))
    return present(df, y, pred).groupBy(*keys).agg(*out)


def positive_estimate(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "p") -> DataFrame:
    """Actual positives ``tp`` and the predicted count ``pos_est``."""
    return present(df, y, pred).groupBy(*keys).agg(
        F.sum(F.col(y).cast("long")).alias("tp"), F.sum(F.col(pred).cast(_DOUBLE)).alias("pos_est")
    )


def count_bias(
    df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "p", decimals: int | None = None
) -> DataFrame:
    """(FP - FN) / n on the expected confusion matrix."""
    pos, p = _positive(y), F.col(pred).cast(_DOUBLE)
    fp, fn = _soft(~pos, p), _soft(pos, 1 - p)
    if decimals is not None:
        fp, fn = F.round(fp, decimals), F.round(fn, decimals)
    return present(df, y, pred).groupBy(*keys).agg(((fp - fn) / F.count(F.lit(1))).alias("bias"))


def _rate(hits: str, misses: str) -> Column:
    return F.try_divide(F.col(hits), (F.col(hits) + F.col(misses)))


def accuracy_of(tn="tn", fp="fp", fn="fn", tp="tp") -> Column:
    return F.try_divide(F.col(tp) + F.col(tn), F.col(tp) + F.col(tn) + F.col(fp) + F.col(fn))


def balanced_accuracy_of() -> Column:
    """Mean recall of the classes that occur."""
    tpr, tnr = _rate("tp", "fn"), _rate("tn", "fp")
    return F.coalesce((tpr + tnr) / 2, tpr, tnr)


def mcc_of() -> Column:
    tn, fp, fn, tp = (F.col(c).cast(_DOUBLE) for c in ("tn", "fp", "fn", "tp"))
    root = F.sqrt((tp + fp)) * F.sqrt((tp + fn)) * F.sqrt((tn + fp)) * F.sqrt((tn + fn))
    return F.coalesce(F.try_divide(tp * tn - fp * fn, root), F.lit(0.0))


def accuracy(df, keys=(), y="y", pred="p", threshold=0.5) -> DataFrame:
    return confusion_hard(df, keys, y, pred, threshold).select(*keys, accuracy_of().alias("accuracy"))


def precision_recall_f1(df, keys=(), y="y", pred="p", threshold=0.5) -> DataFrame:
    """Precision, recall and F1; 0 where undefined."""
    zero = F.lit(0.0)
    return confusion_hard(df, keys, y, pred, threshold).select(
        *keys,
        F.coalesce(_rate("tp", "fp"), zero).alias("precision"),
        F.coalesce(_rate("tp", "fn"), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero).alias("f1"),
    )


def balanced_accuracy(df, keys=(), y="y", pred="p", threshold=0.5) -> DataFrame:
    return confusion_hard(df, keys, y, pred, threshold).select(
        *keys, balanced_accuracy_of().alias("balanced_accuracy")
    )


def mcc(df, keys=(), y="y", pred="p", threshold=0.5) -> DataFrame:
    """Matthews correlation; 0 when a margin of the confusion matrix is empty."""
    return confusion_hard(df, keys, y, pred, threshold).select(*keys, mcc_of().alias("mcc"))


def score_counts(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "p") -> DataFrame:
    """(keys, score, pos, neg): rows per distinct score, combined before the shuffle."""
    return present(df, y, pred).groupBy(*keys, F.col(pred).cast(_DOUBLE).alias("score")).agg(
        _count(_positive(y)).alias("pos"), _count(~_positive(y)).alias("neg")
    )


def auroc(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "p") -> DataFrame:
    """Exact area under the ROC curve, ties counting half; null when only one class occurs.

    Inside a range piece a window counts the negatives below each score; between pieces only
    their totals matter.
    """
    keys = list(keys)
    pieces = range_pieces(score_counts(df, keys, y, pred), keys, ["score"])
    below = Window.partitionBy(*keys, "_piece").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inner = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    per_piece = (
        pieces.withColumn("_a", inner)
        .groupBy(*keys, "_piece")
        .agg(F.sum("_a").alias("_a"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shifted = per_piece.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast(_DOUBLE))
    return shifted.groupBy(*keys).agg(
        F.try_divide(
            F.sum(F.col("_a") + F.col("_p") * F.col("_before")),
            F.sum("_p").cast(_DOUBLE) * F.sum("_n").cast(_DOUBLE),
        ).alias("auroc")
    )


def roc_curve(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "p") -> DataFrame:
    """(keys, threshold, fpr, tpr) for every distinct score, and the origin at +infinity."""
    keys = list(keys)
    ranked = running_before(score_counts(df, keys, y, pred), keys, ["score"], {"_pb": "pos", "_nb": "neg"})
    totals = ranked.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    curve = attach(ranked, materialize(totals), keys, ["_p", "_n"]).select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("_n") - F.col("_nb"), F.col("_n")).alias("fpr"),
        F.try_divide(F.col("_p") - F.col("_pb"), F.col("_p")).alias("tpr"),
    )
    origin = totals.select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return curve.unionByName(origin)


def _rho_aggs(y: str, value: Column) -> list[Column]:
    pos = _positive(y)
    return [
        _count(pos).cast(_DOUBLE).alias("_np"),
        _count(~pos).cast(_DOUBLE).alias("_nn"),
        F.avg(F.when(pos, value)).alias("_mp"),
        F.avg(F.when(~pos, value)).alias("_mn"),
        (F.var_pop(value) * F.count(value)).alias("_ss"),
    ]


def rho_of() -> Column:
    """Point-biserial correlation from group sizes, means and the total sum of squares."""
    scale = F.sqrt(F.try_divide(F.col("_np") * F.col("_nn"), F.col("_np") + F.col("_nn")))
    value = F.try_divide(scale * (F.col("_mp") - F.col("_mn")), F.sqrt("_ss"))
    return F.coalesce(value, F.lit(0.0))


def point_biserial(
    df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "p", logit: bool = False
) -> DataFrame:
    """(keys, rho): correlation of a score with the label; 0 for a constant score.

    With ``logit`` the scores are taken on the log-odds scale, unless they are hard labels.
    """
    value = F.col(pred).cast(_DOUBLE)
    df = present(df, y, pred)
    if not logit:
        return df.groupBy(*keys).agg(*_rho_aggs(y, value)).select(*keys, rho_of().alias("rho"))
    # Whether the scores are hard labels is one more count; both answers come from one pass.
    soft = F.when((value > 0) & (value < 1), logit_of(value))
    both = df.groupBy(*keys).agg(
        *_rho_aggs(y, value),
        *[a.alias(f"_l{i}") for i, a in enumerate(_rho_aggs(y, soft))],
        _count((value > 0) & (value < 1)).alias("_soft"),
        _count((value <= 0) | (value >= 1)).alias("_edge"),
    )
    hard = both.withColumn("_hard", rho_of())
    renamed = hard.drop("_np", "_nn", "_mp", "_mn", "_ss")
    for i, name in enumerate(("_np", "_nn", "_mp", "_mn", "_ss")):
        renamed = renamed.withColumnRenamed(f"_l{i}", name)
    return renamed.select(
        *keys,
        F.when(F.col("_soft") == 0, F.col("_hard"))
        .when(F.col("_edge") == 0, rho_of())
        .otherwise(F.lit(float("nan")))
        .alias("rho"),
    )


def threshold_sweep(
    df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "p", steps: int = 100
) -> DataFrame:
    """(keys, idx, threshold, accuracy, mse) for ``steps`` even thresholds on [0, 1].

    A row is positive when ``pred > threshold``; mse compares the hard with the expected
    confusion matrix.  Rows are counted by the number of thresholds below their score, at
    most ``steps + 1`` counts per key, so the sweep itself never sees the rows.
    """
    keys = list(keys)
    p, pos = F.col(pred).cast(_DOUBLE), _positive(y)
    step = 1.0 / (steps - 1)
    guess = F.greatest(F.lit(0), F.least(F.lit(steps), F.ceil(p * (steps - 1)))).cast("int")
    passed = (
        F.when((guess > 0) & ((guess - 1) * F.lit(step) >= p), guess - 1)
        .when((guess < steps) & (guess * F.lit(step) < p), guess + 1)
        .otherwise(guess)
    )
    # The last threshold is exactly 1, whatever (steps - 1) * step rounds to.
    passed = F.when(p > 1, F.lit(steps)).otherwise(F.least(passed, F.lit(steps - 1)))
    counted = present(df, y, pred).groupBy(*keys, passed.alias("_b")).agg(
        _count(pos).alias("_pos"),
        _count(~pos).alias("_neg"),
        _soft(pos, p).alias("_stp"),
        _soft(pos, 1 - p).alias("_sfn"),
        _soft(~pos, p).alias("_sfp"),
        _soft(~pos, 1 - p).alias("_stn"),
    )
    sums = [F.sum(c).alias(c) for c in ("_pos", "_neg", "_stp", "_sfn", "_sfp", "_stn")]
    whole = counted.groupBy(*keys).agg(
        *sums, F.collect_list(F.struct("_b", F.col("_pos").alias("p"), F.col("_neg").alias("n"))).alias("_cells")
    )
    above = lambda field: F.aggregate(
        "_cells",
        F.lit(0).cast("long"),
        lambda acc, x: acc + F.when(x["_b"] > F.col("idx"), x[field]).otherwise(F.lit(0).cast("long")),
    )
    at = whole.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("idx"))
    at = at.withColumn("_tp", above("p")).withColumn("_fp", above("n"))
    fn, tn = F.col("_pos") - F.col("_tp"), F.col("_neg") - F.col("_fp")
    sq = lambda a, b: (a - b) * (a - b)
    return at.select(
        *keys,
        "idx",
        F.when(F.col("idx") == steps - 1, F.lit(1.0)).otherwise(F.col("idx") * F.lit(step)).alias("threshold"),
        ((F.col("_tp") + tn) / (F.col("_pos") + F.col("_neg"))).alias("accuracy"),
        (
            (
                sq(tn, F.col("_stn")) + sq(F.col("_fp"), F.col("_sfp"))
                + sq(fn, F.col("_sfn")) + sq(F.col("_tp"), F.col("_stp"))
            )
            / 4
        ).alias("mse"),
    )


def optimal_threshold(
    df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "p", steps: int = 100
) -> DataFrame:
    """(keys, idx, opt, threshold, accuracy) where the sweep's mse is least; first one wins a tie.

    ``opt`` is ``idx / steps``, the conventional answer; ``threshold`` is the swept value itself.
    """
    sweep = threshold_sweep(df, keys, y, pred, steps)
    best = sweep.groupBy(*keys).agg(F.min(F.struct("mse", "idx", "threshold", "accuracy")).alias("_m"))
    return best.select(
        *keys,
        F.col("_m.idx").alias("idx"),
        (F.col("_m.idx") / float(steps)).alias("opt"),
        F.col("_m.threshold").alias("threshold"),
        F.col("_m.accuracy").alias("accuracy"),
    )


def score_histogram(df: DataFrame, keys: Sequence[str] = (), pred: str = "p", bins: int = 50) -> DataFrame:
    """(keys, bin, low, high, n): equal bins between the least and the largest score."""
    keys = list(keys)
    p = F.col(pred).cast(_DOUBLE)
    df = present(df, pred)
    # One row per key: the range and the counts both come from collapsed data.
    ends = materialize(df.groupBy(*keys).agg(F.min(p).alias("_lo"), F.max(p).alias("_hi")))
    # A constant score sits in the middle of a unit-wide range.
    ends = ends.select(
        *keys,
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    placed = attach(df.select(*keys, p.alias("_p")), ends, keys, ["_lo", "_hi"])
    span = F.col("_hi") - F.col("_lo")
    bin_ = F.least(F.floor((F.col("_p") - F.col("_lo")) / span * bins), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.lit(0).cast("long").alias("n"))
    full = counts.unionByName(grid).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    return attach(full, ends, keys, ["_lo", "_hi"]).select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * span / bins).alias("low"),
        (F.col("_lo") + (F.col("bin") + 1) * span / bins).alias("high"),
        "n",
    )


def metric_bundle(
    df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "p", threshold: float | Column = 0.5
) -> DataFrame:
    """(keys, tp, pos_est, bias, spcc, acc, ba, mcc, auroc).

    ``tp`` is the number of actual positives and ``pos_est`` the predicted count; spcc and
    auroc use the raw predictions, the rest the labels at ``threshold``.
    """
    keys = list(keys)
    value, pos = F.col(pred).cast(_DOUBLE), _positive(y)
    df = present(df, y, pred)
    one = df.groupBy(*keys).agg(
        *_hard_aggs(y, pred, threshold),
        *_rho_aggs(y, value),
        F.sum(value).alias("pos_est"),
        ((_soft(~pos, value) - _soft(pos, 1 - value)) / F.count(F.lit(1))).alias("bias"),
    )
    area = auroc(df, keys, y, pred)
    joined = one.join(area, keys, "left") if keys else attach(one, area, (), ["auroc"])
    return joined.select(
        *keys,
        F.col("_np").alias("actual"),
        "pos_est",
        "bias",
        rho_of().alias("spcc"),
        accuracy_of().alias("acc"),
        balanced_accuracy_of().alias("ba"),
        mcc_of().alias("mcc"),
        "auroc",
    ).withColumnRenamed("actual", "tp")


@dataclass(frozen=True)
class Scorer:
    """A score made of sums, so that any number of scorers over any groups is one aggregation.

    ``parts`` gives the sums from (is positive, prediction, is predicted positive); parts of one name are one
    and the same sum and are shared between scorers.  ``value`` is the score, made of the finished sums.
    """

    parts: Callable[[Column, Column, Column], Mapping[str, Column]]
    value: Callable[[], Column]


def _counts(pos: Column, _pred: Column, hit: Column) -> Mapping[str, Column]:
    return {"tn": _count(~pos & ~hit), "fp": _count(~pos & hit), "fn": _count(pos & ~hit), "tp": _count(pos & hit)}


def _squares(pos: Column, pred: Column, _hit: Column) -> Mapping[str, Column]:
    off = pred - pos.cast(_DOUBLE)
    return {"_rows": _count(F.lit(True)), "_squares": F.sum(off * off)}


def _surprise(pos: Column, pred: Column, _hit: Column) -> Mapping[str, Column]:
    told = F.least(F.greatest(F.when(pos, pred).otherwise(1 - pred), F.lit(LEAST_CHANCE)), F.lit(1.0))
    return {"_rows": _count(F.lit(True)), "_surprise": F.sum(-F.ln(told))}


def _or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


#: Chances below this count as this in the log loss.
LEAST_CHANCE = 1e-15

#: Scores by name; the larger the better, so losses are negative.
SCORERS: dict[str, Scorer] = {
    "accuracy": Scorer(_counts, lambda: accuracy_of()),
    "balanced_accuracy": Scorer(_counts, lambda: balanced_accuracy_of()),
    "mcc": Scorer(_counts, lambda: mcc_of()),
    "precision": Scorer(_counts, lambda: F.coalesce(_rate("tp", "fp"), F.lit(0.0))),
    "recall": Scorer(_counts, lambda: F.coalesce(_rate("tp", "fn"), F.lit(0.0))),
    "f1": Scorer(_counts, lambda: _or_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))),
    "neg_brier": Scorer(_squares, lambda: -F.try_divide(F.col("_squares"), F.col("_rows"))),
    "neg_log_loss": Scorer(_surprise, lambda: -F.try_divide(F.col("_surprise"), F.col("_rows"))),
}


def score_by(
    df: DataFrame,
    scorers: Sequence[str] | Mapping[str, Scorer],
    keys: Sequence[str] = (),
    y: str = "y",
    pred: str = "p",
    threshold: float | Column = 0.5,
) -> DataFrame:
    """(keys, one column per scorer), all from one aggregation that is combined before its shuffle.

    ``scorers`` names some of ``SCORERS`` or brings own ones by name.  A row is predicted positive when
    ``pred >= threshold``; rows without label or prediction take no part.
    """
    if not isinstance(scorers, Mapping):
        unknown = [name for name in scorers if name not in SCORERS]
        if unknown:
            raise ValueError(f"unknown scorers {unknown}")
        scorers = {name: SCORERS[name] for name in scorers}
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    value = F.col(pred).cast(_DOUBLE)
    parts: dict[str, Column] = {}
    for scorer in scorers.values():
        parts |= scorer.parts(_positive(y), value, value >= cut)
    sums = present(df, y, pred).groupBy(*keys).agg(*[part.alias(name) for name, part in parts.items()])
    return sums.select(*keys, *[scorer.value().alias(name) for name, scorer in scorers.items()])


#: The four prediction variants: (calibrated?, probability?, column).
VARIANTS = (
    (False, False, "raw_label"),
    (False, True, "raw_proba"),
    (True, False, "cal_label"),
    (True, True, "cal_proba"),
)


def variant_rows(df: DataFrame, keep: Sequence[str], threshold: str | None = None) -> DataFrame:
    """Four columns to four rows: (keep, calibrated, proba, pred, threshold).

    ``threshold`` names a column to use for calibrated probabilities; all else is cut at 0.5.
    """
    items = []
    for cal, proba, name in VARIANTS:
        cut = F.col(threshold) if threshold and cal and proba else F.lit(0.5)
        items.append(
            F.struct(
                F.lit(cal).alias("calibrated"),
                F.lit(proba).alias("proba"),
                F.col(name).cast(_DOUBLE).alias("pred"),
                cut.cast(_DOUBLE).alias("threshold"),
            )
        )
    return df.select(*keep, F.inline(F.array(*items)))


def four_variant_report(
    df: DataFrame, keys: Sequence[str] = (), y: str = "y", threshold: str | None = None
) -> DataFrame:
    """The metric row of each variant {raw, calibrated} x {label, probability}."""
    long = variant_rows(df, [*keys, y], threshold)
    return metric_bundle(long, [*keys, "calibrated", "proba"], y, "pred", F.col("threshold"))
