"""Registered queries: evaluation of scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharewise.operators import calibration as cal
from sharewise.operators import metrics as mt
from sharewise.operators import multiclass as mc
from sharewise.plans import attach, store
from sharewise.suite.calibration import fitted_pair
from sharewise.suite.common import (
    FOUR_SQL, R, SCORED_SQL, query, r6, scored, table, test_rows,
)

TEST = f"{SCORED_SQL}, t AS (SELECT * FROM scored)"


def confusion_sql(pred: str, cut: str = "0.5", y: str = "y") -> str:
    return (
        f"count(*) FILTER ({y} = 0 AND {pred} < {cut}) AS tn, count(*) FILTER ({y} = 0 AND {pred} >= {cut}) AS fp, "
        f"count(*) FILTER ({y} = 1 AND {pred} < {cut}) AS fn, count(*) FILTER ({y} = 1 AND {pred} >= {cut}) AS tp"
    )


BA = "(tp / CAST(tp + fn AS DOUBLE) + tn / CAST(tn + fp AS DOUBLE)) / 2"
MCC = (
    "coalesce((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE)) * "
    "sqrt(CAST(tp + fn AS DOUBLE)) * sqrt(CAST(tn + fp AS DOUBLE)) * sqrt(CAST(tn + fn AS DOUBLE)), 0), 0)"
)
ACC = "(tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE)"


def auroc_sql(source: str, keys: str, pred: str, y: str = "y") -> str:
    """Rank-sum form: mean rank of the positives, ties by their average rank."""
    by = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    part = f"PARTITION BY {lead}{pred}"
    return f"""SELECT {lead}(sum(CASE WHEN {y} = 1 THEN r END) - count(*) FILTER ({y} = 1) * (count(*) FILTER ({y} = 1) + 1) / 2.0)
       / (CAST(count(*) FILTER ({y} = 1) AS DOUBLE) * count(*) FILTER ({y} = 0)) AS auroc
  FROM (SELECT *, rank() OVER ({by} ORDER BY {pred}) + (count(*) OVER ({part}) - 1) / 2.0 AS r FROM {source}) ranked {group}"""


@query("confusion_hard", f"WITH {TEST} SELECT {confusion_sql('p')} FROM t")
def confusion_hard(spark, sf_dir):
    return mt.confusion_hard(scored(spark, sf_dir))


_SOFT = {
    "tn": "sum(CASE WHEN y = 0 THEN 1 - p ELSE 0 END)",
    "fp": "sum(CASE WHEN y = 0 THEN p ELSE 0 END)",
    "fn": "sum(CASE WHEN y = 1 THEN 1 - p ELSE 0 END)",
    "tp": "sum(CASE WHEN y = 1 THEN p ELSE 0 END)",
}


@query("confusion_soft", f"WITH {TEST} SELECT " + ", ".join(f"round({e}, 4) AS {c}" for c, e in _SOFT.items()) + " FROM t")
def confusion_soft(spark, sf_dir):
    return mt.confusion_soft(scored(spark, sf_dir), decimals=4)


@query(
    "confusion_soft_normalized",
    f"WITH {TEST} SELECT l_linestatus, " + ", ".join(f"{R(e + ' / count(*)')} AS {c}" for c, e in _SOFT.items()) + " FROM t GROUP BY 1",
)
def confusion_soft_normalized(spark, sf_dir):
    return r6(mt.confusion_soft(scored(spark, sf_dir), ["l_linestatus"], normalize=True))


@query("positive_estimate", f"WITH {TEST} SELECT CAST(sum(y) AS BIGINT) AS tp, round(sum(p), 4) AS pos_est FROM t")
def positive_estimate(spark, sf_dir):
    out = mt.positive_estimate(scored(spark, sf_dir))
    return out.withColumn("pos_est", F.round("pos_est", 4))


@query("count_bias", f"WITH {TEST} SELECT {R('(sum(p) - sum(y)) / count(*)')} AS bias FROM t")
def count_bias(spark, sf_dir):
    return r6(mt.count_bias(scored(spark, sf_dir)))


def _from_confusion(expr: str) -> str:
    return f"WITH {TEST}, c AS (SELECT {confusion_sql('p')} FROM t) SELECT {expr} FROM c"


@query("accuracy", f"WITH {TEST} SELECT {R('avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM t")
def accuracy(spark, sf_dir):
    return r6(mt.accuracy(scored(spark, sf_dir)))


@query(
    "precision_recall_f1",
    _from_confusion(
        f"{R('tp / CAST(tp + fp AS DOUBLE)')} AS precision, {R('tp / CAST(tp + fn AS DOUBLE)')} AS recall, "
        f"{R('2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)')} AS f1"
    ),
)
def precision_recall_f1(spark, sf_dir):
    return r6(mt.precision_recall_f1(scored(spark, sf_dir)))


@query("balanced_accuracy", _from_confusion(f"{R(BA)} AS balanced_accuracy"))
def balanced_accuracy(spark, sf_dir):
    return r6(mt.balanced_accuracy(scored(spark, sf_dir)))


@query("mcc", _from_confusion(f"{R(MCC)} AS mcc"))
def mcc(spark, sf_dir):
    return r6(mt.mcc(scored(spark, sf_dir)))


@query("auroc", f"WITH {TEST}, a AS ({auroc_sql('t', '', 'p')}) SELECT {R('auroc')} AS auroc FROM a")
def auroc(spark, sf_dir):
    return r6(mt.auroc(scored(spark, sf_dir)))


@query(
    "roc_curve",
    f"""WITH {TEST}, d AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM t GROUP BY p),
c AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) / CAST(sum(pos) OVER () AS DOUBLE) AS tpr,
             sum(neg) OVER (ORDER BY p DESC) / CAST(sum(neg) OVER () AS DOUBLE) AS fpr FROM d)
SELECT {R('p')} AS threshold, {R('fpr')} AS fpr, {R('tpr')} AS tpr FROM c
UNION ALL SELECT CAST('inf' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)""",
)
def roc_curve(spark, sf_dir):
    return r6(mt.roc_curve(scored(spark, sf_dir)))


@query("point_biserial", f"WITH {TEST} SELECT {R('corr(p, y)')} AS rho FROM t")
def point_biserial(spark, sf_dir):
    return r6(mt.point_biserial(scored(spark, sf_dir)))


@query("point_biserial_logit", f"WITH {TEST} SELECT l_linestatus, {R('corr(ln(p / (1 - p)), y)')} AS rho FROM t GROUP BY 1")
def point_biserial_logit(spark, sf_dir):
    return r6(mt.point_biserial(scored(spark, sf_dir), ["l_linestatus"], logit=True))


_LONG = """long AS (SELECT vec_id, label AS true_cls, CAST(r.cls AS INTEGER) AS cls, CAST(embedding[r.cls + 1] AS DOUBLE) AS score
         FROM embeddings, (SELECT unnest(range(0, (SELECT max(label) + 1 FROM embeddings))) AS cls) r)"""


def _long(spark, sf_dir):
    """Class scores of every vector: component k is the score of class k."""
    vectors = table(spark, sf_dir, "embeddings")
    classes = vectors.agg(F.max("label").alias("k"))
    return vectors.select(
        "vec_id",
        F.col("label").alias("true_cls"),
        F.posexplode(F.slice("embedding", F.lit(1), classes.select(F.col("k") + 1).scalar())).alias("cls", "_s"),
    ).select("vec_id", "true_cls", "cls", F.col("_s").cast("double").alias("score"))


_OVO = f"""{_LONG},
ovo AS (SELECT a.cls AS i, j.label AS j, coalesce(corr(score, CASE WHEN true_cls = a.cls THEN 1.0 ELSE 0.0 END), 0) AS rho
        FROM long a JOIN (SELECT DISTINCT label FROM embeddings) j ON j.label <> a.cls AND (true_cls = a.cls OR true_cls = j.label)
        GROUP BY 1, 2)"""
_OVR = f"""{_LONG},
ovr AS (SELECT cls AS i, coalesce(corr(score, CASE WHEN true_cls = cls THEN 1.0 ELSE 0.0 END), 0) AS rho FROM long GROUP BY 1)"""


@query("rho_ovo", f"WITH {_OVO} SELECT {R('tanh(avg(atanh(rho)))')} AS rho FROM ovo")
def rho_ovo(spark, sf_dir):
    return r6(mc.rho_ovo(_long(spark, sf_dir)))


@query("rho_ovo_pairs", f"WITH {_OVO} SELECT i, j, {R('rho')} AS rho FROM ovo")
def rho_ovo_pairs(spark, sf_dir):
    return r6(mc.rho_ovo_pairs(_long(spark, sf_dir)))


@query("rho_ovr", f"WITH {_OVR} SELECT {R('tanh(avg(atanh(rho)))')} AS rho FROM ovr")
def rho_ovr(spark, sf_dir):
    return r6(mc.rho_ovr(_long(spark, sf_dir)))


@query("rho_ovr_classes", f"WITH {_OVR} SELECT i, {R('rho')} AS rho FROM ovr")
def rho_ovr_classes(spark, sf_dir):
    return r6(mc.rho_ovr_classes(_long(spark, sf_dir)))


_SWEEP = f"""{TEST},
cuts AS (SELECT CAST(g AS INTEGER) AS idx, CASE WHEN g = 99 THEN CAST(1 AS DOUBLE) ELSE g * (1 / CAST(99 AS DOUBLE)) END AS cut
         FROM range(0, 100) r(g)),
soft AS (SELECT {', '.join(f'{e} AS s{c}' for c, e in _SOFT.items())} FROM t),
hard AS (SELECT idx, cut, count(*) FILTER (y = 0 AND p <= cut) AS tn, count(*) FILTER (y = 0 AND p > cut) AS fp,
                count(*) FILTER (y = 1 AND p <= cut) AS fn, count(*) FILTER (y = 1 AND p > cut) AS tp
         FROM t, cuts GROUP BY 1, 2),
sweep AS (SELECT idx, cut AS threshold, {ACC} AS accuracy,
                 (pow(tn - stn, 2) + pow(fp - sfp, 2) + pow(fn - sfn, 2) + pow(tp - stp, 2)) / 4 AS mse FROM hard, soft)"""


@query(
    "threshold_sweep",
    f"WITH {_SWEEP} SELECT idx, {R('threshold')} AS threshold, {R('accuracy')} AS accuracy, round(mse, 2) AS mse FROM sweep",
)
def threshold_sweep(spark, sf_dir):
    out = r6(mt.threshold_sweep(scored(spark, sf_dir)))
    return out.withColumn("mse", F.round("mse", 2))


@query(
    "optimal_threshold",
    f"""WITH {_SWEEP} SELECT idx, idx / CAST(100 AS DOUBLE) AS opt, {R('threshold')} AS threshold, {R('accuracy')} AS accuracy
FROM sweep ORDER BY mse, idx LIMIT 1""",
)
def optimal_threshold(spark, sf_dir):
    return r6(mt.optimal_threshold(scored(spark, sf_dir)))


@query(
    "score_histogram",
    f"""WITH {SCORED_SQL}, ends AS (SELECT min(p) AS lo, max(p) AS hi FROM scored),
c AS (SELECT least(CAST(floor((p - lo) / (hi - lo) * 50) AS INTEGER), 49) AS bin, count(*) AS n FROM scored, ends GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, {R('lo + r.bin * (hi - lo) / 50')} AS low, {R('lo + (r.bin + 1) * (hi - lo) / 50')} AS high,
       coalesce(n, 0) AS n
FROM range(0, 50) r(bin) LEFT JOIN c USING (bin), ends""",
)
def score_histogram(spark, sf_dir):
    return r6(mt.score_histogram(scored(spark, sf_dir)))


def bundle_sql(source: str, keys: str, pred: str, cut: str) -> str:
    """SQL twin of the metric bundle; ``source`` and ``keys`` are SQL."""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    join = f"JOIN area USING ({keys})" if keys else ", area"
    return f"""base AS (SELECT {lead}{confusion_sql(pred, cut)}, sum({pred}) AS pos_est, CAST(sum(y) AS DOUBLE) AS actual,
       (sum({pred}) - sum(y)) / count(*) AS bias, CASE WHEN var_pop({pred}) = 0 THEN 0 ELSE corr({pred}, y) END AS spcc FROM {source} {group}),
area AS ({auroc_sql(source, keys, pred)}),
bundle AS (SELECT {lead}actual AS tp, pos_est, bias, spcc, {ACC} AS acc, {BA} AS ba, {MCC} AS mcc, auroc FROM base {join})"""


BUNDLE_OUT = f"tp, round(pos_est, 4) AS pos_est, {R('bias')} AS bias, {R('spcc')} AS spcc, {R('acc')} AS acc, {R('ba')} AS ba, {R('mcc')} AS mcc, {R('auroc')} AS auroc"


def bundle_out(df):
    return r6(df).withColumn("pos_est", F.round("pos_est", 4))


@query("metric_bundle", f"WITH {TEST}, {bundle_sql('t', 'l_linestatus', 'p', '0.5')} SELECT l_linestatus, {BUNDLE_OUT} FROM bundle")
def metric_bundle(spark, sf_dir):
    return bundle_out(mt.metric_bundle(scored(spark, sf_dir), ["l_linestatus"]))


@query(
    "metric_bundle_with_missing",
    f"WITH {SCORED_SQL}, t AS (SELECT * FROM scored WHERE l_partkey % 10 <> 3), {bundle_sql('t', 'l_linestatus', 'p', '0.5')} SELECT l_linestatus, {BUNDLE_OUT} FROM bundle",
)
def metric_bundle_with_missing(spark, sf_dir):
    """Scores nulled where the part key ends in 3: those rows take no part in any metric."""
    rows = scored(spark, sf_dir).withColumn("p", F.when(F.col("l_partkey") % 10 != 3, F.col("p")))
    return bundle_out(mt.metric_bundle(rows, ["l_linestatus"]))


FOUR_LONG_SQL = f"""{FOUR_SQL},
lv AS (SELECT y, l_linestatus, FALSE AS calibrated, FALSE AS proba, CAST(raw_label AS DOUBLE) AS pred FROM four
       UNION ALL SELECT y, l_linestatus, FALSE, TRUE, raw_proba FROM four
       UNION ALL SELECT y, l_linestatus, TRUE, FALSE, CAST(cal_label AS DOUBLE) FROM four
       UNION ALL SELECT y, l_linestatus, TRUE, TRUE, cal_proba FROM four)"""


def four(spark, sf_dir):
    """The four predictions of every test row."""
    rows = test_rows(spark, sf_dir)
    pair = fitted_pair(spark, sf_dir)
    state = cal.calibrate(rows, pair)
    out = cal.predict_calibrated(cal.predict_raw(rows), state)
    out = cal.posterior_calibrated(out, pair, state).withColumnRenamed("p", "raw_proba")
    return attach(out, state, (), ["threshold"])


@query(
    "four_variant_report",
    f"WITH RECURSIVE {FOUR_LONG_SQL}, {bundle_sql('lv', 'calibrated, proba', 'pred', '0.5')} SELECT calibrated, proba, {BUNDLE_OUT} FROM bundle",
)
def four_variant_report(spark, sf_dir):
    return bundle_out(mt.four_variant_report(store(four(spark, sf_dir).drop("threshold"), "four")))
