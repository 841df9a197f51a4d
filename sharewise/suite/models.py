"""Registered queries: fitted models and whole experiments.

The fits on one feature have a twin that takes Newton steps in a recursive query, the naive Bayes one in
closed form.  The other fits have none; tests check them by their invariants.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sharewise.operators import calibration as cal
from sharewise.operators import clean
from sharewise.operators import experiments as ex
from sharewise.operators import features as ft
from sharewise.operators import models as md
from sharewise.operators import sampling as sp
from sharewise.operators.density import density_sliding
from sharewise.plans import store
from sharewise.suite.common import (
    BASE_LANG,
    LABELLED_SQL,
    MINDF,
    SCORED_SQL,
    TOKENS_SQL,
    R,
    documents,
    labelled,
    query,
    r6,
    scored,
    table,
)
from sharewise.suite.documents import _ranked

KEY = ["doc_id"]


def training_vectors(spark, sf_dir, as_entries=False):
    """(doc_id, label, features) of the labelled documents, and their vocabulary; or rows of entries, and their number of columns."""
    if as_entries:
        return training_entries(spark, sf_dir)[:2]
    docs = labelled(spark, sf_dir)
    features, vocab = ft.vectorize(docs, mindf=MINDF, base_lang=BASE_LANG)
    size = F.lit(vocab.count() + 1)
    rows = md.document_vectors(features.select("doc_id", "idx", "w"), docs.select("doc_id", "label"), size, keep=["label"])
    return md.write_vectors(rows), vocab


def training_entries(spark, sf_dir):
    """(doc_id, label, entries) of the labelled documents, their number of columns, and their vocabulary."""
    docs = labelled(spark, sf_dir)
    features, vocab = ft.vectorize(docs, mindf=MINDF, base_lang=BASE_LANG)
    rows = md.document_entries(features.select("doc_id", "idx", "w"), docs.select("doc_id", "label"), keep=["label"])
    return rows, vocab.count() + 1, vocab


def train_test(spark, sf_dir):
    """Half of each class of the labelled documents to train, half as the test pool."""
    parts = store(sp.strat_split(labelled(spark, sf_dir), KEY, "label", 0.5, "pools"), "pools")
    return parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")


@query("fit_logistic")
def fit_logistic(spark, sf_dir):
    rows, width, _ = training_entries(spark, sf_dir)
    coefs, intercepts = md.fit_entries(rows, width)
    return r6(coefs.join(F.broadcast(intercepts), "run_id").select("idx", "coef", "intercept"))


@query("fit_class_weighted")
def fit_class_weighted(spark, sf_dir):
    rows, width, _ = training_entries(spark, sf_dir)
    grid = md.class_weight_grid(2)
    scored = md.score_entries(rows, *md.fit_entries(rows, width, grid), ["doc_id", "label"])
    return r6(scored.select("doc_id", "label", "p", md.by_run(dict(enumerate(grid))).alias("class_weight")))


# --- one feature: Newton's steps in SQL ---------------------------------------------------


def newton_sql(weight: str, keys: str = "") -> str:
    """SQL: ``fitted`` (keys, a, b), the optimum of sum w * loss + b^2 / 2 over ``cells`` (keys, p, y, c)."""
    own = f"{keys}, " if keys else ""
    seed = f"SELECT DISTINCT {own}0 AS k, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM cells"
    join = f"newton JOIN cells USING ({keys})" if keys else "newton, cells"
    return f"""newton AS (
  {seed}
  UNION ALL
  SELECT {own}k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT {own}k, a, b, sum(w * (s - y)) AS ga, sum(w * (s - y) * p) + b AS gb, sum(w * s * (1 - s)) AS haa,
               sum(w * s * (1 - s) * p) AS hab, sum(w * s * (1 - s) * p * p) + 1 AS hbb
        FROM (SELECT {own}k, a, b, {weight} AS w, p, y, 1 / (1 + exp(-(a + b * p))) AS s FROM {join} WHERE k < 40) steps
        GROUP BY {own}k, a, b) sums),
fitted AS (SELECT {own}a, b FROM newton WHERE k = 40)"""


def score_vectors(spark, sf_dir):
    """(label, features) of all scored rows, the score being the one feature."""
    rows = scored(spark, sf_dir).select(F.col("y").cast("double").alias("label"), "p")
    return VectorAssembler(inputCols=["p"], outputCol="features").transform(rows)


@query(
    "fit_logistic_scores",
    f"""WITH RECURSIVE {SCORED_SQL},
cells AS (SELECT p, y, count(*) AS c FROM scored GROUP BY 1, 2),
{newton_sql("c")}
SELECT round(a, 4) + 0.0 AS intercept, round(b, 4) + 0.0 AS coef FROM fitted""",
)
def fit_logistic_scores(spark, sf_dir):
    model = md.fit_logistic(score_vectors(spark, sf_dir), tol=1e-12)
    rows = md.coefficient_rows(spark, model.coefficients.toArray())
    return rows.select(F.round(F.lit(model.intercept), 4).alias("intercept"), F.round("coef", 4).alias("coef"))


GRID_SQL = "grid AS (SELECT unnest([pow(10, CAST(0.1 AS DOUBLE)), CAST(100 AS DOUBLE)]) AS class_weight)"


@query(
    "fit_class_weighted_scores",
    f"""WITH RECURSIVE {SCORED_SQL},
{GRID_SQL},
cells AS (SELECT class_weight, p, y, count(*) AS c FROM scored, grid GROUP BY 1, 2, 3),
{newton_sql("c * CASE WHEN y = 1 THEN class_weight ELSE 1 END", "class_weight")}
SELECT round(class_weight, 6) AS class_weight, round(a, 4) + 0.0 AS intercept, round(b, 4) + 0.0 AS coef FROM fitted""",
)
def fit_class_weighted_scores(spark, sf_dir):
    fitted = md.fit_class_weighted(score_vectors(spark, sf_dir), md.class_weight_grid(2), tol=1e-12)
    parts = [
        md.coefficient_rows(spark, model.coefficients.toArray()).select(
            F.round(F.lit(w), 6).alias("class_weight"), F.round(F.lit(model.intercept), 4).alias("intercept"), F.round("coef", 4).alias("coef")
        )
        for w, model in fitted.items()
    ]
    return clean.union_by_name(parts)


# --- naive Bayes for all runs ---------------------------------------------------------------

BAYES_FOLDS = 3

BAYES_SQL = f"""{LABELLED_SQL},
{TOKENS_SQL},
folds AS (SELECT doc_id, label, CAST((r - 1) % {BAYES_FOLDS} AS INTEGER) AS fold FROM {_ranked('labelled', 'bayes', 'label')}),
runs AS (SELECT CAST(r.run_id AS INTEGER) AS run_id, doc_id, label, fold = r.run_id AS held FROM folds, range(0, {BAYES_FOLDS}) r(run_id)),
sizes AS (SELECT run_id, count(*) AS n, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg
          FROM runs WHERE NOT held GROUP BY 1),
vocab AS (SELECT run_id, term, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
          FROM (SELECT run_id, term, count(*) AS df FROM runs JOIN tf USING (doc_id) WHERE NOT held GROUP BY 1, 2 HAVING count(*) >= {MINDF}) d
          JOIN sizes USING (run_id)),
raw AS (SELECT run_id, doc_id, label, held, term, (1.0 + ln(tf)) * idf AS x FROM runs JOIN tf USING (doc_id) JOIN vocab USING (run_id, term)),
rows AS (SELECT run_id, doc_id, label, held, term, x / sqrt(sum(x * x) OVER (PARTITION BY run_id, doc_id)) AS x FROM raw
         UNION ALL
         SELECT run_id, doc_id, r.label, held, NULL, CASE WHEN lang = '{BASE_LANG}' THEN 0.0 ELSE 1.0 END FROM runs r JOIN labelled USING (doc_id)),
sums AS (SELECT run_id, coalesce(term, '') AS term, sum(CASE WHEN label = 1 THEN x ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN x ELSE 0 END) AS neg
         FROM rows WHERE NOT held GROUP BY 1, 2),
whole AS (SELECT run_id, sum(pos) AS all_pos, sum(neg) AS all_neg, count(*) AS width FROM sums GROUP BY 1),
coefs AS (SELECT run_id, term, ln((pos + 1) / (all_pos + width)) - ln((neg + 1) / (all_neg + width)) AS coef
          FROM sums JOIN whole USING (run_id))"""


def bayes_runs(spark, sf_dir):
    """Naive Bayes on all folds but one, for each fold: (corpus, rows of the held folds, fitted runs)."""
    docs = labelled(spark, sf_dir)
    folds = store(sp.kfold_assign(docs, KEY, "label", BAYES_FOLDS, "bayes"), "folds")
    each = folds.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in range(BAYES_FOLDS)])))
    training = each.where("fold <> run_id").select("run_id", "doc_id", "label", F.lit(1).cast("long").alias("copies"))
    corpus = ft.corpus_terms(docs, base_lang=BASE_LANG)
    fitted = md.fit_runs(corpus, training, range(BAYES_FOLDS), MINDF, calibrate=False, estimator="naive_bayes")
    return corpus, each.where("fold = run_id").select("run_id", "doc_id"), fitted


@query(
    "naive_bayes_scores",
    f"""WITH {BAYES_SQL}
SELECT run_id, doc_id, {R('1 / (1 + exp(-(dot + ln(n_pos + 1.0) - ln(n_neg + 1.0))))')} AS p
FROM (SELECT run_id, doc_id, sum(x * coef) AS dot
      FROM (SELECT run_id, doc_id, coalesce(term, '') AS term, x FROM rows WHERE held) h JOIN coefs USING (run_id, term) GROUP BY 1, 2) d
JOIN sizes USING (run_id)""",
)
def naive_bayes_scores(spark, sf_dir):
    corpus, held, fitted = bayes_runs(spark, sf_dir)
    return r6(md.score_runs(corpus, held, fitted).select("run_id", "doc_id", "p"))


@query(
    "naive_bayes_weights",
    f"WITH {BAYES_SQL} SELECT run_id, CASE WHEN term = '' THEN 'language' ELSE term END AS term, {R('coef')} AS coef FROM coefs",
)
def naive_bayes_weights(spark, sf_dir):
    _, _, fitted = bayes_runs(spark, sf_dir)
    return r6(md.feature_weights(fitted.coefs, fitted.vocab, ["run_id"]))


@query("feature_weights")
def feature_weights(spark, sf_dir):
    rows, width, vocab = training_entries(spark, sf_dir)
    coefs, _ = md.fit_entries(rows, width)
    return r6(md.feature_weights(coefs.drop("run_id"), vocab))


@query("calibrated_fit")
def calibrated_fit(spark, sf_dir):
    rows, width, _ = training_entries(spark, sf_dir)
    scored = md.score_entries(rows, *md.fit_entries(rows, width), ["label"])
    return density_sliding(scored, (), "label", "p")


@query("prevalence_of_new_documents")
def prevalence_of_new_documents(spark, sf_dir):
    """Train on the labelled documents, estimate the share of positives among all the others."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("label"))
    training = labels.select(F.lit(0).alias("run_id"), "doc_id", "label", F.lit(1).cast("long").alias("copies"))
    corpus = ft.corpus_terms(docs, base_lang=BASE_LANG)
    fitted = md.fit_runs(corpus, training, [0], MINDF)
    fresh = docs.join(labels, "doc_id", "left_anti").select(F.lit(0).alias("run_id"), "doc_id")
    scored = store(md.score_runs(corpus, fresh, fitted), "scored")
    state = cal.calibrate(scored, fitted.pair, ["run_id"])
    raw = scored.groupBy("run_id").agg(F.avg("p").alias("mean_score"), F.avg((F.col("p") > 0.5).cast("double")).alias("raw_share"))
    return r6(state.join(raw, "run_id"))


@query("cross_validate")
def cross_validate(spark, sf_dir):
    rows, width = training_vectors(spark, sf_dir, True)
    scores, _ = ex.cross_validate(rows, width=width)
    return r6(scores)


@query("benchmark_models")
def benchmark_models(spark, sf_dir):
    rows, width = training_vectors(spark, sf_dir, True)
    return r6(ex.benchmark_models(rows, width=width))


@query("bootstrap_benchmark")
def bootstrap_benchmark(spark, sf_dir):
    train, test = train_test(spark, sf_dir)
    report, _ = ex.bootstrap_benchmark(train, test, mindf=MINDF, base_lang=BASE_LANG, test_frac=0.5)
    return r6(report)


@query("balanced_benchmark")
def balanced_benchmark(spark, sf_dir):
    train, test = train_test(spark, sf_dir)
    return r6(ex.balanced_benchmark(train, test, mindf=MINDF, base_lang=BASE_LANG, test_frac=0.5))


@query("class_weight_sweep")
def class_weight_sweep(spark, sf_dir):
    train, test = train_test(spark, sf_dir)
    return r6(
        ex.class_weight_sweep(
            train, test, steps=2, mindf=MINDF, base_lang=BASE_LANG, neg_frac=0.5, test_frac=0.5
        )
    )


@query("ensemble_fit")
def ensemble_fit(spark, sf_dir):
    ensemble, _ = ex.ensemble_fit(labelled(spark, sf_dir), size=3, mindf=MINDF, base_lang=BASE_LANG)
    return r6(ensemble.accuracy)


@query("ensemble_fit_bayes")
def ensemble_fit_bayes(spark, sf_dir):
    ensemble, _ = ex.ensemble_fit(labelled(spark, sf_dir), size=3, mindf=MINDF, base_lang=BASE_LANG, estimator="naive_bayes")
    return r6(ensemble.accuracy)


@query("cross_validated_predictions")
def cross_validated_predictions(spark, sf_dir):
    """Predictions of the test half by the final fit of a cross-validation on the training half."""
    train, test = train_test(spark, sf_dir)
    features, vocab = ft.vectorize(train, mindf=MINDF, base_lang=BASE_LANG)
    others, _ = ft.vectorize(test, vocab, base_lang=BASE_LANG)
    rows, fresh = (
        md.document_entries(f.select("doc_id", "idx", "w"), d.select("doc_id", "label"), keep=["label"])
        for f, d in ((features, train), (others, test))
    )
    _, final = ex.cross_validate(rows, test=fresh, width=vocab.count() + 1)
    return r6(final)


@query("ensemble_predict")
def ensemble_predict(spark, sf_dir):
    ensemble, _ = ex.ensemble_fit(labelled(spark, sf_dir), size=3, mindf=MINDF, base_lang=BASE_LANG)
    return r6(ex.ensemble_predict(ensemble, documents(spark, sf_dir).select("doc_id", "text", "lang"), proba=True))


@query("ensemble_benchmark")
def ensemble_benchmark(spark, sf_dir):
    train, test = train_test(spark, sf_dir)
    return r6(
        ex.ensemble_benchmark(
            train, test, mindf=MINDF, base_lang=BASE_LANG, neg_frac=0.5, test_frac=0.5
        )
    )
