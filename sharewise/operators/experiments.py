"""Whole experiments: bootstrap, balanced, class-weight and ensemble benchmarks.

``docs`` is (doc_id, text, lang, label) with label 1.0 / 0.0.  Every machine, member or weight
is a ``run_id``; the runs go through counting, weighting, fitting, scoring, calibration and metrics
together, as one more grouping column.  ``estimator`` and ``density`` are those of :func:`models.fit_runs`;
``scorer`` is one of ``metrics.SCORERS`` or made likewise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.operators import calibration as cal
from sharewise.operators import density as dn
from sharewise.operators import features as ft
from sharewise.operators import metrics as mt
from sharewise.operators import models as md
from sharewise.operators import sampling as sp
from sharewise.operators import votes as vt
from sharewise.plans import attach, discard, lookup, materialize, store

KEY = ["doc_id"]
RUN = ["run_id"]


def _labels(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "label")


def _pooled_corpus(train: DataFrame, test: DataFrame, base_lang: str, used: Sequence[DataFrame]) -> DataFrame:
    """The terms of the documents of both pools that occur in ``used``; one in both pools is counted once.

    Texts that no run draws are left out before they are tokenised.
    """
    ids = used[0].select("doc_id")
    for rows in used[1:]:
        ids = ids.unionByName(rows.select("doc_id"))
    drawn = store(ids.distinct(), "drawn")
    pools = [df.select("doc_id", "text", "lang").join(drawn, "doc_id", "left_semi") for df in (train, test)]
    return ft.corpus_terms(pools[0].unionByName(pools[1]), base_lang=base_lang, distinct=True)


def _sample_by_run(
    docs: DataFrame, runs: Sequence[int], take, seed: str, strata: Sequence[str] = ("label",)
) -> DataFrame:
    """(run_id, doc_id, label): an own sample for every run, all drawn in one job.

    ``take(n)`` may refer to the strata columns and to ``run_id``.
    """
    each = _labels(docs).withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in runs])))
    draw = F.concat_ws("|", F.lit(seed), F.col("run_id").cast("string"))
    flagged = sp.flag_sample(each, KEY, take, draw, ["run_id", *strata], "_in")
    return flagged.where("_in").drop("_in")


def predictions(
    corpus: DataFrame, rows: DataFrame, fitted: md.FittedRuns, state: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """The four predictions of every row (run_id, doc_id, ...), and the calibration state.

    The share of positives always comes from these rows; the threshold too, unless ``state``
    brings a stored one.
    """
    assigned = ft.assign_runs(corpus, rows)
    scored = store(md.score_assigned(assigned, fitted), "scored")
    discard(assigned)
    raw = cal.predict_raw(scored)
    if fitted.density == "radius":
        at = dn.radius_pair(fitted.scores, scored, RUN, "label", copies="copies")
        shares = materialize(cal.prevalence_points(at, RUN))
        here = materialize(shares.join(cal.calibrated_threshold(scored, shares, RUN), RUN))
        out = cal.predict_calibrated(raw, here if state is None else state, RUN)
        dense = lookup(out, at.drop("c"), [*RUN, "p"], "left")
        out = cal.with_posterior(attach(dense, here, RUN, ["pi"]))
    else:
        bin_ = dn.hist_bin("p") if fitted.density == "hist" else dn.sliding_bin("p")
        here = cal.calibrate(scored, fitted.pair, RUN, bin_=bin_)
        out = cal.predict_calibrated(raw, here if state is None else state, RUN)
        out = cal.posterior_calibrated(out, fitted.pair, here, RUN, bin_=bin_)
    return store(out.withColumnRenamed("p", "raw_proba"), "predictions"), here if state is None else state


def bootstrap_benchmark(
    train: DataFrame,
    test: DataFrame,
    replicates: int = 100,
    seed: str = "bootstrap",
    mindf: int = 50,
    base_lang: str = "dutch",
    test_frac: float = 0.1,
    estimator: str = "logistic",
    density: str = "sliding",
) -> tuple[DataFrame, DataFrame]:
    """(report, votes): replicates vote on one shared test sample.

    Each replicate draws the positives with replacement and seven negatives for every three
    positives without.
    """
    runs = list(range(replicates))
    pos, neg = train.where("label = 1"), train.where("label = 0")
    drawn = sp.bootstrap_resample(pos.select("doc_id"), KEY, replicates, seed).withColumnRenamed("replicate_id", "run_id")
    n_neg = (pos.count() - 1) * 7 // 3
    others = _sample_by_run(neg, runs, lambda _: F.lit(n_neg), f"{seed}-neg")
    training = drawn.withColumn("label", F.lit(1.0)).unionByName(others.withColumn("copies", F.lit(1).cast("long")))
    training = store(training, "training")

    held_out = store(_labels(sp.stratified_sample(test, KEY, "label", test_frac, f"{seed}-test")), "held_out")
    rows = held_out.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in runs])))
    corpus = _pooled_corpus(train, test, base_lang, [training, held_out])
    fitted = md.fit_runs(corpus, training, runs, mindf, estimator=estimator, density=density)
    pred, _ = predictions(corpus, rows, fitted)
    votes = store(vote_replicates(pred, ["doc_id", "label"]), "votes")
    return mt.four_variant_report(votes, (), "label"), votes


def vote_replicates(pred: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Average over replicates: labels by majority (a tie is positive), probabilities by mean."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return pred.groupBy(*ids).agg(
        (mean("raw_label") >= 0.5).alias("raw_label"),
        mean("raw_proba").alias("raw_proba"),
        (mean("cal_label") >= 0.5).alias("cal_label"),
        mean("cal_proba").alias("cal_proba"),
    )


def machines_report(
    train: DataFrame,
    test: DataFrame,
    runs: Mapping[int, float],
    negatives,
    seed: str,
    mindf: int,
    base_lang: str,
    test_frac: float,
    estimator: str = "logistic",
    density: str = "sliding",
) -> DataFrame:
    """(run_id, calibrated, proba, metrics): every machine samples, fits and tests for itself.

    Calibrated probabilities are cut at the machine's calibrated threshold.
    """
    ids = list(runs)
    one = F.lit(1).cast("long")
    pos = _labels(train.where("label = 1")).withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in ids])))
    neg = _sample_by_run(train.where("label = 0"), ids, negatives, f"{seed}-neg")
    training = store(pos.unionByName(neg).withColumn("copies", one), "training")
    rows = store(_sample_by_run(test, ids, lambda n: F.floor(n * F.lit(test_frac)), f"{seed}-test"), "held_out")
    corpus = _pooled_corpus(train, test, base_lang, [training, rows])
    fitted = md.fit_runs(corpus, training, runs, mindf, estimator=estimator, density=density)
    pred, state = predictions(corpus, rows, fitted)
    cut = attach(pred, state, RUN, ["threshold"])
    return mt.four_variant_report(cut, RUN, "label", "threshold")


def balanced_benchmark(
    train: DataFrame,
    test: DataFrame,
    machines: int = 100,
    seed: str = "balanced",
    mindf: int = 50,
    base_lang: str = "dutch",
    test_frac: float = 0.1,
    estimator: str = "logistic",
    density: str = "sliding",
) -> DataFrame:
    """Machines with as many negatives as positives; metrics averaged per variant."""
    n_pos = train.where("label = 1").count()
    report = machines_report(
        train, test, {r: 1.0 for r in range(machines)}, lambda _: F.lit(n_pos), seed, mindf, base_lang, test_frac, estimator, density
    )
    return vt.average_metrics(report, ["calibrated", "proba"])


def class_weight_sweep(
    train: DataFrame,
    test: DataFrame,
    steps: int = 2,
    machines: int = 5,
    seed: str = "weights",
    mindf: int = 50,
    base_lang: str = "dutch",
    neg_frac: float = 0.1,
    test_frac: float = 0.1,
    estimator: str = "logistic",
    density: str = "sliding",
) -> DataFrame:
    """(class_weight, variant, metrics): machines per positive-class weight of the log grid."""
    grid = md.class_weight_grid(steps)
    runs = {i * machines + m: w for i, w in enumerate(grid) for m in range(machines)}
    report = machines_report(
        train, test, runs, lambda n: F.floor(n * F.lit(neg_frac)), seed, mindf, base_lang, test_frac, estimator, density
    )
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in runs.items() for x in kv]), F.col("run_id"))
    return vt.average_metrics(report.withColumn("class_weight", weight), ["class_weight", "calibrated", "proba"])


def active_features(
    corpus: DataFrame, ids: Sequence[str], mindf: int = 1, keys: Sequence[str] = ()
) -> DataFrame:
    """(ids, term): active terms under the set's own vocabulary; '' is an active language flag."""
    terms = ft.unfold_terms(corpus)
    active = terms.select(*ids, "term")
    if mindf > 1:
        own = materialize(ft.fit_vocabulary(terms, mindf, keys).select(*keys, "term"))
        active = ft.vocab_lookup(active, own, keys)
    flags = corpus.where(F.col("language") != 0).select(*ids, F.lit("").alias("term"))
    return active.select(*ids, "term").unionByName(flags)


# --- ensembles --------------------------------------------------------------------------


@dataclass
class Ensemble:
    """A fitted ensemble; the members are the runs of ``fitted``."""

    fitted: md.FittedRuns
    members: list[int]
    accuracy: DataFrame  #: run_id, calibrated, proba, accuracy
    state: DataFrame  #: run_id, pi, n, threshold on the validation rows
    base_lang: str
    mindf: int


def _fit_members(
    corpus: DataFrame, rows: DataFrame, members: Sequence[int], seed: str, mindf: int, base_lang: str,
    estimator: str = "logistic",
    density: str = "sliding",
    scorer: str | mt.Scorer = "accuracy",
) -> Ensemble:
    """``rows`` is (run_id, doc_id, label): what each member may see; it fits on 80% of it and is scored on the rest."""
    split = store(sp.train_val_split(rows, KEY, 0.2, seed, RUN), "split")
    training = split.where("part = 'train'").drop("part").withColumn("copies", F.lit(1).cast("long"))
    fitted = md.fit_runs(corpus, training, list(members), mindf, estimator=estimator, density=density)
    val = split.where("part = 'val'").drop("part")
    pred, state = predictions(corpus, val, fitted)
    long = mt.variant_rows(attach(pred, state, RUN, ["threshold"]), ["run_id", "label"], "threshold")
    accuracy = materialize(
        vt.member_score(long, [*RUN, "calibrated", "proba"], "label", "pred", F.col("threshold"), scorer)
    )
    return Ensemble(fitted, list(members), accuracy, state, base_lang, mindf)


def ensemble_fit(
    docs: DataFrame, size: int = 3, seed: str = "ensemble", mindf: int = 50, base_lang: str = "dutch",
    estimator: str = "logistic",
    density: str = "sliding",
    scorer: str | mt.Scorer = "accuracy",
) -> tuple[Ensemble, DataFrame]:
    """Fit ``size`` members on their own 80/20 splits; also returns the packed corpus."""
    corpus = ft.corpus_terms(docs, base_lang=base_lang)
    members = list(range(size))
    rows = _labels(docs).withColumn("run_id", F.explode(F.array(*[F.lit(m) for m in members])))
    return _fit_members(corpus, rows, members, seed, mindf, base_lang, estimator, density, scorer), corpus


def ensemble_predict(
    ensemble: Ensemble,
    docs: DataFrame,
    calibrated: bool = False,
    proba: bool = False,
    threshold: float = 0.5,
    indiv_preds: bool = False,
    total_preds: bool = True,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Member predictions and / or their overlap-weighted vote.

    Weights are scaled to sum 1 per document first and multiplied by the member's
    validation accuracy then.  Labels are the vote at ``threshold``.
    """
    corpus = ft.corpus_terms(docs, base_lang=ensemble.base_lang)
    listed = F.explode(F.array(*[F.lit(m) for m in ensemble.members]))
    rows = docs.select("doc_id", listed.alias("run_id"))
    # Calibrated labels use a threshold of the presented documents, as a fresh batch does.
    pred, _ = predictions(corpus, rows, ensemble.fitted)
    name = {v[:2]: v[2] for v in mt.VARIANTS}[(calibrated, proba)]
    single = pred.select("run_id", "doc_id", F.col(name).cast("double").alias("pred"))
    if not total_preds:
        return single
    doc_terms = active_features(corpus, KEY)
    member_terms = materialize(vt.members_by_term(ensemble.fitted.vocab, "run_id"))
    w = vt.overlap_weights(doc_terms, member_terms, rows, KEY, "run_id")
    chosen = ensemble.accuracy.where(
        (F.col("calibrated") == calibrated) & (F.col("proba") == F.lit(False))
    ).select("run_id", "accuracy")
    w = vt.normalize_weights(w, chosen, "before", KEY, "run_id")
    total = vt.weighted_vote(w, single, KEY, "run_id", "pred", None if proba else threshold)
    return (total, single) if indiv_preds else total


def ensemble_benchmark(
    train: DataFrame,
    test: DataFrame,
    ensembles: int = 3,
    size: int = 3,
    seed: str = "ensembles",
    mindf: int = 50,
    base_lang: str = "dutch",
    neg_frac: float = 0.1,
    test_frac: float = 0.1,
    estimator: str = "logistic",
    density: str = "sliding",
    scorer: str | mt.Scorer = "accuracy",
) -> DataFrame:
    """(calibrated, proba, metrics): several ensembles, each with its own data, averaged.

    A member's weight on a document is feature overlap times validation accuracy, scaled to
    sum 1; calibrated labels use the threshold of the member's validation rows.
    """
    ens_ids = list(range(ensembles))
    runs = [e * size + m for e in ens_ids for m in range(size)]
    pos = _labels(train.where("label = 1")).withColumn("run_id", F.explode(F.array(*[F.lit(e) for e in ens_ids])))
    neg = _sample_by_run(train.where("label = 0"), ens_ids, lambda n: F.floor(n * F.lit(neg_frac)), f"{seed}-neg")
    seen = store(pos.unionByName(neg).withColumnRenamed("run_id", "ensemble_id"), "seen")
    held = materialize(
        _sample_by_run(test, ens_ids, lambda n: F.floor(n * F.lit(test_frac)), f"{seed}-test").withColumnRenamed(
            "run_id", "ensemble_id"
        )
    )
    corpus = _pooled_corpus(train, test, base_lang, [seen, held])
    per_member = lambda df: df.withColumn("_m", F.explode(F.array(*[F.lit(m) for m in range(size)]))).select(
        (F.col("ensemble_id") * size + F.col("_m")).cast("int").alias("run_id"), "doc_id", "label"
    )
    ens = _fit_members(corpus, per_member(seen), runs, seed, mindf, base_lang, estimator, density, scorer)
    pred, _ = predictions(corpus, per_member(held), ens.fitted, ens.state)
    of = F.floor(F.col("run_id") / F.lit(size)).cast("int")
    ids = ["ensemble_id", "doc_id"]
    pred = pred.withColumn("ensemble_id", of)

    # Each ensemble's test documents under their own vocabulary.
    tested = ft.unfold_runs(ft.assign_runs(corpus, held.select(*ids)))
    doc_terms = active_features(tested, ids, mindf, ["ensemble_id"])
    member_terms = materialize(
        vt.members_by_term(ens.fitted.vocab.withColumn("ensemble_id", of), "run_id", ["ensemble_id"])
    )
    w = vt.overlap_weights(doc_terms, member_terms, pred, ids, "run_id", ["ensemble_id"])
    w = vt.normalize_weights(w, ens.accuracy, "after", ids, "run_id", ["calibrated", "proba"])
    long = mt.variant_rows(pred, ["run_id", *ids])
    keys = [*ids, "calibrated", "proba"]
    vote = vt.weighted_vote(w, long, keys, "run_id")
    final = vote.select(
        *keys,
        F.when(F.col("proba"), F.col("pred")).otherwise((F.col("pred") >= 0.5).cast("double")).alias("pred"),
    ).join(held, ids)
    report = mt.metric_bundle(store(final, "final"), ["ensemble_id", "calibrated", "proba"], "label", "pred", 0.5)
    return vt.average_metrics(report, ["calibrated", "proba"])


# --- cross-validation -------------------------------------------------------------------


def _placed(vectors: DataFrame, folds: int, seed: str) -> DataFrame:
    """The vectors with their ``fold``, written once for all classifiers that are validated on them."""
    fold_of = sp.kfold_assign(vectors, KEY, "label", folds, seed)
    return store(vectors.join(fold_of.drop("label"), "doc_id"), "folds")


def _fit(rows: DataFrame, estimator):
    return md.fit_logistic(rows) if estimator is None else estimator.fit(rows)


def _fold_predictions(placed: DataFrame, folds: int, estimator, calibrated: bool) -> DataFrame:
    """Predictions for each fold by one fit on the others, with the calibrated ones if asked for."""

    def one(f: int) -> DataFrame:
        train, val = placed.where(F.col("fold") != f), placed.where(F.col("fold") == f)
        out = _four(_fit(train, estimator), train, val, calibrated)
        return store(out.withColumn("fold", F.lit(f)), "fold")

    return reduce(DataFrame.unionByName, md.in_parallel(one, list(range(folds))))


def _side_by_side(
    placed: DataFrame, width: int, folds: int, name: str, calibrated: bool, test: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Predictions for each fold by the fit on the others, and of ``test`` by one on all rows; all fitted in one go."""
    runs = list(range(folds)) + ([folds] if test is not None else [])
    fitted = md.fit_folds(placed, width, runs, name)
    scored = md.score_folds(placed, *fitted, runs, ["doc_id", "label", "fold"], None if calibrated else "fold")
    own, others = F.col("run_id") == F.col("fold"), F.col("run_id") != F.col("fold")
    train = scored.where(others) if calibrated else None
    pred = store(_four_by_run(scored.where(own), train), "folds")
    final = None
    if test is not None:
        fresh = md.score_folds(test.withColumn("fold", F.lit(folds)), *fitted, runs, ["doc_id", "label", "fold"], "fold")
        final = _four_by_run(fresh, train)
    return pred, final


def _four_by_run(rows: DataFrame, train: DataFrame | None) -> DataFrame:
    """The predictions of ``rows`` (run_id, p, ...); calibrated ones too, given the scores of the rows each run was fitted on."""
    if train is None:
        return cal.predict_raw(rows).withColumnRenamed("p", "raw_proba")
    pair = materialize(dn.class_pair(dn.density_sliding(train, RUN, "label", "p"), RUN))
    state = cal.calibrate(rows, pair, RUN)
    out = cal.predict_calibrated(cal.predict_raw(rows), state, RUN)
    return cal.posterior_calibrated(out, pair, state, RUN).withColumnRenamed("p", "raw_proba")


def _fold_scores(
    pred: DataFrame, variants: Sequence[bool], scoring: Sequence[str] | Mapping[str, mt.Scorer] | None = None
) -> DataFrame:
    """Scores (the metric bundle by default) of the raw (False) and calibrated (True) variants, averaged over the folds."""
    long = reduce(DataFrame.unionByName, [_report_rows(pred, v) for v in variants])
    each, keys = ["calibrated", "proba"], ["fold", "calibrated", "proba"]
    if scoring is None:
        return vt.average_metrics(mt.metric_bundle(long, keys, "label", "pred", 0.5), each)
    return vt.average_metrics(mt.score_by(long, scoring, keys, "label", "pred", 0.5), each, list(scoring))


def cross_validate(
    vectors: DataFrame,
    folds: int = 10,
    estimator=None,
    calibrated: bool = False,
    seed: str = "folds",
    test: DataFrame | None = None,
    scoring: Sequence[str] | Mapping[str, mt.Scorer] | None = None,
    width: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(scores per variant averaged over folds, predictions of ``test`` by a final fit).

    ``vectors`` is (doc_id, label, features), materialised.  ``estimator`` is any MLlib
    probabilistic classifier; by default the logistic regression of this package.  ``scoring`` is as in
    :func:`metrics.score_by`; by default the metric bundle.
    With ``width``, ``vectors`` is (doc_id, label, entries) over that many columns, as :func:`models.document_entries` gives
    them, ``estimator`` is one of ``models.FOLD_CLASSIFIERS``, and the folds and the final fit are fitted side by side.
    """
    placed, final = _placed(vectors, folds, seed), None
    if width is not None:
        pred, final = _side_by_side(placed, width, folds, estimator or "logistic", calibrated, test)
    else:
        pred = _fold_predictions(placed, folds, estimator, calibrated)
        if test is not None:
            final = _four(_fit(vectors, estimator), vectors, test, calibrated)
    scores = _fold_scores(pred, [calibrated], scoring)
    if final is not None:
        label, score = ("cal_label", "cal_proba") if calibrated else ("raw_label", "raw_proba")
        final = final.select(
            "doc_id",
            F.col("label").alias("y_test"),
            F.col(label).cast("double").alias("y_pred"),
            F.col(score).alias("y_predP"),
        )
    return scores, final


def _four(model, train: DataFrame, rows: DataFrame, calibrated: bool) -> DataFrame:
    scored = md.positive_score(model, rows, ["doc_id", "label"])
    if not calibrated:
        return cal.predict_raw(scored).withColumnRenamed("p", "raw_proba")
    scored = store(scored, "scored")
    fitted = md.positive_score(model, train, ["label"])
    pair = materialize(dn.class_pair(dn.density_sliding(fitted, (), "label", "p")))
    state = cal.calibrate(scored, pair)
    out = cal.predict_calibrated(cal.predict_raw(scored), state)
    return cal.posterior_calibrated(out, pair, state).withColumnRenamed("p", "raw_proba")


def _report_rows(pred: DataFrame, calibrated: bool) -> DataFrame:
    if calibrated:
        return mt.variant_rows(pred, ["fold", "label"]).where("calibrated")
    if "cal_label" in pred.columns:
        return mt.variant_rows(pred, ["fold", "label"]).where("NOT calibrated")
    blank = pred.withColumn("cal_label", F.lit(None).cast("boolean")).withColumn("cal_proba", F.lit(None).cast("double"))
    return mt.variant_rows(blank, ["fold", "label"]).where("NOT calibrated")


def default_models() -> dict[str, object]:
    """The classifiers compared by default."""
    return {
        "logistic": None,
        "naive_bayes": NaiveBayes(featuresCol="features", labelCol="label"),
        "ridge_logistic": LogisticRegression(featuresCol="features", labelCol="label", regParam=0.1),
    }


def benchmark_models(
    vectors: DataFrame,
    models: Mapping[str, object] | None = None,
    folds: int = 10,
    calibrated: bool = True,
    scoring: Sequence[str] | Mapping[str, mt.Scorer] | None = None,
    width: int | None = None,
) -> DataFrame:
    """Leaderboard: (clf, calibrated, proba, scores) by cross-validation; ``scoring`` and ``width`` as in :func:`cross_validate`.

    The folds are drawn once; a classifier is fitted once a fold, for its raw and calibrated variants together.
    """
    placed = _placed(vectors, folds, "folds")
    variants = (False, True) if calibrated else (False,)
    if models is None:
        models = default_models() if width is None else {name: name for name in md.FOLD_CLASSIFIERS}

    def predicted(estimator) -> DataFrame:
        if width is None:
            return _fold_predictions(placed, folds, estimator, calibrated)
        return _side_by_side(placed, width, folds, estimator or "logistic", calibrated)[0]

    # Steps of a fit on entries are short jobs, so the classifiers take them together.
    every = [predicted(e) for e in models.values()] if width is None else md.in_parallel(predicted, list(models.values()))
    boards = [_fold_scores(pred, variants, scoring).withColumn("clf", F.lit(alias)) for alias, pred in zip(models, every, strict=True)]
    return reduce(DataFrame.unionByName, boards).select("clf", "calibrated", "proba", *(vt.METRICS if scoring is None else scoring))
