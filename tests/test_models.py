"""Fitted models: the optimum itself, calibration on shifted data, and whole experiments."""

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sharewise.operators import experiments as ex
from sharewise.operators import features as ft
from sharewise.operators import metrics as mt
from sharewise.operators import models as md
from sharewise.operators.calibrator import Calibrator
from sharewise.operators.density import class_pair, density_sliding
from sharewise.plans import materialize, shared_path
from sharewise.sources.scans import gen_binormal
from sharewise.streaming.microbatch import calibrate_stream, stream_states
from sharewise.suite.models import train_test


def newton(x, y, w, C=1.0, steps=50):
    """Optimum of C * sum w * loss + |b|^2 / 2 with a free intercept."""
    a = np.c_[np.ones(len(x)), x]
    beta, ridge = np.zeros(a.shape[1]), np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-a @ beta))
        grad = C * a.T @ (w * (p - y)) + ridge * beta
        hess = C * (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        beta -= np.linalg.solve(hess, grad)
    return beta


@pytest.mark.parametrize("weight", [1.0, 4.0])
def test_logistic_reaches_the_penalised_optimum(spark, weight):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)) * np.array([1.0, 0.1, 3.0, 0.5])
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ np.array([1.0, 2.0, -0.5, 0.0]) - 1)))).astype(float)
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, label DOUBLE")
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df)
    model = md.fit_class_weighted(df, [weight])[weight]
    want = newton(x, y, np.where(y == 1, weight, 1.0))
    got = np.r_[model.intercept, model.coefficients.toArray()]
    assert np.abs(got - want).max() < 2e-3


def test_class_weight_grid():
    assert md.class_weight_grid(2) == pytest.approx([10**0.1, 100.0])


@pytest.fixture(scope="module")
def tiny_corpus(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = []
    for i in range(60):
        label = float(i % 3 == 0)
        text = " ".join(words[(i * (k + 1) + k) % 5] for k in range(4)) + (" signal" if label or i % 7 == 0 else " noise")
        rows.append((i, text, "dutch" if i % 2 else "other", label))
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, label DOUBLE")


def test_runs_score_like_the_vector_model(spark, tiny_corpus):
    """Scoring by one aggregation equals the MLlib model on the vectors, copies included."""
    docs = tiny_corpus
    corpus = ft.corpus_terms(docs)
    training = docs.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("run_id"), "doc_id", "label"
    ).withColumn("copies", F.when((F.col("run_id") == 1) & (F.col("doc_id") % 4 == 0), 3).otherwise(1).cast("long"))
    fitted = md.fit_runs(corpus, training, {0: 1.0, 1: 5.0}, mindf=2)
    scored = md.score_runs(corpus, training, fitted)
    got = {(r["run_id"], r["doc_id"]): r["p"] for r in scored.collect()}
    assert len(got) == 120

    feats, vocab = ft.vectorize(docs, mindf=2)
    rows = md.document_vectors(feats.select("doc_id", "idx", "w"), docs.select("doc_id", "label"), F.lit(vocab.count() + 1), keep=["label"])
    vectors = md.write_vectors(rows)
    plain = md.positive_score(md.fit_logistic(vectors), vectors, ["doc_id"])
    for r in plain.collect():
        assert got[(0, r["doc_id"])] == pytest.approx(r["p"], abs=1e-4)

    # Copies are the same as repeating the documents.
    thrice = docs.where("doc_id % 4 = 0")
    repeated = docs.unionByName(thrice.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(
        thrice.withColumn("doc_id", F.col("doc_id") + 2000)
    )
    feats, vocab = ft.vectorize(repeated, mindf=2)
    rows = md.document_vectors(
        feats.select("doc_id", "idx", "w"), repeated.select("doc_id", "label"), F.lit(vocab.count() + 1), keep=["label"]
    )
    vectors = md.write_vectors(rows)
    model = md.fit_class_weighted(vectors, [5.0])[5.0]
    for r in md.positive_score(model, vectors.where("doc_id < 1000"), ["doc_id"]).collect():
        assert got[(1, r["doc_id"])] == pytest.approx(r["p"], abs=1e-4)
    names = {r["term"] for r in md.feature_weights(fitted.coefs, fitted.vocab, ["run_id"]).where("run_id = 0").collect()}
    assert "language" in names and "signal" in names
    total = fitted.pair.groupBy("run_id").agg(F.sum("dt").alias("t"), F.sum("df").alias("f")).collect()
    assert all(r["t"] == pytest.approx(1) and r["f"] == pytest.approx(1) for r in total)


def test_ensemble(spark, tiny_corpus):
    ens, _ = ex.ensemble_fit(tiny_corpus, size=2, mindf=2)
    assert {r["run_id"] for r in ens.accuracy.collect()} == {0, 1}
    total, single = ex.ensemble_predict(ens, tiny_corpus.drop("label"), proba=True, indiv_preds=True)
    assert total.count() == 60 and single.count() == 120
    assert total.where("pred < 0 OR pred > 1").count() == 0
    labels = ex.ensemble_predict(ens, tiny_corpus.drop("label"), threshold=0.5)
    assert {f.dataType.simpleString() for f in labels.schema} == {"bigint", "boolean"}


def test_bootstrap_report(spark, sf_dir):
    train, test = train_test(spark, sf_dir)
    report, votes = ex.bootstrap_benchmark(train, test, 2, mindf=5, base_lang="en", test_frac=0.5)
    rows = {(r["calibrated"], r["proba"]): r for r in report.collect()}
    assert len(rows) == 4
    n = votes.count()
    actual = votes.agg(F.sum("label")).head()[0]
    mean = votes.agg(F.avg("raw_proba") - F.avg("label")).head()[0]
    assert all(r["tp"] == actual for r in rows.values())
    assert rows[(False, True)]["bias"] == pytest.approx(mean)
    assert rows[(False, True)]["bias"] == pytest.approx((rows[(False, True)]["pos_est"] - actual) / n)
    assert rows[(True, False)]["auroc"] == pytest.approx(rows[(True, False)]["ba"])


def test_cross_validation_with_and_without_calibration(spark, tiny_corpus, monkeypatch):
    feats, vocab = ft.vectorize(tiny_corpus, mindf=2)
    vectors = md.write_vectors(
        md.document_vectors(
            feats.select("doc_id", "idx", "w"), tiny_corpus.select("doc_id", "label"), F.lit(vocab.count() + 1), keep=["label"]
        )
    )
    scores, final = ex.cross_validate(vectors, folds=2, test=vectors)
    assert {(r["calibrated"], r["proba"]) for r in scores.collect()} == {(False, False), (False, True)}
    assert final.columns == ["doc_id", "y_test", "y_pred", "y_predP"] and final.count() == 60
    drawn, fits = [], []
    folds_of, fit = ex.sp.kfold_assign, ex.md.fit_logistic
    monkeypatch.setattr(ex.sp, "kfold_assign", lambda *a, **k: drawn.append(1) or folds_of(*a, **k))
    monkeypatch.setattr(ex.md, "fit_logistic", lambda *a, **k: fits.append(1) or fit(*a, **k))
    board = ex.benchmark_models(vectors, {"logistic": None}, folds=2)
    got = {(r["calibrated"], r["proba"]): r for r in board.drop("clf").collect()}
    # Both variants come from one draw of the folds and one fit a fold, and are what they are alone.
    assert len(drawn) == 1 and len(fits) == 2 and board.select("clf").distinct().head()[0] == "logistic"
    both = scores.collect() + ex.cross_validate(vectors, folds=2, calibrated=True)[0].collect()
    assert len(both) == len(got) == 4
    for row in both:
        mine = got[row["calibrated"], row["proba"]].asDict()
        assert mine == pytest.approx(row.asDict(), nan_ok=True)
    with pytest.raises(ValueError):
        md.positive_score(LinearSVC().fit(vectors), vectors, ["doc_id"])


class Parabola:
    """A custom density: rising for positives, falling for negatives."""

    def __init__(self, rising):
        self.rising, self.n = rising, 0

    def init(self, scores):
        self.n = scores.count()

    def pdf(self, p):
        return 2 * p if self.rising else 2 * (1 - p)


@pytest.mark.parametrize("density", ["radius", "sliding", "hist", "custom", "table"])
def test_calibrator_finds_a_shifted_share(spark, density):
    train = materialize(gen_binormal(spark, 2, 3000, 0.5, 7))
    batch = materialize(gen_binormal(spark, 2, 1500, 0.2, 11))
    to_vec = VectorAssembler(inputCols=["x"], outputCol="features")
    train = to_vec.transform(train).withColumn("label", F.col("y").cast("double"))
    batch = to_vec.transform(batch)
    use = density
    if density == "custom":
        use = (Parabola(True), Parabola(False))
    if density == "table":
        use = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.9), (0, 0, 0.9), (0, 1, 0.1)], "cls INT, bin INT, density DOUBLE")
    cal = Calibrator(LogisticRegression(), use, bins=10).fit(train)
    truth = batch.agg(F.avg(F.col("y").cast("double"))).head()[0]
    pi = cal.proportion(batch).head()["pi"]
    assert abs(pi - truth) < (0.05 if density in ("radius", "sliding", "hist") else 0.2)
    if density == "radius":
        pred = cal.predict(batch)
        share = pred.agg(F.avg(F.col("label_pred").cast("double"))).head()[0]
        assert share == pytest.approx(pi, abs=0.01)
        stored = cal.stored.head()["threshold"]
        again = cal.predict(batch, new_threshold=False)
        assert again.where("label_pred").count() == pred.where("label_pred").count()
        assert cal.stored.head()["threshold"] == stored
        proba = cal.predict_proba(batch)
        assert proba.agg(F.avg(F.col("proba")[1])).head()[0] == pytest.approx(pi, abs=0.01)
        assert cal.predict(batch, calibrated=False).count() == 1500
        near = cal.compare_dists(batch).head()
        far = cal.compare_dists(to_vec.transform(batch.drop("features").withColumn("x", F.col("x") + 2))).head()
        assert near["ks"] < 0.1 and far["chi2"] > near["chi2"]


def test_calibrator_rejects_bad_input(spark):
    for bad in ("nonsense", (Parabola(True),), (Parabola(True), object())):
        with pytest.raises(ValueError):
            Calibrator(density=bad)
    with pytest.raises(ValueError):
        Calibrator(object())


def test_stream_of_batches(spark, sf_dir):
    from sharewise.suite.common import test_rows as later_rows
    from sharewise.suite.common import train_rows

    pair = materialize(class_pair(density_sliding(train_rows(spark, sf_dir))))
    source, out, check = (shared_path(spark, n) for n in ("scores", "states", "progress"))
    later_rows(spark, sf_dir).select("p").repartition(2).write.parquet(source)
    stream = spark.readStream.schema("p DOUBLE").option("maxFilesPerTrigger", 1).parquet(source)
    calibrate_stream(stream, pair, out, check).awaitTermination()
    states = stream_states(spark, out).collect()
    assert len(states) == 2 and sum(r["n"] for r in states) == later_rows(spark, sf_dir).count()
    assert all(0.05 < r["pi"] < 0.35 for r in states)
    assert mt.score_histogram(later_rows(spark, sf_dir)).count() == 50


def run_rows(docs, runs):
    """Each run sees other documents, some of them several times."""
    each = docs.select(F.explode(F.array(*[F.lit(r) for r in runs])).alias("run_id"), "doc_id", "label")
    return each.where("doc_id % 5 <> run_id").withColumn("copies", (F.lit(1) + (F.col("doc_id") + F.col("run_id")) % 3).cast("long"))


@pytest.mark.parametrize("bound, dense, flags", [(1, 0.1, "mixed"), (25, 0.1, "mixed"), (10**6, 0.1, "constant"), (10**6, 2.0, "mixed")])
def test_runs_fitted_together_equal_runs_fitted_alone(spark, tiny_corpus, monkeypatch, bound, dense, flags):
    """One model per run, per group of runs, and one for all runs, with and without centred columns; optimum by Newton's method."""
    monkeypatch.setattr(md, "GROUP_COEFFICIENTS", bound)
    monkeypatch.setattr(md, "DENSE_SHARE", dense)
    runs = {0: 1.0, 1: 3.0, 2: 1.0, 3: 10.0}
    docs = tiny_corpus if flags == "mixed" else tiny_corpus.withColumn("lang", F.lit("other"))
    corpus = ft.corpus_terms(docs)
    training = run_rows(docs, runs)
    fitted = md.fit_runs(corpus, training, runs, mindf=2, calibrate=False)
    coefs = {(r["run_id"], r["idx"]): r["coef"] for r in fitted.coefs.collect()}
    heads = {r["run_id"]: r["intercept"] for r in fitted.heads.collect()}
    members = ft.unfold_runs(ft.assign_runs(corpus, training))
    weight = md.class_weight_column("label", md.by_run(runs), "copies")
    rows = md._weighted_entries(members, fitted.vocab, weight).collect()
    for run in runs:
        own = [r for r in rows if r["run_id"] == run]
        width = sum(k[0] == run for k in coefs)
        x = np.zeros((len(own), width))
        for i, r in enumerate(own):
            for e in r["entries"]:
                x[i, e["idx"]] = e["w"]
            x[i, -1] = r["language"]
        want = newton(x, np.array([r["label"] for r in own]), np.array([r["weight"] for r in own]))
        got = np.r_[heads[run], [coefs[run, i] for i in range(width)]]
        assert np.abs(got - want).max() < 1e-4


def test_bayes_runs_equal_the_vector_model(spark, tiny_corpus):
    """Closed form and relational scores against MLlib's fit of one run on vectors."""
    runs = [0, 1]
    corpus = ft.corpus_terms(tiny_corpus)
    training = run_rows(tiny_corpus, runs)
    fitted = md.fit_runs(corpus, training, runs, mindf=2, estimator="naive_bayes")
    scored = md.score_runs(corpus, training, fitted)
    members = ft.unfold_runs(ft.assign_runs(corpus, training))
    rows = md._weighted_entries(members, fitted.vocab, F.col("copies").cast("double"))
    for run in runs:
        size = fitted.vocab.where(F.col("run_id") == run).count()
        flag = F.when(F.col("language") != 0, F.array(F.struct(F.lit(size).alias("idx"), F.col("language").alias("w"))))
        entries = F.concat("entries", F.coalesce(flag, F.array().cast("array<struct<idx:int,w:double>>")))
        own = rows.where(F.col("run_id") == run).select("doc_id", "label", "weight", md.sparse_struct(entries, F.lit(size + 1)).alias("features"))
        vectors = md.write_vectors(own)
        model = NaiveBayes(weightCol="weight", smoothing=1.0).fit(vectors)
        want = {r["doc_id"]: r["p"] for r in md.positive_score(model, vectors, ["doc_id"]).collect()}
        got = {r["doc_id"]: r["p"] for r in scored.where(F.col("run_id") == run).collect()}
        assert got == pytest.approx(want, abs=1e-9)
    assert fitted.pair.groupBy("run_id").agg(F.sum("dt").alias("t")).where("abs(t - 1) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        md.fit_runs(corpus, training, runs, mindf=2, estimator="forest")


def scored_rows(spark):
    """Two overlapping classes of scores, and a batch in which some scores are missing and one is hot."""
    train = spark.range(400).select(
        (F.col("id") % 2).cast("double").alias("label"), ((F.col("id") * 37 % 100) / 200.0 + (F.col("id") % 2) * 0.4).alias("p")
    )
    batch = spark.range(300).select(
        "id", F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, 0.7).otherwise(F.col("id") * 53 % 300 / 300.0).alias("p")
    )
    return train, batch


@pytest.mark.parametrize("use", ["radius", "sliding", "hist"])
def test_rows_without_a_score_stay(spark, use):
    train, batch = scored_rows(spark)
    fitted = Calibrator(density=use, bins=10).fit(train)
    rows = fitted.predict_proba(batch).collect()
    assert sorted(r["id"] for r in rows) == list(range(300))
    assert all((r["p"] is None) == (r["proba"][1] is None) for r in rows if r["p"] is None)
    assert len({tuple(r["proba"]) for r in rows if r["p"] == 0.7}) == 1
    assert fitted.proportion(batch).head()["n"] == 270
    labels = {r["id"]: r["label_pred"] for r in fitted.predict(batch).collect()}
    assert len(labels) == 300 and all((labels[i] is None) == (i % 10 == 0) for i in labels)


def test_custom_table_with_gaps(spark):
    # Four cells, the second without a row: counting rows would take the table for three cells.
    table = spark.createDataFrame([(1, 3, 3.0), (1, 2, 1.0), (0, 0, 3.0), (0, 2, 1.0)], "cls INT, bin INT, density DOUBLE")
    train, _ = scored_rows(spark)
    fitted = Calibrator(density=table).fit(train)
    assert fitted.pair.count() == 4
    batch = spark.createDataFrame([(0.1,), (0.3,), (0.6,), (0.9,), (0.95,)], "p DOUBLE")
    share = fitted.proportion(batch).head()
    # 0.1 must be negative, 0.9 and 0.95 positive; 0.3 and 0.6 say nothing.
    assert share["pi"] == pytest.approx(2 / 3, abs=1e-6) and share["n"] == 5
    got = {r["p"]: r["proba"][1] for r in fitted.predict_proba(batch).collect()}
    assert (got[0.1], got[0.3], got[0.9]) == (0, None, 1) and got[0.6] == pytest.approx(2 / 3, abs=1e-6)


def test_the_classifier_scores_a_batch_once(spark, monkeypatch):
    train, batch = scored_rows(spark)
    pack = VectorAssembler(inputCols=["p"], outputCol="features")
    fitted = Calibrator(LogisticRegression(), "hist", bins=5).fit(pack.transform(train).drop("p"))
    calls, real = [], fitted._score
    monkeypatch.setattr(fitted, "_score", lambda rows, keep: calls.append(1) or real(rows, keep))
    rows = pack.transform(batch.na.fill(0.5, ["p"])).drop("p")
    for use in (fitted.predict, fitted.predict_proba, fitted.compare_dists):
        calls.clear()
        assert use(rows).count() > 0 and len(calls) == 1


@pytest.mark.parametrize("density", md.DENSITIES)
def test_every_density_by_run_equals_the_single_form(spark, tiny_corpus, density):
    """All runs are calibrated in one job as each would be by itself, copies repeated as rows."""
    runs = [0, 1]
    corpus = ft.corpus_terms(tiny_corpus)
    training = run_rows(tiny_corpus, runs)
    fitted = md.fit_runs(corpus, training, runs, mindf=2, estimator="naive_bayes", density=density)
    rows = tiny_corpus.select("doc_id", "label", F.explode(F.array(F.lit(0), F.lit(1))).alias("run_id"))
    pred, state = ex.predictions(corpus, rows, fitted)
    # Ranks see the last bit of a score, so both forms get the same ones.
    own = fitted.scores if density == "radius" else materialize(md.score_runs(corpus, training, fitted))
    for run in runs:
        repeated = own.where(F.col("run_id") == run).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        batch = materialize(pred.where(F.col("run_id") == run).withColumnRenamed("raw_proba", "p").select("doc_id", "p", "cal_label", "cal_proba"))
        single = Calibrator(density=density).fit(repeated.select("label", "p"))
        want = {r["doc_id"]: r["proba"][1] for r in single.predict_proba(batch.select("doc_id", "p")).collect()}
        label = {r["doc_id"]: r["label_pred"] for r in single.predict(batch.select("doc_id", "p")).collect()}
        got = batch.collect()
        assert len(got) == 60
        for r in got:
            assert r["cal_proba"] == pytest.approx(want[r["doc_id"]], abs=1e-6)
            assert r["cal_label"] == label[r["doc_id"]]
    assert state.count() == 2


def test_unknown_options_are_refused(spark, tiny_corpus):
    with pytest.raises(ValueError, match="unknown density"):
        md.fit_runs(tiny_corpus, tiny_corpus, [0], density="kernel")
    with pytest.raises(ValueError, match="unknown scorers"):
        mt.score_by(tiny_corpus, ["auc"])


def test_ensembles_and_folds_take_any_scorer(spark, tiny_corpus):
    """A scorer of the user's own: the share of rows predicted positive."""
    share = mt.Scorer(
        lambda pos, pred, hit: {"_all": F.count(F.lit(1)), "_hits": F.count_if(hit)}, lambda: F.col("_hits") / F.col("_all")
    )
    ens, _ = ex.ensemble_fit(tiny_corpus, size=2, mindf=2, estimator="naive_bayes", density="hist", scorer=share)
    rows = ens.accuracy.collect()
    assert len(rows) == 8 and all(0 <= r["accuracy"] <= 1 for r in rows)
    total = ex.ensemble_predict(ens, tiny_corpus.drop("label"), proba=True)
    assert total.count() == 60
    feats, vocab = ft.vectorize(tiny_corpus, mindf=2)
    size = F.lit(vocab.count() + 1)
    vectors = md.write_vectors(
        md.document_vectors(feats.select("doc_id", "idx", "w"), tiny_corpus.select("doc_id", "label"), size, keep=["label"])
    )
    bayes = NaiveBayes(featuresCol="features", labelCol="label")
    plain, _ = ex.cross_validate(vectors, folds=2, estimator=bayes)
    named, _ = ex.cross_validate(vectors, folds=2, estimator=bayes, scoring={"acc": mt.SCORERS["accuracy"], "mcc": mt.SCORERS["mcc"], "share": share})
    want = {r["proba"]: (r["acc"], r["mcc"]) for r in plain.collect()}
    got = {r["proba"]: (r["acc"], r["mcc"]) for r in named.collect()}
    assert set(got) == {False, True} and all(got[k] == pytest.approx(want[k]) for k in got)


def test_scores_of_odd_rows(spark):
    """Missing labels and predictions take no part; one class alone and certain errors have defined scores."""
    df = spark.createDataFrame(
        [("one", 1, 0.0), ("one", 1, 1.0), ("both", 0, 1.0), ("both", 1, 0.75), ("both", None, 0.5), ("both", 1, None), ("both", 0, float("nan"))],
        "k STRING, y INT, p DOUBLE",
    )
    got = {r["k"]: r.asDict() for r in mt.score_by(df, list(mt.SCORERS), ["k"]).collect()}
    assert got["one"]["balanced_accuracy"] == 0.5 and got["one"]["mcc"] == 0.0 and got["one"]["precision"] == 1.0
    assert got["one"]["neg_log_loss"] == pytest.approx(np.log(1e-15) / 2) and got["one"]["neg_brier"] == -0.5
    assert got["both"]["neg_brier"] == pytest.approx(-(1 + 0.0625) / 2) and got["both"]["f1"] == pytest.approx(2 / 3)
    assert mt.score_by(df.limit(0), ["accuracy", "f1"], ["k"]).count() == 0
