"""What a task or the driver holds does not grow with the input; results are those of the plain way."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.sql import functions as F
from test_models import newton

from sharewise.operators import experiments as ex
from sharewise.operators import features as ft
from sharewise.operators import joint
from sharewise.operators import models as md
from sharewise.operators import votes as vt
from sharewise.plans import by_rows, state, store
from sharewise.sources import sinks
from sharewise.suite import models as suite


def pairs(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_texts_are_dealt_by_their_bytes(spark, monkeypatch):
    """Twice the text gives twice the partitions, so a task counts the terms of as much text as before."""
    monkeypatch.setattr(ft, "DOCUMENT_PARTITION_BYTES", 1000)
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.md5(F.col("id").cast("string"))).alias("text"), F.lit("nl").alias("lang")
    )
    few, many = (ft.term_counts(docs.where(f"doc_id < {n}")) for n in (300, 600))
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (12, 24)
    packed = ft.corpus_terms(docs)
    assert ft.packed_by_document(packed).rdd.getNumPartitions() == 15
    terms = ft.unfold_terms(packed)
    assert pairs(terms, "doc_id", "term", "tf") == pairs(many, "doc_id", "term", "tf")
    assert terms.count() == 1200
    nothing = ft.term_counts(docs.where("doc_id < 0"))
    assert nothing.count() == 0


@pytest.mark.parametrize("entries, piece", [(1 << 20, 1 << 15), (500, 16)])
def test_runs_fitted_side_by_side_reach_the_optimum(spark, monkeypatch, entries, piece):
    """Rare, common and heavy columns, one block and piece a run or many; few evaluations, and one class alone."""
    monkeypatch.setattr(joint, "BLOCK_ENTRIES", entries)
    taken = []
    step = joint._step
    monkeypatch.setattr(joint, "_step", lambda *a: taken.append(1) or step(*a))
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for run, (n, v, positive) in enumerate([(200, 40, 1.0), (300, 50, 100.0)]):
        x = (rng.random((n, v)) < np.r_[0.9, 1.0, rng.uniform(0.02, 0.3, v - 2)]) * rng.uniform(0.1, 1, (n, v))
        y = (rng.random(n) < 1 / (1 + np.exp(-(x @ rng.normal(size=v) * 2 - 1)))).astype(float)
        w = np.where(y == 1, positive, 1.0) * rng.integers(1, 3, n)
        want[run] = newton(x, y, w)
        rows += [(run, float(a), float(b), [(int(j), float(r[j])) for j in np.nonzero(r)[0]]) for r, a, b in zip(x, y, w)]
    rows += [(7, 1.0, 1.0, [(0, 1.0)]), (7, 1.0, 1.0, [])]
    df = store(spark.createDataFrame(rows, "run_id int, label double, weight double, entries array<struct<idx:int,w:double>>"))
    coefs, intercepts = joint.fit_joint(df, {0: 40, 1: 50, 7: 2}, piece=piece)
    found = {(r["run_id"], r["idx"]): r["coef"] for r in coefs.collect()}
    heads = {r["run_id"]: r["intercept"] for r in intercepts.collect()}
    assert len(found) == 92
    for run, optimum in want.items():
        got = np.r_[heads[run], [found[run, i] for i in range(len(optimum) - 1)]]
        assert np.abs(got - optimum).max() < 1e-4
    assert heads[7] == np.inf and found[7, 0] == found[7, 1] == 0
    assert len(taken) < 80


def test_wide_predictions_are_dealt_by_their_rows(spark, monkeypatch):
    """Twice the rows give twice the partitions; columns and rows are those of a plain pivot, null keys included."""
    monkeypatch.setattr(state, "PARTITION_ROWS", 100)
    long = spark.range(800).select(
        F.when(F.col("id") % 100 != 98, F.col("id") % 2).cast("int").alias("replicate_id"), F.floor(F.col("id") / 4).alias("doc_id"),
        F.when(F.col("id") % 4 < 2, "a").otherwise("b").alias("variant"), (F.col("id") / 7).alias("pred"),
    )
    assert [by_rows(long.where(f"id < {n}"), ["doc_id"]).rdd.getNumPartitions() for n in (400, 800)] == [4, 8]
    ids = ["replicate_id", "doc_id"]
    got = sinks.predictions_wide(long, ids, ["a", "b"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
    want = long.groupBy(*ids).agg(*[F.max(F.when(F.col("variant") == v, F.col("pred"))).alias(v) for v in "ab"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_single_model_needs_no_vector_on_the_driver(spark, monkeypatch):
    """The registered fits of one model: coefficients and scores are those of MLlib on vectors."""
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    docs = spark.createDataFrame(
        [(i, " ".join(words[(i * (k + 1) + k) % 5] for k in range(4)), "en" if i % 2 else "nl", float(i % 3 == 0)) for i in range(60)],
        "doc_id BIGINT, text STRING, lang STRING, label DOUBLE",
    )
    vectors, _ = (monkeypatch.setattr(suite, "labelled", lambda *_: docs), suite.training_vectors(spark, ""))[1]
    model = md.fit_logistic(vectors, tol=1e-10)
    want = {r["doc_id"]: r["p"] for r in md.positive_score(model, vectors, ["doc_id"]).collect()}
    monkeypatch.setattr(md, "fit_logistic", None)
    coefs = {r["idx"]: r["coef"] for r in suite.fit_logistic(spark, "").collect()}
    assert coefs == pytest.approx(dict(enumerate(model.coefficients.toArray())), abs=1e-4)
    rows, width, _ = suite.training_entries(spark, "")
    got = {r["doc_id"]: r["p"] for r in md.score_entries(rows, *md.fit_entries(rows, width), ["doc_id"]).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_folds_are_fitted_without_a_vector_on_the_driver(spark, monkeypatch):
    """Every default classifier: the scores of each fold are those of MLlib's fit on the other folds."""
    words = [f"word{k}" for k in range(12)]
    docs = spark.createDataFrame(
        [(i, " ".join(words[(i * (k + 3) + k * k) % 12] for k in range(5)), "en" if i % 4 else "nl", float((i * i) % 5 == 1)) for i in range(90)],
        "doc_id BIGINT, text STRING, lang STRING, label DOUBLE",
    )
    monkeypatch.setattr(suite, "labelled", lambda *_: docs)
    vectors, _ = suite.training_vectors(spark, "")
    rows, width, _ = suite.training_entries(spark, "")
    placed, side = ex._placed(vectors, 3, "folds"), ex._placed(rows, 3, "folds")
    own = {"logistic": None, "naive_bayes": NaiveBayes(), "ridge_logistic": LogisticRegression(regParam=0.1, tol=1e-12, maxIter=500)}
    fit = md.fit_logistic
    for name, estimator in own.items():
        monkeypatch.setattr(md, "fit_logistic", lambda train: fit(train, tol=1e-12))
        cols = ["doc_id", "fold", "raw_proba"]
        want = {r[0]: tuple(r[1:]) for r in ex._fold_predictions(placed, 3, estimator, False).select(cols).collect()}
        monkeypatch.setattr(md, "fit_logistic", None)
        for calibrated in (False, True):
            pred, final = ex._side_by_side(side, width, 3, name, calibrated, rows)
            got = {r[0]: tuple(r[1:]) for r in pred.select(cols).collect()}
            assert len(got) == pred.count() == 90 and all(got[d] == pytest.approx(want[d], abs=2e-5) for d in want)
            assert calibrated == ("cal_proba" in pred.columns) and final.count() == 90
        whole = (fit(vectors, tol=1e-12) if estimator is None else estimator.fit(vectors))
        one = {r["doc_id"]: r["p"] for r in md.positive_score(whole, vectors, ["doc_id"]).collect()}
        assert {r["doc_id"]: r["raw_proba"] for r in final.collect()} == pytest.approx(one, abs=2e-5)
    scores, _ = ex.cross_validate(rows, folds=3, width=width)
    assert scores.count() == 2
    board = ex.benchmark_models(rows, folds=3, width=width)
    assert {tuple(r) for r in board.select("clf", "calibrated", "proba").collect()} == {(c, a, b) for c in own for a in (False, True) for b in (False, True)}
    with pytest.raises(ValueError):
        md.fit_folds(side.withColumn("label", F.lit(None).cast("double")), width, [0, 1, 2])


def test_many_word_vectors_are_tiled(spark, monkeypatch):
    """Means by tiles are those of broadcast vectors, and no joined row carries a vector to its document."""
    tf = store(spark.range(3000).select(
        F.floor(F.col("id") / 25).alias("doc_id"), F.concat(F.lit("w"), F.col("id") * 7 % 211).alias("term"), (F.col("id") % 3 + 1).alias("tf")
    ))
    docs = spark.range(125).select(F.col("id").alias("doc_id"))
    values = F.array(*[(F.xxhash64("term", F.lit(k)) % 1000 / 100).cast("float") for k in range(5)])
    vectors = store(spark.range(150).select(F.concat(F.lit("w"), "id").alias("term")).withColumn("vec", values))
    # A term of two vectors counts with both; a null one with neither.
    vectors = store(vectors.unionByName(vectors.where("term = 'w9'")).unionByName(vectors.limit(1).withColumn("term", F.lit(None).cast("string"))))
    want = {r["doc_id"]: r["embedding"] for r in ft.mean_embedding(tf, docs, vectors).collect()}
    monkeypatch.setattr(ft, "VECTOR_TILE_BYTES", 2000)
    monkeypatch.setattr(ft, "VECTOR_TILE_ROWS", 100)
    tiled = ft.mean_embedding(tf, docs, vectors)
    plan = tiled._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "_salt" not in plan
    got = {r["doc_id"]: r["embedding"] for r in tiled.collect()}
    assert len(got) == 125 and got[124] == [0.0] * 5
    assert all(got[d] == pytest.approx(want[d]) for d in want) and set(got) == set(want)
    gaps = vectors.withColumn("vec", F.when(F.col("term") != "w3", F.col("vec")))
    with pytest.raises(Exception, match="one length"):
        ft.mean_embedding(tf, docs, gaps).collect()


def test_large_joins_are_dealt_by_their_bytes(spark, monkeypatch, settings):
    """More rows give more partitions of a salted join, however few the session's shuffles have; one key holds a third."""
    monkeypatch.setattr(state, "JOIN_PARTITION_BYTES", 2000)
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 500 == 2, None).otherwise(F.col("id")).alias("k"))
    table = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    with settings(spark__sql__shuffle__partitions="4", spark__sql__adaptive__enabled="false"):
        for how in ("inner", "left"):
            few, many = (state.lookup(rows.where(f"id < {n}"), table, ["k"], how, broadcast_rows=10) for n in (1000, 4000))
            assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (32, 56)
            want = rows.join(table, "k", how)
            assert pairs(many.fillna(-1), "id", "k", "v") == pairs(want.fillna(-1), "id", "k", "v")


def test_lists_of_a_document_are_collected_by_bytes(spark, monkeypatch, settings):
    """Twice the documents give twice the partitions in which their entries are collected, and the same entries."""
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("word"), (F.col("id") % 7).cast("string"))).alias("text"), F.lit("nl").alias("lang")
    )
    corpus = ft.corpus_terms(docs)
    rows = docs.select(F.lit(0).alias("run_id"), "doc_id", (F.col("doc_id") % 2).cast("double").alias("label"), F.lit(1).cast("long").alias("copies"))
    members = ft.unfold_runs(ft.assign_runs(corpus, rows))
    vocab = ft.fit_vectorizer(ft.unfold_terms(corpus), docs, 5).withColumn("run_id", F.lit(0)).cache()
    whole = pairs(md._weighted_entries(members, vocab, F.lit(1.0)), "doc_id", "entries")
    with settings(spark__sql__shuffle__partitions="4", spark__sql__adaptive__enabled="false"):
        monkeypatch.setattr(ft, "DOCUMENT_PARTITION_BYTES", 1200)
        half, every = (md._weighted_entries(members.where(f"doc_id < {n}"), vocab, F.lit(1.0)) for n in (300, 600))
        assert (half.rdd.getNumPartitions(), every.rdd.getNumPartitions()) == (6, 12)
        assert pairs(every, "doc_id", "entries") == whole
        again = ft.unfold_runs(ft.assign_runs(corpus, rows))
        assert again.exceptAll(members).count() == 0 and members.exceptAll(again).count() == 0


@pytest.mark.parametrize("n", [3, 70])
def test_members_are_counted_without_a_row_each(spark, n):
    """A term of many members is one row of the count; more members than one number has bits, unknown terms, no members."""
    terms = spark.range(400).select((F.col("id") % 20).cast("int").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 90).cast("string")).alias("term"))
    known = spark.range(80 * n).select((F.col("id") % n).cast("int").alias("member_id"), F.floor(F.col("id") / n).alias("t")).where("(t + member_id) % 3 > 0")
    known = known.select("member_id", F.concat(F.lit("t"), F.col("t").cast("string")).alias("term"))
    table = store(vt.members_by_term(known))
    got = vt.feature_intersection(terms, table)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = terms.join(known, "term").groupBy("doc_id", "member_id").agg(F.count(F.lit(1)).alias("shared"))
    assert got.schema["shared"].dataType == want.schema["shared"].dataType and got.columns == want.columns
    assert pairs(got, *want.columns) == pairs(want, *want.columns)
    assert vt.feature_intersection(terms, table.where("false")).count() == 0


def test_votes_are_dealt_by_their_rows(spark, monkeypatch, settings):
    """More pairs than the session's partitions hold give more partitions, and the same weights and votes."""
    terms = spark.range(600).select((F.col("id") % 60).alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 70).cast("string")).alias("term"))
    known = spark.range(200).select((F.col("id") % 3).alias("member_id"), F.concat(F.lit("t"), (F.col("id") % 50).cast("string")).alias("term")).distinct()
    every = spark.range(186).select((F.col("id") % 62).alias("doc_id"), F.floor(F.col("id") / 62).alias("member_id"))
    table = store(vt.members_by_term(known))

    def votes(**rows):
        weights = vt.overlap_weights(terms, table, every, **rows)
        return vt.weighted_vote(weights, weights.select("doc_id", "member_id", (F.col("member_id") + F.col("w")).alias("pred")), **rows)

    want = votes()
    with settings(spark__sql__shuffle__partitions="4", spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        monkeypatch.setattr(state, "PARTITION_ROWS", 20)
        plan = votes(rows=186)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("REPARTITION_BY_NUM") >= 6 and ", 10)" in plan
        assert [(d, round(p, 9)) for d, p in pairs(votes(rows=186), "doc_id", "pred")] == [(d, round(p, 9)) for d, p in pairs(want, "doc_id", "pred")]
