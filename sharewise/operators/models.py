"""Logistic regression on long-form text features.

Training vectors are written once, as a table, and read back as MLlib vectors, so no Python
touches a row.  Scoring needs no vectors at all: one aggregation over (document, term)
rows gives the dot product and the document's length together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharewise.functions.scores import sigmoid
from sharewise.operators import features as ft
from sharewise.operators.density import class_pair, density_hist, density_sliding
from sharewise.operators.joint import fit_joint
from sharewise.plans import attach, discard, lookup, materialize, shared_path, store

#: Fits submitted to Spark together.
PARALLEL_FITS = 4

#: Coefficients of a run are kept in pieces of at most this many; a piece holds some twenty vectors of them.
GROUP_COEFFICIENTS = 1 << 15

#: Columns with a value in at least this share of a run's rows are centred during a fit.
DENSE_SHARE = 0.0

#: Vectors are read in partitions of about so many bytes, as every step of a fit visits them all.
VECTOR_PARTITION_BYTES = 16 << 20

#: Steps after which a fit that has not converged is an error.
MOST_STEPS = 1000


# --- the objective and one fit ----------------------------------------------------------


def fit_logistic(
    train: DataFrame,
    label: str = "label",
    weight: str | None = None,
    C: float = 1.0,
    features: str = "features",
    total: float | None = None,
    tol: float = 1e-6,
    intercept: bool = True,
):
    """L2 logistic regression minimising C * sum of weighted losses + |coef|^2 / 2.

    MLlib averages the loss over the total weight, hence its penalty is 1 / (C * total).
    The intercept is not penalised and the features are not rescaled.  The partitions are those
    of ``train``.  Raises when the optimiser stops at the step limit.
    """
    if total is None:
        total = train.agg(F.sum(F.col(weight) if weight else F.lit(1.0)).cast("double")).head()[0]
    lr = LogisticRegression(
        featuresCol=features,
        labelCol=label,
        regParam=1.0 / (C * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=MOST_STEPS,
        tol=tol,
        fitIntercept=intercept,
        # A block costs a dense gradient, so there is about one a partition.
        maxBlockSizeInMB=VECTOR_PARTITION_BYTES / 2**20,
    )
    if weight:
        lr = lr.setWeightCol(weight)
    model = lr.fit(train)
    if model.summary.totalIterations >= MOST_STEPS:
        raise RuntimeError(f"the fit did not converge in {MOST_STEPS} steps")
    return model


def class_weight_column(label: str, positive_weight: float | Column, copies: str | None = None) -> Column:
    """Weight of a training row: the class weight times the number of copies."""
    w = positive_weight if isinstance(positive_weight, Column) else F.lit(float(positive_weight))
    base = F.when(F.col(label) == 1, w).otherwise(F.lit(1.0))
    return base * F.col(copies) if copies else base


def class_weight_grid(steps: int, low: float = 0.1, high: float = 2.0) -> list[float]:
    """``steps`` positive-class weights, even on the log scale from 10^low to 10^high."""
    return [float(w) for w in np.logspace(low, high, steps)]


def fit_class_weighted(
    train: DataFrame,
    weights: Iterable[float],
    label: str = "label",
    C: float = 1.0,
    features: str = "features",
    tol: float = 1e-6,
) -> dict[float, Any]:
    """One model per positive-class weight."""
    weights = list(weights)

    def one(w: float):
        return fit_logistic(train.withColumn("_w", class_weight_column(label, w)), label, "_w", C, features, tol=tol)

    return dict(zip(weights, in_parallel(one, weights)))


def in_parallel(work: Callable[[Any], Any], items: Sequence[Any]) -> list[Any]:
    """Submit several Spark jobs together; each fit is itself distributed."""
    if len(items) <= 1:
        return [work(i) for i in items]
    spark = SparkSession.active()
    with ThreadPool(min(PARALLEL_FITS, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items)


# --- vectors at the model edge ----------------------------------------------------------


def sparse_struct(entries: Column, size: Column) -> Column:
    """Sorted ``array<struct<idx, w>>`` to the storage layout of a sparse MLlib vector."""
    return F.struct(
        F.lit(0).cast("byte").alias("type"),
        size.cast("int").alias("size"),
        F.transform(entries, lambda e: e["idx"].cast("int")).alias("indices"),
        F.transform(entries, lambda e: e["w"].cast("double")).alias("values"),
    )


def write_vectors(rows: DataFrame, partition_by: Sequence[str] = (), column: str = "features") -> DataFrame:
    """Store a frame with a :func:`sparse_struct` column; read it back with real vectors."""
    spark = rows.sparkSession
    path = shared_path(spark, "vectors")
    writer = rows.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    entries = spark.read.schema(rows.schema).parquet(path).agg(F.sum(F.size(f"{column}.indices"))).head()[0] or 0
    fields = [
        T.StructField(f.name, VectorUDT() if f.name == column else f.dataType) for f in rows.schema.fields
    ]
    vectors = spark.read.schema(T.StructType(fields)).parquet(path)
    return vectors.coalesce(max(1, -(-12 * entries // VECTOR_PARTITION_BYTES)))


def document_vectors(
    weights: DataFrame, docs: DataFrame, size: Column, id_col: str = "doc_id", keep: Sequence[str] = ()
) -> DataFrame:
    """Long weights (id, idx, w) to one vector per document, empty where no term is known."""
    entries = weights.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("_e"))
    empty = F.array().cast("array<struct<idx:int,w:double>>")
    return docs.join(entries, id_col, "left").select(
        id_col, *keep, sparse_struct(F.coalesce("_e", empty), size).alias("features")
    )


def document_entries(weights: DataFrame, docs: DataFrame, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """Long weights (id, idx, w) to one stored row per document: (id, keep, entries), empty where no term is known."""
    entries = weights.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("_e"))
    empty = F.array().cast("array<struct<idx:int,w:double>>")
    return store(docs.join(entries, id_col, "left").select(id_col, *keep, F.coalesce("_e", empty).alias("entries")), "entries")


def fit_entries(
    rows: DataFrame, width: int, weights: Sequence[float] = (1.0,), label: str = "label", C: float = 1.0
) -> tuple[DataFrame, DataFrame]:
    """(run_id, idx, coef) and (run_id, intercept) of one logistic regression per positive-class weight, numbered in order.

    ``rows`` are those of :func:`document_entries`.  The objective is that of :func:`fit_logistic`; no vector comes to the driver.
    """
    # No row is held out, and all runs share the rows: a run only weighs the classes otherwise.
    shared = rows.select(F.lit(-1).alias("held"), F.col(label).alias("label"), F.lit(1.0).alias("weight"), "entries")
    classes = dict(enumerate(map(float, weights)))
    return fit_joint(shared, {r: width for r in classes}, C, GROUP_COEFFICIENTS, DENSE_SHARE, held="held", classes=classes)


def score_entries(rows: DataFrame, coefs: DataFrame, intercepts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(run_id, keep, p): every row of :func:`document_entries` by every model of :func:`fit_entries`."""
    placed = store(
        rows.select(F.monotonically_increasing_id().alias("_row"), *keep, "entries").join(
            F.broadcast(intercepts.select("run_id", "intercept"))
        ),
        "placed",
    )
    known = lookup(placed.select("_row", "run_id", F.inline("entries")), coefs, ["run_id", "idx"])
    dots = known.groupBy("_row", "run_id").agg(F.sum(F.col("w") * F.col("coef")).alias("_dot"))
    p = sigmoid(F.coalesce("_dot", F.lit(0.0)) + F.col("intercept"))
    return placed.drop("entries").join(dots, ["_row", "run_id"], "left").select("run_id", *keep, p.alias("p"))


#: Linear classifiers that :func:`fit_folds` fits for all folds side by side, and MLlib's penalty of a standardised one.
FOLD_CLASSIFIERS = {"logistic": None, "naive_bayes": None, "ridge_logistic": 0.1}


def fit_folds(rows: DataFrame, width: int, runs: Sequence[int], estimator: str = "logistic") -> tuple[DataFrame, DataFrame]:
    """(run_id, idx, coef) and (run_id, intercept): for every run, the fit on all rows whose ``fold`` is another.

    ``rows`` is a stored table (label, fold, entries) over ``width`` columns; ``estimator`` is one of ``FOLD_CLASSIFIERS``:
    the objective of :func:`fit_logistic`, MLlib's multinomial naive Bayes, or its standardised ridge.  The rows are kept
    once for all runs, and no vector comes to the driver.
    """
    if estimator not in FOLD_CLASSIFIERS:
        raise ValueError(f"unknown classifier {estimator!r}")
    if rows.where(F.col("label").isNull() | ~F.col("label").isin(0.0, 1.0)).limit(1).count():
        raise ValueError("labels must be 0 or 1")
    if estimator == "naive_bayes":
        return _fold_bayes(rows, width, runs)
    weighted = rows.select("fold", "label", F.lit(1.0).alias("weight"), "entries")
    return fit_joint(
        weighted, {r: width for r in runs}, 1.0, GROUP_COEFFICIENTS, DENSE_SHARE, held="fold", regParam=FOLD_CLASSIFIERS[estimator]
    )


def _fold_bayes(rows: DataFrame, width: int, runs: Sequence[int], smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Naive Bayes in closed form (see :func:`fit_class_terms`), from the sums of every (column, fold, class)."""
    spark, s = rows.sparkSession, F.lit(float(smoothing))
    each = F.explode(F.array(*[F.lit(r) for r in runs])).alias("run_id")
    own = lambda c: F.sum(F.when(F.col("fold") != F.col("run_id"), F.col(c)).otherwise(0.0)).alias(c)
    of = lambda cls, value, name: F.sum(F.when(F.col("label") == cls, value).otherwise(0.0)).alias(name)
    sums = rows.select("fold", "label", F.inline("entries")).groupBy("idx", "fold").agg(of(1, F.col("w"), "pos"), of(0, F.col("w"), "neg"))
    # A column that a run has not seen has a coefficient too.
    every = spark.range(width).select(F.col("id").cast("int").alias("idx"), F.lit(-1).alias("fold"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"))
    terms = store(sums.unionByName(every).select("*", each).groupBy("run_id", "idx").agg(own("pos"), own("neg")), "class_terms")
    whole = terms.groupBy("run_id").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    sizes = rows.groupBy("fold").agg(of(1, F.lit(1.0), "n_pos"), of(0, F.lit(1.0), "n_neg"))
    classes = sizes.select("*", each).groupBy("run_id").agg(own("n_pos"), own("n_neg"))
    state = materialize(whole.join(classes, "run_id"))
    joined = attach(terms, state, ["run_id"], ["all_pos", "all_neg"])
    ratio = lambda a, n: F.ln((F.col(a) + s) / (F.col(n) + s * width))
    coefs = store(joined.select("run_id", "idx", (ratio("pos", "all_pos") - ratio("neg", "all_neg")).alias("coef")), "coefficients")
    return coefs, state.select("run_id", (F.ln(F.col("n_pos") + s) - F.ln(F.col("n_neg") + s)).alias("intercept"))


def score_folds(
    rows: DataFrame, coefs: DataFrame, intercepts: DataFrame, runs: Sequence[int], keep: Sequence[str], held: str | None = None
) -> DataFrame:
    """(run_id, keep, p), stored: every row by the models of all ``runs``, or by that of its own column ``held`` alone.

    The coefficients of a column stand side by side, so an entry meets them once for all runs.
    """
    runs = list(runs)
    name = lambda r: f"_c{r}"
    wide = store(
        coefs.groupBy("idx").agg(*[F.coalesce(F.max(F.when(F.col("run_id") == r, F.col("coef"))), F.lit(0.0)).alias(name(r)) for r in runs]),
        "coefficients",
    )
    placed = store(rows.select(F.monotonically_increasing_id().alias("_row"), *keep, "entries"), "placed")
    known = lookup(placed.select("_row", *([held] if held else []), F.inline("entries")), wide, ["idx"])
    if held:
        own = reduce(lambda past, r: past.when(F.col(held) == r, F.col(name(r))), runs, F)
        dots = known.groupBy("_row").agg(F.sum(F.col("w") * own).alias("_dot"))
        scored = placed.drop("entries").join(dots, "_row", "left").withColumn("run_id", F.col(held).cast("int"))
    else:
        dots = known.groupBy("_row").agg(*[F.sum(F.col("w") * F.col(name(r))).alias(name(r)) for r in runs])
        listed = F.explode(F.array(*[F.struct(F.lit(r).alias("run_id"), F.col(name(r)).alias("_dot")) for r in runs])).alias("_m")
        scored = placed.drop("entries").join(dots, "_row", "left").select("_row", *keep, listed).select("_row", *keep, "_m.*")
    p = sigmoid(F.coalesce("_dot", F.lit(0.0)) + F.col("intercept"))
    done = store(attach(scored, materialize(intercepts), ["run_id"], ["intercept"]).select("run_id", *keep, p.alias("p")), "scored")
    discard(placed)
    discard(wide)
    return done


def positive_score(model, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Transform with any MLlib probabilistic classifier: (keep, p)."""
    out = model.transform(rows)
    if "probability" not in out.columns:
        raise ValueError(f"{type(model).__name__} gives no class probabilities")
    return out.select(*keep, vector_to_array("probability")[1].alias("p"))


# --- coefficients as tables -------------------------------------------------------------


def coefficient_rows(spark: SparkSession, coefficients: np.ndarray) -> DataFrame:
    """(idx, coef) of one fitted model."""
    frame = pd.DataFrame(
        {"idx": np.arange(len(coefficients), dtype="int32"), "coef": np.asarray(coefficients, dtype="float64")}
    )
    return spark.createDataFrame(frame, "idx int, coef double")


def feature_weights(coefs: DataFrame, vocab: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, term, coef): coefficients by name; the one past the vocabulary is the language."""
    named = coefs.join(vocab.select(*keys, "idx", "term"), [*keys, "idx"], "left")
    return named.select(*keys, F.coalesce("term", F.lit("language")).alias("term"), "coef")


def top_features(weights: DataFrame, k: int = 20) -> DataFrame:
    """(side, term, coef): the k largest and the k smallest coefficients; ties by term."""
    top = weights.orderBy(F.desc("coef"), "term").limit(k).withColumn("side", F.lit("positive"))
    low = weights.orderBy("coef", "term").limit(k).withColumn("side", F.lit("negative"))
    return top.unionByName(low).select("side", "term", "coef")


def score_linear(
    tf: DataFrame,
    docs: DataFrame,
    model: DataFrame,
    heads: DataFrame,
    keys: Sequence[str] = (),
    id_col: str = "doc_id",
    flag: str = "language",
) -> DataFrame:
    """Add ``p = sigmoid(x . coef + intercept)`` to ``docs``, x being the TF-IDF row plus the flag.

    ``model`` is (keys, term, idf, coef); ``heads`` is (keys, intercept, language_coef), one row
    per model.  ``docs`` lists (keys, id, flag); with keys it says who is scored by which model,
    and ``tf`` carries the same keys.  A document without known terms keeps flag and intercept.
    """
    keys = list(keys)
    x = (F.lit(1.0) + F.ln("tf")) * F.col("idf")
    dots = (
        lookup(tf, model, [*keys, "term"])
        .groupBy(*keys, id_col)
        .agg(F.sum(x * F.col("coef")).alias("_dot"), F.sum(x * x).alias("_len2"))
    )
    joined = attach(docs.join(dots, [*keys, id_col], "left"), heads, keys, ["intercept", "language_coef"])
    return joined.withColumn("p", linear_p(flag)).drop("_dot", "_len2", "intercept", "language_coef")


def linear_p(flag: str) -> Column:
    """Probability from dot product, squared length, language flag and the model's head."""
    return sigmoid(
        F.coalesce(F.try_divide(F.col("_dot"), F.sqrt("_len2")), F.lit(0.0))
        + F.col(flag) * F.col("language_coef")
        + F.col("intercept")
    )


# --- many runs in one job ---------------------------------------------------------------


@dataclass
class FittedRuns:
    """Models of all runs (replicates, members, weights ...) as tables keyed by ``run_id``."""

    vocab: DataFrame  #: run_id, term, df, idx, idf
    model: DataFrame  #: run_id, term, idx, idf, coef
    heads: DataFrame  #: run_id, intercept, language_coef
    pair: DataFrame | None  #: run_id, bin, dt, df; none for the radius density
    coefs: DataFrame  #: run_id, idx, coef
    density: str = "sliding"  #: kind of density, one of ``DENSITIES``
    scores: DataFrame | None = None  #: run_id, label, p, copies: training scores, for the radius density alone


#: Densities that all runs can be calibrated with.
DENSITIES = ("sliding", "hist", "radius")


def fit_runs(
    corpus: DataFrame,
    training: DataFrame,
    runs: Mapping[int, float] | Sequence[int],
    mindf: int = 50,
    C: float = 1.0,
    calibrate: bool = True,
    estimator: str = "logistic",
    density: str = "sliding",
) -> FittedRuns:
    """Vectorise, fit and calibrate every run.

    ``corpus`` comes from :func:`features.corpus_terms`; ``training`` is (run_id, doc_id, label,
    copies); ``runs`` lists the run ids, with the positive-class weight of each if it is a
    mapping.  The corpus is joined to its runs once; all runs share the counting, weighting,
    fitting and scoring jobs.  ``estimator`` is ``logistic`` (see :func:`fit_blocks`) or
    ``naive_bayes`` (see :func:`fit_class_terms`); both give a linear model, scored alike.
    ``density`` is that of the training scores, one of ``DENSITIES``.
    """
    if density not in DENSITIES:
        raise ValueError(f"unknown density {density!r}")
    if estimator not in ("logistic", "naive_bayes"):
        raise ValueError(f"unknown estimator {estimator!r}")
    weights = dict(runs) if isinstance(runs, Mapping) else {r: 1.0 for r in runs}
    run = ["run_id"]
    assigned = ft.assign_runs(corpus, training)
    members = ft.unfold_runs(assigned)
    n_docs = materialize(ft.count_documents(members, run, "copies"))
    terms = ft.unfold_terms(members)
    vocab = materialize(ft.fit_idf(ft.fit_vocabulary(terms, mindf, run, "copies"), n_docs, run))
    sizes = materialize(
        n_docs.join(vocab.groupBy("run_id").agg(F.count(F.lit(1)).alias("v")), run, "left")
        .select("run_id", F.coalesce("v", F.lit(0)).alias("v"))
    )
    weighted = _weighted_entries(members, vocab, class_weight_column("label", by_run(weights), "copies"))
    if estimator == "naive_bayes":
        coefs, intercepts = fit_class_terms(weighted, sizes)
    else:
        coefs, intercepts = fit_blocks(weighted, sizes, C)
    model = materialize(vocab.join(coefs, ["run_id", "idx"]).select("run_id", "term", "idx", "idf", "coef"))
    language = coefs.join(sizes, run).where(F.col("idx") == F.col("v")).select("run_id", F.col("coef").alias("language_coef"))
    heads = materialize(intercepts.join(language, run))
    fitted = FittedRuns(vocab, model, heads, None, coefs, density)
    if calibrate:
        scored = score_assigned(assigned, fitted)
        if density == "radius":
            fitted.scores = store(scored.select("run_id", "label", "p", "copies"), "train_scores")
        else:
            of = density_hist if density == "hist" else density_sliding
            fitted.pair = materialize(class_pair(of(scored, run, "label", "p", copies="copies"), run))
    discard(assigned)
    return fitted


def by_run(values: Mapping[int, Any], key: str = "run_id") -> Column:
    """The value of a row's run, from one value per run."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(key))


def _weighted_entries(members: DataFrame, vocab: DataFrame, weight: Column) -> DataFrame:
    """run_id, doc_id, label, weight, language and entries: the TF-IDF row (idx, w) of unit length, in order."""
    doc = ["run_id", "doc_id", "label", "copies", "language"]
    value = (F.lit(1.0) + F.ln("tf")) * F.col("idf")
    known = lookup(_outer_terms(members, doc), vocab.select("run_id", "term", "idx", "idf"), ["run_id", "term"], "left")
    # The lists of a document are collected where it lands: a task's share is bounded, however many documents there are.
    known = ft.apart(known, ft.term_bytes(members))
    entries = known.groupBy(*doc).agg(
        F.array_sort(
            F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", value.alias("w"))))
        ).alias("_e"),
        F.sqrt(F.sum(value * value)).alias("_len"),
    )
    scaled = F.transform("_e", lambda e: F.struct(e["idx"].cast("int").alias("idx"), (e["w"] / F.col("_len")).alias("w")))
    return entries.select(
        "run_id", "doc_id", F.col("label").cast("double").alias("label"), weight.alias("weight"), "language", scaled.alias("entries")
    )


def fit_blocks(weighted: DataFrame, sizes: DataFrame, C: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(run_id, idx, coef) and (run_id, intercept) of one logistic regression per run.

    Runs are fitted side by side, see :mod:`sharewise.operators.joint`; the language flag is the column after the last term.
    """
    flag = F.array(F.struct(F.col("v").cast("int").alias("idx"), F.col("language").cast("double").alias("w")))
    none = F.array().cast("array<struct<idx:int,w:double>>")
    rows = store(
        attach(weighted, sizes, ["run_id"], ["v"]).select(
            "run_id", "label", "weight", F.concat("entries", F.when(F.col("language") != 0, flag).otherwise(none)).alias("entries")
        ),
        "entries",
    )
    # One row per run.
    fitted = fit_joint(rows, {r["run_id"]: r["v"] + 1 for r in sizes.collect()}, C, GROUP_COEFFICIENTS, DENSE_SHARE)
    discard(rows)
    return fitted


def fit_class_terms(weighted: DataFrame, sizes: DataFrame, smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(run_id, idx, coef) and (run_id, intercept) of one multinomial naive Bayes per run, in closed form.

    The sums of every (run, class, term) are one aggregation, combined before it moves.  With two classes the log
    odds are linear in the features, so the coefficient of a term is the difference of its
    smoothed log shares and the intercept that of the classes.
    """
    flag = F.struct(F.col("v").cast("int").alias("idx"), F.col("language").alias("w"))
    rows = attach(weighted, sizes, ["run_id"], ["v"])
    sums = rows.select("run_id", "label", "weight", F.inline(F.concat("entries", F.array(flag)))).groupBy("run_id", "idx")
    of = lambda cls, value: F.sum(F.when(F.col("label") == cls, value).otherwise(0.0))
    share = F.col("weight") * F.col("w")
    terms = store(sums.agg(of(1, share).alias("pos"), of(0, share).alias("neg")), "class_terms")
    whole = terms.groupBy("run_id").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    classes = rows.groupBy("run_id").agg(of(1, F.col("weight")).alias("n_pos"), of(0, F.col("weight")).alias("n_neg"))
    state = materialize(whole.join(classes, "run_id").join(sizes.select("run_id", "v"), "run_id"))
    joined = attach(terms, state, ["run_id"], ["all_pos", "all_neg", "v"])
    s = F.lit(float(smoothing))
    width = s * (F.col("v") + 1)
    ratio = lambda a, n: F.ln((F.col(a) + s) / (F.col(n) + width))
    coefs = materialize(joined.select("run_id", "idx", (ratio("pos", "all_pos") - ratio("neg", "all_neg")).alias("coef")))
    prior = (F.ln(F.col("n_pos") + s) - F.ln(F.col("n_neg") + s)).alias("intercept")
    return coefs, state.select("run_id", prior)


def _outer_terms(members: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, term, tf); a document without terms keeps one row with nulls."""
    return members.select(*keep, F.inline_outer("terms"))


def score_assigned(assigned: DataFrame, fitted: FittedRuns) -> DataFrame:
    """Score every document of an assigned corpus by the models of its runs: adds ``p``.

    One aggregation per (run, document), combined before its shuffle, gives the dot product
    and the length of the TF-IDF row together.
    """
    members = ft.unfold_runs(assigned)
    doc = [c for c in members.columns if c != "terms"]
    hit = lookup(
        _outer_terms(members, doc), fitted.model.select("run_id", "term", "idf", "coef"), ["run_id", "term"], "left"
    )
    x = (F.lit(1.0) + F.ln("tf")) * F.col("idf")
    dots = hit.groupBy(*doc).agg(F.sum(x * F.col("coef")).alias("_dot"), F.sum(x * x).alias("_len2"))
    joined = attach(dots, fitted.heads, ["run_id"], ["intercept", "language_coef"])
    return joined.withColumn("p", linear_p("language")).drop(
        "_dot", "_len2", "intercept", "language_coef", "language"
    )


def score_runs(corpus: DataFrame, rows: DataFrame, fitted: FittedRuns) -> DataFrame:
    """Add ``p`` to ``rows`` (run_id, doc_id, ...): the score of each document by its run's model."""
    return score_assigned(ft.assign_runs(corpus, rows), fitted)
