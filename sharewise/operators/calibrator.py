"""The calibrator as an object: fit once, then present one batch after another."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.functions.scores import present, two_class_proba
from sharewise.operators import calibration as cal
from sharewise.operators import density as dn
from sharewise.operators import drift
from sharewise.operators.models import positive_score
from sharewise.plans import attach, lookup, materialize, store


class CustomDensity(Protocol):
    """A density of one's own: learn from the scores of one class, then evaluate on a column."""

    def init(self, scores: DataFrame) -> Any: ...

    def pdf(self, p: Column) -> Column: ...


class Calibrator:
    """Learn the score densities of both classes; estimate shares on new data.

    ``density``: ``"radius"`` (nearest ranks, the default), ``"sliding"`` (1,000 cells),
    ``"hist"`` (``bins`` cells), a pair (positive, negative) of :class:`CustomDensity`, or a
    table (cls, bin, density) whose bins 0, 1, ... are equal cells of [0, 1]; the largest bin is the last
    cell, and a cell without a row has density 0.

    With a ``classifier`` (an MLlib estimator) the frames hold its features; without one they
    hold a score column ``p``.
    """

    def __init__(
        self, classifier=None, density: Any = "radius", bins: int = 3, radius: float = 0.1, label: str = "label"
    ):
        if isinstance(density, str) and density not in ("radius", "sliding", "hist"):
            raise ValueError(f"unknown density {density!r}")
        if isinstance(density, tuple):
            if len(density) != 2:
                raise ValueError("a custom density is a pair (positive, negative)")
            for d in density:
                if not (hasattr(d, "init") and hasattr(d, "pdf")):
                    raise ValueError("a custom density needs init() and pdf()")
        if classifier is not None and not hasattr(classifier, "fit"):
            raise ValueError("the classifier cannot be fitted")
        self.classifier, self.density, self.bins, self.radius, self.label = (
            classifier, density, bins, radius, label,
        )
        self.model = None
        self.train: DataFrame | None = None
        self.pair: DataFrame | None = None
        self.hist: DataFrame | None = None
        self.stored: DataFrame | None = None
        self.cells = bins

    # -- fitting

    def fit(self, train: DataFrame) -> Calibrator:
        if self.classifier is not None:
            self.model = self.classifier.fit(train)
        scored = self._score(train, [self.label]).select(F.col(self.label).alias("y"), "p")
        cal.require_columns(scored)
        self.hist = materialize(dn.class_pair(dn.density_hist(scored, bins=self.bins)))
        if self.density == "hist":
            self.pair = self.hist
        elif self.density == "sliding":
            self.pair = materialize(dn.class_pair(dn.density_sliding(scored, radius=self.radius)))
        elif self.density == "radius":
            self.train = store(present(scored, "p", "y"), "train")
        elif isinstance(self.density, tuple):
            positive, negative = self.density
            positive.init(scored.where("y = 1").select("p"))
            negative.init(scored.where("y = 0").select("p"))
        else:
            self.cells = self.density.agg(F.max("bin")).head()[0] + 1
            every = train.sparkSession.range(self.cells).select(F.col("id").cast("int").alias("bin"))
            filled = every.join(dn.class_pair(self.density), "bin", "left").na.fill(0.0, ["dt", "df"])
            self.pair = materialize(filled)
        return self

    def _score(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        if self.model is None:
            return rows
        return positive_score(self.model, rows, keep)

    def _scored_once(self, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Scores that several jobs read: the classifier runs over the rows once."""
        scored = self._score(rows, keep)
        return scored if self.model is None else store(scored, "scored")

    def _bin(self) -> Column:
        if isinstance(self.density, str) and self.density == "sliding":
            return dn.sliding_bin("p")
        return dn.hist_bin("p", self.cells)

    def _with_densities(self, scored: DataFrame) -> DataFrame:
        """Add ``dt`` and ``df`` to rows with ``p``; a missing score has none."""
        if isinstance(self.density, tuple):
            positive, negative = self.density
            return scored.withColumn("dt", positive.pdf(F.col("p"))).withColumn("df", negative.pdf(F.col("p")))
        if self.train is not None:
            points = present(scored, "p").select(F.col("p").alias("x")).distinct().select("x", F.explode(F.array(F.lit(0), F.lit(1))).alias("cls"))
            at = dn.density_radius(
                self.train.select(F.col("y").cast("int").alias("cls"), "p"), points, ["cls"], self.radius
            )
            pair = at.groupBy("x").agg(
                F.max(F.when(F.col("cls") == 1, F.col("density"))).alias("dt"),
                F.max(F.when(F.col("cls") == 0, F.col("density"))).alias("df"),
            )
            return lookup(scored, store(pair.withColumnRenamed("x", "p"), "at"), ["p"], "left").select(
                *scored.columns, "dt", "df"
            )
        return dn.density_lookup(scored, self.pair, self._bin())

    # -- one batch

    def proportion(self, batch: DataFrame) -> DataFrame:
        """One row (pi, n): the share of positives in the batch."""
        return self._proportion(self._score(batch, []))

    def _proportion(self, scored: DataFrame) -> DataFrame:
        if self.pair is not None:
            return materialize(cal.prevalence_ml(cal.likelihood_cells(scored, self.pair, bin_=self._bin())))
        counts = present(scored, "p").groupBy("p").agg(F.count(F.lit(1)).alias("c"))
        return cal.prevalence_points(store(self._with_densities(counts).select("c", "dt", "df"), "points"))

    def determine_threshold(self, batch: DataFrame) -> DataFrame:
        """One row (pi, n, threshold), also kept as the stored state."""
        return self._threshold(self._scored_once(batch, []))

    def _threshold(self, scored: DataFrame) -> DataFrame:
        shares = self._proportion(scored)
        self.stored = materialize(attach(shares, cal.calibrated_threshold(scored, shares), (), ["threshold"]))
        return self.stored

    def predict(self, batch: DataFrame, new_threshold: bool = True, calibrated: bool = True) -> DataFrame:
        """The batch with ``label_pred``."""
        if not calibrated:
            return cal.predict_raw(self._score(batch, batch.columns), out="label_pred")
        if not new_threshold and self.stored is not None:
            return cal.predict_calibrated(self._score(batch, batch.columns), self.stored, out="label_pred")
        scored = self._scored_once(batch, batch.columns)
        return cal.predict_calibrated(scored, self._threshold(scored), out="label_pred")

    def predict_proba(self, batch: DataFrame, calibrated: bool = True) -> DataFrame:
        """The batch with ``proba = [P(0), P(1)]``; rows without a score stay and get nulls."""
        if not calibrated:
            return cal.proba_raw(self._score(batch, batch.columns))
        scored = self._scored_once(batch, batch.columns)
        dense = attach(self._with_densities(scored), self._proportion(scored), (), ["pi"])
        return cal.with_posterior(dense, "_post").withColumn("proba", two_class_proba("_post")).drop("_post")

    transform = predict_proba

    def compare_dists(self, batch: DataFrame) -> DataFrame:
        """K-S, divergence and chi-square between the batch and the mixture of training histograms."""
        scored = self._scored_once(batch, [])
        hist = drift.mixture_histogram(scored, self.hist, self._proportion(scored), bins=self.bins)
        return drift.compare_distributions(hist, bins=self.bins)
