"""Combining predictions: averages over replicates, feature-overlap weights, weighted votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharewise.operators.metrics import SCORERS, Scorer, score_by
from sharewise.plans import lookup, spread_rows, store

#: Metric columns that are averaged over machines.
METRICS = ("tp", "pos_est", "bias", "spcc", "acc", "ba", "mcc", "auroc")

#: Members that one number holds as bits.
MASK_BITS = 32


def bagged_vote(
    preds: DataFrame, keys: Sequence[str], pred: str = "pred", threshold: float | None = None
) -> DataFrame:
    """Mean prediction over replicates per row; with a threshold, the label of that mean."""
    mean = F.avg(F.col(pred).cast("double"))
    return preds.groupBy(*keys).agg((mean if threshold is None else mean >= threshold).alias(pred))


def average_metrics(report: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of every metric over machines, per ``keys`` (usually the variant)."""
    return report.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics if m in report.columns])


def member_accuracy(
    val: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred", threshold: float | Column = 0.5
) -> DataFrame:
    """(keys, accuracy) of each member (and variant) on its own validation rows."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = F.col(pred).cast("double") >= cut
    return val.groupBy(*keys).agg(
        F.avg((hit == (F.col(y).cast("int") == 1)).cast("double")).alias("accuracy")
    )


def member_score(
    val: DataFrame,
    keys: Sequence[str],
    y: str = "y",
    pred: str = "pred",
    threshold: float | Column = 0.5,
    scorer: str | Scorer = "accuracy",
) -> DataFrame:
    """(keys, accuracy): what a member's votes count, by any scorer of :func:`metrics.score_by`.

    A score below 0 would turn a vote round, and counts as 0.
    """
    named = {"accuracy": SCORERS[scorer] if isinstance(scorer, str) else scorer}
    scored = score_by(val, named, keys, y, pred, threshold)
    return scored.withColumn("accuracy", F.greatest(F.coalesce("accuracy", F.lit(0.0)), F.lit(0.0)))


def members_by_term(
    member_features: DataFrame, member: str = "member_id", keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, term, members): the ensemble's feature sets, one row per term.

    The array is no longer than the ensemble.
    """
    return member_features.groupBy(*keys, "term").agg(
        F.array_sort(F.collect_set(member)).alias("members")
    )


def feature_intersection(
    doc_terms: DataFrame,
    member_terms: DataFrame,
    ids: Sequence[str] = ("doc_id",),
    member: str = "member_id",
    keys: Sequence[str] = (),
) -> DataFrame:
    """(ids, member, shared): size of the intersection of two feature sets.

    ``member_terms`` comes from :func:`members_by_term`, so the join does not multiply rows.  Neither does the
    counting: a term carries its members as bits, each of which is added up by document.
    """
    each = member_terms.select(F.explode("members").alias(member))
    kind = each.schema[member].dataType
    # One row per member of the ensemble; without any, a null stands for none.
    known = sorted(r[0] for r in each.where(F.col(member).isNotNull()).distinct().collect()) or [None]
    bit = [F.when(F.array_contains("members", F.lit(m).cast(kind)), F.lit(1 << i % MASK_BITS)).otherwise(0) for i, m in enumerate(known)]
    masks = [sum(bit[i : i + MASK_BITS], F.lit(0).cast("long")).alias(f"_mask{i // MASK_BITS}") for i in range(0, len(bit), MASK_BITS)]
    hit = lookup(doc_terms, store(member_terms.select(*keys, "term", *masks), "members"), [*keys, "term"])
    ones = [F.sum(F.shiftrightunsigned(f"_mask{i // MASK_BITS}", i % MASK_BITS).bitwiseAND(F.lit(1).cast("long"))) for i in range(len(known))]
    counts = [F.struct(F.lit(m).cast(kind).alias(member), n.alias("shared")) for m, n in zip(known, ones, strict=True)]
    return hit.groupBy(*ids).agg(F.array(*counts).alias("_all")).select(*ids, F.inline("_all")).where("shared > 0")


def overlap_weights(
    doc_terms: DataFrame,
    member_terms: DataFrame,
    pairs: DataFrame,
    ids: Sequence[str] = ("doc_id",),
    member: str = "member_id",
    keys: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """(ids, member, w): share of the document's features that the member knows.

    ``pairs`` lists the (ids, member) to weigh, one row each.  A document without features
    has weight 0 for every member.  ``rows``, the number of pairs, keeps the partitions of the joins bounded.
    """
    ids = list(ids)
    dealt = lambda df, *on: spread_rows(df, rows, on)
    shared = feature_intersection(doc_terms, member_terms, ids, member, keys)
    sizes = doc_terms.groupBy(*ids).agg(F.count(F.lit(1)).alias("_size"))
    met = dealt(pairs.select(*ids, member), *ids, member).join(dealt(shared, *ids, member), [*ids, member], "left")
    return (
        dealt(met, *ids)
        .join(dealt(sizes, *ids), ids, "left")
        .select(
            *ids,
            member,
            F.coalesce(F.try_divide(F.col("shared"), F.col("_size")), F.lit(0.0)).alias("w"),
        )
    )


def normalize_weights(
    weights: DataFrame,
    accuracy: DataFrame | None = None,
    normalize: str = "after",
    ids: Sequence[str] = ("doc_id",),
    member: str = "member_id",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Multiply by the member's accuracy and scale each document's weights to sum 1.

    ``normalize='before'`` scales first and multiplies then; ``'after'`` multiplies first.
    ``accuracy`` is (member, keys, accuracy) and small; ``keys`` are its variants.
    """
    if normalize not in ("before", "after"):
        raise ValueError("normalize must be 'before' or 'after'")
    doc = Window.partitionBy(*ids, *keys)
    joined = lookup(weights, accuracy, [member]) if accuracy is not None else weights.withColumn("accuracy", F.lit(1.0))
    base = F.col("w") if normalize == "before" else F.col("w") * F.col("accuracy")
    scaled = F.coalesce(F.try_divide(base, F.sum(F.abs(base)).over(doc)), F.lit(0.0))
    out = scaled * F.col("accuracy") if normalize == "before" else scaled
    return joined.select(*ids, member, *keys, out.alias("w"))


def weighted_vote(
    weights: DataFrame,
    preds: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    member: str = "member_id",
    pred: str = "pred",
    threshold: float | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Sum over members of weight times prediction; with a threshold, its label.

    ``rows``, the number of weights, keeps the partitions of the join bounded.
    """
    weights, preds = (spread_rows(df, rows, [*keys, member]) for df in (weights, preds))
    total = F.sum(F.col("w") * F.col(pred).cast("double"))
    return (
        weights.join(preds, [*keys, member])
        .groupBy(*keys)
        .agg((total if threshold is None else total >= threshold).alias(pred))
    )
