"""Registered queries: combining given predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharewise.functions.hashing import unit_hash
from sharewise.operators import features as ft
from sharewise.operators import metrics as mt
from sharewise.operators import votes as vt
from sharewise.plans import materialize
from sharewise.suite.common import (
    BASE_LANG, MINDF, NUDGE, R, SCORED_SQL, TOKENS_SQL, documents, query, r6, scored, table, unit_sql,
)
from sharewise.suite.metrics import bundle_sql

# Replicates: the lines of an order are the replicate predictions of that order.


@query("bagged_vote", f"WITH {SCORED_SQL} SELECT l_orderkey, avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) >= 0.5 AS label_vote, {R('avg(p)')} AS proba_vote FROM scored GROUP BY 1")
def bagged_vote(spark, sf_dir):
    preds = scored(spark, sf_dir)
    long = preds.select(
        "l_orderkey",
        F.inline(
            F.array(
                F.struct(F.lit("label").alias("variant"), (F.col("p") > 0.5).cast("double").alias("pred")),
                F.struct(F.lit("proba").alias("variant"), F.col("p").alias("pred")),
            )
        ),
    )
    mean = vt.bagged_vote(long, ["l_orderkey", "variant"])
    return r6(
        mean.groupBy("l_orderkey").agg(
            F.max(F.when(F.col("variant") == "label", F.col("pred") >= 0.5)).alias("label_vote"),
            F.max(F.when(F.col("variant") == "proba", F.col("pred"))).alias("proba_vote"),
        )
    )


_AVERAGES = ", ".join(f"{R(f'avg({m})')} AS {m}" for m in vt.METRICS)


@query(
    "average_metrics",
    f"WITH {SCORED_SQL}, {bundle_sql('scored', 'l_linestatus, l_linenumber', 'p', '0.5')} SELECT l_linestatus, {_AVERAGES} FROM bundle GROUP BY 1",
)
def average_metrics(spark, sf_dir):
    report = mt.metric_bundle(scored(spark, sf_dir), ["l_linestatus", "l_linenumber"])
    return r6(vt.average_metrics(report, ["l_linestatus"]))


@query(
    "member_accuracy",
    f"WITH {SCORED_SQL} SELECT l_linenumber AS member_id, {R('avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM scored GROUP BY 1",
)
def member_accuracy(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumnRenamed("l_linenumber", "member_id")
    return r6(vt.member_accuracy(rows, ["member_id"], "y", "p"))


_SCORES = {
    "accuracy": "(tp + tn) / n",
    "balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2",
    "mcc": "coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0)",
    "precision": "coalesce(tp / nullif(tp + fp, 0), 0)",
    "recall": "coalesce(tp / nullif(tp + fn, 0), 0)",
    "f1": "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)",
    "neg_brier": "-squares / n",
    "neg_log_loss": "-surprise / n",
}


def scores_sql(rows: str, keys: str) -> str:
    """SQL: ``scores`` (keys, one column per scorer) of the rows (keys, y, p)."""
    cells = {"tn": (0, "false"), "fp": (0, "true"), "fn": (1, "false"), "tp": (1, "true")}
    sums = ", ".join(
        f"CAST(count(*) FILTER (y = {y} AND (p >= 0.5) = {hit}) AS DOUBLE) AS {name}" for name, (y, hit) in cells.items()
    )
    told = "least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, CAST(1e-15 AS DOUBLE)), 1)"
    return f"""sums AS (SELECT {keys}, {sums}, CAST(count(*) AS DOUBLE) AS n, sum((p - y) * (p - y)) AS squares, sum(-ln({told})) AS surprise
         FROM {rows} GROUP BY {keys}),
scores AS (SELECT {keys}, {", ".join(f"{value} AS {name}" for name, value in _SCORES.items())} FROM sums)"""


_ROUNDED = ", ".join(f"{R(name, NUDGE)} AS {name}" for name in _SCORES)


@query("member_scores", f"WITH {SCORED_SQL}, {scores_sql('scored', 'l_linenumber')} SELECT l_linenumber AS member_id, {_ROUNDED} FROM scores")
def member_scores(spark, sf_dir):
    """Every scorer of every member, from one aggregation."""
    rows = scored(spark, sf_dir).withColumnRenamed("l_linenumber", "member_id")
    return r6(mt.score_by(rows, list(mt.SCORERS), ["member_id"]), NUDGE)


_WEIGHTED = f"""WITH {SCORED_SQL}, {scores_sql('scored', 'l_linenumber')},
weights AS (SELECT l_linenumber, greatest(mcc, 0) AS w FROM scores),
own AS (SELECT l_orderkey, l_linenumber, max(p) AS p FROM scored GROUP BY 1, 2)
SELECT l_orderkey, {R('coalesce(sum(w * p) / nullif(sum(w), 0), 0)')} AS proba_vote FROM own JOIN weights USING (l_linenumber) GROUP BY 1"""


@query("scorer_weighted_vote", _WEIGHTED)
def scorer_weighted_vote(spark, sf_dir):
    """Replicate predictions of an order, weighed by their member's Matthews correlation."""
    rows = scored(spark, sf_dir).withColumnRenamed("l_linenumber", "member_id")
    scores = materialize(vt.member_score(rows, ["member_id"], "y", "p", scorer="mcc"))
    own = rows.groupBy("l_orderkey", "member_id").agg(F.max("p").alias("pred"))
    weights = vt.normalize_weights(own.select("l_orderkey", "member_id", F.lit(1.0).alias("w")), scores, "after", ["l_orderkey"])
    vote = vt.weighted_vote(weights, own, ["l_orderkey"])
    return r6(vote.withColumnRenamed("pred", "proba_vote"))


# Members: every source is a member that knows the terms frequent in its own documents; its
# accuracy is the share of its labelled documents of good quality.

_MEMBERS = f"""{TOKENS_SQL},
features AS (SELECT source AS member_id, term FROM tf JOIN documents USING (doc_id) GROUP BY 1, 2 HAVING count(*) >= {MINDF}),
members AS (SELECT DISTINCT source AS member_id FROM documents),
doc_terms AS (SELECT doc_id, term FROM tf UNION ALL SELECT doc_id, '' FROM documents WHERE lang <> '{BASE_LANG}'),
shared AS (SELECT doc_id, member_id, count(*) AS shared FROM doc_terms JOIN features USING (term) GROUP BY 1, 2),
sizes AS (SELECT doc_id, count(*) AS size FROM doc_terms GROUP BY 1),
overlap AS (SELECT doc_id, member_id, coalesce(coalesce(shared, 0) / CAST(size AS DOUBLE), 0) AS w
            FROM (SELECT doc_id, member_id FROM documents, members) every
            LEFT JOIN shared USING (doc_id, member_id) LEFT JOIN sizes USING (doc_id)),
acc AS (SELECT source AS member_id, avg(CAST(quality AS DOUBLE)) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1)"""


def _member_parts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    corpus = ft.corpus_terms(docs)
    tf = ft.unfold_terms(corpus)
    # Larger partitions than those of texts combine more of the counts below.
    own = ft.apart(tf, ft.term_bytes(corpus) // 4).join(docs.select("doc_id", F.col("source").alias("member_id")), "doc_id")
    features = own.groupBy("member_id", "term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= MINDF)
    doc_terms = ft.doc_feature_sets(tf, docs, 1, BASE_LANG)
    return docs, doc_terms, materialize(vt.members_by_term(features))


def _overlap(spark, sf_dir):
    """The weights and their number."""
    docs, doc_terms, member_terms = _member_parts(spark, sf_dir)
    members = docs.agg(F.array_sort(F.collect_set("source")).alias("all"))
    pairs = docs.select("doc_id", F.explode(members.scalar()).alias("member_id"))
    rows = pairs.count()
    return vt.overlap_weights(doc_terms, member_terms, pairs, rows=rows), rows


def _accuracies(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    joined = documents(spark, sf_dir).join(labels, "doc_id")
    return materialize(
        joined.groupBy(F.col("source").alias("member_id")).agg(F.avg(F.col("quality").cast("double")).alias("accuracy"))
    )


@query("feature_intersection", f"WITH {_MEMBERS} SELECT doc_id, member_id, shared FROM shared")
def feature_intersection(spark, sf_dir):
    _, doc_terms, member_terms = _member_parts(spark, sf_dir)
    return vt.feature_intersection(doc_terms, member_terms)


@query("overlap_weights", f"WITH {_MEMBERS} SELECT doc_id, member_id, {R('w', NUDGE)} AS w FROM overlap")
def overlap_weights(spark, sf_dir):
    return r6(_overlap(spark, sf_dir)[0], NUDGE)


_AFTER = f"""{_MEMBERS},
norm AS (SELECT doc_id, member_id, coalesce(w * accuracy / nullif(sum(w * accuracy) OVER (PARTITION BY doc_id), 0), 0) AS w
         FROM overlap JOIN acc USING (member_id))"""


@query("normalize_weights", f"WITH {_AFTER} SELECT doc_id, member_id, {R('w', NUDGE)} AS w FROM norm")
def normalize_weights(spark, sf_dir):
    return r6(vt.normalize_weights(_overlap(spark, sf_dir)[0], _accuracies(spark, sf_dir), "after"), NUDGE)


_BEFORE = f"""{_MEMBERS},
norm AS (SELECT doc_id, member_id, coalesce(w / nullif(sum(w) OVER (PARTITION BY doc_id), 0), 0) * accuracy AS w
         FROM (SELECT * FROM overlap JOIN acc USING (member_id)) o)"""


@query("normalize_weights_before", f"WITH {_BEFORE} SELECT doc_id, member_id, {R('w', NUDGE)} AS w FROM norm")
def normalize_weights_before(spark, sf_dir):
    return r6(vt.normalize_weights(_overlap(spark, sf_dir)[0], _accuracies(spark, sf_dir), "before"), NUDGE)


_PRED = unit_sql("member", "doc_id || '|' || member_id")


@query(
    "weighted_vote",
    f"WITH {_BEFORE} SELECT doc_id, {R(f'sum(w * {_PRED})')} AS proba_vote, sum(w * {_PRED}) >= 0.25 AS label_vote FROM norm GROUP BY 1",
)
def weighted_vote(spark, sf_dir):
    overlap, rows = _overlap(spark, sf_dir)
    weights = vt.normalize_weights(overlap, _accuracies(spark, sf_dir), "before")
    preds = weights.select("doc_id", "member_id", unit_hash("member", "doc_id", "member_id").alias("pred"))
    vote = vt.weighted_vote(weights, preds, rows=rows)
    return r6(vote.select("doc_id", F.col("pred").alias("proba_vote"), (F.col("pred") >= 0.25).alias("label_vote")))
