"""Registered queries: every source and sink, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharewise.functions.hashing import hash32
from sharewise.operators import clean
from sharewise.operators import metrics as mt
from sharewise.plans import by_rows, shared_path
from sharewise.sources import scans, sinks
from sharewise.suite.common import (
    BASE_LANG, MINDF, R, SCORED_SQL, VOCAB_SQL, documents, hash_sql, query, r6, scored,
)
from sharewise.suite.documents import LONG_ENOUGH, RAW_SQL, raw_documents
from sharewise.suite.features import corpus_tf, corpus_vocab
from sharewise.suite.metrics import BUNDLE_OUT, TEST, bundle_out, bundle_sql

DOC_SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


@query(
    "scan_csv_multi",
    f"""WITH {RAW_SQL}
SELECT doc_id, text, lang, CASE WHEN lang = '{BASE_LANG}' THEN coalesce(platform, ' ') END AS platform FROM raw""",
)
def scan_csv_multi(spark, sf_dir):
    raw = raw_documents(spark, sf_dir)
    own, other = shared_path(spark, "own"), shared_path(spark, "other")
    sinks.sink_csv(raw.where(F.col("lang") == BASE_LANG), own, ";")
    sinks.sink_csv(raw.where(F.col("lang") != BASE_LANG).drop("platform"), other, ";")
    return scans.scan_csv_multi(
        spark,
        {own: "doc_id BIGINT, text STRING, lang STRING, platform STRING", other: "doc_id BIGINT, text STRING, lang STRING"},
    )


@query("scan_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_csv(spark, sf_dir):
    path = sinks.sink_csv(documents(spark, sf_dir), shared_path(spark, "documents"))
    return scans.scan_csv(spark, path, DOC_SCHEMA)


@query("sink_processed", f"WITH {RAW_SQL} SELECT doc_id, replace(text, '  ', ' ') AS text, lang FROM raw WHERE {LONG_ENOUGH}")
def sink_processed(spark, sf_dir):
    path = sinks.sink_processed(clean.clean_documents(raw_documents(spark, sf_dir)), shared_path(spark, "processed"))
    return scans.scan_csv(spark, path, "doc_id BIGINT, text STRING, lang STRING")


_PREDICTIONS = "CAST(y AS DOUBLE) AS y_test, CASE WHEN p > 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y_pred"


@query("scan_predictions", f"WITH {SCORED_SQL} SELECT {_PREDICTIONS}, {R('p')} AS \"y_predP\" FROM scored")
def scan_predictions(spark, sf_dir):
    rows = scored(spark, sf_dir).select(
        F.col("y").cast("double").alias("y_test"),
        (F.col("p") > 0.5).cast("double").alias("y_pred"),
        F.col("p").alias("y_predP"),
    )
    path = sinks.sink_predictions_long(rows, shared_path(spark, "predictions"))
    return r6(scans.scan_predictions(spark, path))


@query("sink_predictions_long", f"WITH {SCORED_SQL} SELECT l_linestatus AS clf_alias, {_PREDICTIONS}, {R('p')} AS \"y_predP\" FROM scored")
def sink_predictions_long(spark, sf_dir):
    rows = scored(spark, sf_dir).select(
        F.col("l_linestatus").alias("clf_alias"),
        F.col("y").cast("double").alias("y_test"),
        (F.col("p") > 0.5).cast("double").alias("y_pred"),
        F.col("p").alias("y_predP"),
    )
    path = sinks.sink_predictions_long(rows, shared_path(spark, "predictions"))
    return r6(scans.scan_csv(spark, path, scans.PREDICTIONS + ", clf_alias STRING", ";"))


@query(
    "sink_predictions_wide",
    f"""WITH {SCORED_SQL} SELECT l_linenumber AS replicate_id, l_orderkey AS doc_id, {R('max(p)')} AS raw_proba,
max(CASE WHEN p > 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS raw_label FROM scored GROUP BY 1, 2""",
)
def sink_predictions_wide(spark, sf_dir):
    ids = ["replicate_id", "doc_id"]
    rows = scored(spark, sf_dir).select(F.col("l_linenumber").alias("replicate_id"), F.col("l_orderkey").alias("doc_id"), "p")
    best = by_rows(rows, ids).groupBy(*ids).agg(F.max("p").alias("p"))
    long = best.select(
        "replicate_id",
        "doc_id",
        F.inline(
            F.array(
                F.struct(F.lit("raw_proba").alias("variant"), F.col("p").alias("pred")),
                F.struct(F.lit("raw_label").alias("variant"), (F.col("p") > 0.5).cast("double").alias("pred")),
            )
        ),
    )
    path = sinks.sink_predictions_variants(long, shared_path(spark, "variants"))
    back = scans.scan_csv(spark, path, "replicate_id INT, doc_id BIGINT, pred DOUBLE, variant STRING")
    return r6(sinks.predictions_wide(back, ids, ["raw_proba", "raw_label"]))


@query("sink_features", f"WITH {VOCAB_SQL} SELECT 0 AS run_id, term, {hash_sql('coef', 'term')} / CAST(4294967296 AS DOUBLE) AS coef FROM vocab")
def sink_features(spark, sf_dir):
    vocab = corpus_vocab(spark, sf_dir, corpus_tf(spark, sf_dir))
    weights = vocab.select(F.lit(0).alias("run_id"), "term", (hash32("coef", "term") / F.lit(2.0**32)).alias("coef"))
    path = sinks.sink_features(weights, shared_path(spark, "features"))
    return scans.scan_csv(spark, path, "term STRING, coef DOUBLE, run_id INT")


@query(
    "sink_metrics",
    f"WITH {TEST}, {bundle_sql('t', 'l_linestatus', 'p', '0.5')} SELECT l_linestatus, {BUNDLE_OUT} FROM bundle",
)
def sink_metrics(spark, sf_dir):
    report = mt.metric_bundle(scored(spark, sf_dir), ["l_linestatus"])
    path = sinks.sink_metrics(report, shared_path(spark, "metrics"), ["l_linestatus"])
    values = ", ".join(f"{c} DOUBLE" for c in report.columns if c != "l_linestatus")
    return bundle_out(scans.scan_csv(spark, path, f"{values}, l_linestatus STRING"))
