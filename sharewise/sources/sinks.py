"""Delimited text sinks.  Row order and index columns are not kept: every row has its key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.plans import by_rows


def sink_csv(df: DataFrame, path: str, sep: str = ",", partition_by: Sequence[str] = ()) -> str:
    writer = (
        df.write.mode("errorifexists")
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        # Strings keep their own blanks.
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)
    return path


def sink_processed(df: DataFrame, path: str) -> str:
    """The cleaned document table, comma-separated."""
    return sink_csv(df, path, ",")


def sink_predictions_long(preds: DataFrame, path: str, alias: str | None = "clf_alias") -> str:
    """y_test;y_pred;y_predP, one folder per classifier alias when that column exists."""
    part = [alias] if alias and alias in preds.columns else []
    return sink_csv(preds.select(*part, "y_test", "y_pred", "y_predP"), path, ";", part)


def sink_predictions_variants(preds: DataFrame, path: str) -> str:
    """(replicate_id, doc_id, variant, pred), one folder per variant."""
    return sink_csv(preds.select("replicate_id", "doc_id", "pred", "variant"), path, ",", ["variant"])


def predictions_wide(preds: DataFrame, ids: Sequence[str], variants: Sequence[str]) -> DataFrame:
    """One row per document, one column per variant."""
    return by_rows(preds, ids).groupBy(*ids).pivot("variant", list(variants)).agg(F.first("pred"))


def sink_features(weights: DataFrame, path: str, run: str = "run_id") -> str:
    """(term, coef) per run, one folder per run."""
    return sink_csv(weights, path, ",", [run])


def sink_metrics(report: DataFrame, path: str, by: Sequence[str] = ()) -> str:
    """The metric table, one folder per class weight if asked."""
    return sink_csv(report, path, ",", by)
