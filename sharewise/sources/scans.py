"""Delimited text sources with explicit schemas, and synthetic scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharewise.operators.clean import fill_null_text, union_by_name

PREDICTIONS = "y_test DOUBLE, y_pred DOUBLE, y_predP DOUBLE"


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = ",") -> DataFrame:
    """Header CSV; quoted fields may hold separators, quotes and line ends."""
    paths = [path] if isinstance(path, str) else list(path)
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(paths)
    )


def scan_csv_multi(spark: SparkSession, schemas: Mapping[str, str], sep: str = ";") -> DataFrame:
    """Several CSV sources (path -> schema), missing strings filled, columns united and sorted by name."""
    return union_by_name([fill_null_text(scan_csv(spark, p, s, sep)) for p, s in schemas.items()])


def scan_predictions(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """(y_test, y_pred, y_predP) as written by ``sink_predictions_long``."""
    return scan_csv(spark, path, PREDICTIONS, sep)


def gen_binormal(spark: SparkSession, d_prime: float, n: int, ppos: float, seed: int = 0) -> DataFrame:
    """Synthetic scores: y true with chance ``ppos``; x is standard normal, shifted by d' when y."""
    return (
        spark.range(n)
        .withColumn("y", F.rand(seed) <= ppos)
        .withColumn("x", F.randn(seed + 1) + F.when(F.col("y"), F.lit(float(d_prime))).otherwise(F.lit(0.0)))
    )
