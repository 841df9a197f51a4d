"""Calibration of a stream of scores: share and threshold belong to each presented batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.operators.calibration import calibrate
from sharewise.plans import store


def calibrate_stream(scores: DataFrame, pair: DataFrame, path: str, checkpoint: str):
    """Start a query that appends (batch_id, pi, n, threshold) to a table, one row per micro-batch.

    ``scores`` is a streaming frame with ``p``; ``pair`` is the fitted class pair.  A batch that
    is run again after a failure overwrites its own folder, so each batch counts once.
    """

    def present(batch: DataFrame, batch_id: int) -> None:
        rows = store(batch.select("p"), "batch")
        if rows.isEmpty():
            return
        calibrate(rows, pair).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        scores.writeStream.foreachBatch(present)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_states(spark, path: str) -> DataFrame:
    """What ``calibrate_stream`` has written."""
    return spark.read.parquet(path).select(F.col("batch_id").cast("long"), "pi", "n", "threshold")
