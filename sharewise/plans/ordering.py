"""Global order without a single-task window.

Rows are range-partitioned on (keys, order), so Spark balances the pieces by sampling and
each piece is one contiguous stretch of the global order.  A window runs inside each
piece; the totals of the pieces (at most one row per piece and key) give the offsets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharewise.plans.state import lookup, materialize, store


def range_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_piece``, the number of the range partition a row falls in."""
    return df.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id())


def range_count(df: DataFrame) -> int:
    """No range exchange of this session makes more pieces than this."""
    conf = df.sparkSession.conf
    shuffles = int(conf.get("spark.sql.shuffle.partitions"))
    return max(shuffles, int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 0))


def lookup_piece(pieces: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join what is known per (keys, piece) back to the rows of the pieces.

    Without keys there is one row per partition; with keys they are counted first.
    """
    if keys:
        return lookup(pieces, materialize(ends), [*keys, "_piece"])
    return lookup(pieces, ends, ["_piece"], bound=range_count(pieces))


def running_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, str | Column]
) -> DataFrame:
    """For each ``name: column`` add ``name``, the sum of the column over earlier rows.

    "Earlier" is by ``order`` within ``keys``; the order must be unique within the keys.
    The pieces are written first, because offsets and rows must see the same split.
    """
    keys, order = list(keys), list(order)
    names = list(sums)
    measured = df.select("*", *[F.lit(1).alias(f"_m_{n}") if c == 1 else
                                (F.col(c) if isinstance(c, str) else c).alias(f"_m_{n}")
                                for n, c in sums.items()])
    pieces = store(range_pieces(measured, keys, order), "pieces")
    totals = pieces.groupBy(*keys, "_piece").agg(*[F.sum(f"_m_{n}").alias(f"_t_{n}") for n in names])
    across = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_piece",
        *[F.coalesce(F.sum(f"_t_{n}").over(across), F.lit(0)).alias(f"_o_{n}") for n in names],
    )
    inside = (
        Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return lookup_piece(pieces, offsets, keys).select(
        *df.columns,
        *[
            (F.col(f"_o_{n}") + F.coalesce(F.sum(f"_m_{n}").over(inside), F.lit(0))).alias(n)
            for n in names
        ],
    )


def dense_index(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "idx"
) -> DataFrame:
    """Number the rows 0, 1, 2 ... by ``order`` within ``keys``."""
    return running_before(df, keys, order, {name: 1})
