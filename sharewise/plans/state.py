"""Small state tables and the joins that bring them to the rows.

A *state table* holds one row, or a bounded number of rows, per fitted model (a share, a
threshold, a density, a vocabulary).  It is materialised once in the shared checkpoint
folder, counted, and only then broadcast; a table over the bound is joined by a salted
shuffle, so that neither a large table nor a hot key ends in one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast when it has at most this many rows ...
BROADCAST_ROWS = 2_000_000

#: ... and its values take at most this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024

#: A salted join cuts a heavy key so that a part holds this share of an even shuffle partition, about.
PARTS = 4

#: Spark's sketch of frequent keys tracks no more than these ...
SKETCH_ITEMS = 1_000_000

#: ... and names at least so many keys.
SKETCH_KEYS = 4096

#: Spark's option by which an action drops its shuffle files when it has ended.
SHUFFLES_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: A partition of a salted join is dealt about so many bytes of both sides, however large they are.
JOIN_PARTITION_BYTES = BROADCAST_BYTES


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``.  Where it is unset, a folder in the warehouse,
    which driver and executors share, takes its place.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table, next to the checkpoints."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def drop_shuffles(spark: SparkSession) -> None:
    """From now on an action of the session leaves no shuffle files behind; tables that are written do not need them."""
    if spark.conf.get(SHUFFLES_DROPPED, "false") != "true":
        spark.conf.set(SHUFFLES_DROPPED, "true")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, once, and cut its lineage."""
    checkpoint_root(df.sparkSession)
    drop_shuffles(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a result that grows with the data as a columnar table in the shared folder.

    Later reads prune columns and survive lost executors; small states use
    :func:`materialize`.
    """
    path = shared_path(df.sparkSession, name)
    drop_shuffles(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(sc: SparkContext, path: str) -> None:
    """Delete a folder by Spark's file systems."""
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Delete a table of :func:`store` that nothing reads any more."""
    spark = table.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    of = checkpoint_root(spark).rstrip("/").rsplit("/", 1)[-1]
    if len(folders) != 1 or (folder := folders.pop()).split("/")[-2] != of:
        raise ValueError("only a table of store can be discarded")
    delete_folder(spark.sparkContext, folder)


#: Rows of a partition of :func:`by_rows`.
PARTITION_ROWS = 1 << 19


def by_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` into partitions of about ``PARTITION_ROWS`` rows, however many there are.

    For groups nearly as many as the rows: combining them first would fill a hash table with a whole split of the input.
    The rows are counted first.
    """
    return df.repartition(max(1, -(-df.count() // PARTITION_ROWS)), *keys)


def spread_rows(df: DataFrame, rows: int | None, keys: Sequence[str]) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` where its ``rows``, if known, ask for more partitions than the session's shuffles have."""
    spread = -(-(rows or 0) // PARTITION_ROWS)
    if spread <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(spread, *keys)


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.StructType, T.ArrayType)):
            inner = F.aggregate(
                value, F.lit(0).cast("long"), lambda acc, x: acc + _width(x, kind.elementType).cast("long")
            )
            return F.coalesce(inner, F.lit(0)) + 16
        return F.greatest(F.size(value), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def _row_width(table: DataFrame) -> Column:
    """Bytes a row takes."""
    return sum((_width(F.col(f.name), f.dataType) for f in table.schema.fields), F.lit(0)).cast("long")


def measure(table: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of a materialised table, in one aggregation."""
    rows, size = table.agg(F.count(F.lit(1)), F.sum(_row_width(table))).head()
    return rows, size or 0


def attach(rows: DataFrame, state: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Add ``cols`` of a one-row-per-key ``state`` table to every row.

    Without keys the state is one row and arrives as a scalar subquery, which Spark runs
    once and inlines as a literal: no join at all.  With keys, rows without a state stay and get nulls.
    """
    if not keys:
        return rows.select("*", *[state.select(c).scalar().alias(c) for c in cols])
    return lookup(rows, state.select(*keys, *cols), keys, how="left")


def _salted(rows: DataFrame, table: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: heavy keys of ``rows`` get as many salts as their share asks for, all others one.

    A sketch of the most frequent keys, one more pass over ``rows`` that also adds up their bytes, gives the shares.  There are fewer than ``PARTS``
    times the partitions of them, and their salts add up to at most twice that, so hardly any row of the
    table is repeated.  A key the sketch takes for heavier or lighter than it is has other salts, not other rows.
    Where the bytes ask for more partitions than the session's shuffles have, both sides are dealt into so many.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = max(PARTS * usual, SKETCH_KEYS)
    keyed = rows.select(F.xxhash64(*on).alias("_meet"), _row_width(rows).alias("_bytes"))
    sketch = materialize(
        keyed.agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_bytes").alias("_bytes"),
            F.expr(f"approx_top_k(_meet, {keys}, {min(8 * keys, SKETCH_ITEMS)})").alias("_top"),
        )
    )
    size = (sketch.select("_bytes").head()[0] or 0) + measure(table)[1]
    spread = max(usual, -(-size // JOIN_PARTITION_BYTES))
    parts = PARTS * spread
    share = F.ceil(F.col("count") * F.lit(float(parts)) / F.col("_n")).cast("long")
    heavy = materialize(
        sketch.select("_n", F.inline("_top")).select(F.col("item").alias("_meet"), share.alias("_parts")).where("_parts > 1")
    )

    def parted(df: DataFrame) -> DataFrame:
        known = df.withColumn("_meet", F.xxhash64(*on))
        return lookup(known, heavy, ["_meet"], "left", bound=parts).withColumn(
            "_parts", F.coalesce("_parts", F.lit(1).cast("long"))
        )

    # A hash of the whole row: the same salt on every retry.
    dealt = parted(rows).withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")))
    copied = parted(table).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    both = dealt.drop("_meet", "_parts"), copied.drop("_meet", "_parts")
    return both if spread == usual else tuple(df.repartition(spread, *on, "_salt") for df in both)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    bound: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Equi-join ``rows`` to ``table``, broadcasting the table only behind a size check.

    ``bound`` is a row count that holds by construction (say one row per range piece).
    Without one the table, which the caller has materialised, is measured in rows and bytes.
    Beyond the limits both sides shuffle on ``on`` plus a salt, which splits heavy keys alone, into
    partitions of bounded bytes.
    """
    on = list(on)
    if bound is not None:
        small = bound <= broadcast_rows
    else:
        size, width = measure(table)
        small = size <= broadcast_rows and width <= BROADCAST_BYTES
    if small:
        return rows.join(F.broadcast(table), on, how)
    salted_rows, salted_table = _salted(rows, table, on)
    return salted_rows.join(salted_table, [*on, "_salt"], how).drop("_salt")
