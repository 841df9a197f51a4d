"""Exact-size random samples, splits and resamples, keyed by a hash of the row key.

A sample of n rows is "the n rows with the smallest hash".  It needs no sort and no shuffle
of the rows: one pass over the key columns counts them by the upper 16 bits of the hash, the next by
the lower 16 inside the cell that holds the n-th row, and where keys share a whole hash a last one
counts those keys.  The n-th smallest (hash, key) pair of each stratum is then known, and the
sample is a plain filter against that one pair.  Texts never move.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharewise.functions.hashing import hash32, unit_hash
from sharewise.operators.clean import union_by_name
from sharewise.plans import attach, dense_index, lookup, materialize, store

#: Bits of the hash that one counting pass tells apart: at most 2^16 counts a stratum.
CELL_BITS = 16


def _hashed(df: DataFrame, key: Sequence[str], strata: Sequence[str], seed) -> DataFrame:
    return df.select(
        *strata, hash32(seed, *key).alias("_h"), F.struct(*key).alias("_k")
    ).withColumn("_cell", F.shiftright("_h", 32 - CELL_BITS))


def _holding_goal(counts: DataFrame, within: Sequence[str], order: str) -> DataFrame:
    """Of each group's counts ``_c``, the one that place ``_goal`` falls in.

    ``_before``, the places before the group, grows by those before the count.
    """
    here = Window.partitionBy(*within).orderBy(order)
    return (
        counts.withColumn("_upto", F.col("_before") + F.sum("_c").over(here))
        .withColumn("_before", F.col("_upto") - F.col("_c"))
        .where((F.col("_before") < F.col("_goal")) & (F.col("_goal") <= F.col("_upto")))
        .drop("_upto")
    )


def cutoffs(
    df: DataFrame,
    key: Sequence[str],
    take: Callable[[Column], Column],
    seed: int | str | Column = 0,
    strata: Sequence[str] = (),
) -> DataFrame:
    """Per stratum, the largest (hash, key) pair inside a sample of ``take(n)`` rows.

    Columns: the strata, ``cut_h``, ``cut_k``.  ``key`` must identify a row.  Raises when a
    stratum is asked for more rows than it has.
    """
    strata, key = list(strata), list(key)
    hashed = _hashed(df, key, strata, seed)
    # Pass 1: at most 2^16 counts per stratum, combined before the shuffle.
    cells = hashed.groupBy(*strata, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    by_cell = Window.partitionBy(*strata).orderBy("_cell")
    whole = Window.partitionBy(*strata)
    ranked = cells.select(
        *strata,
        "_cell",
        "_c",
        F.sum("_c").over(by_cell).alias("_upto"),
        F.sum("_c").over(whole).alias("_n"),
    ).withColumn("_goal", take(F.col("_n")).cast("long"))
    hits = materialize(
        ranked.withColumn("_before", F.col("_upto") - F.col("_c")).where(
            ((F.col("_before") < F.col("_goal")) & (F.col("_goal") <= F.col("_upto")))
            | ((F.col("_goal") > F.col("_n")) & (F.col("_upto") == F.col("_n")))
        )
    )
    if not strata and hits.isEmpty():
        asked = df.sparkSession.range(1).select(take(F.lit(0)).cast("long")).head()[0]
        if asked:
            raise ValueError(f"cannot take {asked} rows without replacement from 0")
    short = hits.where(F.col("_goal") > F.col("_n")).select("_goal", "_n").head()
    if short is not None:
        raise ValueError(f"cannot take {short[0]} rows without replacement from {short[1]}")
    # A struct of the strata also matches where a stratum is null.
    stratum = F.struct(*strata) if strata else F.lit(0)
    hashed = hashed.withColumn("_s", stratum)
    places = ["_s", "_before", "_goal"]
    # Pass 2: the lower bits, in the cell that holds the cut alone: 2^16 counts at most.
    inside = lookup(hashed, hits.select(stratum.alias("_s"), "_cell", "_before", "_goal"), ["_s", "_cell"])
    by_hash = inside.groupBy(*strata, *places, "_h").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_k").alias("_least"), F.max("_k").alias("_most")
    )
    cut = materialize(_holding_goal(by_hash, ["_s"], "_h"))
    one_key = F.col("_least") == F.col("_most")
    found = cut.where(one_key).select(*strata, F.col("_h").alias("cut_h"), F.col("_least").alias("cut_k"))
    shared = cut.where(~one_key)
    if shared.isEmpty():
        return materialize(found)
    # Pass 3: different keys with one 32-bit hash, about n / 2^32 of them; repeats of a key are one count.
    meet = lookup(hashed.select("_s", "_h", "_k"), shared.select(*strata, *places, "_h"), ["_s", "_h"])
    by_key = meet.groupBy(*strata, *places, "_h", "_k").agg(F.count(F.lit(1)).alias("_c"))
    last = _holding_goal(by_key, ["_s", "_h"], "_k")
    return materialize(
        found.unionByName(last.select(*strata, F.col("_h").alias("cut_h"), F.col("_k").alias("cut_k")))
    )


def flag_sample(
    df: DataFrame,
    key: Sequence[str],
    take: Callable[[Column], Column],
    seed: int | str | Column = 0,
    strata: Sequence[str] = (),
    out: str = "in_sample",
) -> DataFrame:
    """Add a boolean column: is the row among the ``take(n)`` of its stratum?"""
    cut = cutoffs(df, key, take, seed, strata)
    h, k = hash32(seed, *key), F.struct(*key)
    joined = (
        lookup(
            df.withColumn("_s", F.struct(*strata)), cut.select(F.struct(*strata).alias("_s"), "cut_h", "cut_k"), ["_s"], how="left"
        )
        if strata
        else attach(df, cut, (), ["cut_h", "cut_k"])
    )
    inside = (h < F.col("cut_h")) | ((h == F.col("cut_h")) & (k <= F.col("cut_k")))
    return joined.select(*df.columns, F.coalesce(inside, F.lit(False)).alias(out))


def _keep(df: DataFrame, flag: str, value: bool = True) -> DataFrame:
    return df.where(F.col(flag) if value else ~F.col(flag)).drop(flag)


def sample_n(df: DataFrame, key: Sequence[str], n: int, seed=0, strata: Sequence[str] = ()) -> DataFrame:
    """Exactly ``n`` distinct rows (of each stratum), without replacement."""
    return _keep(flag_sample(df, key, lambda _: F.lit(n), seed, strata, "_in"), "_in")


def sample_fraction(
    df: DataFrame, key: Sequence[str], frac: float, seed=0, strata: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``floor(n * frac)`` rows of each stratum, without replacement."""
    return _keep(
        flag_sample(df, key, lambda n: F.floor(n * F.lit(frac)), seed, strata, "_in"), "_in"
    )


def sampled_scan(scan: DataFrame, key: Sequence[str], n: int, seed=0) -> DataFrame:
    """Read ``n`` random records of a source; the sample is a filter on the scan."""
    return sample_n(scan, key, n, seed)


def shuffle(df: DataFrame, key: Sequence[str], seed=0) -> DataFrame:
    """All rows in random order."""
    return (
        df.withColumn("_h", hash32(seed, *key)).orderBy("_h", *key).drop("_h")
    )


def shuffle_positions(df: DataFrame, key: Sequence[str], seed=0, keys: Sequence[str] = ()) -> DataFrame:
    """The key columns with ``position``, the place of a row in the shuffled order."""
    hashed = df.select(*keys, *key, hash32(seed, *key).alias("_h"))
    return dense_index(hashed, ["_h", *key], keys, "position").drop("_h")


def head_tail_split(
    df: DataFrame, key: Sequence[str], frac: float = 0.5, seed=0, out: str = "part"
) -> DataFrame:
    """Random halves: ``floor(n * frac)`` rows are the head, the rest the tail."""
    flagged = flag_sample(df, key, lambda n: F.floor(n * F.lit(frac)), seed, (), "_in")
    return flagged.withColumn(
        out, F.when(F.col("_in"), F.lit("head")).otherwise(F.lit("tail"))
    ).drop("_in")


def ratio_mix(
    pos: DataFrame, neg: DataFrame, key: Sequence[str], ratio: tuple[int, int] = (7, 3), seed=0
) -> DataFrame:
    """All positives and ``floor(ratio * n_pos)`` sampled negatives (7:3 gives about 30/70)."""
    n = ratio[0] * pos.count() // ratio[1]
    return union_by_name([pos, sample_n(neg, key, n, seed)])


def balanced_mix(pos: DataFrame, neg: DataFrame, key: Sequence[str], seed=0) -> DataFrame:
    """All positives and as many sampled negatives."""
    return ratio_mix(pos, neg, key, (1, 1), seed)


def fraction_mix(
    pos: DataFrame, neg: DataFrame, key: Sequence[str], frac: float = 0.1, seed=0
) -> DataFrame:
    """All positives and a fixed fraction of the negatives."""
    return union_by_name([pos, sample_fraction(neg, key, frac, seed)])


def stratified_sample(
    df: DataFrame, key: Sequence[str], label: str, frac: float = 0.1, seed=0
) -> DataFrame:
    """The same fraction of each class, without replacement."""
    return sample_fraction(df, key, frac, seed, [label])


def train_val_split(
    df: DataFrame,
    key: Sequence[str],
    test_size: float = 0.2,
    seed=0,
    keys: Sequence[str] = (),
    out: str = "part",
) -> DataFrame:
    """``ceil(n * test_size)`` random rows are 'val', the rest 'train'; one draw per ``keys``."""
    draw = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    flagged = flag_sample(df, key, lambda n: F.ceil(n * F.lit(test_size)), draw, keys, "_in")
    return flagged.withColumn(
        out, F.when(F.col("_in"), F.lit("val")).otherwise(F.lit("train"))
    ).drop("_in")


def strat_split(
    df: DataFrame,
    key: Sequence[str],
    label: str,
    test_size: Mapping[float, float] | float = 0.2,
    seed=0,
    out: str = "part",
) -> DataFrame:
    """Per class, ``floor(n_c * frac_c)`` rows to 'test', the rest to 'train'.

    ``test_size`` is one fraction for all classes or a mapping class -> fraction.
    """
    if isinstance(test_size, Mapping):
        frac = reduce(
            lambda acc, item: acc.when(F.col(label) == F.lit(item[0]), F.lit(float(item[1]))),
            test_size.items(),
            F.when(F.lit(False), F.lit(0.0)),
        ).otherwise(F.lit(0.0))
    else:
        frac = F.lit(float(test_size))
    flagged = flag_sample(df, key, lambda n: F.floor(n * frac), seed, [label], "_in")
    return flagged.withColumn(
        out, F.when(F.col("_in"), F.lit("test")).otherwise(F.lit("train"))
    ).drop("_in")


def kfold_assign(
    df: DataFrame, key: Sequence[str], label: str, k: int = 10, seed=0
) -> DataFrame:
    """The key and label columns with ``fold`` in 0..k-1, each fold stratified by label."""
    placed = shuffle_positions(df, key, seed, [label])
    return placed.withColumn("fold", F.pmod("position", F.lit(k)).cast("int")).drop("position")


def bootstrap_resample(
    df: DataFrame, key: Sequence[str], replicates: int, seed=0, first: int = 0
) -> DataFrame:
    """``n`` draws with replacement from ``n`` rows, for each replicate.

    Columns: ``replicate_id``, the key, ``copies``.  The texts are not repeated: a row drawn
    three times is one row with three copies.
    """
    spark = df.sparkSession
    numbered = store(dense_index(df.select(*key), list(key), (), "_idx"), "numbered")
    n = numbered.count()
    draws = (
        spark.range(n * replicates)
        .select(
            (F.floor(F.col("id") / F.lit(max(n, 1))) + F.lit(first)).cast("int").alias("replicate_id"),
            F.pmod("id", F.lit(max(n, 1))).alias("_i"),
        )
        .select(
            "replicate_id",
            F.floor(unit_hash(seed, "replicate_id", "_i") * F.lit(n)).cast("long").alias("_idx"),
        )
        .groupBy("replicate_id", "_idx")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    return draws.join(numbered, "_idx").select("replicate_id", *key, "copies")
