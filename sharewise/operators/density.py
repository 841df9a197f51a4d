"""Per-class densities of classifier scores.

A density is a small table (keys, cls, bin, density).  Fitting one is a count per class and
cell, combined before its shuffle; whatever follows runs on at most 1,000 cells per class.
The nearest-rank density keeps every distinct score and is handled as ordered data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharewise.functions.scores import present
from sharewise.plans import attach, lookup, materialize, store
from sharewise.plans.ordering import lookup_piece, range_pieces

#: Cells of the sliding density.
CELLS = 1000


def class_counts(
    scored: DataFrame, cell: Column, keys: Sequence[str], y: str = "y", copies: str | None = None
) -> DataFrame:
    weight = F.col(copies) if copies else F.lit(1)
    return (
        scored.groupBy(*keys, F.col(y).cast("int").alias("cls"), cell.alias("cell"))
        .agg(F.sum(weight).alias("c"))
    )


def _with_empty_cells(counts: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Every class gets a row for every cell; missing counts are 0."""
    empty = (
        counts.select(*keys, "cls").distinct()
        .select(*keys, "cls", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("cell"), F.lit(0).alias("c"))
    )
    return counts.unionByName(empty).groupBy(*keys, "cls", "cell").agg(F.sum("c").alias("c"))


def density_sliding(
    scored: DataFrame,
    keys: Sequence[str] = (),
    y: str = "y",
    p: str = "p",
    radius: float = 0.1,
    eps: float = 1e-20,
    copies: str | None = None,
) -> DataFrame:
    """Moving-average density on 1,000 cells.

    Cell i sums the histogram over (i - R, i + R], clipped to the unit interval, divides by
    the width in cells, gets a tiny floor, and is scaled to sum 1 per class.  Scores outside
    [0, 1] count in the cell at that end; rows without score or label take no part.
    """
    reach = int(radius * CELLS)
    cell = F.greatest(F.lit(1), F.least(F.floor(F.col(p) * CELLS) + 1, F.lit(CELLS))).cast("int")
    grid = _with_empty_cells(class_counts(present(scored, y, p), cell, keys, y, copies), keys, 1, CELLS)
    around = Window.partitionBy(*keys, "cls").orderBy("cell").rowsBetween(-reach, reach - 1)
    whole = Window.partitionBy(*keys, "cls")
    i = F.col("cell") - 1
    width = F.least(i + reach, F.lit(CELLS)) - F.greatest(i - reach, F.lit(0))
    slid = grid.select(*keys, "cls", i.alias("bin"), (F.sum("c").over(around) / width).alias("_h"))
    floored = slid.withColumn("_g", F.col("_h") + F.sum("_h").over(whole) * F.lit(eps))
    return floored.select(
        *keys, "cls", "bin", (F.col("_g") / F.sum("_g").over(whole)).alias("density")
    )


def sliding_bin(p: str | Column) -> Column:
    """The lookup cell of the sliding density, ``int(p * 999)``; null for a null score."""
    return _clamped(p, CELLS - 1, CELLS - 1)


def _clamped(p: str | Column, cells: int, last: int) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    cell = F.greatest(F.lit(0), F.least(F.floor(p * cells), F.lit(last))).cast("int")
    return F.when(p.isNotNull(), cell)


def density_hist(
    scored: DataFrame,
    keys: Sequence[str] = (),
    y: str = "y",
    p: str = "p",
    bins: int = 3,
    copies: str | None = None,
) -> DataFrame:
    """Share of each class in each of ``bins`` equal cells."""
    counts = _with_empty_cells(
        class_counts(present(scored, y, p), hist_bin(p, bins), keys, y, copies), keys, 0, bins - 1
    )
    whole = Window.partitionBy(*keys, "cls")
    return counts.select(
        *keys, "cls", F.col("cell").alias("bin"), (F.col("c") / F.sum("c").over(whole)).alias("density")
    )


def hist_bin(p: str | Column, bins: int = 3) -> Column:
    """The cell of a histogram; scores outside [0, 1] fall in the cell at that end, null in none."""
    return _clamped(p, bins, bins - 1)


def class_pair(density: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, dt, df): the densities of the positive and the negative class side by side."""
    return density.groupBy(*keys, "bin").agg(
        F.coalesce(F.max(F.when(F.col("cls") == 1, F.col("density"))), F.lit(0.0)).alias("dt"),
        F.coalesce(F.max(F.when(F.col("cls") == 0, F.col("density"))), F.lit(0.0)).alias("df"),
    )


def density_lookup(
    rows: DataFrame, pair: DataFrame, bin_: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Add ``dt`` and ``df`` to every row through its bin.

    ``pair`` is a class pair, materialised.
    """
    on = [*[k for k in keys if k in pair.columns], "bin"]
    return lookup(rows.withColumn("bin", bin_), pair, on, "left").drop("bin")


# --- nearest-rank density ---------------------------------------------------------------


def nearest_rank(
    scores: DataFrame, targets: DataFrame, keys: Sequence[str] = (), s: str = "s", t: str = "t", copies: str | None = None
) -> DataFrame:
    """For each target, the index in the sorted scores of the score nearest to it.

    Ties go to the lowest index.  Scores and targets are laid out in one global order; each
    range piece fills forward and backward, and the ends of the pieces are carried over
    through a table with at most one row per piece.  ``copies`` names a column with the number of
    times a score stands in the order.  Columns: keys, ``t``, ``idx``.
    """
    keys = list(keys)
    weight = F.col(copies) if copies else F.lit(1)
    counts = scores.groupBy(*keys, F.col(s).alias("v")).agg(F.sum(weight).cast("long").alias("c"))
    points = counts.select(*keys, "v", "c", F.lit(0).alias("kind")).unionByName(
        targets.select(*keys, F.col(t).alias("v")).distinct()
        .select(*keys, "v", F.lit(0).cast("long").alias("c"), F.lit(1).alias("kind"))
    )
    pieces = store(range_pieces(points, keys, ["v", "kind"]), "pieces")
    is_score = F.col("kind") == 0
    ends = pieces.groupBy(*keys, "_piece").agg(
        F.sum("c").alias("_total"),
        F.max(F.when(is_score, F.struct("v", "c"))).alias("_last"),
        F.min(F.when(is_score, F.col("v"))).alias("_first"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(1, Window.unboundedFollowing)
    carried = ends.select(
        *keys,
        "_piece",
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"),
        F.last("_last", ignorenulls=True).over(earlier).alias("_carry_low"),
        F.first("_first", ignorenulls=True).over(later).alias("_carry_high"),
    )
    upto = Window.partitionBy(*keys, "_piece").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys, "_piece").orderBy("v", "kind").rowsBetween(0, Window.unboundedFollowing)
    filled = lookup_piece(pieces, carried, keys).select(
        *keys,
        "v",
        "kind",
        (F.col("_offset") + F.sum("c").over(upto)).alias("_le"),
        F.coalesce(F.last(F.when(is_score, F.struct("v", "c")), ignorenulls=True).over(upto), F.col("_carry_low")).alias("_low"),
        F.coalesce(F.first(F.when(is_score, F.col("v")), ignorenulls=True).over(after), F.col("_carry_high")).alias("_high"),
    )
    gap_low = (F.col("v") - F.col("_low.v")) * (F.col("v") - F.col("_low.v"))
    gap_high = (F.col("v") - F.col("_high")) * (F.col("v") - F.col("_high"))
    low_wins = F.col("_high").isNull() | (gap_low <= gap_high)
    return filled.where(F.col("kind") == 1).select(
        *keys,
        F.col("v").alias(t),
        F.when(F.col("_low").isNull(), F.lit(0).cast("long"))
        .when(low_wins, F.col("_le") - F.col("_low.c"))
        .otherwise(F.col("_le"))
        .alias("idx"),
    )


def _raw_radius(
    train: DataFrame, queries: DataFrame, keys: Sequence[str], radius: float, copies: str | None = None
) -> DataFrame:
    """f(x) at distinct query points ``x``: rank distance over width.  Columns: keys, x, f."""
    r = F.lit(radius)
    points = queries.select(*keys, "x").distinct()
    ends = points.select(*keys, "x", F.explode(F.array(F.col("x") - r, F.col("x") + r)).alias("t"))
    ranks = nearest_rank(train, ends.select(*keys, "t"), keys, "p", "t", copies)
    width = F.least(F.col("x") + r, F.lit(1.0)) - F.greatest(F.col("x") - r, F.lit(0.0))
    return (
        ends.join(ranks, [*keys, "t"])
        .groupBy(*keys, "x")
        .agg((F.max("idx") - F.min("idx")).alias("_d"))
        .select(*keys, "x", (F.col("_d") / width).alias("f"))
    )


def density_radius(
    train: DataFrame,
    queries: DataFrame,
    keys: Sequence[str] = (),
    radius: float = 0.1,
    grid: int = CELLS,
    copies: str | None = None,
) -> DataFrame:
    """Nearest-rank density of the scores ``p`` in ``train`` at the points ``x`` of ``queries``.

    f(x) counts the scores between the ranks nearest to x - r and x + r, per unit of width;
    it is divided by its integral over [0, 1], taken by the midpoint rule on ``grid`` cells.
    Columns: keys, x, density.
    """
    keys = list(keys)
    mids = (
        train.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: (i + F.lit(0.5)) / F.lit(float(grid)))).alias("x"),
        )
    )
    both = queries.select(*keys, "x", F.lit(0).alias("_g")).unionByName(mids.withColumn("_g", F.lit(1)))
    marked = both.groupBy(*keys, "x").agg(F.max("_g").alias("_g"), F.min("_g").alias("_q"))
    f = store(_raw_radius(train, marked, keys, radius, copies).join(marked, [*keys, "x"]), "density")
    area = materialize(
        f.where(F.col("_g") == 1).groupBy(*keys).agg((F.sum("f") / F.lit(float(grid))).alias("area"))
    )
    wanted = f.where(F.col("_q") == 0)
    return attach(wanted, area, keys, ["area"]).select(
        *keys, "x", F.coalesce(F.try_divide(F.col("f"), F.col("area")), F.lit(0.0)).alias("density")
    )


def radius_pair(
    train: DataFrame,
    scored: DataFrame,
    keys: Sequence[str] = (),
    y: str = "y",
    p: str = "p",
    radius: float = 0.1,
    copies: str | None = None,
) -> DataFrame:
    """(keys, p, c, dt, df), stored: the nearest-rank densities of both classes at every distinct score.

    ``c`` counts the rows of ``scored`` with that score.  All keys and both classes go through
    one ordered job; a key whose training rows lack a class has density 0 there.
    """
    keys = list(keys)
    points = present(scored, p).groupBy(*keys, F.col(p).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    both = points.select(*keys, "x", F.explode(F.array(F.lit(0), F.lit(1))).alias("cls"))
    known = present(train, y, p).select(*keys, F.col(y).cast("int").alias("cls"), F.col(p).alias("p"), *([copies] if copies else []))
    at = density_radius(known, both, [*keys, "cls"], radius, copies=copies)
    side = lambda cls: F.coalesce(F.max(F.when(F.col("cls") == cls, F.col("density"))), F.lit(0.0))
    pair = at.groupBy(*keys, "x").agg(side(1).alias("dt"), side(0).alias("df"))
    return store(points.join(pair, [*keys, "x"]).withColumnRenamed("x", p), "pair")
