"""Mixing sources to target weights by balanced sampling (the cube method).

A source's rate is its target over its size.  Each text is taken floor(rate) times for sure; the
rest of the rate is its inclusion probability.  The flight phase moves the probabilities of three
texts at a time along the null space of the constraints (total of words, number of texts) until
one of them is 0 or 1.  It runs in blocks of a source, each block in one task; the texts a
block leaves undecided meet in fewer blocks, level by level, until a source has one block.
Some texts of all sizes sit out the flight of each block and go on with those it leaves undecided.
In the last block they land: many draws by their chances are compared, and that nearest the totals
is taken and mended text by text.  Blocks are cut by a hash, so a source with a third of all rows is many blocks, and only counts reach the driver.

Defined cases: a null text has size 0; a null source is one source, last in order; texts without
words are taken by chance like others and add nothing; if no text has a word, all targets
are 0; repeated rows are drawn each; an empty table gives no rows; other columns pass unread.
Reruns agree: every draw comes from a hash of the block and its rows.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharewise.plans import dense_index, store

#: Texts per block.
BLOCK = 4096

#: Least and largest number of texts of a block that sit out its flight, and draws compared at the landing.
RESERVE, MOST_RESERVE, LANDINGS = 24, 256, 4096

#: No text is taken more often.
MOST_COPIES = 3

_SPACE = r"[^\x20\x09-\x0D]+"


def size_of(text: F.Column) -> F.Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_SPACE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, texts, source_size and target of every source, from rows of source and size.

    Weights 1, 2, 3 repeat over the sources in order of their UTF-8 bytes, null last.  The total is
    shared by weight; a share over ``MOST_COPIES`` times its source's size stops there, and
    what it leaves is shared again among the others until no share is above.
    """
    by = store(
        sizes.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("source_size"))
        .withColumn("_last", F.col("source").isNull().cast("int"))
        .withColumn("_name", F.coalesce("source", F.lit(""))),
        "sources",
    )
    ranked = store(dense_index(by, ["_last", "_name"], name="_rank").withColumn("weight", F.col("_rank") % 3 + 1), "ranked")
    total, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).head()
    left, free, full = total or 0, weights or 0, 0
    share = F.lit(0.0)
    while free:
        share = F.col("weight") * F.lit(int(left)).cast("double") / F.lit(int(free)).cast("double")
        limit = F.col("source_size") * MOST_COPIES
        row = ranked.where(share > limit).agg(F.sum(limit), F.sum("weight"), F.count(F.lit(1))).head()
        if row[2] == full:
            break
        full = row[2]
        left, free = (total or 0) - row[0], weights - row[1]
    return ranked.select(
        "source", "texts", "source_size",
        F.least(share, (F.col("source_size") * MOST_COPIES).cast("double")).alias("target"),
    )


def fly(chance: list[float], size: list[int], draw: random.Random) -> list[float]:
    """Move the chances of one block until at most two are undecided; order is kept."""
    chance = list(chance)
    active: list[int] = []
    for i in range(len(chance)):
        if 0.0 < chance[i] < 1.0:
            active.append(i)
        if len(active) == 3:
            a, b, c = active
            u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
            if not any(u):
                u = (1.0, -1.0, 0.0)
            _move(chance, active, u, draw)
            active = [k for k in active if 0.0 < chance[k] < 1.0]
    return chance


def _move(chance: list[float], at: list[int], u: tuple[float, ...], draw: random.Random) -> None:
    """Go along u or against it, as far as the chances allow, with equal expectation."""
    up = min(((1 - chance[k]) / x if x > 0 else chance[k] / -x) for k, x in zip(at, u, strict=False) if x)
    down = min((chance[k] / x if x > 0 else (1 - chance[k]) / -x) for k, x in zip(at, u, strict=False) if x)
    step = up if draw.random() * (up + down) < down else -down
    moved = []
    for k, x in zip(at, u, strict=False):
        new = chance[k] + step * x
        moved.append((abs(new - round(new)), k))
        chance[k] = min(1.0, max(0.0, 0.0 if new < 1e-9 else 1.0 if new > 1 - 1e-9 else new))
    nearest = min(m for m in moved if u[at.index(m[1])])[1]
    chance[nearest] = float(round(chance[nearest]))


def land(chance: list[float], size: list[int], draw: random.Random) -> list[float]:
    """Decide the last texts of a source: of many draws by their chances the one nearest both totals.

    Turning one or two texts the other way follows while that comes nearer.  A text counts as
    much as a word.  One or two texts leave no choice: they keep the total of words as far as they can, and
    the last is drawn.
    """
    chance = list(chance)
    at = [i for i, p in enumerate(chance) if 0.0 < p < 1.0]
    if len(at) == 2:
        a, b = at
        _move(chance, at, (float(size[b]), -float(size[a])) if size[a] or size[b] else (1.0, -1.0), draw)
        at = [i for i in at if 0.0 < chance[i] < 1.0]
    if len(at) <= 1:
        for i in at:
            chance[i] = float(draw.random() < chance[i])
        return chance
    p = np.array([chance[i] for i in at])
    words = np.array([float(size[i]) for i in at])

    def miss(taken: np.ndarray) -> np.ndarray:
        off = taken - p
        return np.abs(off @ words) + np.abs(off.sum(axis=-1))

    rng = np.random.default_rng(draw.getrandbits(64))
    drawn = rng.random((LANDINGS, len(at))) < p
    taken = drawn[miss(drawn).argmin()].astype(float)
    one, two = np.triu_indices(len(at))
    single = one == two
    while True:
        off, turn = taken - p, 1 - 2 * taken
        more = np.where(single, 0, turn[two])
        now = np.abs(off @ words + turn[one] * words[one] + more * words[two]) + np.abs(off.sum() + turn[one] + more)
        if now.min() >= miss(taken) - 1e-6:
            break
        for i in {int(one[now.argmin()]), int(two[now.argmin()])}:
            taken[i] = 1 - taken[i]
    for i, t in zip(at, taken.tolist(), strict=True):
        chance[i] = t
    return chance


def fly_but_some(chance: list[float], size: list[int], draw: random.Random, most: int) -> list[float]:
    """The flight of a block whose texts are in order of size, without some of the undecided texts.

    These are evenly spaced in that order and go on undecided, with the two the flight leaves: texts of every
    size, which can make up for one large text where the source lands.  There are ``RESERVE`` of them, or as
    many as outweigh the largest text twice; ``most`` at most.
    """
    at = [i for i, p in enumerate(chance) if 0.0 < p < 1.0]
    free = sum(size[i] * min(chance[i], 1 - chance[i]) for i in at)
    largest = max((size[i] for i in at), default=0)
    few = min(max(RESERVE, math.ceil(2 * largest * len(at) / free) if free else 0), len(at), most)
    kept = {at[k * len(at) // few] for k in range(few)}
    rest = [i for i in range(len(chance)) if i not in kept]
    flown = fly([chance[i] for i in rest], [size[i] for i in rest], draw)
    out = list(chance)
    for i, p in zip(rest, flown, strict=True):
        out[i] = p
    return out


def _level(rows: DataFrame, final: bool) -> DataFrame:
    """One flight over blocks; ``final`` lands as well."""

    def work(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["size", "hash", "id"], ascending=[False, True, True], na_position="last")
        draw = random.Random(f"{block['hash'].iloc[0]} {len(block)} {block['block'].iloc[0]}")
        size = block["size"].tolist()
        most = MOST_RESERVE if final else min(MOST_RESERVE, len(size) // 4)
        chance = fly_but_some(block["chance"].tolist(), size, draw, most)
        block["chance"] = land(chance, size, draw) if final else chance
        return block

    return rows.groupBy("source", "block").applyInPandas(work, rows.schema)


def inclusion(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """id, source, hash and taken (0 or 1) for rows of id, source, size, hash and chance in [0, 1]."""
    rows = store(rows.withColumn("block", F.lit(0).cast("long")), "chances")
    decided = "chance <= 0 or chance >= 1"
    done = [rows.where(decided)]
    rows = rows.where(f"not ({decided})")
    level = 0
    while True:
        counts = rows.groupBy("source").count().withColumn("blocks", F.ceil(F.col("count") / block))
        most = counts.agg(F.max("blocks")).head()[0]
        if most is None:
            break
        counts = counts.select(F.col("source").alias("_source"), "blocks")
        dealt = rows.join(counts, F.col("source").eqNullSafe(F.col("_source"))).select(
            "id", "source", "size", "hash", "chance",
            F.pmod(F.xxhash64("hash", "id", F.lit(level)), F.col("blocks")).alias("block"),
        )
        flown = store(_level(dealt, most == 1), "flight")
        done.append(flown.where(decided))
        rows = flown.where(f"not ({decided})")
        level += 1
        if most == 1:
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("id", "source", "hash", F.col("chance").cast("long").alias("taken"))


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words, repeats counted) of every row."""
    sizes = store(
        docs.select(
            F.col("doc_id"), F.col("doc_id").cast("string").alias("id"), F.col("source"), size_of(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "source", "text").alias("hash"),
        ),
        "sizes",
    )
    by = targets(sizes).select(F.col("source").alias("_source"), "source_size", "target")
    rated = sizes.join(by, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    )
    rated = store(rated.select("doc_id", "id", "source", "size", "hash", "source_size", "target", "rate"), "rated")
    chosen = inclusion(
        rated.select("id", "source", "size", "hash", (F.col("rate") - F.floor("rate")).alias("chance")), block
    )
    # Repeated rows share id and hash: number them on both sides, so each meets its own draw.
    same = Window.partitionBy("id", "hash")
    left = rated.withColumn("_no", F.row_number().over(same.orderBy("size")))
    right = chosen.withColumn("_no", F.row_number().over(same.orderBy("taken"))).select(
        F.col("id").alias("_id"), F.col("hash").alias("_hash"), "_no", F.col("taken").alias("_extra")
    )
    met = left.join(
        right, (F.col("id").eqNullSafe(F.col("_id"))) & (F.col("hash") == F.col("_hash")) & (left["_no"] == right["_no"])
    )
    copies = (F.floor("rate") + F.col("_extra")).cast("long")
    return met.select(
        "doc_id", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), F.col("hash").alias("_hash"),
    )


def mix_rows(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    hashed = docs.withColumn("__sw_hash", F.xxhash64("doc_id", "source", "text"))
    copies = mix(docs, block).groupBy("doc_id", "_hash").agg(F.array_sort(F.collect_list("copies")).alias("__sw_copies"))
    copies = copies.select(F.col("doc_id").alias("__sw_id"), F.col("_hash").alias("__sw_h"), "__sw_copies")
    met = hashed.join(copies, F.col("doc_id").eqNullSafe(F.col("__sw_id")) & (F.col("__sw_hash") == F.col("__sw_h")))
    single = met.where(F.size("__sw_copies") == 1).withColumn("__sw_n", F.col("__sw_copies")[0])
    window = Window.partitionBy("__sw_id", "__sw_h").orderBy(F.lit(1))
    many = met.where(F.size("__sw_copies") > 1).withColumn("__sw_n", F.element_at("__sw_copies", F.row_number().over(window)))
    both = single.unionByName(many).where("__sw_n > 0")
    return both.withColumn("__sw_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__sw_n")))).select(*docs.columns)

