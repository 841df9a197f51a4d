"""Hard negatives by slots: the positives' upper limits cut the scores into disjoint slots.

An anchor's positives are its best rows of the same label.  A positive of score s asks for the
best rows of other labels in the window from ``low`` to ``high`` per cent of s.  These windows overlap;
but their upper limits, in descending order, cut the scores into disjoint slots, one per positive.  Each
tile of anchors and candidates keeps its k best per slot, lists of a slot are merged as a tree,
and what a window asks is the merge of its slot and all lower ones, from the lowest up, cut at k
and then at the window's lower limit.  So every candidate is scored once for all windows, and
only k rows a slot leave a tile.

Vectors are floor(scale * x), scores their exact inner products.  Both passes deal anchors and
candidates into blocks by a hash of the row, so neither a hot label nor a hot vector is a
task's burden; blocks are bounded in bytes.

Defined cases: rows with a null label, vec_id or vector, or with a null or non-finite component, take no part;
rows that share a vec_id count each, as anchors too, and an anchor leaves out its own row alone; vectors meet
those of their own length only; scores beyond a long stop at its ends; ties go to the smaller
vec_id; a positive of a score below 0 has an empty window; anchors without positives and
windows without negatives give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.llm.topk import ROWS_AT_ONCE, SCALE, best, integers, matrix, merge_lists, number_rows, prefixed, scores
from sharewise.plans import store

#: Bytes of vectors in a block of anchors or of candidates.
BLOCK_BYTES = 4 << 20

Selected = tuple[np.ndarray, ...]


def share(score: str, percent: int, up: bool = False) -> Column:
    """floor (or ceiling) of percent / 100 of a column of long scores, by parts that stay within a long."""
    part = F.ceil if up else F.floor
    rest = part(F.col(score) % F.lit(100) * percent / 100)
    return (F.expr(f"{score} div 100") * percent + rest).cast("long")


def select_positives(a: tuple, c: tuple, k: int) -> Selected:
    """(anchor rows, vec ids, scores): the k best candidates of the anchor's label.

    Both sides are (vectors, ids, rows, labels) in order of id.  Labels are worked on one by one, so a
    product is made within a label only.
    """
    found: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    for label in np.intersect1d(a[3], c[3]):
        own, (vectors, ids, rows, _) = a[3] == label, (x[c[3] == label] for x in c)
        anchors, numbers = a[0][own], a[2][own]
        for at in range(0, len(anchors), ROWS_AT_ONCE):
            s = scores(anchors[at : at + ROWS_AT_ONCE], vectors)
            some = numbers[at : at + ROWS_AT_ONCE]
            row, col = best(s, some[:, None] != rows[None, :], k)
            found.append((some[row], ids[col], s[row, col]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def select_slots(a: tuple, high: np.ndarray, low: np.ndarray, c: tuple, k: int) -> Selected:
    """(anchor rows, slots, vec ids, scores): the k best candidates of other labels in each slot.

    Slot i holds the scores in (high[i + 1], high[i]] that are not below low[i], the least lower limit of the
    windows that reach down to it.  Both limits descend; slots an anchor lacks have a high
    below all scores.
    """
    found: list[tuple] = []
    for at in range(0, len(a[0]), ROWS_AT_ONCE):
        vectors, _, rows, labels = (x[at : at + ROWS_AT_ONCE] for x in a)
        tops, ends = high[at : at + ROWS_AT_ONCE], low[at : at + ROWS_AT_ONCE]
        s = scores(vectors, c[0])
        other = labels[:, None] != c[3][None, :]
        for slot in range(tops.shape[1]):
            inside = other & (s <= tops[:, slot, None]) & (s >= ends[:, slot, None])
            if slot + 1 < tops.shape[1]:
                inside &= s > tops[:, slot + 1, None]
            row, col = best(s, inside, k)
            found.append((rows[row], np.full(len(row), slot), c[1][col], s[row, col]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tiles(anchors: DataFrame, vectors: DataFrame, blocks: int, shards: int):
    """Every block of anchors with every shard of candidates of its length."""
    spread = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("block", spread(blocks, 1)).withColumn("shard", every(shards))
    right = vectors.withColumn("shard", spread(shards, 2)).withColumn("block", every(blocks))
    key = ("dim", "shard", "block")
    return prefixed(left).groupBy(*[f"q_{c}" for c in key]).cogroup(right.groupBy(*key))


def _table(key: tuple, found: Selected, *names: str) -> pa.Table:
    columns = {n: pa.array(x, pa.int64()) for n, x in zip(names, found, strict=True)}
    return pa.table(columns | {"node": pa.array(np.full(len(found[0]), key[1].as_py()), pa.int32())})


def _nothing(width: int) -> Selected:
    return (np.zeros(0, np.int64),) * width


def mine(
    table: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``table`` has vec_id, label and embedding.  A negative of a positive of score s has low * s <= 100 * score <= high * s.
    """
    vectors = number_rows(integers(table.where(F.col("label").isNotNull()), scale, ["label"]))
    total, asked, width = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_anchor, 1)), F.max("dim")).head()
    block_rows = max(ROWS_AT_ONCE, BLOCK_BYTES // (8 * max(1, width or 1)))
    blocks, shards = max(1, -(-asked // block_rows)), max(1, -(-total // block_rows))
    anchors = vectors.where(is_anchor)
    side = ("v", "vec_id", "row", "label")
    own = tuple(f"q_{c}" for c in side)

    def near(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        both = left.num_rows and right.num_rows
        found = select_positives(matrix(left, *own), matrix(right, *side), positives) if both else _nothing(3)
        return _table(key, found, "row", "vec_id", "score")

    lists = _tiles(anchors, vectors, blocks, shards).applyInArrow(near, "row long, vec_id long, score long, node int")
    chosen = store(
        merge_lists(lists, ["row"], shards, positives).select(
            "row", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
            share("score", high).alias("high"), share("score", low, up=True).alias("low"),
        ),
        "positives",
    )
    window = F.sort_array(F.collect_list(F.struct("slot", "high", "low")))
    limits = chosen.groupBy("row").agg(window.alias("windows"))
    limited = anchors.join(limits, "row").select("dim", *side, F.col("windows.high").alias("high"), F.col("windows.low").alias("low"))

    def slots(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return _table(key, _nothing(4), "row", "slot", "vec_id", "score")
        order = np.lexsort([left.column(c).to_numpy() for c in ("q_label", "q_row", "q_vec_id")])
        top, end = np.full((len(order), positives), -(1 << 63)), np.zeros((len(order), positives), np.int64)
        for i, (h, lo) in enumerate(zip(left.column("q_high").to_pylist(), left.column("q_low").to_pylist(), strict=True)):
            top[i, : len(h)], end[i, : len(lo)] = h, lo
        found = select_slots(matrix(left, *own), top[order], end[order], matrix(right, *side), negatives)
        return _table(key, found, "row", "slot", "vec_id", "score")

    lists = _tiles(limited, vectors, blocks, shards).applyInArrow(slots, "row long, slot long, vec_id long, score long, node int")
    kept = merge_lists(lists, ["row", "slot"], shards, negatives)
    by_anchor = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "vec_id", "score"))).alias("found"))
    answers = by_anchor.select("row", suffixes(F.col("found"), positives, negatives).alias("answers"))
    asked_for = chosen.join(answers, "row").join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    inside = F.filter(F.element_at("answers", F.col("slot") + 1), lambda x: x["score"] >= F.col("low"))
    return asked_for.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("place", "hit")).select(
        "anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("negative_id"), "positive_score", F.col("hit.score").alias("negative_score"),
    )


def suffixes(found: Column, slots: int, k: int) -> Column:
    """For each slot the k best of it and all lower slots, from lists in order of slot and rank.

    Slots are disjoint and descend, so a merge is a concatenation; it goes from the lowest slot up.
    """
    none = F.filter(found, lambda x: F.lit(False))

    def merged(below: list[Column], slot: int) -> list[Column]:
        own = F.filter(found, lambda x: x["slot"] == slot)
        return [F.slice(F.concat(own, below[0] if below else none), 1, k), *below]

    return F.array(*reduce(merged, reversed(range(slots)), []))
