"""Links between the members of lists, as whole as if all pairs of every list were verified.

A list holds names; a pair of one list is *linked* when ``verify`` says so.  Pairs inside a list are
not all formed: a pair whose two names are joined already changes no component.  The first round
compares every member with the first and the last name, which is all pairs of a list of three.  In
each further round the lists that still hold more than one component are open.  Their pivots are
picked: the member whose sketch shares most bytes with all others, then the same among those far
from it; every member is compared with the pivots of other components.  When a round closes too little,
or few pairs are left, all pairs of the open lists that cross components are tallied and verified, cell
by cell.  So no pair across two final components stays unseen, whatever the rounds did; they only
make the last step small.  Where very many different names share lists and stay apart, that step
is the square of them, spread over cells of ``BLOCK`` by ``BLOCK`` names.

A sketch is an array of longs; pairs that share fewer than ``least_shared`` of its bytes are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharewise.llm import components
from sharewise.plans import store

#: Members of an open list that one task compares at a time.
BLOCK = 1024

#: Pivots of an open list in a round.
PIVOTS = 4

#: A pivot stands for the members that share so many of its bytes.
SURE = 0.85

#: Open lists with at most so many pairs a member are finished by all pairs ...
FEW_PAIRS = 16

#: ... and so are those of which a round leaves more than this share.
SLOW = 0.75


def _sketches(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(np.uint8).reshape(rows, -1) if rows else np.zeros((0, 1), np.uint8)


def _tallied(pairs: DataFrame, sketches: DataFrame, least_shared: int) -> DataFrame:
    """Pairs (a, b) that share enough bytes."""
    if not least_shared:
        return pairs
    side = lambda n, c: sketches.select(F.col("name").alias(n), F.col("bytes").alias(c))
    both = pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_sketches(batch.column(c), batch.num_rows) for c in ("_x", "_y"))
            enough = pa.array(np.count_nonzero(x == y, axis=1) >= least_shared)
            yield batch.select(["a", "b"]).filter(enough)

    return both.select("a", "b", "_x", "_y").mapInArrow(tally, "a string, b string")


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each combination of (whole-number) keys, which stand next to one another."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)
        heads = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])
        for a, b in zip(heads, [*heads[1:], batch.num_rows], strict=True):
            this = tuple(values[a].tolist())
            if held and this != now:
                yield now, pa.Table.from_batches(held).combine_chunks()
                held = []
            now = this
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held).combine_chunks()


def _members(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """names, labels and sketches."""
    names, labels = (np.array(table.column(c).to_pylist(), object) for c in ("name", "label"))
    return names, labels, _sketches(table.column("bytes").combine_chunks(), table.num_rows)


def _central(sketches: np.ndarray) -> int:
    """The row that shares most bytes with all rows."""
    total = np.zeros(len(sketches), np.int64)
    for values in sketches.T:
        total += np.bincount(values, minlength=256)[values]
    return int(total.argmax())


def _pivots(opened: DataFrame, keys: list[str], sketches: DataFrame, turn: int) -> DataFrame:
    """keys, pivot and its label: the most central members of each open list."""
    block = F.pmod(F.xxhash64("name", F.lit(turn)), F.ceil(F.col("n") / BLOCK))
    dealt = opened.withColumn("block", block.cast("long")).join(sketches.select("name", "bytes"), "name")
    dealt = dealt.select(*keys, "block", "name", "label", "bytes").repartition(*keys, "block").sortWithinPartitions(*keys, "block")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in _groups(batches, [*keys, "block"]):
            names, labels, every = _members(table)
            left, out = np.arange(len(names)), []
            while len(left) and len(out) < PIVOTS:
                at = left[_central(every[left])]
                near = np.count_nonzero(every[left] == every[at], axis=1) >= SURE * every.shape[1]
                out.append((*key[:-1], names[at], labels[at], int(near.sum())))
                left = left[~near & (left != at)]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*[pa.int64()] * len(keys), pa.string(), pa.string(), pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "pivot", "of", "weight"])

    found = dealt.mapInArrow(pick, ", ".join(f"{k} long" for k in keys) + ", pivot string, of string, weight long")
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "pivot"))
    return found.withColumn("_best", best).where(F.col("_best") <= PIVOTS).select(*keys, "pivot", "of")


def _crossing(opened: DataFrame, keys: list[str], sketches: DataFrame, least_shared: int) -> DataFrame:
    """All pairs (a, b) of the open lists that cross components and share enough bytes."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    placed = opened.withColumn("block", F.pmod(F.xxhash64("name"), blocks))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    placed = placed.select(*keys, F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high"), "block", "name", "label")
    cell = [*keys, "low", "high"]
    dealt = placed.join(sketches.select("name", "bytes"), "name").select(*cell, "block", "name", "label", "bytes")
    dealt = dealt.repartition(*cell).sortWithinPartitions(*cell)

    def record(pairs: list[tuple]) -> pa.RecordBatch:
        a, b = zip(*pairs, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[tuple] = []
        for key, table in _groups(batches, cell):
            names, labels, every = _members(table)
            block = table.column("block").to_numpy()
            _, label = np.unique(labels.astype(str), return_inverse=True)
            for i in range(len(names) - 1):
                wanted = label[i + 1 :] != label[i]
                if key[-2] != key[-1]:
                    wanted &= block[i + 1 :] != block[i]
                at = np.flatnonzero(wanted) + i + 1
                if least_shared and len(at):
                    at = at[np.count_nonzero(every[at] == every[i], axis=1) >= least_shared]
                pairs += [(min(names[i], x), max(names[i], x)) for x in names[at]]
                if len(pairs) > 20_000:
                    yield record(pairs)
                    pairs = []
        if pairs:
            yield record(pairs)

    return dealt.mapInArrow(work, "a string, b string").distinct()


def _opened(long: DataFrame, keys: list[str], joined: DataFrame) -> tuple[DataFrame, int, int]:
    """Members of lists that hold several components (with label and n, the list's size); rows; pairs across."""
    labels = joined.select(F.col("node").alias("name"), "label")
    known = store(long.join(labels, "name", "left").select(*keys, "name", F.coalesce("label", "name").alias("label")), "labelled")
    sizes = known.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_own")).groupBy(*keys)
    sizes = sizes.agg(F.sum("_own").alias("n"), F.sum(F.col("_own") * F.col("_own")).alias("_same"))
    sizes = store(sizes.where(F.col("_same") < F.col("n") * F.col("n")), "open_lists")
    pairs = (F.col("n") * F.col("n") - F.col("_same")) / 2
    rows, crossing = sizes.agg(F.sum("n"), F.sum(pairs.cast("decimal(38,0)"))).head()
    return known.join(sizes.select(*keys, "n"), keys), int(rows or 0), int(crossing or 0)


def covered(
    rows: DataFrame, keys: list[str], sketches: DataFrame, verify: Callable[[DataFrame], DataFrame], least_shared: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(links, components) of the names in ``rows``: lists by whole-number ``keys``, and name.

    ``verify`` takes pairs (a, b), a < b, and returns those that are linked, with further columns.
    """
    rows = rows.select(*[F.col(k).cast("long").alias(k) for k in keys], "name")
    ends = rows.groupBy(*keys).agg(F.min("name").alias("first"), F.max("name").alias("last"), F.count(F.lit(1)).alias("n"))
    ends = store(ends.where("first < last"), "lists")
    met = store(rows.join(ends, keys), "met")
    against = lambda other: (F.least("name", other).alias("a"), F.greatest("name", other).alias("b"))
    pairs = met.select("name", F.explode(F.array("first", "last")).alias("other")).where("name <> other")
    pairs = store(pairs.select(*against("other")).distinct(), "pairs")
    links = store(verify(store(_tallied(pairs, sketches, least_shared), "candidates")), "found")
    joined = components.connected(links.select("a", "b"))
    long = met.where("n > 3").select(*keys, "name")
    before, turn = None, 0
    while True:
        opened, members, crossing = _opened(long, keys, joined)
        if not members:
            return links, joined
        last = crossing <= FEW_PAIRS * members or (before is not None and crossing > SLOW * before)
        opened, before, turn = store(opened, "open"), crossing, turn + 1
        if last:
            pairs = store(_crossing(opened, keys, sketches, least_shared), "candidates")
        else:
            pivots = store(_pivots(opened, keys, sketches, turn), "pivots")
            pairs = opened.join(pivots, keys).where("label <> of").select(*against("pivot")).distinct()
            pairs = store(_tallied(store(pairs, "pairs"), sketches, least_shared), "candidates")
        links = store(links.unionByName(verify(pairs)).distinct(), "found")
        joined = components.connected(links.select("a", "b"))
        if last:
            return links, joined
        long = opened.select(*keys, "name")
