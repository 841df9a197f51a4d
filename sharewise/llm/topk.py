"""Exact top-k search: tiles of queries and shards, selection per tile, tree merge per query.

Vectors become integers, ``floor(scale * x)``.  Queries and candidates are cut into blocks by a
hash; a tile is one block of queries and one of candidates, scored by one matrix product
(doubles while every product is below 2**53 and so exact, whole Python numbers beyond).  A
tile gives at most k rows per query; the lists of a query are merged 32 at a time, level by
level, so no task reads all lists of a query at once.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows
without vec_id; rows that share a vec_id are candidates each, and queries each (a query leaves
out its own row alone); a query meets vectors of its own length only; scores beyond a long stop
at its ends; ties go to the smaller vec_id; a query without any candidate has no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharewise.plans import store

SCALE = 256
QUERY_BLOCK = 4096
SHARD = 4096
FAN_IN = 32

#: Queries whose scores against a shard are in memory together.
ROWS_AT_ONCE = 256

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def integers(table: DataFrame, scale: int = SCALE, keep: Sequence[str] = ()) -> DataFrame:
    """vec_id, the columns to keep and v (array of long) of every usable row."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return rows.select("vec_id", *keep, v.alias("v"))


def number_rows(vectors: DataFrame) -> DataFrame:
    """The vectors as a stored table with ``dim``, their length, and ``row``, a number of their own."""
    return store(vectors.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(table: pa.Table, vector: str, *names: str) -> tuple[np.ndarray, ...]:
    """(vectors, then the named columns) in order of the first name, then of the others."""
    columns = [table.column(n).to_numpy() for n in names]
    values = table.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort(columns[::-1])
    return values.reshape(len(order), -1)[order], *[c[order] for c in columns]


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    largest = [max((abs(int(m.min())), abs(int(m.max())))) if m.size else 0 for m in (q, c)]
    if largest[0] * largest[1] * q.shape[1] < 1 << 53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, _LOW, _HIGH).astype(np.int64)


def best(score: np.ndarray, valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest valid scores of each row, ties to the smaller column."""
    s = np.where(valid, score, _LOW)
    take = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take, None]
    above, level = s > least, (s == least) & valid
    level &= np.cumsum(level, axis=1) <= take - above.sum(axis=1, keepdims=True)
    return np.nonzero(above & valid | level)


def select_tile(q: tuple[np.ndarray, ...], c: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """(query ids, query rows, vec ids, scores): the k best candidates of each query, its own row left out.

    Both sides are (vectors, ids, rows) in order of id.
    """
    found: list[tuple] = []
    for at in range(0, len(q[0]), ROWS_AT_ONCE):
        vectors, ids, rows = (x[at : at + ROWS_AT_ONCE] for x in q)
        s = scores(vectors, c[0])
        row, col = best(s, rows[:, None] != c[2][None, :], k)
        found.append((ids[row], rows[row], c[1][col], s[row, col]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def prefixed(df: DataFrame) -> DataFrame:
    """All columns under ``q_`` names: the sides of a cogroup may not share columns."""
    return df.select(*[F.col(c).alias(f"q_{c}") for c in df.columns])


def merge_lists(lists: DataFrame, keys: Sequence[str], nodes: int, k: int) -> DataFrame:
    """The k best of each key, as ``rank``, from lists of ``node`` 0 to ``nodes - 1``, ``FAN_IN`` at a time."""
    while True:
        nodes = -(-nodes // FAN_IN)
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int"))
        order = Window.partitionBy(*keys, "node").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if nodes == 1:
            return lists.drop("node")


def search(table: DataFrame, is_query: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every query."""
    vectors = number_rows(integers(table, scale))
    total, asked = vectors.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).head()
    shards, blocks = max(1, -(-total // SHARD)), max(1, -(-asked // QUERY_BLOCK))
    spread = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = vectors.where(is_query).withColumn("block", spread(blocks, 1)).withColumn("shard", every(shards))
    candidates = vectors.withColumn("shard", spread(shards, 2)).withColumn("block", every(blocks))

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if left.num_rows and right.num_rows:
            out = select_tile(matrix(left, "q_v", "q_vec_id", "q_row"), matrix(right, "v", "vec_id", "row"), k)
        columns = dict(zip(("query_id", "query_row", "vec_id", "score"), (pa.array(x, pa.int64()) for x in out), strict=True))
        return pa.table(columns | {"node": pa.array(np.full(len(out[0]), key[1].as_py()), pa.int32())})

    key = ("dim", "shard", "block")
    tiles = prefixed(queries).groupBy(*[f"q_{c}" for c in key]).cogroup(candidates.groupBy(*key))
    lists = tiles.applyInArrow(tile, "query_id long, query_row long, vec_id long, score long, node int")
    return merge_lists(lists, ["query_id", "query_row"], shards, k).select("query_id", "rank", "vec_id", "score")
