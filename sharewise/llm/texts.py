"""Texts as one flat byte array per Arrow batch, for vectorised work inside tasks.

Spark hands a task its rows as Arrow batches.  A string column is already a byte buffer and
offsets, so words, hashes of words and hashes of word runs are found for all texts of a
batch at once, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Multiplier of the polynomial hash; odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15

#: At most this many bytes of text (or one text) are worked on at a time.
PIECE_BYTES = 512 << 10

#: Rows per Arrow batch while whole texts or pages go through Python.
BATCH_ROWS = 1000

WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand over ``BATCH_ROWS`` rows at a time: rows hold whole texts, and a batch of
    the default 10,000 is in memory several times over, in the executor and in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _classes(one: Sequence[int], two: Sequence[int] = ()) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(one)] = 1
    table[list(two)] = 2
    return table


#: Words: everything but white space.
WORDS = _classes([b for b in range(256) if b not in WHITE])

_ALNUM = [b for b in range(256) if chr(b).isalnum() and b < 128 or b >= 128 or b == 0x5F]

#: Words of letters, digits and non-ASCII bytes (1), runs of punctuation (2).
WORDS_AND_MARKS = _classes(_ALNUM, [b for b in range(256) if b not in WHITE and b not in _ALNUM])

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    return _powers(1 << max(16, (n - 1).bit_length()))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``H[i]``: polynomial hash of the first ``i`` bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end): depends on those bytes alone."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    size = len(column)
    if size == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, values = column.buffers()
    offsets = np.frombuffer(places, np.int64, size + 1, column.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple]:
    """Cut a batch into (first text, bytes, offsets) of at most ``limit`` bytes or one text."""
    first, size = 0, len(offsets) - 1
    while first < size:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(size, max(first + 1, last))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple:
    """(start, end, counts): maximal runs of one class, never across texts; runs per text."""
    size = len(data)
    if size == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    kind = classes[data]
    edge = np.ones(size + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:size])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    return start, end, np.diff(np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple:
    """(hash of each word, words per text)."""
    start, end, counts = spans(data, offsets, classes)
    return span_hash(prefix_hash(data), start, end), counts


def run_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple:
    """(hash of each run of ``width`` words, runs per text).

    A text with fewer words has one run of all of them; a text without words has none.
    """
    last = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(words))
    first = np.repeat(np.cumsum(counts) - counts, counts)
    at = at[(at + width <= last) | (at == first)]
    total = np.zeros(len(at), np.uint64)
    step = 1
    for i in range(width):
        step = step * BASE % (1 << 64)
        inside = at + i < last[at]
        part = words[np.minimum(at + i, len(words) - 1)] if len(words) else words
        total += np.where(inside, part * np.uint64(step) + np.uint64(1), np.uint64(0))
    runs = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    return mix(total), runs
