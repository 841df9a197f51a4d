"""Harmonic packing of token ids into sequences of a fixed capacity.

A document's ids are cut into full sequences and a rest.  A rest of length r belongs to the class of
the reciprocal 1 / k of the capacity, k = capacity // r: a bin of that class takes k pieces, each
at most capacity // k long.  Where r fills that slot but for ``slack``, it is one piece; otherwise a
piece as long as the next smaller slot is cut off, which fills it, and what is left is classed
again.  A bin is closed by the number of its pieces alone, so a worker keeps one open bin a
class and looks at no other.

Every task is such a worker: it packs the rows of its own partition, so nothing is shuffled.  At
its end the bins that lack pieces are emptied and their ids cut anew into full sequences and, for the
last, powers of two, which need no padding; that is at most one bin a class.  Memory is
bounded by the open bins, one batch of texts and its ids.

Ids come from tiktoken, loaded with the vocabulary and the added tokens of the tokenizers library's
file; both libraries give the same ids, and tiktoken takes a quarter of the time.

Defined cases: a null text counts as empty and has the end id alone; every row is a document of
its own, so repeated rows and ids are packed each; a null doc_id stays null; an empty table gives no rows;
other columns are not read.  The pieces depend on the text alone, sequences on the partitions too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 2048

#: The part of a slot that may stay empty.
SLACK = 1 / 32

#: Texts, and bytes of text, whose ids are in memory together.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 250, 1 << 20

#: Sequences of one task.
_TASK_BITS = 40

Piece = tuple[int, int, int]


@lru_cache(maxsize=2)
def load_encoding(path: str, pattern: str):
    """The encoding of a byte-level BPE file of the tokenizers library.

    Its vocabulary writes each byte as a printable character: those that print stand for themselves,
    the others in order for the characters from 256 on.  Merges are in order of the id they make.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printed]
    byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in added}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def cut(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if slot - rest > slack * slot:
            slot = capacity // (k + 1)
        out.append(min(slot, rest))
        rest -= out[-1]
    return out


def recut(length: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of sequences for ids that may be cut anywhere: full ones, then powers of two."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        nearly = capacity - rest <= slack * capacity
        out.append(rest if nearly else 1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


class Bins:
    """One open bin for each class; a piece is any (length, what), closed bins are handed to ``close``."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = {}

    def put(self, length: int, what: tuple) -> list[tuple]:
        """The bin, as (sequence, offset, what) of its pieces, if the piece completes it."""
        k = self.capacity // length
        pieces = self.open.setdefault(k, [])
        pieces.append((length, what))
        return self.close([self.open.pop(k)]) if len(pieces) == k else []

    def close(self, bins: list[list[tuple]]) -> list[tuple]:
        out = []
        for pieces in bins:
            at = 0
            for length, what in pieces:
                out.append((self.next, at, what))
                at += length
            self.next += 1
        return out

    def rest(self, slack: float) -> list[tuple]:
        """The pieces of all open bins, cut anew; what is (row, start, ids, tokens)."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        bins: list[list[tuple]] = []
        for size in recut(sum(length for length, _ in pieces), self.capacity, slack):
            bins.append([])
            while size:
                length, (row, start, ids, tokens) = pieces.pop(0)
                part = min(size, length)
                bins[-1].append((part, (row, start, ids[:part], tokens)))
                if part < length:
                    pieces.insert(0, (length - part, (row, start + part, ids[part:], tokens)))
                size -= part
        return self.close(bins)


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, small in rows and in bytes of text (or one text)."""
    sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        fits = int(np.searchsorted(np.cumsum(sizes[at : at + TEXTS_AT_ONCE]), BYTES_AT_ONCE, "right"))
        yield batch.slice(at, max(1, fits))
        at += max(1, fits)


def pack(
    docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, slack: float = SLACK, end: int = 1
) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id and offset of every piece.

    ``ids`` are little-endian 32-bit integers.  A document's ids are those of its text and ``end``.
    ``vocabulary`` is a path that every executor can open.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")

    def rows(done: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*((w[0], w[1], len(w[2]), w[2].tobytes(), w[3], s, at) for s, at, w in done), strict=True)) or [()] * 7
        kinds = (ids, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], list(names))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(vocabulary, pattern)
        bins = Bins(capacity, TaskContext.get().partitionId() << _TASK_BITS)
        of_ids = None
        for whole in batches:
            of_ids = whole.schema.field("doc_id").type
            for part in _batches(whole):
                done: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = np.append(encoding.encode_to_numpy(text or "", allowed_special="all"), end).astype("<u4")
                    start = 0
                    for length in cut(len(own), capacity, slack):
                        done += bins.put(length, (doc, start, own[start : start + length].copy(), len(own)))
                        start += length
                yield rows(done, of_ids)
        if of_ids is not None:
            yield rows(bins.rest(slack), of_ids)

    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select("doc_id", "text").mapInArrow(work, schema)
