"""Byte-level BPE by merge replay over the words of a whole batch.

A text is split by the tokenizer's pattern.  All words of an Arrow batch that the task has not met
yet form one corpus: an inverted index goes from a pair, by its rank, to its places in the words, and
merges are replayed in the order of rank over the whole index, each touching only the two
neighbours of the places it joins.  A word's ids don't depend on the other words, so batches and tasks agree.

Defined cases: a null text counts as empty and has no ids; long runs without a break are
words like any other; repeated rows are encoded each; ids decode to the same bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: A task forgets its words when they take this many bytes, ``WORD_BYTES`` being what a word takes besides its own.
KEPT_BYTES, WORD_BYTES = 24 << 20, 200

#: Texts, and bytes of text, whose words are replayed together.
TEXTS_AT_ONCE, BYTES_AT_ONCE = 1000, 4 << 20


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank (which is the id) from a rank file of base64 tokens."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def load_pairs(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(pair, rank) in order of pair: every way to make a token from two tokens; left << 16 | right."""
    return pairs_of(load_ranks(path))


def pairs_of(ranks: Mapping[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    if max(ranks.values(), default=0) >= 1 << 16:
        raise ValueError("pairs are packed as 16 bits each: the vocabulary has an id beyond 65,535")
    found = [
        (ranks[raw[:i]] << 16 | ranks[raw[i:]], rank)
        for raw, rank in ranks.items()
        for i in range(1, len(raw))
        if raw[:i] in ranks and raw[i:] in ranks
    ]
    out = np.array(sorted(found), np.int64).reshape(-1, 2)
    return out[:, 0].copy(), out[:, 1].copy()


class _Index:
    """Places of pairs by rank: slabs of 256 ranks, each a list of (rank, place, pair) arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray) -> None:
        self.pairs, self.ranks = pairs, ranks
        #: Tokens that join some neighbour at a rank below their own.
        self.early = np.zeros(max(1 << 16, int(ranks.max(initial=0)) + 1), bool)
        for part in (pairs >> 16, pairs & 0xFFFF):
            self.early[part[part > ranks]] = True
        self.slabs: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.order: list[int] = []

    def put(self, slab: int, entries: tuple[np.ndarray, ...]) -> None:
        if slab not in self.slabs:
            self.slabs[slab] = []
            heapq.heappush(self.order, slab)
        self.slabs[slab].append(entries)

    def rank_of(self, pairs: np.ndarray) -> np.ndarray:
        """The rank at which each pair is merged, -1 where it makes no token."""
        if not len(self.pairs):
            return np.full(len(pairs), -1)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.ranks[at], -1)

    def add(self, places: np.ndarray, pairs: np.ndarray) -> None:
        """Post the places whose pair makes a token."""
        ranks = self.rank_of(pairs)
        hit = ranks >= 0
        places, pairs, ranks = places[hit], pairs[hit], ranks[hit]
        slab = ranks >> 8
        by = np.argsort(slab.astype(np.uint16), kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(slab[by]) != 0]) if len(by) else []
        for a, b in zip(heads, [*heads[1:], len(by)], strict=False):
            some = by[a:b]
            self.put(int(slab[some[0]]), (ranks[some], places[some], pairs[some]))

    def lowest(self) -> tuple[int, tuple[np.ndarray, ...]]:
        slab = heapq.heappop(self.order)
        return slab, tuple(np.concatenate(x) for x in zip(*self.slabs.pop(slab), strict=True))


def _early(index: _Index, rank: np.ndarray, place: np.ndarray, symbol: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places whose new token joins a neighbour, as it is or merged alike, at a rank below its own."""
    before, after = left[place], right[right[place]]
    sides = [
        np.where(before >= 0, symbol[before] << 16 | rank, -1),
        np.where(after >= 0, rank << 16 | symbol[after], -1),
        rank << 16 | rank,
    ]
    out = np.zeros(len(place), bool)
    for key in sides:
        joined = index.rank_of(key)
        out |= (joined >= 0) & (joined < rank)
    return out


def _applied(index: _Index, rank: np.ndarray, place: np.ndarray, word: np.ndarray, symbol: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which entries, in order of (word, rank, place), are merged now: those of the word's lowest rank.

    Of places that overlap, every other one from the left.  A word in which a new token would join a
    neighbour at a still lower rank merges its leftmost place alone, as that join comes first.
    """
    at = np.arange(len(place))
    head = np.r_[True, word[place[1:]] != word[place[:-1]]]
    own = np.cumsum(head) - 1
    lowest = rank == rank[head][own]
    alone = np.zeros(own[-1] + 1, bool)
    check = np.flatnonzero(lowest & index.early[rank])
    alone[own[check[_early(index, rank[check], place[check], symbol, left, right)]]] = True
    some = at[lowest & (head | ~alone[own])]
    overlaps = np.r_[False, place[some[1:]] == right[place[some[:-1]]]]
    turn = np.arange(len(some))
    chain = np.maximum.accumulate(np.where(overlaps, 0, turn))
    out = np.zeros(len(place), bool)
    out[some[(turn - chain) % 2 == 0]] = True
    return out


def replay(words: Sequence[bytes], ranks: Mapping[bytes, int], pairs: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """The ids of each word, packed as 32-bit integers, from one replay of the merges over all words.

    The lowest slab of ranks that has places is taken; in it each word applies its lowest rank at all
    its places, leftmost first, and the pairs of the touched neighbours are posted anew.  What
    else the slab holds goes back, so a pair of a still lower rank comes first and every word sees
    its merges in the order of rank.  A very long word takes as many turns as it has ranks, not places.
    """
    whole = [ranks.get(w) for w in words]
    split = [i for i, r in enumerate(whole) if r is None and words[i]]
    out = [b"" if r is None else r.to_bytes(4, "little") for r in whole]
    if not split:
        return out
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    symbol = single[np.frombuffer(b"".join(words[i] for i in split), np.uint8)]
    sizes = np.array([len(words[i]) for i in split])
    word = np.repeat(np.arange(len(split)), sizes)
    size = len(symbol)
    right, left = np.arange(1, size + 1), np.arange(-1, size - 1)
    last = np.cumsum(sizes) - 1
    right[last] = -1
    left[last - sizes + 1] = -1

    def pair(places: np.ndarray) -> np.ndarray:
        """The pair at each place, -1 where there is none."""
        after = right[places]
        return np.where((after >= 0) & (symbol[places] >= 0), symbol[places] << 16 | symbol[after], -1)

    index = _Index(*pairs)
    index.add(np.arange(size), pair(np.arange(size)))
    while index.order:
        slab, (rank, place, key) = index.lowest()
        valid = pair(place) == key
        rank, place, key = rank[valid], place[valid], key[valid]
        if len(place) == 0:
            continue
        order = np.lexsort((place, rank, word[place]))
        rank, place, key = rank[order], place[order], key[order]
        apply = _applied(index, rank, place, word, symbol, left, right)
        if not apply.all():
            index.put(slab, (rank[~apply], place[~apply], key[~apply]))
        p, merged = place[apply], rank[apply]
        q = right[p]
        symbol[p], symbol[q] = merged, -1
        after = right[q]
        right[p] = after
        left[after[after >= 0]] = p[after >= 0]
        before = left[p]
        touched = np.unique(np.concatenate([before[before >= 0], p]))
        index.add(touched, pair(touched))
    ends = np.cumsum(np.bincount(word[symbol >= 0], minlength=len(split))) * 4
    packed = symbol[symbol >= 0].astype("<i4").tobytes()
    at = 0
    for i, end in zip(split, ends.tolist(), strict=True):
        out[i] = packed[at:end]
        at = end
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, bounded in rows and in bytes of text (or one text)."""
    sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        fits = int(np.searchsorted(np.cumsum(sizes[at : at + TEXTS_AT_ONCE]), BYTES_AT_ONCE, "right"))
        yield batch.slice(at, max(1, fits))
        at += max(1, fits)


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """doc_id and ids of batches of doc_id and text."""
    import regex

    split = regex.compile(pattern).findall
    ranks, pairs = load_ranks(vocabulary), load_pairs(vocabulary)
    known: dict[str, bytes] = {}
    size = 0
    for batch in batches:
        for part in _slices(batch):
            texts = [split(t or "") for t in part.column("text").to_pylist()]
            if size > KEPT_BYTES:
                known.clear()
                size = 0
            new = list(set().union(*texts).difference(known))
            packed = replay([w.encode() for w in new], ranks, pairs)
            known.update(zip(new, packed, strict=True))
            size += sum(map(len, new)) + sum(map(len, packed)) + WORD_BYTES * len(new)
            ids = [b"".join(map(known.__getitem__, words)) for words in texts]
            ends = np.cumsum([0, *map(len, ids)]) // 4
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["doc_id", "ids"]
            )


@lru_cache(maxsize=1)
def load_tokens(path: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(all tokens in one string, start of each id, its length)."""
    ranks = load_ranks(path)
    length = np.zeros(max(ranks.values()) + 1, np.int64)
    order = sorted(ranks, key=ranks.get)
    length[[ranks[t] for t in order]] = [len(t) for t in order]
    return b"".join(order), np.cumsum(length) - length, length


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    """doc_id, n_tokens, ids_sha256 and text of batches of doc_id and ids."""
    body, start, length = load_tokens(vocabulary)
    every = np.frombuffer(body, np.uint8)
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
            batch = whole.slice(at, TEXTS_AT_ONCE)
            ids = batch.column("ids")
            values = ids.flatten().to_numpy(zero_copy_only=False)
            sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            counts, digests, bodies = [], [], []
            for end, n in zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True):
                own = values[end - n : end]
                counts.append(n)
                digests.append(hashlib.sha256(" ".join(map(str, own.tolist())).encode()).hexdigest())
                size = length[own]
                first = np.repeat(start[own] - np.cumsum(size) + size, size)
                bodies.append(every[first + np.arange(len(first))].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(bodies, pa.binary())],
                ["doc_id", "n_tokens", "ids_sha256", "text"],
            )


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text.

    ``vocabulary`` is the path of a rank file that every executor can open.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    work = lambda batches: _encoded(batches, vocabulary, pattern)
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Of rows with doc_id and ids: doc_id, n_tokens, ids_sha256 and text (the decoded bytes)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    work = lambda batches: _decoded(batches, vocabulary)
    return encoded.select("doc_id", "ids").mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, text binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``decode`` of ``encode`` in one Python worker a task, so that its tables are in memory once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    work = lambda batches: _decoded(_encoded(batches, vocabulary, pattern), vocabulary)
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_tokens long, ids_sha256 string, text binary")
