"""Induced suffix sorting with common prefixes, through queues that spill to disk.

``repeated`` gives the positions of a text at which a string of ``cap`` symbols starts that also starts
elsewhere in it.  As in external induced sorting, suffix tuples (position, length of the common
prefix with the tuple before) wait in a priority queue whose priority is (first symbol, order of
arrival); the sorted tuples of one symbol induce those of their predecessors, first the larger
ones from left to right, then the smaller ones from right to left, and a common prefix grows by one
over the least common prefix passed since the last tuple sent to that symbol.  The queue is one list
per symbol that goes to disk when all lists together pass a memory bound; batches of tuples
are induced at once in numpy.  The suffixes that start the induction are ordered by the
same induction over their substrings, named, and the reduced text is ordered by doubling the
names; its doubling levels give the common prefixes that the last induction carries on.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Entries of all queues that stay in memory.
MEMORY_ENTRIES = 16_000_000

_FAR = 1 << 30


class Queues:
    """A priority queue with one list of (position, prefix) arrays per symbol, spilled when large."""

    def __init__(self, folder: str, memory: int) -> None:
        self.folder, self.memory = folder, memory
        self.lists: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def _file(self, symbol: int) -> str:
        return os.path.join(self.folder, f"{id(self)}-{symbol}")

    def push(self, symbol: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.lists.setdefault(symbol, []).append((positions, prefixes))
        self.held += len(positions)
        if self.held > self.memory:
            for s, arrays in self.lists.items():
                with open(self._file(s), "ab") as out:
                    for p, x in arrays:
                        np.stack([p, x.astype(np.int64)], axis=1).tofile(out)
            self.lists, self.held = {}, 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All that was pushed for a symbol since the last pop, in order."""
        arrays = self.lists.pop(symbol, [])
        self.held -= sum(len(p) for p, _ in arrays)
        if os.path.exists(self._file(symbol)):
            spilled = np.fromfile(self._file(symbol), np.int64).reshape(-1, 2)
            os.truncate(self._file(symbol), 0)
            arrays.insert(0, (spilled[:, 0], spilled[:, 1]))
        if not arrays:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([p for p, _ in arrays]), np.concatenate([x for _, x in arrays])


def _narrow(symbols: np.ndarray) -> np.ndarray:
    """Symbols in 16 bits where they fit: those are sorted by counting."""
    return symbols.astype(np.uint16) if len(symbols) == 0 or symbols.max() < 1 << 16 else symbols


class _Sender:
    """Sends predecessors to their symbols and keeps the least prefix passed since the last one sent."""

    def __init__(self, queues: Queues, symbols: int, cap: int) -> None:
        self.queues, self.cap = queues, cap
        self.passed = np.full(symbols, -1, np.int64)

    def send(self, prefixes: np.ndarray, at: np.ndarray, positions: np.ndarray, symbols: np.ndarray) -> None:
        """A batch with ``prefixes``; entries ``at`` send ``positions`` to ``symbols``."""
        if len(prefixes) == 0:
            return
        before = self.passed
        self.passed = np.minimum(before, prefixes.min())
        if len(at) == 0:
            return
        order = np.argsort(_narrow(symbols), kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(symbols[order]) != 0])
        for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
            own = order[a:b]
            symbol, where = int(symbols[own[0]]), at[own]
            least = np.empty(len(own), np.int64)
            least[0] = min(before[symbol], prefixes[: where[0] + 1].min())
            if len(own) > 1:
                least[1:] = np.minimum.reduceat(prefixes[: where[-1] + 1], where[:-1] + 1)
            rest = prefixes[where[-1] + 1 :]
            self.passed[symbol] = rest.min() if len(rest) else _FAR
            self.queues.push(symbol, positions[own], np.minimum(least + 1, self.cap))


def _run(text: np.ndarray, position: int, cap: int) -> int:
    """Times the symbol at a position is repeated from there, ``cap`` at most."""
    part = text[position : position + cap]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def _induce(text, smaller, starts, prefixes, cap, folder, memory):
    """(symbol, positions, prefixes) of all suffixes, by descending symbol, each in ascending order.

    ``starts`` are the positions that start the induction, sorted within their symbol, with the
    common prefix with the one before.
    """
    symbols = int(text.max()) + 1
    first = text[starts]
    bounds = np.searchsorted(first, np.arange(symbols + 1))
    queues, larger = Queues(folder, memory), Queues(folder, memory)
    sender = _Sender(queues, symbols, cap)

    def preceding(positions, wanted):
        at = np.flatnonzero(positions > 0)
        before = positions[at] - 1
        keep = smaller[before] == wanted
        return at[keep], before[keep]

    for c in range(symbols):
        last = None
        while True:
            positions, common = queues.pop(c)
            if len(positions) == 0:
                break
            if last is None:
                common[0] = 0
            last = positions[-1]
            larger.push(c, positions, common)
            at, before = preceding(positions, False)
            sender.send(common, at, before, text[before])
        own = slice(bounds[c], bounds[c + 1])
        positions, common = starts[own], prefixes[own].copy()
        if len(positions):
            common[0] = 0 if last is None else min(_run(text, last, cap), _run(text, positions[0], cap))
            at, before = preceding(positions, False)
            sender.send(common, at, before, text[before])
    queues = Queues(folder, memory)
    sender = _Sender(queues, symbols, cap)
    for c in range(symbols - 1, -1, -1):
        taken = []
        last = None
        if c == text[-1]:
            taken.append((np.array([len(text) - 1]), np.zeros(1, np.int64)))
            last = len(text) - 1
        while True:
            positions, common = queues.pop(c)
            if len(positions) == 0:
                break
            if last is None:
                common[0] = 0
            last = positions[-1]
            taken.append((positions, common))
            at, before = preceding(positions, True)
            sender.send(common, at, before, text[before])
        low, low_common = larger.pop(c)
        seam = 0
        if len(low):
            if last is not None:
                seam = min(_run(text, low[-1], cap), _run(text, last, cap))
            down = np.r_[seam, low_common[:0:-1]]
            positions = low[::-1]
            at, before = preceding(positions, True)
            sender.send(down, at, before, text[before])
        high = np.concatenate([p for p, _ in taken])[::-1] if taken else np.zeros(0, np.int64)
        high_common = np.concatenate([x for _, x in taken]) if taken else np.zeros(0, np.int64)
        # Going down, a prefix belongs to a tuple and the larger one before it.
        high_common = np.r_[seam, high_common[:0:-1]] if len(high) else high_common
        yield c, np.concatenate([low, high]), np.concatenate([low_common, high_common])


def _types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last is."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    decided = text[change] < text[change + 1]
    out = np.ones(n, bool)
    where = np.searchsorted(change, np.arange(n - 1))
    some = where < len(change)
    out[: n - 1][some] = decided[where[some]]
    return out


def _same_substring(text: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the substrings of ``sizes`` at two lists of positions are equal."""
    same = np.ones(len(one), bool)
    active = np.arange(len(one))
    step = 0
    while len(active):
        active = active[sizes[active] > step]
        hit = text[one[active] + step] == text[two[active] + step]
        same[active[~hit]] = False
        active = active[hit]
        step += 1
    return same


def _reduced_order(names: np.ndarray, places: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of the reduced text, and common prefixes (symbols, ``cap`` at most)."""
    n = len(names)
    levels, width = [names.astype(np.int64)], 1
    # Starts are two symbols apart at least, so ``width`` names cover twice as many symbols.
    while 2 * width < cap and int(levels[-1].max()) + 1 < n:
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        after[:-width] = rank[width:] + 1 if width < n else 0
        key = rank * np.int64(n + 1) + after
        order = np.argsort(key)
        fresh = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        levels.append(rank)
        width *= 2
    order = np.argsort(levels[-1])
    one, two = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(n - 1, 0), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        rank, step = levels[level], 1 << level
        # The last level may match twice: prefixes that long are beyond the cap anyway.
        at, bt = one + shared, two + shared
        inside = (at + step <= n) & (bt + step <= n)
        hit = inside.copy()
        hit[inside] = rank[at[inside]] == rank[bt[inside]]
        shared[hit] += step
    end = np.r_[places, places[-1] + 1]
    common = end[np.minimum(one + shared, n)] - end[one]
    return order, np.r_[0, np.minimum(common, cap)] if n else common


def repeated(text: np.ndarray, cap: int, memory: int = MEMORY_ENTRIES, scratch: str | None = None) -> np.ndarray:
    """A flag per position: its string of ``cap`` symbols also starts at another position.

    ``text`` holds non-negative integers; strings that reach past its end are not counted.
    """
    size = len(text)
    flags = np.zeros(size, bool)
    if size <= cap:
        return flags
    text = np.r_[text.astype(np.int32) + 1, 0]
    smaller = _types(text)
    starts = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    # Where Spark itself spills on this machine; nothing in it outlives the sort.
    scratch = scratch or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryDirectory(dir=scratch) as folder:
        # Substrings from one start to the next, in order.
        loose = starts[np.argsort(_narrow(text[starts]), kind="stable")]
        zeros = np.zeros(len(starts), np.int64)
        is_start = np.zeros(size + 1, bool)
        is_start[starts] = True
        buckets = [p[is_start[p]] for _, p, _ in _induce(text, smaller, loose, zeros, 1, folder, memory)]
        ordered = np.concatenate(buckets[::-1])
        ends = np.r_[starts[1:], size]
        number = np.empty(size + 1, np.int64)
        number[starts] = np.arange(len(starts))
        sizes = ends - starts + 1
        index = number[ordered]
        one, two = index[:-1], index[1:]
        equal = sizes[one] == sizes[two]
        equal[equal] = _same_substring(text, starts[one[equal]], starts[two[equal]], sizes[one[equal]])
        names = np.empty(len(starts), np.int64)
        names[index] = np.r_[0, np.cumsum(~equal)]
        order, common = _reduced_order(names, starts, cap)
        sorted_starts = starts[order]
        common[1:] = _exact_prefix(text, sorted_starts[:-1], sorted_starts[1:], common[1:], cap)
        for _, positions, prefixes in _induce(text, smaller, sorted_starts, common, cap, folder, memory):
            full = prefixes >= cap
            flags_at = full | np.r_[full[1:], False] if len(full) else full
            flags[positions[flags_at & (positions < size)]] = True
    return flags


def _exact_prefix(text, one, two, known, cap) -> np.ndarray:
    """Go on from common prefixes known to be at least ``known``, symbol by symbol, to the cap."""
    out = known.copy()
    active = np.flatnonzero(out < cap)
    last = len(text) - 1
    while len(active):
        a, b = one[active] + out[active], two[active] + out[active]
        hit = (a <= last) & (b <= last)
        hit[hit] = text[a[hit]] == text[b[hit]]
        active = active[hit]
        out[active] += 1
        active = active[out[active] < cap]
    return out
