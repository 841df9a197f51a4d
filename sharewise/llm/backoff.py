"""Stupid-backoff scores of documents from n-gram counts of the whole corpus.

Words are runs between white space, A-Z lowered; n-grams of orders 1 to ``order`` are hashed to 64
bits.  Texts are dealt into batches by a hash.  Each batch sends the distinct n-grams it holds,
with its counts, to the partition of their hash (the high bits), packed as sorted arrays; there
the counts of all batches are summed, and what the others hold goes back to each batch that asked.  So the
count tables are partitioned by hash, a frequent n-gram is one entry per batch however often
it occurs, and the join of counts and exploded n-grams moves no n-gram twice.  A batch then
sums the logarithms of the scores of its words per document.

A document is scored against the rest of the corpus: its own occurrences are taken off every
count.  S(w | h) = c(hw) / c(h) where hw occurs elsewhere, else ``alpha`` * S(w | shorter h); a
word that occurs nowhere else has ``alpha`` / (N + 1), N being the words elsewhere.  At the head of
a text h is as long as the text allows, without a factor.

Defined cases: null and empty texts have no words and score 0 (mean null); repeated rows and copies are
documents of their own and count for each other; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.llm import texts

ORDER = 3
ALPHA = 0.4

#: Bytes of text per batch.
BATCH_BYTES = 16 << 20

#: Entries of a partition of the count tables, about.
PART_ENTRIES = 4_000_000


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the hash of the n-gram that ends at each word; words per text; text of each word.

    Where a text has too few words before, the hash is that of a shorter n-gram and not used.
    """
    words, counts = texts.word_hashes(texts.LOWER[data], offsets, texts.WORDS)
    owner = np.repeat(np.arange(len(counts)), counts)
    out = [texts.mix(words + np.uint64(1))]
    for n in range(2, order + 1):
        longer = out[-1].copy()
        longer[n - 1 :] = texts.mix(out[-1][:-1][n - 2 :] * np.uint64(texts.BASE) + words[n - 1 :] + np.uint64(n))
        out.append(longer)
    return out, counts, owner


def _whole(counts: np.ndarray, order: int) -> np.ndarray:
    """Whether an n-gram of ``order`` words ends at each word."""
    heads = np.repeat(np.cumsum(counts) - counts, counts)
    return np.arange(counts.sum()) - heads >= order - 1


def _entries(ends: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    return np.concatenate([h[_whole(counts, n + 1)] for n, h in enumerate(ends)])


def _distinct(asked: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes and how often each occurs."""
    every = np.concatenate([np.zeros(0, np.uint64), *asked])
    every.sort()
    heads = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
    return every[heads], np.diff(np.r_[heads, len(every)])


def _pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as gaps.  The low bytes of a gap are noise and stay as they are; the high bytes, small
    numbers, and the counts are compressed as byte planes, each kind by itself."""
    import zstandard

    n = len(hashes)
    gaps = np.diff(hashes, prepend=np.uint64(0))
    spread = int(hashes[-1] - hashes[0]) // max(n - 1, 1)
    low = min(7, max(spread.bit_length() - 1, 0) // 8)
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    seen = np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    packer = zstandard.ZstdCompressor(level=1)
    high = packer.compress(planes[low:].tobytes())
    head = np.array([n, low, len(high)], "<u4").tobytes()
    return head + planes[:low].tobytes() + high + packer.compress(seen.tobytes())


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    n, low, size = (int(x) for x in np.frombuffer(packed, "<u4", 3))
    unpacker, at = zstandard.ZstdDecompressor(), 12 + low * n
    planes = np.frombuffer(packed[12:at] + unpacker.decompress(packed[at : at + size]), np.uint8)
    seen = np.frombuffer(unpacker.decompress(packed[at + size :]), np.uint8)
    gaps = np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.ascontiguousarray(seen.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _plane(values: np.ndarray) -> bytes:
    import zstandard

    planes = np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unplane(packed: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(">u8").ravel().astype(np.int64)


def _places(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where each hash stands in ``known``; asked in order, neighbours meet the same part of the table."""
    order = np.argsort(hashes)
    at = np.empty(len(hashes), np.int64)
    at[order] = np.searchsorted(known, hashes[order])
    return at


def score_batch(data, offsets, order: int, alpha: float, known: np.ndarray, totals: np.ndarray, words: int) -> tuple:
    """(words, sum of log scores) per text; ``known`` (sorted hashes) and ``totals`` cover the batch."""
    ends, counts, owner = grams(data, offsets, order)
    size = int(counts.sum())
    rest = (words - counts)[owner].astype(float)
    elsewhere = []
    for n, h in enumerate(ends):
        whole = _whole(counts, n + 1)
        at = np.where(whole, _places(known, h), 0)
        pair = owner * np.int64(len(known) + 1) + at
        pair[~whole] = -1
        _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
        elsewhere.append(np.where(whole, totals[at] - own[back], 0) if size else np.zeros(0, np.int64))
    score = np.where(elsewhere[0] > 0, elsewhere[0] / np.maximum(rest, 1), alpha / (rest + 1)) if size else np.zeros(0)
    for n in range(1, order):
        context = np.concatenate([np.zeros(1, np.int64), elsewhere[n - 1][:-1]])[:size]
        hit = elsewhere[n] > 0
        shorter = np.where(_whole(counts, n + 1), alpha * score, score)
        score = np.where(hit, elsewhere[n] / np.maximum(context, 1), shorter)
    return counts, np.bincount(owner, np.log(score), minlength=len(counts))


def score(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, log_score (sum over words) and mean_log_score of every row."""
    kind = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size, words = rows.agg(
        F.sum(F.octet_length("text").cast("long")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    ).head()
    size, words = size or 0, words or 0
    batches = max(1, -(-size // batch_bytes))
    bits = max(0, (-(-words * order // PART_ENTRIES) - 1).bit_length())
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        asked: list[np.ndarray] = []
        for _, data, offsets in texts.pieces(*texts.flat(table.column("text"))):
            ends, counts, _ = grams(data, offsets, order)
            asked.append(_entries(ends, counts))
        hashes, n = _distinct(asked)
        part = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        tails = np.r_[heads[1:], len(part)] if len(part) else heads
        return pa.table({
            "part": pa.array(part[heads], pa.int64()),
            "batch": pa.array([key[0].as_py()] * len(heads), pa.int64()),
            "entries": pa.array([_pack(hashes[a:b], n[a:b]) for a, b in zip(heads, tails, strict=True)], pa.binary()),
        })

    def total(key: tuple, table: pa.Table) -> pa.Table:
        unpacked = [_unpack(e) for e in table.column("entries").to_pylist()]
        hashes = np.concatenate([h for h, _ in unpacked])
        known, back = np.unique(hashes, return_inverse=True)
        sums = np.bincount(back, np.concatenate([n for _, n in unpacked])).astype(np.int64)
        answers, at = [], 0
        for h, n in unpacked:
            # What the other batches hold: nothing, for most n-grams.
            answers.append(_plane(sums[back[at : at + len(h)]] - n))
            at += len(h)
        return pa.table({"batch": table.column("batch"), "part": table.column("part"), "others": pa.array(answers, pa.binary())})

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        others = np.concatenate([np.zeros(0, np.int64), *(_unplane(t) for t in right.column("others").to_pylist())])
        parts = list(texts.pieces(*texts.flat(left.column("text"))))
        asked = []
        for _, data, offsets in parts:
            ends, counts, _ = grams(data, offsets, order)
            asked.append(_entries(ends, counts))
        known, here = _distinct(asked)
        asked.clear()
        totals = others + here
        done = [score_batch(data, offsets, order, alpha, known, totals, words) for _, data, offsets in parts]
        n = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in done)]).astype(np.int64)
        log = np.concatenate([np.zeros(0), *(s for _, s in done)])
        mean = np.divide(log, n, out=np.zeros(len(n)), where=n > 0)
        return pa.table({
            "doc_id": left.column("doc_id"), "n_words": pa.array(n), "log_score": pa.array(log),
            "mean_log_score": pa.array(mean, mask=n == 0),
        })

    grouped = dealt.groupBy("batch")
    asked = grouped.applyInArrow(ask, "part long, batch long, entries binary")
    answered = asked.groupBy("part").applyInArrow(total, "batch long, part long, others binary")
    return grouped.cogroup(answered.groupBy("batch")).applyInArrow(
        finish, f"doc_id {kind.simpleString()}, n_words long, log_score double, mean_log_score double"
    )


