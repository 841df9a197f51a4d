"""Quality by importance: hashed n-gram models of target and raw text, and a Gumbel top-k.

Words, marks, pairs of neighbours, pairs of word shapes and repeats of the word before are hashed into
``BUCKETS`` cells.  The raw model counts all texts; the target model counts texts labelled good.
At most ``LABELLED`` good and as many other labelled texts (the smallest hashes of doc_id) are
used: a documented bound on the fitting sample, the only one here.  Three quarters of the good
ones fit the target model; the rest and the others place the offset, the mean of
log(target / raw) per n-gram that parts them best.  A text's log weight is the sum of
log(target / raw) - offset over its n-grams.  Adding standard Gumbel noise, drawn from a hash of
doc_id, and keeping the k largest sums samples k texts without replacement in proportion to
their weights.  By default k is the number of texts with log weight >= 0, so texts unlike the
target fall out.

Defined cases: a null or empty text has log weight 0; without any labelled text every weight is 0
and every row stays; rows with equal keys at the cut all stay; a null doc_id draws its noise
like another value; repeated rows have equal keys and share their fate; an empty table stays
empty; other columns pass through ``select_rows`` unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharewise.llm import texts
from sharewise.plans import store

BUCKETS = 10_000
LABELLED = 20_000
SEED = 7

_BYTES = np.arange(256)
_UPPER = ((_BYTES >= ord("A")) & (_BYTES <= ord("Z"))).astype(np.int64)
_LETTER = (_UPPER.astype(bool) | ((_BYTES >= ord("a")) & (_BYTES <= ord("z"))) | (_BYTES >= 0xC0)).astype(np.int64)
_DIGIT = ((_BYTES >= ord("0")) & (_BYTES <= ord("9"))).astype(np.int64)


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Lower case, capital, upper case, with digits, or the mark itself: a small number per token."""
    sums = [np.r_[0, np.cumsum(t[data])] for t in (_UPPER, _LETTER, _DIGIT)]
    upper, letter, digit = (x[end] - x[start] for x in sums)
    shape = np.where(upper == 0, 1, np.where((upper == letter) & (upper > 1), 3, 2))
    shape = np.where(digit > 0, 4, shape)
    return np.where((letter == 0) & (digit == 0), 16 + data[start], shape).astype(np.uint64)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text) of every word, mark and pair (case ignored), pair of shapes and repeat."""
    start, end, counts = texts.spans(data, offsets, texts.WORDS_AND_MARKS)
    words = texts.span_hash(texts.prefix_hash(texts.LOWER[data]), start, end)
    owner = np.repeat(np.arange(len(counts)), counts)
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    both = texts.mix(words[pair] * np.uint64(3) + words[pair + 1])
    shape = _shapes(data, start, end)
    shapes = texts.mix(shape[pair] * np.uint64(1000) + shape[pair + 1] + np.uint64(1 << 40))
    again = pair[words[pair] == words[pair + 1]]
    marks = np.full(len(again), texts.mix(np.array([2**41], np.uint64))[0])
    cells = np.concatenate([words, both, shapes, marks]) % np.uint64(BUCKETS)
    return cells.astype(np.int64), np.concatenate([owner, owner[pair], owner[pair], owner[again]])


def _counts(docs: DataFrame) -> np.ndarray:
    """N-grams per cell over all rows: one vector per task, summed by Spark, BUCKETS rows at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, offsets in texts.pieces(*texts.flat(batch.column("text"))):
                total += np.bincount(_features(data, offsets)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    rows = docs.select("text").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for cell, n in rows.collect():
        out[cell] = n
    return out


def _labelled(labels: DataFrame, condition: str, most: int) -> DataFrame:
    some = labels.where(condition).where("doc_id is not null").select("doc_id").distinct()
    return some.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(most)


def best_offset(good: list[float], other: list[float]) -> float:
    """The cut between two lists of means that gets the largest shares of both right; 0 if one is empty."""
    if not good or not other:
        return 0.0
    means = np.array([*good, *other])
    is_good = np.arange(len(means)) < len(good)
    order = np.argsort(means, kind="stable")
    below_good = np.r_[0, np.cumsum(is_good[order])] / len(good)
    below_other = np.r_[0, np.cumsum(~is_good[order])] / len(other)
    at = int(np.argmax(below_other - below_good))
    sorted_means = means[order]
    low, high = sorted_means[max(at - 1, 0)], sorted_means[min(at, len(means) - 1)]
    return float((low + high) / 2)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> np.ndarray | None:
    """log(target / raw) - offset per cell, one count added to every cell; None without good texts."""
    held = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(4)) == 0
    good = _labelled(labels, "quality = 1", labelled)
    rest = _labelled(labels, "quality = 0", labelled)
    target = _counts(docs.join(F.broadcast(good.where(~held)), "doc_id", "left_semi"))
    raw = _counts(docs)
    if not target.sum():
        return None
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    marked = good.where(held).withColumn("good", F.lit(True)).unionByName(rest.withColumn("good", F.lit(False)))
    met = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, size = _sums(batch, ratio)
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(weight / np.maximum(size, 1))], ["good", "mean"])

    means = met.select("good", "text").mapInArrow(work, "good boolean, mean double").collect()
    return ratio - best_offset([m for g, m in means if g], [m for g, m in means if not g])


def _sums(part: pa.RecordBatch, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the ratios, n-grams) of the texts of a batch."""
    weight, grams = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
    for first, data, offsets in texts.pieces(*texts.flat(part.column("text"))):
        cells, owner = _features(data, offsets)
        size = len(offsets) - 1
        weight[first : first + size] = np.bincount(owner, ratio[cells], minlength=size)
        grams[first : first + size] = np.bincount(owner, minlength=size)
    return weight, grams


def _weigh(part: pa.RecordBatch, ratio: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(log weight, log weight plus noise) of the rows of a batch."""
    weight = np.zeros(part.num_rows) if ratio is None else _sums(part, ratio)[0]
    draw = part.column("__sw_draw").to_numpy(zero_copy_only=False).view(np.uint64)
    uniform = ((draw >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    return weight, weight - np.log(-np.log(uniform))


def _sortable(x: np.ndarray) -> np.ndarray:
    """Long integers in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _with_draw(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__sw_draw", F.xxhash64("doc_id", F.lit(SEED)))


def scores(docs: DataFrame, ratio: np.ndarray | None) -> DataFrame:
    """doc_id, log_weight, score (with noise) and key (the score as a sortable long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, score = _weigh(batch, ratio)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(weight), pa.array(score), pa.array(_sortable(score))],
                ["doc_id", "log_weight", "score", "key"],
            )

    rows = _with_draw(docs.select("doc_id", "text"))
    return rows.mapInArrow(work, f"doc_id {kind}, log_weight double, score double, key long")


def cut_key(scored: DataFrame, k: int) -> int:
    """The k-th largest key, found by counting cells of 16 bits, four times."""
    low, seen = -(1 << 63), 0
    for shift in (48, 32, 16, 0):
        inside = scored if shift == 48 else scored.where(
            (F.shiftright("key", shift + 16) == (low >> (shift + 16)))
        )
        cells = inside.groupBy(F.shiftright("key", shift).alias("cell")).count().collect()  # 65,536 at most
        for cell, n in sorted(cells, reverse=True):
            if seen + n >= k:
                low = cell << shift
                break
            seen += n
    return low


def select(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, score and keep (true) of the sampled rows."""
    scored = store(scores(docs, fit(docs, labels)), "scores")
    if k is None:
        k = scored.where("log_weight >= 0").count()
    if k <= 0:
        return scored.limit(0).select("doc_id", "log_weight", "score", F.lit(True).alias("keep"))
    kept = scored.where(F.col("key") >= cut_key(scored, k))
    return kept.select("doc_id", "log_weight", "score", F.lit(True).alias("keep"))


def select_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with all their columns.

    The rows are scored a second time, in place, instead of moving the texts to the decisions.
    """
    ratio = fit(docs, labels)
    scored = store(scores(docs, ratio), "scores")
    if k is None:
        k = scored.where("log_weight >= 0").count()
    if k <= 0:
        return docs.limit(0)
    least = cut_key(scored, k)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _sortable(_weigh(batch, ratio)[1]) >= least
            yield batch.select(names).filter(pa.array(keep))

    return _with_draw(docs).mapInArrow(work, docs.schema)
