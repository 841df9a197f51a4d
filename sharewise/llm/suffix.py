"""Removal of long repeated strings: shards of candidate strings, sorted by induction.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus.
Every such string holds a run of ``GRAM`` bytes with the least hash among its runs; equal strings
have equal runs in equal places.  The strings that start next to one another and share their run
form a *segment*.  Only segments whose run occurs twice can hold repeats, so only they are cut
out, and equal ones are counted and sent once.  Segments with equal runs meet in one shard, where
``induced.repeated`` sorts their suffixes and finds the repeated strings.  Where very many
different segments share one run, their strings are instead dealt by their own content and
counted: a string in a segment of a hot run is a key of its own, however hot the run.

With ``words`` the symbols are the words between white space (by their hash) instead of bytes: ``length``,
``gram`` and all places count words, and a cut goes from the first byte of a word to the last of one.

Defined cases: null and empty texts, and texts shorter than ``LENGTH``, lose nothing; copies lose
all strings, the first copy too; repeated rows count as copies; an empty table gives no rows;
matches never cross documents; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharewise.llm import induced, texts
from sharewise.plans import store

LENGTH = 400
GRAM = 64

#: Bytes of segments that one induction sorts.
SHARD_BYTES = 1 << 20

#: Runs shared by more different segments than this are hot.
HOT_SEGMENTS = 2048

_PLACE = np.uint64((1 << 40) - 1)


def _key(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)), 1, 16)


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple:
    """(text, first start, starts, hash of the run) of every segment; starts count within the text."""
    none = np.zeros(0, np.int64)
    size = len(data)
    if size < length:
        return none, none, none, none
    prefix = texts.prefix_hash(data)
    head = np.arange(size - gram + 1)
    value = texts.span_hash(prefix, head, head + gram)
    width = length - gram + 1
    # Least value, then first place, of each window of runs: from block minima on both sides.
    mixed = (texts.mix(value) & ~_PLACE) | head.astype(np.uint64)
    whole = -(-len(mixed) // width) * width
    padded = np.full(whole, ~np.uint64(0), np.uint64)
    padded[: len(mixed)] = mixed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: size - length + 1], ahead[width - 1 : width - 1 + size - length + 1])
    anchor = (least & _PLACE).astype(np.int64)
    # Starts whose string stays inside its text.
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[owner]
    anchor = anchor[start]
    if len(start) == 0:
        return none, none, none, none
    heads = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    return owner[heads], start[heads] - offsets[owner[heads]], np.diff(np.r_[heads, len(start)]), value[anchor[heads]].view(np.int64)


def _symbols(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts (bytes, or a hash per word) and their offsets."""
    if not words:
        return data, offsets
    hashes, counts = texts.word_hashes(data, offsets, texts.WORDS)
    return hashes, np.r_[0, np.cumsum(counts)]


def _segments(rows: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    """key (of the text), run, and starts and sizes (in strings) of the segments of that run in a text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("_key")
            for first, data, offsets in texts.pieces(*texts.flat(batch.column("text"))):
                owner, start, n, run = segments_of(*_symbols(data, offsets, words), length, gram)
                order = np.lexsort((start, run, owner))
                owner, start, n, run = owner[order], start[order], n[order], run[order]
                heads = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])][: len(run)])
                bounds = pa.array(np.r_[heads, len(run)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(owner[heads] + first)), pa.array(run[heads]),
                        pa.ListArray.from_arrays(bounds, pa.array(start)), pa.ListArray.from_arrays(bounds, pa.array(n)),
                    ],
                    ["key", "run", "starts", "sizes"],
                )

    return rows.select("_key", "text").mapInArrow(work, "key binary, run long, starts array<long>, sizes array<long>")


def _cut_out(candidates: DataFrame, length: int, words: bool) -> DataFrame:
    """The different segments of every candidate text, with their starts in it, digest and bytes.

    Candidates have key, copies (rows of the text), text and found (its segments by run).
    """

    def segments(raw: np.ndarray, found: list[dict]) -> Iterator[tuple]:
        for one in found:
            same: dict[bytes, tuple[list[int], int, bytes]] = {}
            for start, n in zip(one["starts"], one["sizes"], strict=True):
                body = raw[start : start + n + length - 1].tobytes()
                same.setdefault(hashlib.blake2b(body, digest_size=16).digest(), ([], n, body))[0].append(start)
            for digest, (starts, n, body) in same.items():
                yield starts, digest, n, one["run"], body

    def record(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["key", "starts", "digest", "n", "run", "copies", "body"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts.flat(batch.column("text"))
            rows, size = [], 0
            columns = [batch.column(n).to_pylist() for n in ("key", "copies", "found")]
            for i, (key, copies, found) in enumerate(zip(*columns, strict=True)):
                one = data[offsets[i] : offsets[i + 1]]
                for starts, digest, n, run, body in segments(_symbols(one, np.array([0, len(one)]), words)[0], found):
                    rows.append((key, starts, digest, n, run, copies * len(starts), body))
                    size += len(body)
                if size > 1 << 20:
                    yield record(rows)
                    rows, size = [], 0
            if rows:
                yield record(rows)

    return candidates.select("key", "copies", "text", "found").mapInArrow(
        work, "key binary, starts array<long>, digest binary, n long, run long, copies long, body binary"
    )


def _sortable(shard: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """The bodies as one text for the induction, the place of each, and symbols for each unit.

    Words become two digits of their rank in the shard, the second above all first ones, so that the alphabet
    stays small and a string that starts at a word equals only such strings.
    """
    width = 8 if words else 1
    lengths = [len(body) // width + 1 for body in shard]
    heads = np.cumsum([0, *lengths])
    inside = np.ones(heads[-1], bool)
    inside[heads[1:] - 1] = False
    every = np.frombuffer(b"".join(shard), np.uint64 if words else np.uint8)
    if not words:
        text = np.zeros(len(inside), np.int32)
        text[inside] = every.astype(np.int32) + 1
        return text, heads, 1
    known, rank = np.unique(every, return_inverse=True)
    base = int(np.sqrt(len(known))) + 1
    text = np.zeros((len(inside), 2), np.int32)
    text[inside, 0] = rank // base + 1
    text[inside, 1] = rank % base + base + 2
    return text.ravel(), heads, 2


def _sort_shards(unique: DataFrame, length: int, shard_bytes: int, words: bool) -> DataFrame:
    """digest, low, high (a range of starts) of repeated strings in segments that stand once."""
    size = unique.agg(F.sum(F.octet_length("body").cast("long"))).head()[0] or 0
    dealt = unique.repartition(max(1, -(-size // shard_bytes)), "run").sortWithinPartitions("run")

    def sort(shard: list[tuple]) -> pa.RecordBatch:
        text, heads, each = _sortable([body for _, _, _, body in shard], words)
        flags = induced.repeated(text, length * each)[::each]
        out: list[tuple] = []
        for (digest, n, copies, _), at in zip(shard, heads, strict=False):
            if copies > 1:
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, flags[at : at + n], False].astype(np.int8)))
            out += [(digest, int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        kinds = [pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["digest", "low", "high"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []  # segments of finished groups
        group: list[tuple] = []  # segments of the run being read
        size, run = 0, None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("run", "digest", "n", "copies", "body")]
            for this, *segment in zip(*columns, strict=True):
                if this != run:
                    if len(group) > 1:
                        shard += group
                        size += sum(len(s[3]) for s in group)
                    if size > shard_bytes:
                        yield sort(shard)
                        shard, size = [], 0
                    group, run = [], this
                group.append(tuple(segment))
        if len(group) > 1:
            shard += group
        if shard:
            yield sort(shard)

    return dealt.select("run", "digest", "n", "copies", "body").mapInArrow(work, "digest binary, low long, high long")


def _count_strings(hot: DataFrame, length: int, words: bool) -> DataFrame:
    """digest, low and high (one start) of repeated strings in segments of hot runs."""
    width = 8 if words else 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, n, copies, body in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "copies", "body")), strict=True):
                strings = [hashlib.blake2b(body[i * width : (i + length) * width], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(strings, pa.binary()), pa.array([digest] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array([copies] * n, pa.int64())],
                    ["string", "digest", "low", "copies"],
                )

    strings = hot.select("digest", "n", "copies", "body").mapInArrow(work, "string binary, digest binary, low long, copies long")
    strings = store(strings, "strings")
    often = strings.groupBy("string").agg(F.sum("copies").alias("_often")).where("_often > 1")
    return strings.where("copies = 1").join(often, "string").select("digest", "low", F.col("low").alias("high"))


def repeats(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    hot_segments: int = HOT_SEGMENTS,
    words: bool = False,
) -> DataFrame:
    """key (of a text) and removed of texts that lose bytes: from each of ``starts`` on, the bytes (or words)
    from ``low`` to ``high`` (exclusive) of each of ``ranges``."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", _key(F.col("text")))
    every = store(_segments(rows, length, gram, words), "segments")
    # A table of its own, so that Spark can split the rows of a run that very many texts share.
    twice = store(every.groupBy("run").agg(F.sum(F.size("starts")).alias("n")).where("n > 1").select("run"), "twice")
    found = every.join(twice, "run").groupBy("key").agg(F.collect_set(F.struct("run", "starts", "sizes")).alias("found"))
    distinct = rows.groupBy(F.col("_key").alias("key")).agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    cut = store(_cut_out(distinct.join(found, "key"), length, words), "cut")
    unique = store(
        cut.groupBy("digest").agg(
            F.sum("copies").alias("copies"), F.first("n").alias("n"), F.first("run").alias("run"), F.first("body").alias("body")
        ),
        "unique",
    )
    hot = store(unique.groupBy("run").count().where(F.col("count") > hot_segments).select("run"), "hot")
    ranges = unique.where("copies > 1").select("digest", F.lit(0).cast("long").alias("low"), (F.col("n") - 1).alias("high"))
    calm = unique
    if not hot.isEmpty():
        calm = unique.join(hot, "run", "left_anti")
        ranges = ranges.unionByName(_count_strings(unique.join(hot, "run", "left_semi"), length, words))
    ranges = ranges.unionByName(_sort_shards(calm, length, shard_bytes, words))
    # All ranges of a segment in one row: a segment has at most length - gram + 1 starts.
    spans = ranges.select("digest", F.struct("low", (F.col("high") + length).alias("high")).alias("span"))
    spans = store(spans.groupBy("digest").agg(F.collect_set("span").alias("ranges")), "ranges")
    placed = cut.select("key", "starts", "digest").join(spans, "digest").select("key", F.struct("starts", "ranges").alias("r"))
    return placed.groupBy("key").agg(F.collect_set("r").alias("removed"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """The removed byte ranges of a text in order, those that touch or overlap joined."""
    out: list[list[int]] = []
    every = ((s + span["low"], s + span["high"]) for r in ranges or () for span in r["ranges"] for s in r["starts"])
    for low, high in sorted(every):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _removed(raw: bytes, ranges: list[dict] | None, words: bool) -> list[tuple[int, int]]:
    """The removed byte ranges of a text in order."""
    spans = merged(ranges)
    if not words or not spans:
        return spans
    start, end, _ = texts.spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), texts.WORDS)
    return [(int(start[a]), int(end[b - 1])) for a, b in spans]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _with_ranges(docs: DataFrame, **options: int) -> DataFrame:
    found = repeats(docs, **options).select(F.col("key").alias("__sw_found"), F.col("removed").alias("__sw_removed"))
    keyed = docs.withColumn("__sw_key", _key(F.coalesce("text", F.lit(""))))
    return keyed.join(found, F.col("__sw_key") == F.col("__sw_found"), "left").drop("__sw_found", "__sw_key")


def remove(docs: DataFrame, words: bool = False, **options: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests = [], [], [], []
            for raw, ranges in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("__sw_removed").to_pylist(), strict=True):
                raw = raw or b""
                whole = _removed(raw, ranges, words)
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in whole))
                spans.append(len(whole))
                digests.append(hashlib.sha256(_kept(raw, whole)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return _with_ranges(docs.select("doc_id", "text"), words=words, **options).mapInArrow(
        work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def remove_rows(docs: DataFrame, words: bool = False, **options: int) -> DataFrame:
    """The rows of ``docs`` with repeated strings cut from ``text`` and ``n_chars`` counted anew.

    A cut may fall inside a character; what is left of it goes too.
    """
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                raw if raw is None or not ranges else _kept(raw, _removed(raw, ranges, words)).decode(errors="ignore").encode()
                for raw, ranges in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), batch.column("__sw_removed").to_pylist(), strict=True)
            ]
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(out, pa.large_binary()).cast(batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    cut = _with_ranges(docs, words=words, **options).mapInArrow(work, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut
