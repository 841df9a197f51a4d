"""SimHash near copies: a byte-position index of fingerprints, count filtering, verified links.

Shingles are runs of three words (white space between, A-Z lowered), hashed by XXH64; a
fingerprint bit is set when over half of the hashes have it.  Two fingerprints that differ in
at most two bits agree in at least six of their eight bytes.  The inverted index is keyed by
byte positions: a fingerprint is posted under each choice of six positions with the bytes it
has there, so a pair meets in the index exactly when its tally of shared positional bytes can
reach six.  In a posting list the tally is counted, pairs below six are dropped, and the
others are verified by their differing bits.  A posting list holds distinct fingerprints that
differ in two bytes at most, hence never more than 65,536 of them whatever the number of
copies; a long list gives the links of a spanning forest, not all of its pairs.

Defined cases: null and empty texts have the fingerprint zero; texts of one or two words have one
shingle of all words; equal fingerprints are linked; a null doc_id is linked too but names
no component unless its component has no other; repeated rows give repeated rows; an empty table
gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.llm import components, texts
from sharewise.plans import store

#: Links join fingerprints that differ in at most so many bits.
MOST_BITS = 2

#: Hence so many of the eight bytes agree.
LEAST_BYTES = 8 - MOST_BITS

#: Posting lists of at most this many fingerprints are compared pair by pair.
SHORT_LIST = 8


def shingle_hashes(raw: bytes) -> list[int]:
    from xxhash import xxh64_intdigest as digest

    words = raw.lower().split()
    if len(words) < 3:
        return [digest(b" ".join(words), 42)] if words else []
    return [digest(b"%b %b %b" % t, 42) for t in zip(words, words[1:], words[2:], strict=False)]


def _majority(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprints (unsigned) of texts given the hashes of their shingles."""
    sizes = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some) == 0:
        return out
    every = np.array([x for h in hashes for x in h], np.uint64).astype(">u8")
    bits = np.unpackbits(every.view(np.uint8).reshape(-1, 8), axis=1)
    heads = (np.cumsum(sizes) - sizes)[some]
    sums = np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    packed = np.packbits(2 * sums > sizes[some, None], axis=1)
    out[some] = np.ascontiguousarray(packed).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, body (a hash of the text) and fp (the fingerprint as a signed long) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts.flat(batch.column("text"))
            out = np.zeros(batch.num_rows, np.uint64)
            for first, part, places in texts.pieces(data, offsets, 256 << 10):
                raw = part.tobytes()
                hashes = [shingle_hashes(raw[a:b]) for a, b in zip(places[:-1], places[1:], strict=True)]
                out[first : first + len(hashes)] = _majority(hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("body"), pa.array(out.view(np.int64))], ["doc_id", "body", "fp"]
            )

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("body"))
    return rows.mapInArrow(work, f"doc_id {kind}, body long, fp long")


def postings(prints: DataFrame) -> DataFrame:
    """positions (which six), bytes (the rest masked out) and fp of distinct fingerprints."""
    masks = [sum(0xFF << (8 * p) for p in six) for six in combinations(range(8), LEAST_BYTES)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return prints.select(
        "fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in signed])).alias("positions", "mask")
    ).select("positions", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp")


def _alike(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Tally the shared positional bytes, then verify the bits."""
    differ = np.ascontiguousarray(np.bitwise_xor(one, two))
    tally = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=-1)
    return (tally >= LEAST_BYTES) & (np.bitwise_count(differ.view(np.uint64)) <= MOST_BITS)


def _forest(members: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of one list: each member reached once, nearest first."""
    links, left = [], members
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            node, front = front[0], front[1:]
            hit = _alike(left, np.full(len(left), node))
            links += [(int(node), int(x)) for x in left[hit]]
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return links


def links(prints: DataFrame) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints ``fp`` that keep all connections."""

    def lists(keys: np.ndarray, fps: np.ndarray) -> Iterator[np.ndarray]:
        heads = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        ends = np.r_[heads[1:], len(fps)]
        for a, b in zip(heads[ends - heads > 1], ends[ends - heads > 1], strict=True):
            yield fps[a:b]

    def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        pairs: list[tuple[int, int]] = []
        for members in lists(keys, fps):
            if len(members) > SHORT_LIST:
                pairs += _forest(members)
            else:
                i, j = np.triu_indices(len(members), 1)
                hit = _alike(members[i], members[j])
                pairs += zip(members[i[hit]].tolist(), members[j[hit]].tolist(), strict=True)
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new = [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("positions", "bytes", "fp")]
            keys = np.concatenate([keys, np.stack(new[:2], axis=1)])
            fps = np.concatenate([fps, new[2]])
            last = int(np.flatnonzero((keys == keys[-1]).all(axis=1))[0]) if len(fps) else 0
            yield found(keys[:last], fps[:last])  # the last list may go on in the next batch
            keys, fps = keys[last:], fps[last:]
        yield found(keys, fps)

    dealt = postings(prints).repartition("positions", "bytes").sortWithinPartitions("positions", "bytes", "fp")
    return dealt.mapInArrow(work, "a long, b long").distinct()


def components_of(docs: DataFrame) -> DataFrame:
    """doc_id, body, fp, label (of the component) and component_id (smallest doc_id reachable) of every row."""
    known = store(fingerprints(docs), "fingerprints")
    classes = store(known.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = components.connected(links(classes.select("fp")))
    labelled = store(
        classes.join(joined.select(F.col("node").alias("fp"), "label"), "fp", "left").select(
            "fp", "least", F.coalesce("label", "fp").alias("label")
        ),
        "labelled",
    )
    named = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = labelled.select("fp", "label").join(named, "label").select("fp", "label", "component_id")
    return known.join(by_print, "fp").select("doc_id", "body", "fp", "label", "component_id")


def hexadecimal(column: str) -> F.Column:
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of each component, all columns: that with the smallest doc_id.

    ``found`` has doc_id, body and label of every row; by default ``components_of`` gives it.  Rows are
    met by doc_id and text together, as unrelated texts may share a doc_id.  Of rows that share both,
    one stays; of different texts with the smallest doc_id of one component, that with the smaller hash.
    Rows without a doc_id all stay.
    """
    found = components_of(docs) if found is None else found
    rows = found.where("doc_id is not null").groupBy("label", "doc_id", "body").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("label").agg(F.min(F.struct("doc_id", "body", "n")).alias("w"))
    first = store(
        first.select(F.col("w.doc_id").alias("__sw_kept"), F.col("w.body").alias("__sw_body"), F.col("w.n").alias("__sw_rows")), "kept"
    )
    here = (F.col("doc_id") == F.col("__sw_kept")) & (F.xxhash64("text") == F.col("__sw_body"))
    named = docs.join(first, here).drop("__sw_kept", "__sw_body")
    single = named.where("__sw_rows = 1").drop("__sw_rows")
    whole = F.struct(*docs.columns)
    same = named.where("__sw_rows > 1").groupBy(F.col("doc_id").alias("__sw_again"), F.xxhash64("text").alias("__sw_text"))
    again = same.agg(F.min_by(whole, F.to_json(whole)).alias("__sw_row")).select("__sw_row.*")
    return single.unionByName(again).unionByName(docs.where("doc_id is null"))
