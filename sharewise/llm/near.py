"""Near copies at a Jaccard similarity of five-word shingles, by an index of fingerprint bytes.

Of two texts with similarity 0.8, about ten of 64 SimHash bits differ, so no choice of six bytes
agrees and the short fingerprint of ``simhash`` misses them.  Here the fingerprint has 256 bytes, two
for each of 128 least hashes, and a byte of two texts agrees about as often as their shingles do.
The index and the filter are those of ``simhash``: a fingerprint is posted under 32 choices of eight
byte positions with the bytes it has there; the shared positional bytes of a pair are tallied,
pairs below ``LEAST_SHARED`` are dropped, and the others are verified on all their shingles.

Posting lists are covered by ``lists``: members of one component are not compared again, and every other
pair of a list is tallied and verified, so a group comes out as from all pairs.  A pair
with similarity 0.8 shares no list once in 10**7 and falls under ``LEAST_SHARED`` about as rarely.

Defined cases: texts with the same set of shingles are one class; null, empty and blank texts are one
class, without links; fewer than five words are one shingle; a null doc_id takes no part;
repeated rows share their class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.llm import fingerprints, lists, texts
from sharewise.plans import store

#: Texts of at least this similarity are linked.
LEAST_ALIKE = 0.8

#: Pairs share at least so many of the 256 bytes: five deviations below the mean at 0.8.
LEAST_SHARED = 160


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The different hashes of the shingles of each text, in order."""
    words, counts = texts.word_hashes(texts.LOWER[data], offsets, texts.WORDS)
    runs, sizes = texts.run_hashes(words, counts, fingerprints.SHINGLE_WORDS)
    ends = np.cumsum(sizes)
    return [np.unique(runs[b - n : b]) for b, n in zip(ends, sizes, strict=True)]


def _name(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def classes_of(docs: DataFrame) -> DataFrame:
    """doc_id, body (a hash of the text), name of the class (of its set of shingles) and bytes (the fingerprint, eight in a long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rows = [], [np.zeros((0, 32), np.int64)]
            for _, data, offsets in texts.pieces(*texts.flat(batch.column("text"))):
                names += map(_name, shingle_sets(data, offsets))
                rows.append(fingerprints.signatures(texts.LOWER[data], offsets).view(np.int64))
            longs = np.concatenate(rows)
            bounds = pa.array(np.arange(len(longs) + 1) * 32, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("body"), pa.array(names, pa.string()), pa.ListArray.from_arrays(bounds, pa.array(longs.ravel()))],
                ["doc_id", "body", "name", "bytes"],
            )

    rows = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("body"))
    return rows.mapInArrow(work, f"doc_id {kind}, body long, name string, bytes array<long>")


def _shingles(docs: DataFrame) -> DataFrame:
    """name and shingles of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in texts.pieces(*texts.flat(batch.column("text"))):
                sets = shingle_sets(data, offsets)
                bounds = np.cumsum([0, *map(len, sets)])
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(map(_name, sets), pa.string()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))],
                    ["name", "shingles"],
                )

    return docs.select("text").mapInArrow(work, "name string, shingles array<long>")


def covered(docs: DataFrame, classes: DataFrame, least: float = LEAST_ALIKE) -> tuple[DataFrame, DataFrame]:
    """(links, components) of ``classes`` (name, bytes, and the doc_id of one of its rows)."""

    def verify(pairs: DataFrame) -> DataFrame:
        names = store(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "names")
        ids = store(classes.join(names, "name").select(F.col("doc_id").alias("_of")).distinct(), "ids")
        bodies = _shingles(docs.join(ids, F.col("doc_id") == F.col("_of"), "left_semi"))
        # Two texts may have one doc_id, and a text may stand in two rows with it.
        bodies = store(bodies.join(names, "name", "left_semi").groupBy("name").agg(F.first("shingles").alias("shingles")), "bodies")
        side = lambda n, c: bodies.select(F.col("name").alias(n), F.col("shingles").alias(c))
        both = pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b")
        shared = F.size(F.array_intersect("_x", "_y"))
        alike = both.select("a", "b", shared.alias("_n"), (F.size("_x") + F.size("_y")).alias("_all"))
        return alike.select("a", "b", (F.col("_n") / (F.col("_all") - F.col("_n"))).alias("jaccard")).where(F.col("jaccard") >= least)

    index = classes.select("name", F.posexplode("bytes").alias("positions", "key"))
    return lists.covered(index, ["positions", "key"], classes.select("name", "bytes"), verify, LEAST_SHARED)


def links(docs: DataFrame, classes: DataFrame, least: float = LEAST_ALIKE) -> DataFrame:
    """Verified links (a, b, jaccard) between ``classes`` that join all that links of their lists join."""
    return covered(docs, classes, least)[0]


def components_of(docs: DataFrame, least: float = LEAST_ALIKE) -> DataFrame:
    """doc_id, body, label and component_id (smallest doc_id reachable by links) of every row with a doc_id."""
    known = store(classes_of(docs), "shingled")
    classes = store(known.groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("bytes").alias("bytes")), "classes")
    _, joined = covered(docs, classes, least)
    labelled = store(
        classes.join(joined.select(F.col("node").alias("name"), "label"), "name", "left").select(
            "name", "doc_id", F.coalesce("label", "name").alias("label")
        ),
        "labelled",
    )
    named = store(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "named")
    by_name = store(labelled.select("name", "label").join(named, "label").select("name", "label", "component_id"), "by_name")
    return known.select("doc_id", "body", "name").join(by_name, "name").select("doc_id", "body", "label", "component_id")
