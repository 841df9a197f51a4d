"""MinHash fingerprints of texts, likeness of fingerprints, and near copies by bands.

Shingles are runs of five words.  Each of ``PERMUTATIONS`` universal hashes ``a * x + b`` runs
over all shingles of a batch of texts as one numpy product; the smallest value per text is
one component.  A fingerprint is the low 16 bits of every component in hexadecimal, and two
fingerprints are as alike as the share of equal components.

Defined cases: a null text counts as empty; texts without words have the fingerprint of the
empty set and are alike; equal texts have equal fingerprints; repeated rows are rows of
their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharewise.llm import lists, texts
from sharewise.plans import store

PERMUTATIONS = 128
SHINGLE_WORDS = 5

#: Rows of the product of shingles and permutations that are worked on at a time.
_ROWS = 2048


def _coefficients(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 1 << 32, permutations, dtype=np.uint32)


def signatures(data: np.ndarray, offsets: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """One row of minima per text (16 bits of each)."""
    a, b = _coefficients(permutations)
    out = np.full((len(offsets) - 1, permutations), 0xFFFFFFFF, np.uint32)
    for first, part, places in texts.pieces(data, offsets):
        words, counts = texts.word_hashes(part, places, texts.WORDS)
        runs, per_text = texts.run_hashes(words, counts, SHINGLE_WORDS)
        x = (runs >> np.uint64(32)).astype(np.uint32)
        owner = np.repeat(np.arange(first, first + len(per_text)), per_text)
        for i in range(0, len(x), _ROWS):
            own = owner[i : i + _ROWS]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            least = np.minimum.reduceat(x[i : i + _ROWS, None] * a + b, heads, axis=0)
            out[own[heads]] = np.minimum(out[own[heads]], least)
    return (out & np.uint32(0xFFFF)).astype(np.uint16)


def hexadecimal(rows: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in rows.astype(">u2")]


def _flat(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [v.encode() for v in values]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = hexadecimal(signatures(*texts.flat(batch.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(rows, pa.string())], ["doc_id", "fingerprint"]
            )

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, fingerprint string")


def edited_neighbours(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprint each text and its edit: the second half taken from the next document.

    "Next" is by descending doc_id (null last, then a hash of the text), and the first
    follows the last.  Rows are dealt once, by ranges of doc_id; each range also gets the first
    row of the range after it, so a task reads its rows in order and holds one batch.
    """
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_text")
    ).withColumn("_tie", F.xxhash64("_text"))
    cuts = rows.agg(
        F.percentile_approx("_id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000)
    ).head()[0]
    cuts = sorted(set(cuts or []), reverse=True)
    if not cuts:
        cuts = [0]
    step = math.isqrt(len(cuts) - 1) + 1
    whole = F.array(*[F.lit(c).cast("long") for c in cuts])
    above = lambda some: F.size(F.filter(some, lambda c: F.col("_id") < c))
    coarse = above(F.array(*[F.lit(c).cast("long") for c in cuts[step - 1 :: step]]))
    fine = above(F.slice(whole, coarse * step + 1, F.lit(step)))
    bucket = F.when(F.col("_id").isNull(), F.lit(len(cuts))).otherwise(coarse * step + fine)
    rows = rows.withColumn("_bucket", bucket.cast("int"))
    first = F.min(F.struct((-F.col("_id")).isNull().alias("n"), (-F.col("_id")).alias("m"), F.col("_tie").alias("t")))
    heads = sorted(rows.groupBy("_bucket").agg(first.alias("h")).collect())  # one row per range
    halo = [
        (None if heads[(i + 1) % len(heads)]["h"]["m"] is None else -heads[(i + 1) % len(heads)]["h"]["m"],
         heads[(i + 1) % len(heads)]["h"]["t"], heads[i]["_bucket"])
        for i in range(len(heads))
    ]
    wanted = spark.createDataFrame(halo, "_hid long, _htie long, _to int")
    extra = (
        rows.join(F.broadcast(wanted), F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_tie") == F.col("_htie")))
        .select("_id", "_text", "_tie", F.col("_to").alias("_bucket"), F.lit(1).alias("_halo"))
    )
    dealt = (
        rows.withColumn("_halo", F.lit(0)).unionByName(extra)
        .repartitionByRange(max(1, len(heads)), "_bucket")
        .sortWithinPartitions("_bucket", "_halo", F.col("_id").desc_nulls_last(), "_tie")
        .select("_bucket", "_halo", "_id", "_text")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sign = signatures(*texts.flat(part.column("_text")))
                now = list(zip(*(part.column(n).to_pylist() for n in ("_bucket", "_halo", "_id", "_text")), sign, strict=True))
                chain = now if held is None else [held, *now]
                held = chain[-1]
                pairs = [(x, y) for x, y in zip(chain, chain[1:], strict=False) if x[0] == y[0] and not x[1]]
                if not pairs:
                    continue
                sizes = [len(x[3]) for x, _ in pairs]
                edits = [x[3][: n - n // 2] + y[3][: n // 2] for n, (x, y) in zip(sizes, pairs, strict=True)]
                own, after = np.stack([x[4] for x, _ in pairs]), np.stack([y[4] for _, y in pairs])
                edited = signatures(*_flat(edits))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([x[2] for x, _ in pairs], pa.int64()),
                    "n_chars": pa.array(sizes, pa.int64()),
                    "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edits],
                    "fingerprint": hexadecimal(own),
                    "edited_fingerprint": hexadecimal(edited),
                    "near_edited": (own == edited).mean(axis=1),
                    "near_next": (own == after).mean(axis=1),
                })

    return dealt.mapInArrow(
        work,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )


def _shingles(value: str | None) -> set[bytes]:
    words = (value or "").encode().split()
    if len(words) < SHINGLE_WORDS:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + SHINGLE_WORDS]) for i in range(len(words) - SHINGLE_WORDS + 1)}


def near_links(spark: SparkSession, docs: DataFrame, bands: int = 32, least: float = 0.8) -> DataFrame:
    """Links (a, b, jaccard) between fingerprint classes that share a band, Jaccard verified.

    A class is all rows of one fingerprint, named by that fingerprint.  The links join whatever the
    links among all pairs of a band join (see ``lists``); ``bands`` is the recall knob.
    """
    return _near(docs, bands, least)[0]


def _near(docs: DataFrame, bands: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(links, components) of the fingerprint classes."""
    named = fingerprint(docs).select("doc_id", "fingerprint")
    classes = store(named.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "classes")
    width = PERMUTATIONS * 4 // bands
    parts = F.array(*[F.xxhash64(F.substring("fingerprint", i * width + 1, width)) for i in range(bands)])
    keys = classes.select(F.col("fingerprint").alias("name"), F.posexplode(parts).alias("band", "key"))
    longs = [F.conv(F.substring("fingerprint", i * 16 + 1, 16), 16, -10).cast("long") for i in range(PERMUTATIONS // 4)]
    sketches = classes.select(F.col("fingerprint").alias("name"), F.array(*longs).alias("bytes"))
    body = docs.select("doc_id", "text").join(classes, "doc_id").select(F.col("fingerprint").alias("name"), "text").dropDuplicates(["name"])

    @F.udf("double")
    def jaccard(one, two):
        x, y = _shingles(one), _shingles(two)
        return len(x & y) / len(x | y) if x or y else 1.0

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(body.select(F.col("name").alias("a"), F.col("text").alias("_x")), "a").join(
            body.select(F.col("name").alias("b"), F.col("text").alias("_y")), "b"
        )
        return both.select("a", "b", jaccard("_x", "_y").alias("jaccard")).where(F.col("jaccard") >= least)

    return lists.covered(keys, ["band", "key"], sketches, verify)


def near_groups(spark: SparkSession, docs: DataFrame, bands: int = 32, least: float = 0.8) -> DataFrame:
    """doc_id, fingerprint and group (the smallest fingerprint reachable by verified links)."""
    _, groups = _near(docs, bands, least)
    return (
        fingerprint(docs).join(groups.select(F.col("node").alias("fingerprint"), "label"), "fingerprint", "left")
        .select("doc_id", "fingerprint", F.coalesce("label", "fingerprint").alias("group"))
    )
