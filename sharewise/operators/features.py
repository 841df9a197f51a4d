"""Text to numbers: term counts, vocabulary, TF-IDF and mean embeddings, all in long form.

The documents are hash-partitioned by their id once, before tokens are exploded.  Counting
terms, weighting and normalising then run inside that partitioning: the only other shuffle
is the document-frequency count, which is combined before it moves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharewise.functions import text as tx
from sharewise.plans import attach, dense_index, lookup, materialize, store
from sharewise.plans.state import BROADCAST_BYTES, BROADCAST_ROWS, measure

#: Name of the language feature; it sorts after every term, as the last column.
LANGUAGE = "\U0010ffff language"

#: Documents are dealt into partitions of about so many bytes of text, however large the corpus.
DOCUMENT_PARTITION_BYTES = 8 << 20

#: A term of a packed corpus counts as so many bytes of text.
TERM_BYTES = 12

#: Word vectors of more bytes than this are cut into tiles of about so many, ...
VECTOR_TILE_BYTES = BROADCAST_BYTES

#: ... each of which meets about so many term rows in a group.
VECTOR_TILE_ROWS = 4 << 20

#: Term rows that are sorted by group and packed together before they are sent to the tiles.
PACKED_ROWS = 1 << 19


def by_document(docs: DataFrame, size: Column, id_col: str = "doc_id") -> DataFrame:
    """``docs`` hash-partitioned by document, into as many partitions as their sizes (in bytes) ask for.

    The tokens of a text take many times its room in the hash tables and sorts that follow, so a
    task's memory hangs on the bytes dealt to it.  They are counted first, which reads ``docs`` once more.
    """
    total = docs.agg(F.sum(size)).head()[0] or 0
    spread = min(docs.sparkSession.sparkContext.defaultParallelism, 16 * total // DOCUMENT_PARTITION_BYTES)
    return docs.repartition(max(1, spread, -(-total // DOCUMENT_PARTITION_BYTES)), id_col)


def term_bytes(corpus: DataFrame) -> int:
    """The size of a packed corpus, in one aggregation."""
    return corpus.agg(F.sum(F.greatest(F.size("terms"), F.lit(0)).cast("long") * TERM_BYTES)).head()[0] or 0


def apart(rows: DataFrame, size: int, id_col: str = "doc_id") -> DataFrame:
    """``rows`` hash-partitioned by document where ``size`` (bytes) asks for more partitions than the session's shuffles have."""
    spread = -(-size // DOCUMENT_PARTITION_BYTES)
    if spread <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows
    return rows.repartition(spread, id_col)


def packed_by_document(corpus: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A packed corpus (see :func:`corpus_terms`) by document, in partitions of a bounded number of terms."""
    return by_document(corpus, F.greatest(F.size("terms"), F.lit(0)) * TERM_BYTES, id_col)


def tokenize_terms(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chars: int = 3) -> DataFrame:
    """One row per token occurrence: (id, term).  Documents without a term give no row."""
    return docs.select(id_col, F.explode(tx.terms(text, chars)).alias("term"))


def term_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chars: int = 3) -> DataFrame:
    """(id, term, tf).  Hash-partitioned by the document id."""
    placed = by_document(docs.select(id_col, text), F.octet_length(text), id_col)
    return (
        tokenize_terms(placed, id_col, text, chars)
        .groupBy(id_col, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def corpus_terms(
    docs: DataFrame,
    chars: int = 3,
    base_lang: str = "dutch",
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    distinct: bool = False,
) -> DataFrame:
    """A corpus as one row per document: (id, language, terms), terms being (term, tf) pairs.

    ``distinct`` keeps one row of a document that occurs in several pools.

    Texts are shuffled once, by document; splitting, counting and packing all happen where
    the document lands.  The table is written and shared by everything that follows, so no
    text is read twice, and a document later moves as one row.
    """
    flagged = docs.select(id_col, tx.language_flag(lang, base_lang).alias("language"), text)
    placed = by_document(flagged, F.octet_length(text), id_col)
    if distinct:
        placed = placed.dropDuplicates([id_col])
    counted = (
        placed.select(id_col, "language", F.explode_outer(tx.terms(text, chars)).alias("term"))
        .groupBy(id_col, "language", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    known = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    return store(counted.groupBy(id_col, "language").agg(F.collect_list(known).alias("terms")), "corpus")


def unfold_terms(corpus: DataFrame) -> DataFrame:
    """(everything else, term, tf): one row per term of a packed corpus."""
    return corpus.select(*[c for c in corpus.columns if c != "terms"], F.inline("terms"))


def assign_runs(corpus: DataFrame, rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Join a corpus once to ``rows`` (run_id, id, ...): adds ``runs``, all rows of a document.

    A document that many runs use is stored once, with an array no longer than the runs.
    """
    roster = rows.groupBy(id_col).agg(
        F.collect_list(F.struct(*[c for c in rows.columns if c != id_col])).alias("runs")
    )
    return store(apart(corpus, term_bytes(corpus), id_col).join(roster, id_col), "assigned")


def unfold_runs(assigned: DataFrame) -> DataFrame:
    """One row per document and run, terms still packed."""
    return assigned.select(*[c for c in assigned.columns if c != "runs"], F.inline("runs"))


def fit_vocabulary(
    tf: DataFrame, mindf: int = 50, keys: Sequence[str] = (), copies: str | None = None
) -> DataFrame:
    """Terms in at least ``mindf`` documents: (keys, term, df, idx), idx in alphabetical order.

    ``copies`` names a column with the number of times a document was drawn.
    """
    weight = F.col(copies) if copies else F.lit(1)
    frequent = (
        tf.groupBy(*keys, "term").agg(F.sum(weight).cast("long").alias("df")).where(F.col("df") >= mindf)
    )
    return dense_index(frequent, ["term"], keys).withColumn("idx", F.col("idx").cast("int"))


def fit_idf(vocab: DataFrame, n_docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``idf = ln((1 + n) / (1 + df)) + 1``; ``n_docs`` has one row (per keys) with ``n``."""
    counted = attach(vocab, n_docs, keys, ["n"])
    idf = F.ln((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    return counted.withColumn("idf", idf).drop("n")


def vocab_lookup(tf: DataFrame, vocab: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Keep the terms of a fitted vocabulary, with their index (and idf)."""
    shared = [k for k in keys if k in tf.columns]
    return lookup(tf, vocab, [*shared, "term"])


def tfidf_transform(
    tf: DataFrame, vocab: DataFrame, keys: Sequence[str] = (), id_col: str = "doc_id"
) -> DataFrame:
    """Apply a fitted vocabulary with idf: (keys, id, idx, term, w), unit length per document."""
    raw = vocab_lookup(tf, vocab, keys).withColumn("_w", (F.lit(1.0) + F.ln("tf")) * F.col("idf"))
    doc = Window.partitionBy(id_col, *keys)
    return raw.select(
        *keys, id_col, "idx", "term", (F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(doc))).alias("w")
    )


def append_language(
    weights: DataFrame,
    docs: DataFrame,
    size: int | DataFrame,
    base_lang: str = "dutch",
    id_col: str = "doc_id",
    lang: str = "lang",
) -> DataFrame:
    """Add the language flag as one more feature after the last term, not normalised.

    ``size`` is the vocabulary size, or a one-row table with the column ``v``.  A zero flag
    gives no row, as in any sparse vector.
    """
    flag = docs.select(id_col, tx.language_flag(lang, base_lang).alias("w")).where(F.col("w") != 0)
    if isinstance(size, DataFrame):
        flag = attach(flag, size, (), ["v"])
    else:
        flag = flag.withColumn("v", F.lit(size))
    return weights.unionByName(
        flag.select(id_col, F.col("v").cast("int").alias("idx"), F.lit(LANGUAGE).alias("term"), "w")
    )


def count_documents(docs: DataFrame, keys: Sequence[str] = (), copies: str | None = None) -> DataFrame:
    """``n`` documents (per keys), counting copies."""
    weight = F.col(copies) if copies else F.lit(1)
    return docs.groupBy(*keys).agg(F.sum(weight).cast("long").alias("n"))


def fit_vectorizer(tf: DataFrame, docs: DataFrame, mindf: int = 50) -> DataFrame:
    """Vocabulary with idf, materialised: the fitted state of the text pipeline."""
    return materialize(fit_idf(fit_vocabulary(tf, mindf), count_documents(docs)))


def vectorize(
    docs: DataFrame,
    vocab: DataFrame | None = None,
    chars: int = 3,
    mindf: int = 50,
    base_lang: str = "dutch",
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """Documents to sparse long features with the language flag; returns (features, vocabulary).

    Give a fitted ``vocab`` to transform new documents with it.
    """
    if vocab is None:
        corpus = corpus_terms(docs, chars, base_lang, id_col, text, lang)
        vocab = fit_vectorizer(unfold_terms(corpus), docs, mindf)
        tf = unfold_terms(packed_by_document(corpus, id_col))
    else:
        tf = term_counts(docs, id_col, text, chars)
    features = tfidf_transform(tf, vocab, (), id_col)
    return append_language(features, docs, vocab.count(), base_lang, id_col, lang), vocab


def doc_feature_sets(
    tf: DataFrame, docs: DataFrame, mindf: int = 1, base_lang: str = "dutch", id_col: str = "doc_id", lang: str = "lang"
) -> DataFrame:
    """(id, term): the active terms under the set's own vocabulary; '' is an active language flag."""
    active = tf.select(id_col, "term")
    if mindf > 1:
        own = materialize(fit_vocabulary(tf, mindf))
        active = vocab_lookup(active, own.select("term"))
    flag = docs.where(tx.language_flag(lang, base_lang) != 0).select(id_col, F.lit("").alias("term"))
    return active.unionByName(flag)


def embedding_lookup(tf: DataFrame, vectors: DataFrame) -> DataFrame:
    """Terms with their word vector; words without one are dropped."""
    return lookup(tf, vectors, ["term"])


def _packed_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_group, rows): the rows of every group as compressed Arrow streams of many rows each."""

    def sent(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        group = table.column("_group").to_numpy()
        order = np.argsort(group, kind="stable")
        table, group = table.drop_columns(["_group"]).take(order).combine_chunks(), group[order]
        heads = np.flatnonzero(np.diff(group, prepend=-1))
        for at, to in zip(heads, [*heads[1:], len(group)]):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(table.slice(at, to - at))
            yield pa.record_batch([pa.array([group[at]], pa.int64()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["_group", "rows"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACKED_ROWS:
            yield from sent(held)
            held, n = [], 0
    if n:
        yield from sent(held)


def _means_by_tile(tf: DataFrame, vectors: DataFrame, tiles: int, id_col: str) -> DataFrame:
    """(id, _m): the mean vector of the known words, without moving a vector for every term of a document.

    Terms are dealt into ``tiles``, documents into blocks.  A group holds the vectors of one tile and the term rows of one
    block in it, and sends one sum of vectors for each of its documents: at most ``tiles`` rows a document are shuffled.
    The term rows go there packed and compressed.
    """
    blocks = max(-(-tf.count() // (VECTOR_TILE_ROWS * tiles)), -(-tf.sparkSession.sparkContext.defaultParallelism // tiles))
    tile = F.pmod(F.xxhash64("term"), F.lit(tiles))
    rows = tf.select((tile * blocks + F.pmod(F.xxhash64(id_col), F.lit(blocks))).cast("long").alias("_group"), F.col(id_col).alias("_id"), "term", F.col("tf").cast("double").alias("_w"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    words = vectors.select("term", "vec", tile.alias("_tile"), each.alias("_b")).select((F.col("_tile") * blocks + F.col("_b")).cast("long").alias("_group"), "term", "vec")
    kind = tf.schema[id_col].dataType.simpleString()
    none = rows.drop("_group").limit(0).toArrow().schema

    def sums(parts: pa.Table, words: pa.Table) -> pa.Table:
        rows = pa.concat_tables([none.empty_table(), *(pa.ipc.open_stream(x.as_py()).read_all().cast(none) for x in parts.column("rows"))])
        terms = words.column("term").combine_chunks().dictionary_encode()
        terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
        place = pa.compute.index_in(rows.column("term"), value_set=terms.dictionary, skip_nulls=True)
        hit = place.is_valid()
        rows, place = rows.filter(hit), place.filter(hit).to_numpy()
        ids = rows.column("_id").combine_chunks().dictionary_encode()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        if not len(rows):
            return pa.table({"_id": ids.dictionary, "_sum": pa.array([], pa.list_(pa.float64())), "_n": pa.array([], pa.float64())})
        vec = words.column("vec").combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        flat, width = vec.flatten(), len(vec[0])
        if flat.null_count or vec.null_count or (np.diff(vec.offsets.to_numpy()) != width).any():
            raise ValueError("word vectors must have one length and no nulls")
        # A term may have several vectors; the one past the last term stands for null.
        term = pa.compute.fill_null(terms.indices, len(terms.dictionary)).to_numpy()
        matrix = np.zeros((len(terms.dictionary) + 1, width))
        np.add.at(matrix, term, flat.to_numpy().reshape(len(vec), width))
        times = np.bincount(term, minlength=len(matrix))
        own = pa.compute.fill_null(ids.indices, len(ids.dictionary)).to_numpy()
        weight = rows.column("_w").to_numpy()
        order = np.argsort(own, kind="stable")
        total, n = np.zeros((len(ids.dictionary) + 1, width)), np.bincount(own, weight * times[place], len(ids.dictionary) + 1)
        for at in range(0, len(order), 1 << 15):
            some = order[at : at + (1 << 15)]
            heads = np.flatnonzero(np.diff(own[some], prepend=-1))
            total[own[some[heads]]] += np.add.reduceat(matrix[place[some]] * weight[some, None], heads, axis=0)
        kept = len(ids.dictionary)
        offsets = pa.array(np.arange(kept + 1) * width, pa.int32())
        return pa.table({"_id": ids.dictionary, "_sum": pa.ListArray.from_arrays(offsets, pa.array(total[:kept].ravel())), "_n": pa.array(n[:kept])})

    rows = rows.mapInArrow(_packed_groups, "_group long, rows binary")
    parts = rows.groupBy("_group").cogroup(words.groupBy("_group")).applyInArrow(sums, f"_id {kind}, _sum array<double>, _n double")
    # At most one row a tile.
    every = parts.groupBy(F.col("_id").alias(id_col)).agg(F.collect_list(F.struct("_sum", "_n")).alias("_parts"))
    n = F.aggregate("_parts", F.lit(0.0), lambda acc, x: acc + x["_n"])
    whole = F.aggregate(
        F.slice("_parts", 2, F.lit(tiles)), F.col("_parts")[0]["_sum"], lambda acc, x: F.zip_with(acc, x["_sum"], lambda a, b: a + b)
    )
    return every.select(id_col, F.transform(whole, lambda v: v / n).alias("_m"))


def mean_embedding(tf: DataFrame, docs: DataFrame, vectors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, embedding): mean vector of the known words, repeats counted; zeros if none is known.

    The mean is MLlib's vector aggregate, combined before the shuffle: no dimension is exploded.  Vectors too large to
    broadcast are cut into tiles instead, see :func:`_means_by_tile`.
    """
    size, held = measure(vectors)
    if size <= BROADCAST_ROWS and held <= VECTOR_TILE_BYTES:
        known = embedding_lookup(tf, vectors).select(
            id_col, array_to_vector(F.col("vec").cast("array<double>")).alias("_v"), F.col("tf").cast("double").alias("_w")
        )
        means = known.groupBy(id_col).agg(vector_to_array(Summarizer.mean(F.col("_v"), F.col("_w"))).alias("_m"))
    else:
        means = _means_by_tile(tf, vectors, -(-held // VECTOR_TILE_BYTES), id_col)
    width = vectors.agg(F.max(F.size("vec")).alias("dim"))
    zeros = F.array_repeat(F.lit(0.0), F.coalesce(F.col("dim"), F.lit(0)))
    joined = attach(docs.select(id_col).join(means, id_col, "left"), width, (), ["dim"])
    return joined.select(id_col, F.coalesce("_m", zeros).alias("embedding"))
