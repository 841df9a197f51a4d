"""Registered queries: text features, word vectors, linear scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharewise.functions import text as tx
from sharewise.functions.hashing import hash32
from sharewise.operators import features as ft
from sharewise.operators import models as md
from sharewise.plans import store
from sharewise.suite.common import (
    BASE_LANG, LABELLED_SQL, MINDF, R, TOKENS_SQL, VOCAB_SQL, WORD_SQL,
    documents, hash_sql, query, r6, table,
)


def corpus_tf(spark, sf_dir):
    """Term counts of all documents, read from the written, packed corpus."""
    return ft.unfold_terms(ft.corpus_terms(documents(spark, sf_dir)))


def corpus_vocab(spark, sf_dir, tf):
    return ft.fit_vectorizer(tf, documents(spark, sf_dir), MINDF)


@query("tokenize_terms", f"WITH {TOKENS_SQL} SELECT doc_id, term FROM tokens")
def tokenize_terms(spark, sf_dir):
    return ft.tokenize_terms(documents(spark, sf_dir))


@query("term_counts", f"WITH {TOKENS_SQL} SELECT doc_id, term, tf FROM tf")
def term_counts(spark, sf_dir):
    return ft.term_counts(documents(spark, sf_dir))


@query("fit_vocabulary", f"WITH {VOCAB_SQL} SELECT term, df, idx FROM vocab")
def fit_vocabulary(spark, sf_dir):
    return ft.fit_vocabulary(ft.term_counts(documents(spark, sf_dir)), MINDF)


@query("fit_idf", f"WITH {VOCAB_SQL} SELECT term, df, idx, {R('idf')} AS idf FROM vocab")
def fit_idf(spark, sf_dir):
    docs = documents(spark, sf_dir)
    vocab = ft.fit_vocabulary(ft.term_counts(docs), MINDF)
    return r6(ft.fit_idf(vocab, ft.count_documents(docs)))


_WEIGHTS = f"""{VOCAB_SQL},
raw AS (SELECT doc_id, idx, term, (1 + ln(tf)) * idf AS w0 FROM tf JOIN vocab USING (term)),
weights AS (SELECT doc_id, idx, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id)) AS w FROM raw)"""


@query("tfidf", f"WITH {_WEIGHTS} SELECT doc_id, idx, term, {R('w')} AS w FROM weights")
def tfidf(spark, sf_dir):
    corpus = ft.corpus_terms(documents(spark, sf_dir))
    vocab = corpus_vocab(spark, sf_dir, ft.unfold_terms(corpus))
    return r6(ft.tfidf_transform(ft.unfold_terms(ft.packed_by_document(corpus)), vocab))


@query(
    "tfidf_transform",
    f"""WITH {LABELLED_SQL}, {TOKENS_SQL},
known AS (SELECT term, ln((1.0 + (SELECT count(*) FROM labelled)) / (1.0 + df)) + 1.0 AS idf,
                 CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx
          FROM (SELECT term, count(*) AS df FROM tf SEMI JOIN labelled USING (doc_id) GROUP BY term HAVING count(*) >= {MINDF}) kept),
raw AS (SELECT doc_id, idx, term, (1 + ln(tf)) * idf AS w0 FROM tf ANTI JOIN labelled USING (doc_id) JOIN known USING (term))
SELECT doc_id, idx, term, {R('w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id))')} AS w FROM raw""",
)
def tfidf_transform(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id")
    docs = documents(spark, sf_dir)
    known = docs.join(labels, "doc_id", "left_semi")
    vocab = ft.fit_vectorizer(ft.term_counts(known), known, MINDF)
    fresh = ft.term_counts(docs.join(labels, "doc_id", "left_anti"))
    return r6(ft.tfidf_transform(fresh, vocab))


@query("vocab_lookup", f"WITH {VOCAB_SQL} SELECT doc_id, term, tf, idx FROM tf JOIN vocab USING (term)")
def vocab_lookup(spark, sf_dir):
    tf = corpus_tf(spark, sf_dir)
    return ft.vocab_lookup(tf, corpus_vocab(spark, sf_dir, tf)).select("doc_id", "term", "tf", "idx")


_LANG_ROWS = f"SELECT doc_id, (SELECT CAST(count(*) AS INTEGER) FROM vocab) AS idx, CAST(1 AS DOUBLE) AS w FROM documents WHERE lang <> '{BASE_LANG}'"


@query("append_language", f"WITH {_WEIGHTS} SELECT doc_id, idx, {R('w')} AS w FROM weights UNION ALL {_LANG_ROWS}")
def append_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    tf = corpus_tf(spark, sf_dir)
    vocab = corpus_vocab(spark, sf_dir, tf)
    every = ft.append_language(ft.tfidf_transform(tf, vocab), docs, vocab.count(), BASE_LANG)
    return r6(every.select("doc_id", "idx", "w"))


@query("vectorize_pipeline", f"WITH {_WEIGHTS} SELECT doc_id, idx, {R('w')} AS w FROM weights UNION ALL {_LANG_ROWS}")
def vectorize_pipeline(spark, sf_dir):
    features, _ = ft.vectorize(documents(spark, sf_dir), mindf=MINDF, base_lang=BASE_LANG)
    return r6(features.select("doc_id", "idx", "w"))


@query(
    "doc_feature_sets",
    f"""WITH {VOCAB_SQL} SELECT doc_id, term FROM tf SEMI JOIN vocab USING (term)
UNION ALL SELECT doc_id, '' FROM documents WHERE lang <> '{BASE_LANG}'""",
)
def doc_feature_sets(spark, sf_dir):
    return ft.doc_feature_sets(corpus_tf(spark, sf_dir), documents(spark, sf_dir), MINDF, BASE_LANG)


# Word vectors: every word of the vocabulary gets the vector its hash names.
_VECTORS = f"""{VOCAB_SQL}, vectors AS (SELECT term, vec_id, embedding AS vec FROM vocab
            JOIN embeddings ON vec_id = {hash_sql('vector', 'term')} % (SELECT count(*) FROM embeddings))"""


def word_vectors(spark, sf_dir, tf):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    words = corpus_vocab(spark, sf_dir, tf).withColumn("vec_id", hash32("vector", "term") % vectors.count())
    return store(words.join(vectors, "vec_id").select("term", "vec_id", "vec"), "vectors")


@query(
    "embedding_lookup",
    f"WITH {_VECTORS} SELECT doc_id, term, tf, vec_id, CAST(len(vec) AS INTEGER) AS dim FROM tf JOIN vectors USING (term)",
)
def embedding_lookup(spark, sf_dir):
    tf = corpus_tf(spark, sf_dir)
    hit = ft.embedding_lookup(tf, word_vectors(spark, sf_dir, tf))
    return hit.select("doc_id", "term", "tf", "vec_id", F.size("vec").alias("dim"))


@query(
    "mean_embedding",
    f"""WITH {_VECTORS},
parts AS (SELECT doc_id, tf, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM tf JOIN vectors USING (term)),
means AS (SELECT doc_id, pos, sum(tf * CAST(x AS DOUBLE)) / sum(tf) AS value FROM parts GROUP BY 1, 2)
SELECT doc_id, CAST(g.pos AS INTEGER) AS pos, {R('coalesce(value, 0)')} AS value
FROM (SELECT doc_id, unnest(range(0, (SELECT max(len(vec)) FROM vectors))) AS pos FROM documents) g LEFT JOIN means USING (doc_id, pos)""",
)
def mean_embedding(spark, sf_dir):
    tf = corpus_tf(spark, sf_dir)
    means = ft.mean_embedding(tf, documents(spark, sf_dir), word_vectors(spark, sf_dir, tf))
    return r6(means.select("doc_id", F.posexplode("embedding").alias("pos", "value")))


# A coefficient per vocabulary term, drawn from the term's hash, and a fixed head.
_COEF = f"({hash_sql('coef', 'term')} / CAST(4294967296 AS DOUBLE) - 0.5) * 4"
_HEAD = (-0.25, 0.75)


def given_model(spark, sf_dir, tf):
    vocab = corpus_vocab(spark, sf_dir, tf)
    return store(vocab.withColumn("coef", (hash32("coef", "term") / F.lit(2.0**32) - 0.5) * 4), "model")


@query(
    "score_linear",
    f"""WITH {_WEIGHTS},
dots AS (SELECT doc_id, sum(w * {_COEF}) AS dot FROM weights GROUP BY 1)
SELECT doc_id, {R(f"1 / (1 + exp(-(coalesce(dot, 0) + {_HEAD[0]} + CASE WHEN lang <> '{BASE_LANG}' THEN {_HEAD[1]} ELSE 0 END)))")} AS p
FROM documents LEFT JOIN dots USING (doc_id)""",
)
def score_linear(spark, sf_dir):
    tf = corpus_tf(spark, sf_dir)
    docs = documents(spark, sf_dir).select("doc_id", tx.language_flag("lang", BASE_LANG).alias("language"))
    heads = spark.createDataFrame([_HEAD], "intercept double, language_coef double")
    model = given_model(spark, sf_dir, tf).select("term", "idf", "coef")
    return r6(md.score_linear(tf, docs, model, heads).select("doc_id", "p"))


@query(
    "top_features",
    f"""WITH {VOCAB_SQL}, coefs AS (SELECT term, {_COEF} AS coef FROM vocab)
SELECT 'positive' AS side, term, {R('coef')} AS coef FROM (SELECT * FROM coefs ORDER BY coefs.coef DESC, term LIMIT 20) a
UNION ALL SELECT 'negative', term, {R('coef')} FROM (SELECT * FROM coefs ORDER BY coefs.coef, term LIMIT 20) b""",
)
def top_features(spark, sf_dir):
    tf = corpus_tf(spark, sf_dir)
    return r6(md.top_features(given_model(spark, sf_dir, tf).select("term", "coef"), 20))
